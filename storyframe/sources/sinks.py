"""Sinks: scripts and labelling tasks as JSON Lines.

Lines name their project or work, and lie in a fixed number of folders by its hash, so the number of folders does not grow
with the number of projects, and those of one project are read from one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe.functions.text import json_text

FOLDERS = 256


def write_script_parts(parts: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """One JSON line per part of a script."""
    line = F.concat(
        F.lit('{"project_id":'), json_text(F.col("project_id")), F.lit(',"section":"'), F.col("section"),
        F.lit('","item":'), json_text(F.col("item")), F.lit(',"part":'), F.col("part").cast("string"),
        F.lit(',"body":'), F.col("body"), F.lit("}"))
    _write(parts, line, "project_id", path, folders)


def write_documents(fragments: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """One JSON line per fragment `project_id, position, text` of a document."""
    _write(fragments, F.to_json(F.struct("project_id", "position", "text")), "project_id", path, folders)


def read_documents(spark: SparkSession, path: str, project_id: str | None = None, folders: int = FOLDERS) -> DataFrame:
    """The fragments that `write_documents` wrote; those of one project are looked for in its folder only."""
    rows = spark.read.schema("value string, folder int").text(path)
    if project_id is not None:
        rows = rows.filter(F.col("folder") == _folder(F.lit(str(project_id)), folders))
    found = rows.select(F.from_json("value", "project_id string, position bigint, text string").alias("f")).select("f.*")
    return found if project_id is None else found.filter(F.col("project_id") == str(project_id))


def task_manifest(assets: DataFrame) -> DataFrame:
    """Labelling task and new state of every episode that has a video link."""
    url = F.col("processed_video_url")
    payload = F.to_json(F.struct(F.struct(url.alias("video_url")).alias("data")))
    return assets.filter(F.coalesce(url, F.lit("")) != "").select(
        "asset_id", "media_id", payload.alias("payload"), F.lit("in_progress").alias("l2_l3_status"))


def write_manifest(manifest: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """One JSON line per labelling task, with the episode and the work it belongs to."""
    line = F.concat(F.lit('{"asset_id":'), json_text(F.col("asset_id").cast("string")), F.lit(',"media_id":'),
                    json_text(F.col("media_id").cast("string")), F.lit(',"task":'), F.col("payload"), F.lit("}"))
    _write(manifest, line, "media_id", path, folders)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """`asset_id, media_id, payload` of the tasks that `write_manifest` wrote, ids as text."""
    rows = spark.read.schema("value string, folder int").text(path)
    task = F.from_json("value", "asset_id string, media_id string, task string")
    return rows.select(task.alias("t")).select("t.asset_id", "t.media_id", F.col("t.task").alias("payload"))


def _folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(folders)).cast("int")


def _write(rows: DataFrame, line: Column, key: str, path: str, folders: int) -> None:
    lines = rows.select(_folder(F.col(key), folders).alias("folder"), line.alias("value"))
    # Rebalancing keeps the files of a folder together, yet splits a folder that is far larger than the others.
    lines.hint("rebalance", "folder").write.mode("overwrite").partitionBy("folder").text(path)
