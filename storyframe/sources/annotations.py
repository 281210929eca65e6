"""Annotation exports: one JSON array of tasks per project, or one task per line or file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe import schemas as S
from storyframe.functions import text as T
from storyframe.operators.skew import join_hot, largest_group, numbered
from storyframe.sources import arrays


def read_exports(spark: SparkSession, path: str, block_bytes: int = arrays.BLOCK_BYTES) -> DataFrame:
    """Tasks of `<path>/<project>.json` files that each hold one JSON array, read in blocks of `block_bytes`.

    A file whose root is no array holds no tasks.
    """
    found = arrays.elements(spark, path, "*.json", block_bytes)
    name = T.file_stem(T.file_name(F.col("path")))
    return parse_tasks(found.select(name.alias("project_id"), F.col("position").alias("task_pos"), "body"), F.col("body"))


def read_task_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of `<path>/<project>.jsonl` files with one task per line; large files are read by several tasks."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    name = T.file_name(T.plain_path(F.col("_metadata.file_path")))
    located = lines.filter(F.trim("value") != "").select(
        F.regexp_replace(name, r"\.jsonl$", "").alias("project_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("turn")).alias("task_pos"),
        "value")
    return parse_tasks(located, F.col("value"))


def parse_tasks(rows: DataFrame, body: Column) -> DataFrame:
    """Tasks from rows `project_id, task_pos` with the JSON text of one task each."""
    task = F.from_json(body, S.TASK)
    return rows.withColumn("__task", task).withColumn("corrupt", F.when(_broken("__task"), body)).select(
        "project_id", "task_pos", "__task.inner_id", "__task.file_upload", "__task.annotations", "corrupt")


def merged_tasks(assets: DataFrame, bodies: DataFrame, at_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One list of tasks per work from one JSON text per episode, in sequence order.

    `assets` has `media_id`, `asset_id` and `sequence_number`; `bodies` has `asset_id` and `body`. The second
    frame lists the episodes that were skipped because they have no text. `at_most` bounds the episodes of a work.
    """
    top = largest_group(assets, ["media_id"]) if at_most is None else at_most
    joined = join_hot(assets, bodies, ["asset_id"], "left", left_at_most=1)
    given = F.coalesce("body", F.lit("")) != ""
    ranked = numbered(joined.filter(given), ["media_id"], ["sequence_number", "asset_id"], "task_pos", top)
    rows = ranked.select(F.col("media_id").alias("project_id"), "task_pos", "body")
    skipped = joined.filter(~given).select("media_id", "asset_id", F.lit("missing_annotation").alias("reason"))
    return parse_tasks(rows, F.col("body")), skipped


def most_results(tasks: DataFrame) -> tuple[int, int]:
    """The most results of tasks with one position in a project, and of a project; a task without any counts as one."""
    rows = F.greatest(F.coalesce(F.size(F.get("annotations", F.lit(0))["result"]), F.lit(1)), F.lit(1))
    placed = tasks.groupBy("project_id", "task_pos").agg(F.sum(rows).alias("n"))
    per_project = placed.groupBy("project_id").agg(F.max("n").alias("one"), F.sum("n").alias("all"))
    found = per_project.agg(F.max("one"), F.max("all")).first()
    return found[0] or 0, found[1] or 0


def results(tasks: DataFrame) -> DataFrame:
    """Results of the first annotation of each task; a task without results stays as one row of nulls."""
    first = F.get("annotations", F.lit(0))["result"]
    return tasks.select(
        "project_id", "task_pos", "inner_id", "file_upload", F.posexplode_outer(first).alias("result_pos", "r"),
    ).select(
        "project_id", "task_pos", "inner_id", "file_upload", F.col("result_pos").cast("long").alias("result_pos"),
        F.col("r.id").alias("region_id"), F.col("r.from_name").alias("from_name"), F.col("r.value").alias("value_json"))


def subtitle_chapters(tasks: DataFrame) -> DataFrame:
    """Chapters whose subtitle file is read: some task spells the number as the file name does."""
    digits = T.chapter_digits(F.col("file_upload"))
    spelled = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    chapter = T.chapter_number(F.col("file_upload"))
    return tasks.filter(spelled == T.pad2(chapter)).select("project_id", chapter.alias("chapter_id")).distinct()


def _broken(task: str) -> Column:
    return F.col(task).isNull() | (F.col(f"{task}.file_upload").isNull() & F.col(f"{task}.annotations").isNull())
