"""Subtitle files: reading lines and parsing events.

Lines are rows `project_id, chapter_file, line_no, line`; `line_no` is anything that sorts in line order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe.functions import text as T
from storyframe.functions.timecode import ass_seconds
from storyframe.operators.skew import join_hot, largest_group, numbered
from storyframe.session import measured

FILE_KEY = ["project_id", "chapter_file"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `<path>/<project>/<chapter>.ass`; large files are read by several tasks.

    A line is placed by the start of its file block and its turn within the block, since no task sees a whole file.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.ass").text(path)
    located = lines.select(
        F.col("value").alias("line"), T.plain_path(F.col("_metadata.file_path")).alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("turn")).alias("line_no"),
    )
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return located.select(folder.alias("project_id"), T.file_name(F.col("path")).alias("chapter_file"), "line_no",
                          "line")


def parse_events(lines: DataFrame, at_most: int | None = None) -> DataFrame:
    """Dialogue and caption rows of the events section of each file.

    The section opens after the first `[events]` line and ends for good at the next line that starts with `[`
    and is no such header. Events need ten fields; the text, the last one, may hold commas. `at_most` bounds the lines
    of a file.
    """
    top = largest_group(lines, FILE_KEY) if at_most is None else at_most
    stripped = lines.withColumn("line", T.strip(F.col("line")))
    mark = "dialogue:"
    events = stripped.filter(F.lower(F.left("line", F.lit(len(mark)))) == mark)
    body = T.strip(F.substring("line", len(mark) + 1, 2**31 - 1))
    inside = join_hot(events, _sections(stripped, top), FILE_KEY, left_at_most=top, right_at_most=1).filter(
        (F.col("line_no") > F.col("opened")) & (F.col("closed").isNull() | (F.col("line_no") < F.col("closed"))))
    fields = inside.withColumn("f", F.split(body, ",", 10)).filter(F.size("f") == 10)
    kind = F.when(F.upper(_field(4)) == "CAPTION", F.lit("caption")).otherwise(F.lit("dialogue"))
    return fields.select(
        *FILE_KEY, "line_no", kind.alias("kind"),
        _field(1).alias("start_time_raw"), _field(2).alias("end_time_raw"),
        F.when(kind == "dialogue", _field(4)).alias("speaker"),
        T.line_breaks(_field(9)).alias("content"),
    )


def timed_events(events: DataFrame) -> DataFrame:
    """Add the times in seconds; null where a time cannot be read."""
    return events.withColumns({"start_seconds": ass_seconds(F.col("start_time_raw")),
                               "end_seconds": ass_seconds(F.col("end_time_raw"))})


def with_file_chapter(events: DataFrame) -> DataFrame:
    """Keep events of files named `{chapter:02d}.ass` and add the chapter."""
    chapter = F.regexp_extract("chapter_file", r"^([0-9]+)\.ass$", 1).try_cast("bigint")
    found = events.withColumn("chapter_id", chapter)
    return found.filter(F.col("chapter_file") == T.subtitle_file(F.col("chapter_id")))


def renumbered(assets: DataFrame, at_most: int | None = None) -> DataFrame:
    """Chapter file of each episode by its position within its work.

    Episodes without a subtitle file count too, but get no chapter file. `assets` has `media_id`, `asset_id`,
    `sequence_number` and `l1_output_file`. `at_most` bounds the episodes of a work.
    """
    ranked = numbered(assets, ["media_id"], ["sequence_number", "asset_id"], "position", at_most)
    given = F.coalesce("l1_output_file", F.lit("")) != ""
    return ranked.withColumn("chapter_file", F.when(given, T.subtitle_file(F.col("position"))))


def _sections(stripped: DataFrame, top: int) -> DataFrame:
    """Where the events section of each file opens and closes; files without one are left out.

    The headers are written once, so that the lines are not read for each of the two.
    """
    headers = measured(stripped.filter(F.col("line").startswith("[")).select(
        *FILE_KEY, "line_no", (F.lower("line") == "[events]").alias("is_events")), "headers")
    opened = headers.filter("is_events").groupBy(*FILE_KEY).agg(F.min("line_no").alias("opened"))
    closers = join_hot(headers.filter("NOT is_events"), opened, FILE_KEY, left_at_most=top, right_at_most=1) \
        .filter("line_no > opened")
    closed = closers.groupBy(*FILE_KEY).agg(F.min("line_no").alias("closed"))
    return opened.join(closed, FILE_KEY, "left")


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))
