"""Rows the engine sets aside, with the reason.

Where one bad value would stop a whole project, its row is listed here and the rest goes on. `fail_fast` stops
the job instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe import schemas as S
from storyframe.operators.regions import flattened
from storyframe.operators.timeline import LIST_KEY, gaps


def task_rejects(tasks: DataFrame) -> DataFrame:
    """Tasks that cannot be read, name no file or have an empty list of annotations."""
    return _flag(tasks, "task", F.col("task_pos").cast("string"), {
        "unreadable_task": F.col("corrupt").isNotNull(),
        "no_file_upload": F.col("file_upload").isNull(),
        "no_annotations": F.size("annotations") == 0,
    })


def result_rejects(results: DataFrame) -> DataFrame:
    """Results whose value is an empty list where a first element is taken, or no object at all."""
    rows = flattened(results)
    flat, label = F.col("from_name").isin(S.FLAT_ATTRIBUTES), F.col("from_name") == "region_type"
    item = F.concat_ws("/", F.col("task_pos").cast("string"), F.col("result_pos").cast("string"))
    return _flag(rows, "result", item, {
        "not_an_object": ~F.trim("value_json").startswith("{"),
        "empty_choices": flat & (F.size("parsed.choices") == 0),
        "empty_text": flat & (F.size("parsed.text") == 0),
        "empty_labels": label & (F.size("parsed.labels") == 0),
    })


def event_rejects(events: DataFrame) -> DataFrame:
    """Subtitle events with a time that is no number."""
    item = F.concat_ws("/", "chapter_file", F.col("line_no").cast("string"))
    return _flag(events, "subtitle", item, {
        "bad_start_time": F.col("start_seconds").isNull(),
        "bad_end_time": F.col("end_seconds").isNull(),
    })


def insert_rejects(timeline_input: DataFrame, keys: list[str] = LIST_KEY) -> DataFrame:
    """Inserted scenes whose empty rank would be compared with a value."""
    return _flag(gaps(timeline_input, keys), "scene", F.col("scene_id").cast("string"),
                 {"incomplete_insert": F.col("compared")})


def fail_fast(rejects: DataFrame) -> None:
    """Raise on the first reject."""
    first = rejects.head(1)
    if first:
        raise ValueError(f"rejected input: {first[0].asDict()}")


def _flag(rows: DataFrame, source: str, item: Column, checks: dict[str, Column]) -> DataFrame:
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in checks.items()])
    return rows.select(F.col("project_id").cast("string").alias("project_id"), F.lit(source).alias("source"),
                       item.alias("item"), reason.alias("reason")).filter("reason IS NOT NULL")
