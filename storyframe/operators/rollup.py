"""Chapters and project totals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe import schemas as S
from storyframe.functions import text as T
from storyframe.functions.timecode import iso_utc
from storyframe.operators.children import PART_ROWS, listed
from storyframe.operators.skew import numbered


def chapters(scenes: DataFrame, size: int = PART_ROWS, at_most: int | None = None) -> DataFrame:
    """One row per chapter with its scene ids in order; chapters of more than `size` scenes take several parts.

    `at_most` bounds the scenes of a chapter.
    """
    ranked = numbered(scenes.select("project_id", "chapter_id", "scene_id"), ["project_id", "chapter_id"],
                      ["scene_id"], "ordinal", at_most)
    chapter = F.col("chapter_id")
    return listed(ranked, ["project_id", "chapter_id"], "ordinal", "scene_id", "scene_ids", size).select(
        "project_id", "chapter_id", "part",
        T.numbered_name("Chapter", chapter).alias("name"),
        T.numbered_name("Chapter", chapter, " ").alias("textual"),
        T.subtitle_file(chapter).alias("source_file"),
        "scene_ids",
    )


def project_totals(scenes: DataFrame, generated_at: datetime | str | None = None) -> DataFrame:
    """Counts of chapters and scenes per project, with the version and time of generation.

    Scenes are first counted per chapter, so the distinct chapters need no second pass over the scenes.
    """
    stamp = F.current_timestamp() if generated_at is None else F.lit(generated_at).cast("timestamp")
    per_chapter = scenes.groupBy("project_id", "chapter_id").agg(F.count(F.lit(1)).alias("n"))
    return per_chapter.groupBy("project_id").agg(
        F.count("chapter_id").alias("total_chapters"), F.sum("n").alias("total_scenes"),
    ).select(
        F.col("project_id"), F.col("project_id").cast("string").alias("project_name"),
        "total_chapters", "total_scenes", F.lit(S.SCRIPT_VERSION).alias("version"),
        iso_utc(stamp).alias("generation_date"),
    )
