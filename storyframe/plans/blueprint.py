"""Scripts of catalogued works: from episodes, their annotation texts and their finished subtitles."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.functions import text as T
from storyframe.operators.skew import join_hot, largest_group
from storyframe.plans import script
from storyframe.session import measured
from storyframe.sources import annotations as A
from storyframe.sources import subtitles as S


@dataclass(frozen=True)
class Blueprint:
    script: script.Script
    skipped: DataFrame
    """Episodes left out because they have no annotation text."""
    mismatches: DataFrame
    """Episodes whose subtitles and scenes end up in different chapters."""


def blueprint(assets: DataFrame, annotations: DataFrame, lines: DataFrame,
              generated_at: datetime | str | None = None) -> Blueprint:
    """Scripts with one project per work.

    `assets` has `asset_id, media_id, sequence_number, l1_output_file`, `annotations` has `asset_id, body`, and
    `lines` has `path, line_no, line`. Subtitles get their chapter from the position of the episode in its work,
    scenes from the number in the name of the annotated file; the two may disagree.
    """
    episodes = largest_group(assets, ["media_id"])
    tasks, skipped = A.merged_tasks(assets, annotations, at_most=episodes)
    tasks = measured(tasks, "tasks")
    chapters = measured(S.renumbered(assets, at_most=episodes).select(
        "media_id", "asset_id", "position", "chapter_file", "l1_output_file"), "chapters")
    files = chapters.filter("chapter_file IS NOT NULL").select(
        F.col("media_id").alias("project_id"), "chapter_file", F.col("l1_output_file").alias("path"))
    # A chapter has one path, hence no more lines than its path.
    top = largest_group(lines, ["path"])
    staged = measured(join_hot(lines, files, ["path"], left_at_most=top).select(
        "project_id", "chapter_file", "line_no", "line"), "lines")
    return Blueprint(script.build(tasks, staged, generated_at, lines_at_most=top), skipped, mismatches(chapters, annotations))


def mismatches(chapters: DataFrame, annotations: DataFrame) -> DataFrame:
    """`asset_id, position, chapter_id` where the position of an episode is not the number in its file name."""
    upload = F.get_json_object("body", "$.file_upload")
    named = annotations.select("asset_id", T.chapter_number(upload).alias("chapter_id"))
    return chapters.join(named, "asset_id").filter("position <> chapter_id").select(
        "asset_id", "position", "chapter_id")
