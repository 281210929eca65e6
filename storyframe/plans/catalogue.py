"""Listing, search and link columns of the catalogue.

Works have `media_id, title, media_type, ingestion_status, annotation_project_id`; episodes have `asset_id,
media_id, title, sequence_number`, their states, links and `annotation_task_id`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.functions import links as K
from storyframe.functions import text as T
from storyframe.operators.skew import join_hot, numbered


def with_media(assets: DataFrame, media: DataFrame) -> DataFrame:
    """Episodes with the title and annotation project of their work; a hot work is split over tasks."""
    works = media.select("media_id", F.col("title").alias("media_title"), "annotation_project_id",
                         *[c for c in ("created_at",) if c in media.columns])
    return join_hot(assets, works, ["media_id"], right_at_most=1)


def media_listing(media: DataFrame) -> DataFrame:
    """Works, the newest first, with their `position`."""
    newest = media.withColumn("__age", -F.unix_micros(F.col("created_at").cast("timestamp")))
    return numbered(newest, [], ["__age", "media_id"], "position").drop("__age")


def asset_listing(assets: DataFrame, media: DataFrame) -> DataFrame:
    """Episodes in the order of their works, the newest first, then by sequence number, with label and `position`."""
    joined = with_media(assets, media).withColumns({
        "label": T.asset_label(F.col("media_title"), F.col("sequence_number"), F.col("title")),
        "__age": -F.unix_micros(F.col("created_at").cast("timestamp")),
    })
    return numbered(joined, [], ["__age", "media_id", "sequence_number", "asset_id"], "position").drop("__age")


def faceted(table: DataFrame, **values) -> DataFrame:
    """Rows that equal every given facet."""
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == kv[1]), values.items(), table)


def searched(table: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows where every word of `query` is part of some field, in any case."""

    def word(term: str) -> Column:
        return reduce(Column.__or__, [F.contains(F.lower(f), F.lower(F.lit(term))) for f in fields])

    return reduce(lambda df, term: df.filter(word(term)), query.split(), table)


def with_links(assets: DataFrame, media: DataFrame, config: K.LinkConfig = K.LinkConfig()) -> DataFrame:
    """Episodes with their editor, task and project links."""
    return with_media(assets, media).withColumns({
        "editor_url": K.editor_url(F.col("asset_id"), F.col("processed_video_url"), F.col("source_subtitle_url"),
                                   config),
        "task_url": K.task_url(F.col("annotation_project_id"), F.col("annotation_task_id"), config),
        "project_url": K.project_url(F.col("annotation_project_id"), config),
    })


def media_action(media: DataFrame) -> DataFrame:
    """Works with the action their ingestion state allows."""
    opened = K.project_url(F.col("annotation_project_id")).isNotNull()
    action = (
        F.when(F.col("ingestion_status") == "pending", "batch_upload")
        .when((F.col("ingestion_status") == "completed") & opened, "open_project")
        .when(F.col("ingestion_status") == "completed", "create_project")
    )
    return media.withColumn("action", action)


def asset_actions(linked: DataFrame) -> DataFrame:
    """Subtitle and annotation action of episodes that have their links."""
    subtitle = (
        F.when(F.col("editor_url").isNull(), "files_missing")
        .when(F.col("l1_status") == "completed", "edit_again")
        .otherwise("open_editor")
    )
    annotation = (
        F.when(F.col("task_url").isNotNull() & (F.col("l2_l3_status") == "completed"), "view_completed")
        .when(F.col("task_url").isNotNull(), "open_task")
        .when(F.col("project_url").isNull(), "project_missing")
        .otherwise("not_imported")
    )
    return linked.withColumns({"subtitle_action": subtitle, "annotation_action": annotation})
