"""Ingestion of upload folders and of finished subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.functions import links as K
from storyframe.functions import text as T
from storyframe.operators.skew import join_hot
from storyframe.sources import listing as U

ASSET_KEY = ["media_id", "sequence_number"]


def plan(files: DataFrame, existing: DataFrame, config: K.LinkConfig = K.LinkConfig()) -> DataFrame:
    """Episodes that a listing `media_id, name` creates or updates.

    Videos are taken by suffix, then by name. Those with one sequence number share an episode: an existing one
    keeps its id and title, a new one is titled after the first video, and the links come from the last.
    `existing` has `media_id, sequence_number, asset_id, title`. A listing that grew may also tell the `turn` in which each
    file came, the first of which gives the title, and whether it is `fresh`; an episode is created if all its videos are.
    """
    if "turn" not in files.columns:
        files = files.withColumns({"turn": F.lit(0), "fresh": F.lit(True)})
    paired = join_hot(U.videos(files), U.subtitles(files), ["media_id", "stem"], "left")
    turn = F.struct("ext_rank", "name")
    wanted = paired.groupBy(*ASSET_KEY).agg(
        F.min_by("stem", F.struct("turn", "ext_rank", "name")).alias("first_stem"), F.bool_and("fresh").alias("fresh"),
        F.max_by(F.struct("srt_name"), turn)["srt_name"].alias("srt_name"),
        F.count(F.lit(1)).alias("n_videos"),
    )
    known = existing.select(*ASSET_KEY, F.col("asset_id").alias("known_id"), F.col("title").alias("known_title"))
    # Both sides have one row per episode.
    merged = wanted.join(known, ASSET_KEY, "left").withColumn(
        "asset_id", F.coalesce("known_id", T.stable_uuid(F.col("media_id"), F.col("sequence_number"))))
    return merged.select(
        *ASSET_KEY, "asset_id", F.coalesce("known_title", "first_stem").alias("title"),
        (F.col("known_id").isNull() & F.col("fresh")).alias("created"), "n_videos",
        K.video_url(F.col("asset_id"), config).alias("processed_video_url"),
        K.subtitle_url(F.col("asset_id"), F.col("srt_name"), config).alias("source_subtitle_url"),
        F.lit("completed").alias("processing_status"),
    )


def duplicate_assets(existing: DataFrame) -> DataFrame:
    """Sequence numbers that several episodes of one work hold, which `plan` must not be given."""
    return existing.groupBy(*ASSET_KEY).agg(F.count(F.lit(1)).alias("n_assets")).filter("n_assets > 1")


def run_states(folders: DataFrame, planned: DataFrame) -> DataFrame:
    """`media_id, sequence_number, step, status`: every state that an ingest run goes through, in order of `step`.

    `folders` is a listing with a row without name per work, `planned` has the episodes. A work is ingesting, then completed, or
    failed if it has no folder; its episodes are processing, then completed. Rows of works have no sequence number.
    """
    works = folders.filter("name IS NULL").select(
        "media_id", F.lit(None).cast("bigint").alias("sequence_number"), F.posexplode(F.array(
            F.lit("ingesting"), F.when(F.col("found"), "completed").otherwise("failed"))).alias("step", "status"))
    episodes = planned.select("media_id", F.col("sequence_number").cast("bigint").alias("sequence_number"), F.posexplode(
        F.array(F.lit("processing"), F.lit("completed"))).alias("step", "status"))
    return works.unionByName(episodes)


def media_status(media: DataFrame, folders: DataFrame) -> DataFrame:
    """New ingestion state of each work: failed if it has no upload folder, of which `folders` lists the ids."""
    found = folders.select("media_id").distinct().withColumn("found", F.lit(True))
    status = F.when(F.col("found"), "completed").otherwise("failed")
    return join_hot(media, found, ["media_id"], "left", left_at_most=1) \
        .withColumn("ingestion_status", status).drop("found")


# What a plan changes in an episode that exists; all else stays.
PLANNED = ["processed_video_url", "source_subtitle_url", "processing_status"]


def merged_assets(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """The episode table after a plan: known episodes get new links and state, new ones are added."""
    changes = planned.select(*ASSET_KEY, F.struct(*PLANNED).alias("__change"))
    # A plan has one row per episode.
    joined = join_hot(existing, changes, ASSET_KEY, "left", right_at_most=1)
    met = F.col("__change").isNotNull()
    updated = joined.withColumns({
        c: F.when(met, F.col("__change")[c]).otherwise(F.col(c)) if c in existing.columns else F.col("__change")[c]
        for c in PLANNED}).drop("__change")
    new = planned.filter("created").drop("created", "n_videos")
    return updated.unionByName(new, allowMissingColumns=True)


def subtitle_upload(assets: DataFrame, uploads: DataFrame) -> DataFrame:
    """Episodes after the upload of finished subtitles `asset_id, body`; empty bodies are refused.

    Repeated uploads of one episode are first brought down to whether any of them has content.
    """
    filled = uploads.filter(F.coalesce("body", F.lit("")) != "").select("asset_id").distinct()
    done = filled.withColumn("uploaded", F.lit(True))
    uploaded = F.coalesce("uploaded", F.lit(False))
    name = F.concat(F.lit("l1_outputs/"), F.col("asset_id").cast("string"), F.lit("_l1.ass"))
    return join_hot(assets, done, ["asset_id"], "left", left_at_most=1).withColumns({
        "l1_output_file": F.when(uploaded, name).otherwise(F.col("l1_output_file")),
        "l1_status": F.when(uploaded, "completed").otherwise(F.col("l1_status")),
    }).drop("uploaded")
