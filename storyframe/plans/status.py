"""Status history of episodes. Logs have one row per save, ordered by `ts` and `seq` within an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.operators.skew import with_previous

ORDER = ["ts", "seq"]


def with_last(log: DataFrame, columns: list[str]) -> DataFrame:
    """Add `previous_<column>`: the value at the save before, null for the first save of an episode."""
    return with_previous(log, ["asset_id"], ORDER, {f"previous_{c}": c for c in columns})


def changes(log: DataFrame, column: str = "status") -> DataFrame:
    """Saves that changed a status. The first one is only remembered."""
    return with_last(log, [column]).filter(changed(column))


def changed(column: str) -> Column:
    return F.col(f"previous_{column}").isNotNull() & (F.col(column) != F.col(f"previous_{column}"))


def change_stamps(log: DataFrame, columns: list[str]) -> DataFrame:
    """Last value of each status column per episode and `<column>_changed_at`, the time of its last change."""
    seen = F.struct(*ORDER)
    stamps = [F.max(F.when(changed(c), F.col("ts"))).alias(f"{c}_changed_at") for c in columns]
    values = [F.max_by(c, seen).alias(c) for c in columns]
    return with_last(log, columns).groupBy("asset_id").agg(*values, *stamps)


def triggers(log: DataFrame) -> DataFrame:
    """Saves that ask for processing: the source video is given and differs from the one before."""
    return with_last(log.withColumn("source_video", F.coalesce("source_video", F.lit(""))), ["source_video"]).filter(
        changed("source_video") & (F.col("source_video") != ""))
