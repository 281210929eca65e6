"""What a stream remembers between micro-batches: the newest row per key, in a folder per batch.

Rows are the key columns, `at` and `value`; the row with the greatest `at` is the newest. Every so many batches the
newest rows are gathered into a snapshot, so a batch reads one snapshot and a few batch folders. Folders are named
by batch id and overwritten when a batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe.operators.skew import join_hot

SNAPSHOT_EVERY = 20


def remember(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def recall(spark: SparkSession, folder: str, schema: str, keys: list[str], batch_id: int,
           only: DataFrame | None = None) -> DataFrame:
    """The newest row per key of the batches before `batch_id`.

    `only` has the distinct values of some key columns that are wanted; the others are dropped before they are shuffled
    if it is small enough for Spark to broadcast.
    """
    base = batch_id - batch_id % SNAPSHOT_EVERY
    if base and batch_id == base:
        gathered = _newest(_read(spark, folder, schema, base - SNAPSHOT_EVERY, base), keys)
        gathered.write.mode("overwrite").parquet(f"{folder}/snapshot={base}")
    rows = _read(spark, folder, schema, base, batch_id)
    return _newest(rows if only is None else join_hot(rows, only, only.columns, "left_semi"), keys)


def newest(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """The newest row per key of all batches."""
    return _newest(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder), keys)


def _read(spark: SparkSession, folder: str, schema: str, base: int, end: int) -> DataFrame:
    paths = [f"{folder}/snapshot={base}"] if base else []
    paths += [f"{folder}/batch={i}" for i in range(base, end)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value"))
