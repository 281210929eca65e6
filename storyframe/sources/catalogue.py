"""Catalogue tables: works and their episodes.

A table is kept as Parquet in buckets by the hash of its key, sorted by the key and with bloom filters on it. A point read opens
the files of one bucket, and of these the row groups that may hold the key; an upsert rewrites the buckets that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe import schemas as S
from storyframe.operators.skew import join_hot
from storyframe.session import cut_lineage

BUCKETS = 256
BUCKET = "__bucket"


def read_table(spark: SparkSession, source: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A catalogue table. For `fmt="jdbc"` `source` is the table and the options name the database; give
    `partitionColumn`, `lowerBound`, `upperBound` and `numPartitions` to read it in parallel."""
    reader = spark.read.format(fmt).options(**options)
    return reader.option("dbtable", source).load() if fmt == "jdbc" else reader.load(source).drop(BUCKET)


def _bucket(key: Column, buckets: int) -> Column:
    # by text, so that the type in which an id is asked for makes no difference
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_table(table: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a whole table in buckets; what was there is replaced."""
    _written(table, path, key, buckets, "static")


def _written(table: DataFrame, path: str, key: str, buckets: int, replaced: str) -> None:
    rows = table.withColumn(BUCKET, _bucket(F.col(key), buckets))
    (rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key).write.mode("overwrite").partitionBy(BUCKET)
     .option("partitionOverwriteMode", replaced).option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))


def by_id(spark: SparkSession, path: str, id_, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The row of a written table with one id."""
    found = spark.read.parquet(path).filter(F.col(BUCKET) == _bucket(F.lit(id_), buckets))
    return found.filter(F.col(key) == id_).drop(BUCKET)


def by_ids(spark: SparkSession, path: str, ids: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a written table whose key is in `ids`; if these are few, buckets without any of them are not read."""
    asked = ids.select(key).distinct().withColumn(BUCKET, _bucket(F.col(key), buckets))
    return spark.read.parquet(path).join(asked, [BUCKET, key], "left_semi").drop(BUCKET)


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Put `changes`, one row per key, into a written table: rows with their keys are replaced, others added.

    Buckets without changes keep their files. The new buckets are written aside before any is replaced, and the same
    changes once more change nothing, so a job that was cut off is simply run again.
    """
    own = cut_lineage(changes.withColumn(BUCKET, _bucket(F.col(key), buckets)))
    table = spark.read.parquet(path)
    touched = table.join(F.broadcast(own.select(BUCKET).distinct()), BUCKET, "left_semi")
    kept = join_hot(touched, own.select(key), [key], "left_anti", left_at_most=1)
    merged = cut_lineage(kept.select(table.columns).unionByName(own.select(table.columns)))
    _written(merged.drop(BUCKET), path, key, buckets, "dynamic")


def invalid_values(table: DataFrame) -> DataFrame:
    """Rows with a state outside the allowed values, with the names of the offending columns."""
    bad = [F.when(~F.col(c).isin(allowed), F.lit(c)) for c, allowed in S.CATALOGUE_VALUES.items()
           if c in table.columns]
    return table.withColumn("invalid", F.array_compact(F.array(*bad))).filter(F.size("invalid") > 0)
