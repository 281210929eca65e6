"""Session helpers: defaults for a new session, and the shared folder for checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rows one key may hold before the operators split it over several tasks.
HOT_ROWS = 2_000_000
HOT_ROWS_CONF = "spark.storyframe.hotRows"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "storyframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Checkpoints go away once no frame refers to them, which long-running streams need.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` names, else one below the session's warehouse folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files are deleted when their query ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, of which later stages read the columns they need.

    Unlike a checkpoint it carries no constraints on from round to round. What was shuffled for it is deleted at once.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str) -> DataFrame:
    """`written`, with rows that are counted: a table too large to be broadcast is not, however small its files are.

    Spark takes a Parquet table to be as large as its files. Rows that compress well need a hundred times that in memory. So
    such a table, and what is filtered, projected or grouped from it, is joined by a shuffle, unless the other side is broadcast.
    """
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    size = seen.get["n"] * (8 + df._jdf.schema().defaultSize())
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return table.hint("merge") if size > limit else table


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder, so later stages re-read it after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
