"""Ingestion of files as they arrive.

Folders are listed by tasks, all of them for each micro-batch; no list of all folders or files is ever in one place. The files
of each work are kept in Spark's keyed state, each once, with the turn in which it came. A micro-batch gives the whole listing
of the works that got new files, and plans their episodes from it; titles come from the first turn. A repeated batch overwrites
its own folder of plans and nothing else.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from storyframe.functions.links import LinkConfig
from storyframe.operators.skew import join_hot
from storyframe.plans import ingest
from storyframe.session import cut_lineage
from storyframe.sources import listing as U
from storyframe.streaming.status import STORE


class Listing(StatefulProcessor):
    """The names of a work's files and the turns in which they came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getListState("names", "name string, turn bigint")
        self.turns = handle.getValueState("turns", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        turn = (self.turns.get() or (0,))[0]
        arrived = {row["name"] for row in rows}
        held = [tuple(row) for row in self.names.get()] if turn else []
        fresh = [(name, turn) for name in arrived.difference(name for name, _ in held)]
        if not fresh:
            return
        self.names.appendList(fresh)
        self.turns.update((turn + 1,))
        for name, came in held + fresh:
            yield Row(media_id=key[0], name=name, turn=came, fresh=came == turn)

    def close(self) -> None:
        pass


class Uploads(DataSource):
    """`media_id, name` of the files in `<path>/<media_id>/`, listed by as many tasks as `slices` says."""

    @classmethod
    def name(cls) -> str:
        return "storyframe_uploads"

    def schema(self) -> str:
        return "media_id string, name string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return UploadsReader(self.options["path"], int(self.options["slices"]))


class UploadsReader(DataSourceStreamReader):
    """Each micro-batch is the whole listing as it then is. The driver holds neither folders nor files."""

    def __init__(self, root: str, slices: int) -> None:
        self.root, self.slices = root, slices

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.slices)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, base = U.file_system(self.root)
        rows = ((work, name) for work, length in U.entries(system, base)
                if length is None and zlib.crc32(work.encode()) % self.slices == partition.value
                for name, length in U.entries(system, f"{base}/{work}") if length is not None and U.named_like(name, U.LISTED))
        while some := list(islice(rows, U.ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], ["media_id", "name"])


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """`media_id, name` of files arriving in `<path>/<media_id>/`; their contents are not read.

    Every micro-batch gives all files that are there, so a reader must know which it has seen. Files in deeper folders are left
    out, as are those whose names begin with `_` or `.`, which Spark takes for hidden.
    """
    spark.dataSource.register(Uploads)
    slices = 4 * spark.sparkContext.defaultParallelism
    return spark.readStream.format(Uploads.name()).option("slices", slices).load(U.qualified(spark, path))


def ingest_stream(files: DataFrame, existing: DataFrame, folder: str, config: LinkConfig = LinkConfig(),
                  trigger: dict | None = None) -> StreamingQuery:
    """Keep the plans in `folder` up to date with a stream of files `media_id, name`. Read them with `planned_assets`.

    `trigger` is as for `writeStream.trigger`; by default what is there is read once.
    """
    files.sparkSession.conf.set(*STORE)
    known = existing.select(*ingest.ASSET_KEY, "asset_id", "title")
    kind = files.schema["media_id"].dataType.simpleString()

    def batch(rows: DataFrame, batch_id: int) -> None:
        listing = cut_lineage(rows)
        if batch_id and listing.isEmpty():
            return
        touched = listing.select("media_id").distinct()
        planned = ingest.plan(listing, join_hot(known, touched, ["media_id"], "left_semi"), config)
        planned.write.mode("overwrite").parquet(f"{folder}/plans/batch={batch_id}")

    names = files.select("media_id", "name").groupBy("media_id").transformWithState(
        Listing(), f"media_id {kind}, name string, turn bigint, fresh boolean", "append", "none")
    return (
        names.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def planned_assets(spark: SparkSession, existing: DataFrame, folder: str) -> DataFrame:
    """The newest plan of each episode, with the columns of `ingest.plan`."""
    types = {f.name: f.dataType.simpleString() for f in existing.schema.fields}
    schema = (f"media_id {types['media_id']}, sequence_number bigint, asset_id string, title string, created boolean, "
              "n_videos bigint, processed_video_url string, source_subtitle_url string, processing_status string, batch bigint")
    rows = spark.read.schema(schema).parquet(f"{folder}/plans")
    values = F.struct(*[c for c in rows.columns if c not in (*ingest.ASSET_KEY, "batch")])
    return rows.groupBy(*ingest.ASSET_KEY).agg(F.max_by(values, "batch").alias("p")).select(*ingest.ASSET_KEY, "p.*")
