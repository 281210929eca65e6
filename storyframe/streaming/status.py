"""Status changes and processing triggers from a stream of saves.

The saves of an episode are followed in Spark's keyed state. Saves arrive in any order within `lateness`: one that a later
arrival may still precede waits in state, and a timer settles it once the watermark, the newest time seen less `lateness`, has
passed it. Settled saves are compared with the one before, in the order of the batch job. A save that sorts before one that is
settled already came too late; it is listed and changes nothing.

A row without an episode is a heartbeat: it moves the watermark and nothing else.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from storyframe.plans.status import ORDER, changed

# The state store that keyed state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SAVED, LATE = "saved", "late"
# Saves that wait in one row of state, at most.
CHUNK = 1000


class Saves(StatefulProcessor):
    """The last settled save of an episode with the times of its changes, and the saves that wait."""

    def __init__(self, id_type: str, columns: dict[str, str]):
        self.columns = list(columns)
        values = ", ".join(f"{c} {t}" for c, t in columns.items())
        stamps = ", ".join(f"{c}_changed_at bigint" for c in columns)
        before = ", ".join(f"previous_{c} {t}" for c, t in columns.items())
        self.last_schema = f"ts bigint, seq bigint, {values}, {stamps}"
        self.output = f"asset_id {id_type}, kind string, {self.last_schema}, {before}"
        self.shape = Row("asset_id", "kind", *ORDER, *columns, *(f"{c}_changed_at" for c in columns),
                         *(f"previous_{c}" for c in columns))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.last_schema)
        self.waiting = handle.getListState("waiting", "saves binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        last, on_time = self.last.get(), []
        for row in rows:
            save = tuple(row)[1:]
            if last is not None and save[:2] <= tuple(last[:2]):
                yield self._row(key, LATE, save, last[2 + len(self.columns):], (None,) * len(self.columns))
            else:
                on_time.append(save)
        if on_time:
            yield from self._arrived(key, on_time, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settled(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _arrived(self, key, arrived: list[tuple], watermark: int) -> Iterator[Row]:
        """Add saves to those that wait; only if one of all is due are the others read."""
        first, timers = min(save[0] for save in arrived) // 1000 + 1, list(self.handle.listTimers())
        if min([first, *timers]) <= watermark:
            yield from self._settled(key, arrived, watermark)
            return
        self.waiting.appendList(_chunks(arrived))
        if not timers or first < min(timers):
            for expiry in timers:
                self.handle.deleteTimer(expiry)
            self.handle.registerTimer(first)

    def _settled(self, key, arrived: list[tuple], watermark: int) -> Iterator[Row]:
        """Rows for the saves before the watermark that changed something; the others go on waiting."""
        held = [save for (chunk,) in self.waiting.get() for save in pickle.loads(chunk)] if self.waiting.exists() else []
        saves = sorted(held + arrived, key=lambda save: save[:2])
        n, last = len(self.columns), self.last.get()
        ready = [save for save in saves if save[0] < 1000 * watermark]
        for save in ready:
            values = save[2:]
            before = tuple(last[2:2 + n]) if last is not None else (None,) * n
            stamps = tuple(last[2 + n:]) if last is not None else (None,) * n
            stamps = tuple(save[0] if new is not None and old is not None and new != old else stamp
                           for new, old, stamp in zip(values, before, stamps, strict=True))
            if last is None or values != before:
                yield self._row(key, SAVED, save, stamps, before)
            last = (*save, *stamps)
        if ready:
            self.last.update(last)
        rest = saves[len(ready):]
        if len(rest) != len(held) or ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(_chunks(rest))
        # one timer, for the save that is settled next
        for expiry in list(self.handle.listTimers()):
            self.handle.deleteTimer(expiry)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)

    def _row(self, key, kind: str, save: tuple, stamps: tuple, before: tuple) -> Row:
        return self.shape(*key, kind, *save, *stamps, *before)


def _chunks(saves: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(saves[i:i + CHUNK]),) for i in range(0, len(saves), CHUNK)]


def track(log: DataFrame, folder: str, columns: list[str], lateness: str = "1 hour",
          trigger: dict | None = None) -> StreamingQuery:
    """Follow `columns` of a stream of saves `asset_id, ts, seq, ...`, ts in microseconds, and write what changed to `folder`.

    `trigger` is as for `writeStream.trigger`; by default what is there is read once. Read the outcome with `latest`,
    `changes`, `triggers` and `late`.
    """
    log.sparkSession.conf.set(*STORE)
    types = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    processor = Saves(types["asset_id"], {c: types[c] for c in columns})
    # Rows go on without the event time: Spark would drop those behind the watermark unseen.
    timed = log.withColumn("__at", F.timestamp_micros("ts")).withWatermark("__at", lateness)
    saves = timed.select("asset_id", *[F.col(c).cast("bigint").alias(c) for c in ORDER], *columns)
    rows = saves.groupBy("asset_id").transformWithState(processor, processor.output, "append", "eventTime")
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    )


def _written(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/out").filter(F.col("kind") == kind).drop("kind")


def late(spark: SparkSession, folder: str) -> DataFrame:
    """Saves that came after a later one of their episode was settled."""
    rows = _written(spark, folder, LATE)
    return rows.drop(*[c for c in rows.columns if c.startswith("previous_") or c.endswith("_changed_at")])


def changes(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """Settled saves that changed `column`, as `plans.status.changes`."""
    return _written(spark, folder, SAVED).filter(changed(column)).select(
        "asset_id", *ORDER, column, f"previous_{column}")


def triggers(spark: SparkSession, folder: str) -> DataFrame:
    """Settled saves that ask for processing; `source_video` must be followed without nulls, as by `filled`."""
    asked = changed("source_video") & (F.col("source_video") != "")
    return _written(spark, folder, SAVED).filter(asked).select("asset_id", *ORDER, "source_video")


def filled(log: DataFrame) -> DataFrame:
    """The log with empty texts for missing source videos."""
    return log.withColumn("source_video", F.coalesce("source_video", F.lit("")))


def latest(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Values of the followed columns per episode and the time of each one's last change."""
    seen = F.struct(*ORDER)

    def newest(column: str) -> Column:
        return F.max_by(column, seen).alias(column)

    return _written(spark, folder, SAVED).groupBy("asset_id").agg(
        *[newest(c) for c in columns], *[newest(f"{c}_changed_at") for c in columns])
