"""JSON arrays of any size, read in blocks by many tasks.

A file is cut into blocks of bytes, and every block at the commas of depth one. What a block means depends on how it is entered:
outside a string, inside one, or inside one behind a backslash. A file that is short enough for one task is gone through block by
block from its beginning. Each block of a longer one is first told for all three: how it is left, and how much deeper. Going
through these summaries in order gives the state and depth at which each block really begins, so that many tasks can cut it. A
block owns the elements that begin in it. Only files of several tasks are read twice. Blocks that follow each other go to one task
up to a limit of bytes, which opens their file once. Files are listed by tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe.sources.listing import file_system, files_below, qualified

BLOCK_BYTES = 32 << 20
# Bytes that a task reads, about.
TASK_BYTES = 128 << 20
# Elements, and characters of them, in one batch of a task.
BATCH_ROWS, BATCH_CHARS = 1000, 1 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
# Blanks, and the mark that some files begin with.
_BLANK = b" \t\r\n\xef\xbb\xbf"
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_QUOTE, _BACKSLASH, _COMMA = ord('"'), ord("\\"), ord(",")


def _marked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the quotes before it that open or close a string, and whether it is such a quote."""
    place = np.arange(len(data))
    # the byte before the backslashes that stand right before each byte
    plain = np.maximum.accumulate(np.where(data != _BACKSLASH, place, -1))
    before = np.concatenate(([-1], plain[:-1]))
    quote = (data == _QUOTE) & ((place - 1 - before) % 2 == 0)
    return np.cumsum(quote) - quote, quote


def _entered(data: np.ndarray, state: int) -> np.ndarray:
    return np.concatenate(([_BACKSLASH], data)).astype(np.uint8) if state == ESCAPED else data


def _left(data: np.ndarray, inside: bool) -> int:
    if not inside:
        return OUTSIDE
    other = np.flatnonzero(data != _BACKSLASH)
    return ESCAPED if (len(data) - 1 - (other[-1] if len(other) else -1)) % 2 else INSIDE


def summary(data: np.ndarray, state: int) -> tuple[int, int]:
    """The state in which a block entered in `state` is left, and how much deeper."""
    data = _entered(data, state)
    if not len(data):
        return state, 0
    before, quote = _marked(data)
    within = (before + (state != OUTSIDE)) % 2 == 1
    ends_inside = bool((before[-1] + quote[-1] + (state != OUTSIDE)) % 2)
    return _left(data, ends_inside), int(_STEP[data[~within]].sum())


class Cut(NamedTuple):
    """Ends of elements in a block, whether the first byte of the array is in it, and how the block is left."""

    ends: np.ndarray
    begin: int | None
    state: int
    depth: int


def cuts(data: np.ndarray, state: int, depth: int) -> Cut:
    """Where the elements of an array of depth one end: at commas of that depth, and at its closing bracket."""
    entered = _entered(data, state)
    shift = len(entered) - len(data)
    if not len(data):
        return Cut(np.zeros(0, np.int64), None, state, depth)
    before, quote = _marked(entered)
    outside = (before + (state != OUTSIDE)) % 2 == 0
    step = np.where(outside, _STEP[entered], 0)
    after = depth + np.cumsum(step)
    ends = np.flatnonzero(outside & ((entered == _COMMA) & (after == 1) | (step < 0) & (after == 0)))
    opened = np.flatnonzero((step > 0) & (after == 1)) if depth == 0 else np.zeros(0, np.int64)
    inside = bool((before[-1] + quote[-1] + (state != OUTSIDE)) % 2)
    return Cut(ends - shift, int(opened[0]) - shift + 1 if len(opened) else None, _left(entered, inside), int(after[-1]))


def elements(spark: SparkSession, path: str, pattern: str = "*.json", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`path, position, body`: the elements of all JSON arrays in files below `path` named like `pattern`.

    `position` is the byte at which an element begins. A file whose root is no array has no elements.
    """
    root = qualified(spark, path)
    files = files_below(spark, path, pattern)
    count = F.greatest(F.ceil(F.col("length") / block_bytes), F.lit(1))
    total = files.agg(F.sum(count)).first()[0] or 1
    # a given number of partitions stays as it is, however small the rows are
    tasks = int(max(min(total, spark.sparkContext.defaultParallelism), total * block_bytes // TASK_BYTES))
    most = max(TASK_BYTES // block_bytes, 1)
    short = count <= most
    zero = F.lit(0).cast("bigint")
    known = files.filter(short).select("path", "length", zero.alias("block"), count.cast("bigint").alias("blocks"),
                                       F.lit(OUTSIDE).alias("state"), zero.alias("depth"))
    several = files.filter(~short).select("path", "length", F.explode(F.sequence(zero, count - 1)).alias("block"))

    run = F.col("block") - F.col("block") % most

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "path", run).sortWithinPartitions("path", "block")

    def opened(batch: pa.RecordBatch, system, base: str) -> Iterator[tuple[dict, pa.NativeFile]]:
        """The rows of a batch with their files, each of which is open as long as rows of it follow."""
        for file, rows in groupby(batch.to_pylist(), itemgetter("path")):
            with system.open_input_file(base + file[len(root):]) as stream:
                yield from ((row, stream) for row in rows)

    told_of = [f"{k}{state}" for state in range(3) for k in ("state", "depth")] + ["first"]
    names = ["path", "length", "block", *told_of]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            rows = []
            for row, stream in opened(batch, system, base):
                data = np.frombuffer(stream.read_at(block_bytes, row["block"] * block_bytes), np.uint8)
                first = data.tobytes().lstrip(_BLANK)[:1]
                rows.append([*(x for state in (OUTSIDE, INSIDE, ESCAPED) for x in summary(data, state)),
                             first[0] if first else None])
            added = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How each block is entered, from the summaries of a file in order. No block from where the root proves to be no array."""
        file, state, depth, root_byte = None, OUTSIDE, 0, None
        for batch in batches:
            kept, states, depths = [], [], []
            for i, row in enumerate(batch.to_pylist()):
                if row["path"] != file:
                    file, state, depth, root_byte = row["path"], OUTSIDE, 0, None
                root_byte = row["first"] if root_byte is None else root_byte
                if root_byte in (None, ord("[")):
                    kept.append(i)
                    states.append(state)
                    depths.append(depth)
                state, depth = row[f"state{state}"], depth + row[f"depth{state}"]
            blocks = batch.select(["path", "length", "block"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*blocks.columns, pa.array(states, pa.int32()), pa.array(depths, pa.int64())],
                                             ["path", "length", "block", "state", "depth"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        found, size = [], 0
        for batch in batches:
            for row, stream in opened(batch, system, base):
                given = row["block"] * block_bytes, block_bytes, row["state"], row["depth"]
                for place, text in _gone_through(stream, block_bytes) if row["blocks"] > 1 else zip(*_owned(stream, *given), strict=True):
                    found.append((row["path"], place, text))
                    size += len(text)
                    if len(found) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield rows_of(found)
                        found, size = [], 0
        if found:
            yield rows_of(found)

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        types = pa.string(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)],
                                          ["path", "position", "body"])

    if not several.isEmpty():
        shape = "path string, length bigint, block bigint, " + ", ".join(f"{c} bigint" for c in told_of)
        sums = dealt(several).mapInArrow(summed, shape).repartition(tasks, "path").sortWithinPartitions("path", "block")
        entered = sums.mapInArrow(composed, "path string, length bigint, block bigint, state int, depth bigint")
        known = known.unionByName(entered.withColumn("blocks", F.lit(1).cast("bigint")))
    return dealt(known).mapInArrow(told, "path string, position bigint, body string")


def _begins(raw: bytes, found: Cut) -> tuple[list[int], list[int]]:
    """Where elements begin in a block, and where those of them end that end in it."""
    begins = ([found.begin] if found.begin is not None else []) + (found.ends + 1).tolist()
    # the byte behind the closing bracket begins nothing
    if len(found.ends) and raw[found.ends[-1]:found.ends[-1] + 1] != b",":
        begins.pop()
    return begins, [e for e in found.ends.tolist() if begins and e >= begins[0]]


def _gone_through(stream, size: int) -> Iterator[tuple[int, str]]:
    """Places and texts of the elements of a file, which is read once, in blocks of `size`."""
    start, state, depth, is_array = 0, OUTSIDE, 0, None
    opened: list[tuple[int, list[bytes]]] = []

    def text(parts: list[bytes]) -> bytes:
        return b"".join(parts).strip()

    def ended() -> Iterator[tuple[int, str]]:
        yield from ((place, text(parts).decode("utf-8", "replace").strip()) for place, parts in opened if text(parts))
        opened.clear()

    while raw := stream.read_at(size, start):
        if is_array is None and (first := raw.lstrip(_BLANK)[:1]):
            is_array = first == b"["
        if is_array is False:
            return
        found = cuts(np.frombuffer(raw, np.uint8), state, depth)
        for _, parts in opened:
            parts.append(raw[:found.ends[0]] if len(found.ends) else raw)
        if len(found.ends):
            yield from ended()
        begins, ends = _begins(raw, found)
        for i, begin in enumerate(begins):
            opened.append((start + begin, [raw[begin:ends[i]] if i < len(ends) else raw[begin:]]))
            if i < len(ends):
                yield from ended()
        start, state, depth = start + size, found.state, found.depth
    yield from ended()


def _owned(stream, start: int, size: int, state: int, depth: int) -> tuple[list[int], list[str]]:
    """Places and texts of the elements that begin in the block at `start`."""
    raw = stream.read_at(size, start)
    data = np.frombuffer(raw, np.uint8)
    if start == 0 and raw.lstrip(_BLANK)[:1] not in (b"[", b""):
        return [], []
    found = cuts(data, state, depth)
    begins, ends = _begins(raw, found)
    places, texts = [], []
    for i, begin in enumerate(begins):
        text = raw[begin:ends[i]] if i < len(ends) else raw[begin:] + _rest(stream, start + size, size, found.state, found.depth)
        if text.strip():
            places.append(start + begin)
            texts.append(text.decode("utf-8", "replace").strip())
    return places, texts


def _rest(stream, start: int, size: int, state: int, depth: int) -> bytes:
    """What follows up to the end of the element that is open at `start`."""
    parts = []
    while raw := stream.read_at(size, start):
        found = cuts(np.frombuffer(raw, np.uint8), state, depth)
        if len(found.ends):
            parts.append(raw[:found.ends[0]])
            break
        parts.append(raw)
        start, state, depth = start + size, found.state, found.depth
    return b"".join(parts)
