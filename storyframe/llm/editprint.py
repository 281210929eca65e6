"""Fingerprints of documents by a randomised edit embedding.

A text is cut where the hash of six characters says so (after 1,024 characters at the latest), so that an edit moves no
cut but those near it. Each segment is embedded by a CGK walk: at each step it puts out the character it stands on, and a
shared random function of step and character tells whether to move on. Segments a few edits apart fall into step again,
so edit distance becomes Hamming distance of the outputs. Each of `SLOTS` slots samples `SAMPLED` outputs of every
segment, at steps spread evenly over the scales, and keeps the smallest hash over the segments, 16 bits of it. The
fingerprint is these slots as hex digits; the likeness of two is the share of equal slots.

`similar_classes` takes runs of slots as band keys, and verifies what meets by the exact edit distance.

Defined cases: a null text is empty; an empty text's fingerprint is all f. Equal texts have equal fingerprints. Rows are
ordered by doc_id, null first, then by text, so repeated ids have an order too. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm import _linking
from storyframe.llm import _text as T
from storyframe.session import scratch_path

SLOTS, SAMPLED = 48, 3
CUT_CHARS, CUT_ONE_IN, LONGEST = 6, 256, 1024
STEPS = LONGEST * 5 // 2
SLICE_CHARS = 1 << 20
_DIGEST = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_EDGE = ", text string, part int, head boolean"


def _random():
    random = np.random.default_rng(2)
    moves = random.integers(0, 2, (STEPS, 256), dtype=np.int32)
    # the logarithm of a sampled step is uniform
    steps = np.exp(random.uniform(0, np.log(STEPS), (SLOTS, SAMPLED))).astype(np.int64) - 1
    return moves, steps


MOVES, SAMPLES = _random()


def _segments(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First character and length of each segment, and its text."""
    n = len(code)
    total = np.zeros(n, np.uint64)
    for k, factor in enumerate(T.stream(97, CUT_CHARS)):
        total[:max(n - k, 0)] += code[k:].astype(np.uint64) * factor
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    here = np.arange(n)
    natural = (T.mix(total) % np.uint64(CUT_ONE_IN) == 0) & (here + CUT_CHARS <= offsets[1:][text]) if n else np.zeros(0, bool)
    cuts = np.union1d(np.flatnonzero(natural), offsets[:-1][np.diff(offsets) > 0])
    gap = np.diff(np.append(cuts, n))
    more = (gap - 1) // LONGEST
    start = np.repeat(cuts, more + 1)
    start += (np.arange(len(start)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)) * LONGEST
    return start, np.diff(np.append(start, n)), text[start] if n else start


def prints(texts: list[str]) -> np.ndarray:
    """Slots of each text."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    out = np.full((len(texts), SLOTS), 0xFFFF, np.uint16)
    start, length, text = _segments(code, offsets)
    if not len(start):
        return out
    byte = (T.mix(code) >> np.uint64(56)).astype(np.uint8)
    order = np.argsort(-length, kind="stable")
    at, end = start[order].astype(np.int32), (start + length)[order].astype(np.int32)
    row, shown = np.arange(len(at)), np.zeros((STEPS, len(at)), np.uint32)
    count = np.full(len(at), STEPS)
    for step in range(STEPS):
        alive = at < end
        if not alive.all():
            count[row[~alive]] = step
            at, end, row = at[alive], end[alive], row[alive]
            if not len(at):
                break
        shown[step, row] = code[at]
        at = at + MOVES[step][byte[at]]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    shown, count = shown[:, back], count[back]
    column, firsts = np.arange(len(count)), np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    factors, salts = T.stream(101, SAMPLED), T.stream(103, SLOTS)
    for slot in range(SLOTS):
        key = np.full(len(count), salts[slot])
        for k in range(SAMPLED):
            key += shown[SAMPLES[slot, k] % count, column] * factors[k]
        least = np.minimum.reduceat(T.mix(key), firsts)
        out[text[firsts], slot] = (least & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def hexed(slots: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in slots]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _digests(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Digests of all texts but the last, which only follows."""
    edited = [t[:len(t) - len(t) // 4] + n[:len(t) // 4] for t, n in zip(texts[:-1], texts[1:], strict=True)]
    own, changed = prints(texts), prints(edited)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:len(edited)], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
         pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
         pa.array(hexed(own[:-1]), pa.string()), pa.array(hexed(changed), pa.string()),
         pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:]))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _with_edge(digests: pa.RecordBatch) -> pa.RecordBatch:
    n = digests.num_rows
    return pa.RecordBatch.from_arrays(
        [*digests.columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())],
        [*digests.schema.names, "text", "part", "head"])


def _edge(like: pa.RecordBatch, doc_id, text: str, head: bool) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    columns = [pa.array([doc_id], pa.int64()), *(pa.nulls(1, c.type) for c in like.columns[1:7])]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([text]), pa.array([part], pa.int32()), pa.array([head])],
        [*like.schema.names, "text", "part", "head"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of a sorted partition; its first and last row go out whole, to meet those of the next partition."""
    ids, texts, size, none = [], [], 0, _digests([], [""])
    first = True
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if first:
                yield _edge(none, doc_id, text, True)
                first = False
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size > SLICE_CHARS and len(ids) > 1:
                yield _with_edge(_digests(ids, texts))
                ids, texts, size = ids[-1:], texts[-1:], len(text)
    if ids:
        if len(ids) > 1:
            yield _with_edge(_digests(ids, texts))
        yield _edge(none, ids[-1], texts[-1], False)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next")), strict=True):
            yield _digests([doc_id], [text, after])


def neighbour_report(docs: DataFrame) -> DataFrame:
    """Per row its fingerprint and that of its edited text: the last quarter is replaced by the start of the next text."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(spark, "fingerprints")
    (slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_neighbours, _DIGEST + _EDGE).write.parquet(path))
    done = spark.read.schema(_DIGEST + _EDGE).parquet(path)
    # one head and one tail per partition; partition numbers are collected, not texts
    parts = sorted(r[0] for r in done.where("head").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next_part int")
    heads = done.where("head").select(F.col("part").alias("next_part"), F.col("text").alias("next"))
    last = (done.where("NOT head").select("doc_id", "text", "part").join(F.broadcast(after), "part")
            .join(heads, "next_part").select("doc_id", "text", "next").mapInArrow(_pairs, _DIGEST))
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    return done.where("part IS NULL").select(*names).union(last)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over `a`."""
    if not a or not b:
        return max(len(a), len(b))
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = ones, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        x = eq | down
        level = ((((eq & up) + up) ^ up) | eq) & ones
        plus, minus = (down | ~(level | up)) & ones, up & level
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & ones, minus << 1 & ones
        up, down = (minus | ~(x | plus)) & ones, plus & x
    return distance


def edits_like(least: float, least_print: float) -> _linking.Compare:
    """1 - distance / longer length of at least `least`, for pairs whose fingerprints agree in `least_print`."""

    def compare(a: pa.Table, b: pa.Table) -> np.ndarray:
        left, right = a["text"].to_pylist(), b["text"].to_pylist()
        near = (prints(left)[:, None, :] == prints(right)[None, :, :]).mean(axis=2) >= least_print
        for i, j in zip(*np.nonzero(near), strict=True):
            if a is not b or i < j:
                longer = max(len(left[i]), len(right[j]), 1)
                near[i, j] = edit_distance(left[i], right[j]) <= (1 - least) * longer
        return near

    return compare


def similar_classes(docs: DataFrame, least: float = 0.8, rows: int = 2, least_print: float = 0.1) -> DataFrame:
    """(doc_id, class_id) per row: rows linked by edit likeness, class_id is the smallest doc_id of the class."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
                        ).withColumn("node", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.slices(batch.column("text")):
                slots = prints(batch.column("text").slice(a, b - a).to_pylist()).astype(np.uint64)
                bands = slots[:, :SLOTS // rows * rows].reshape(b - a, -1, rows)
                keys = T.mix((bands * T.stream(107, rows)).sum(axis=2, dtype=np.uint64) + T.stream(109, bands.shape[1]))
                cut = np.arange(b - a + 1, dtype=np.int32) * bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(a, b - a), batch.column("weight").slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(T.signed(keys).ravel()))],
                    ["node", "weight", "keys"])

    distinct = texts.select("node", "text", F.length("text").cast("long").alias("weight")).dropDuplicates(["node"])
    sketches = distinct.mapInArrow(run, "node long, weight long, keys array<long>")
    classes = _linking.linked_classes(sketches, distinct.select("node", "text"), edits_like(least, least_print))
    placed = texts.select("doc_id", "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    return placed.join(placed.groupBy("class").agg(F.min("doc_id").alias("class_id")), "class").select("doc_id", "class_id")
