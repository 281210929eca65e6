"""Near-duplicate documents by weighted Jaccard likeness of word shingles (BagMinHash, banding, exact check).

A document is the bag of its shingles, runs of five words with A-Z lower-cased; the likeness of two is the sum of the
smaller counts over the sum of the larger ones. A text of fewer than five words is one shingle.

Signatures. A shingle of weight w owns Poisson processes over the weight axis, split at 1, 2, 4, 8 ...: the process of
[2^k, 2^(k+1)) has rate 2^k, and its points count only if the unit of weight they fall on is below w. Each point hits a
random register, a register keeps its earliest point. The streams depend on shingle and interval alone, so two
registers agree with a chance equal to the weighted likeness. A document stops drawing when no register can change.

Bands of five registers give bucket keys; `_linking` compares what shares one, on the whole texts, exactly.

Defined cases: a null text reads as an empty one, and equal texts are copies, empty ones too. Bags of any size take part.
Texts without words have no shingles and are copies if equal. Rows are told apart by doc_id and text; repeated rows share a class
and `kept` leaves one. A null doc_id comes after all others. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm import _linking
from storyframe.llm import _text as T
from storyframe.session import cut_lineage

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 26, 5


def bag_signatures(text: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Registers of `n` bags; rows of bags without elements stay infinite."""
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level < 2, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    low = np.where(level == 0, 0, width)
    top = count[owner]
    doc = text[owner]
    state = T.mix(value[owner] + T.stream(23, 64)[level])
    time = np.zeros(len(doc))
    best = np.full(n * registers, np.inf)
    step = 0
    while len(doc):
        step += 1
        first = T.mix(state + np.uint64(step * 0xA0761D6478BD642F % (1 << 64)))
        second = T.mix(first ^ state)
        time = time - np.log1p(-((first >> np.uint64(11)) * 2.0**-53)) / width
        register = ((second >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        unit = np.floor(low + (second & np.uint64(0xFFFFFFFF)) * 2.0**-32 * width)
        inside = unit < top
        np.minimum.at(best, doc[inside] * registers + register[inside], time[inside])
        limit = best.reshape(n, registers).max(axis=1)
        alive = time < limit[doc]
        doc, state, time, width, low, top = (x[alive] for x in (doc, state, time, width, low, top))
    return best.reshape(n, registers)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of `rows` registers; keys of different bands differ."""
    n, registers = signature.shape
    bands = registers // rows
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(n, bands, rows)
    total = (T.mix(bits) * T.stream(31, rows)).sum(axis=2, dtype=np.uint64)
    return T.signed(T.mix(total + T.stream(37, bands)))


def _sketch(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column):
                n = b - a
                text, value, count = T.bag(*T.shingles(T.words(column.slice(a, n)), size))
                weight = np.bincount(text, weights=count, minlength=n).astype(np.int64)
                signature = bag_signatures(text, value, count, n, bands * rows)
                keys = band_keys(signature, rows).ravel()
                has = weight > 0
                offsets = np.concatenate(([0], np.cumsum(has * bands))).astype(np.int32)
                keys = keys.reshape(n, bands)[has].ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), batch.column("node").slice(a, n), pa.array(weight),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                    ["doc_id", "node", "weight", "keys"])

    return run


def bag_like(size: int, likeness: float) -> _linking.Compare:
    """Exact weighted Jaccard of the texts' shingle bags, against a threshold."""

    def ids(table: pa.Table):
        column = table["text"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        text, value, count = T.bag(*T.shingles(T.words(column), size))
        # the k-th copy of a shingle is an id of its own, so common ids count the smaller number of copies
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(text, count), T.mix(np.repeat(value, count) + place.astype(np.uint64) * T.stream(43, 1)), \
            np.bincount(text, weights=count, minlength=len(column))

    def compare(a: pa.Table, b: pa.Table) -> np.ndarray:
        rows_a, ids_a, size_a = ids(a)
        rows_b, ids_b, size_b = (rows_a, ids_a, size_a) if a is b else ids(b)
        common = _linking.overlaps(rows_a, ids_a, len(size_a), rows_b, ids_b, len(size_b))
        # compared as integers, so that a likeness of exactly the threshold counts
        return common * (1 + likeness) + 1e-6 >= likeness * (size_a[:, None] + size_b[None, :])

    return compare


def near_duplicates(docs: DataFrame, likeness: float = LIKENESS, size: int = SHINGLE, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """(doc_id, node, class_id, class_size, keep) for each row; node is the hash of the text.

    class_id is the smallest doc_id of the class and `keep` marks its rows (equal rows all carry the mark, see `kept`).
    Chance that a pair of likeness 0.8 shares no band: (1 - 0.8^5)^26, about 3 in 100,000.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn(
        "node", F.xxhash64("text"))
    sketches = cut_lineage(texts.mapInArrow(
        _sketch(bands, rows, size), "doc_id long, node long, weight long, keys array<long>"))
    nodes = sketches.where(F.size("keys") > 0).dropDuplicates(["node"]).select("node", "weight", "keys")
    payload = texts.select("node", "text").dropDuplicates(["node"])
    classes = _linking.linked_classes(nodes, payload, bag_like(size, likeness))
    placed = cut_lineage(sketches.select("doc_id", "node").join(classes, "node", "left").select(
        "doc_id", "node", F.coalesce("class", "node").alias("class")))
    heads = cut_lineage(placed.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("head"),
        F.count(F.lit(1)).alias("class_size")))
    return placed.join(heads, "class").select(
        "doc_id", "node", F.col("head.doc_id").alias("class_id"), "class_size",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("node") == F.col("head.node"))).alias("keep"))


def kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of `docs` per class of `found`, with the columns of `docs`."""
    marked = found.where("keep").select("doc_id", "node").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn(
        "hash", F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))))
    mine = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("node"))
    # repeated rows carry the same mark
    return (rows.join(marked, mine).groupBy("doc_id", "node").agg(F.first("row").alias("row"))
            .select(*[F.col("row")[c].alias(c) for c in docs.columns]))
