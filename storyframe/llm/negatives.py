"""Hard negatives: for an anchor and one of its positives, the best rows of other labels that score in a range below it.

A row's score with an anchor is the inner product of their integer vectors. Most rows are ruled out without computing it:

- *Codes.* A random orthogonal matrix rotates all vectors, which changes no inner product. A rotated vector is written as
  one-bit codes, one per level: the code is the signs of what the levels before left over, and stored with it is its
  alignment, the inner product of the remainder with the code as a unit vector. Every level leaves about 0.6 of the length of
  the remainder; the length that the last one leaves is stored, too.
- *Estimates.* An anchor's rotated vector is cut into `BITS` bit planes. The inner product of a code with it is a sum of
  population counts of code AND plane, and the sum over levels, weighed by the alignments, estimates the score.
- *Intervals.* By the Cauchy-Schwarz inequality the estimate misses by at most (remainder of the row) * (length of the
  anchor) + (length of the coded part) * (what the bit planes leave of the anchor). The interval is certain, not likely. Rows
  whose interval cannot reach the best found so far, or the range asked for, are left out; all others get their integer score.

The codes are written once as a table. Anchors, the stated queries, go to the tasks in blocks of about `block` rows, first to
find positives, then with the positives' scores to find negatives; each task keeps the best of the rows it reads, and the best of
all tasks are chosen by rank. No pair of rows is ever a row of a table except the few best of a task.

Defined cases: rows with a null id, a null label, a null vector or one with a null, NaN or infinite entry take no part; nor
do vectors of another length than the most frequent one (of several the largest). Of rows with one id, the one with the
smallest label, then vector, counts. Ties in score go to the smaller id. An anchor without other rows of its label has no
positive, one without fitting rows no negative. Entries are clipped to where scores fit a long. Columns besides
id, label and vector are ignored. Empty tables, and tables without anchors, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyframe.llm import _vectors
from storyframe.session import scratch_path

LEVELS, BITS = 4, 6
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256.0
BLOCK = 4096
ROWS, ANCHORS = 2048, 256
PAIRS = 1 << 15
_LEAST = np.iinfo(np.int64).min
_CODED = "vec_id long, label long, vector array<long>, code array<long>, aligned array<double>, size double, rest double"


def rotation(size: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diagonal(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, size = bits.shape
    padded = np.zeros((n, -(-size // 64) * 64), np.uint8)
    padded[:, :size] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def encoded(turned: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rotated vectors: code words per level, alignments per level, length of what is left."""
    rest, unit = turned.copy(), 1 / np.sqrt(turned.shape[1])
    words, aligned = [], []
    for _ in range(levels):
        up = rest >= 0
        signs = np.where(up, unit, -unit)
        along = (rest * signs).sum(axis=1)
        rest -= along[:, None] * signs
        words.append(packed(up))
        aligned.append(along)
    return np.concatenate(words, axis=1), np.stack(aligned, axis=1), np.sqrt((rest * rest).sum(axis=1))


def coded(rows: DataFrame, size: int, scale: float, levels: int) -> DataFrame:
    """`rows` (vec_id, label, vector) with integer vectors and their codes, read back from a table."""
    turn, largest = rotation(size), int(np.sqrt((1 << 62) / size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in _vectors.matrices(batches, "vector", size):
            whole = np.clip(np.floor(matrix * scale), -largest, largest)
            words, aligned, rest = encoded(whole @ turn, levels)

            def lists(values: np.ndarray) -> pa.ListArray:
                ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))

            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), lists(whole.astype(np.int64)), lists(words.view(np.int64)),
                 lists(aligned), pa.array(np.sqrt((whole * whole).sum(axis=1))), pa.array(rest)],
                ["vec_id", "label", "vector", "code", "aligned", "size", "rest"])

    path = scratch_path(rows.sparkSession, "codes")
    rows.mapInArrow(run, _CODED).write.parquet(path)
    return rows.sparkSession.read.schema(_CODED).parquet(path)


class Anchors(NamedTuple):
    """A block of anchors in bit planes: rotated entries are about low + step * (the number its bits make)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    size: np.ndarray
    missed: np.ndarray
    positives: np.ndarray
    scores: np.ndarray

    def part(self, at: slice) -> Anchors:
        return Anchors(*(x[at] for x in self))


def prepared(table: pa.Table, size: int, bits: int) -> Anchors:
    vectors = table["vector"].combine_chunks().flatten().to_numpy().reshape(-1, size)
    turned = vectors.astype(np.float64) @ rotation(size)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << bits) - 1), 1e-300)
    number = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    missed = turned - (low[:, None] + step[:, None] * number)
    planes = np.stack([packed((number >> k & 1).astype(np.uint8)) for k in range(bits)], axis=1)
    n = len(vectors)
    return Anchors(table["vec_id"].to_numpy(), table["label"].to_numpy(), vectors, planes, low, step,
                   number.sum(axis=1), np.sqrt((turned * turned).sum(axis=1)), np.sqrt((missed * missed).sum(axis=1)),
                   np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64))


class Rows(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    code: np.ndarray
    aligned: np.ndarray
    size: np.ndarray
    rest: np.ndarray


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Rows]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            n = part.num_rows
            lists = (part.column(c).flatten().to_numpy().reshape(n, -1) for c in ("vector", "code", "aligned"))
            yield Rows(*(part.column(c).to_numpy() for c in ("vec_id", "label")), *lists,
                       *(part.column(c).to_numpy() for c in ("size", "rest")))


def intervals(anchors: Anchors, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of each anchor with each row."""
    size, levels, words = anchors.vectors.shape[1], rows.aligned.shape[1], anchors.planes.shape[2]
    code = rows.code.view(np.uint64).reshape(len(rows.ids), levels, words)
    about = np.zeros((len(anchors.ids), len(rows.ids)))
    for level in range(levels):
        own = code[:, level]
        counted = np.zeros(about.shape, np.int64)
        for k in range(anchors.planes.shape[1]):
            for word in range(words):
                both = np.bitwise_count(anchors.planes[:, k, word][:, None] & own[None, :, word])
                counted += both.astype(np.int64) << k
        ones = np.bitwise_count(own).sum(axis=1, dtype=np.int64)
        inner = (anchors.step[:, None] * (2 * counted - anchors.total[:, None])
                 + anchors.low[:, None] * (2 * ones - size)[None, :])
        about += inner * (rows.aligned[:, level] / np.sqrt(size))[None, :]
    # the last term is more than what rounding adds
    reach = (rows.rest[None, :] * anchors.size[:, None] + (rows.size + rows.rest)[None, :] * anchors.missed[:, None]
             + 1e-9 * (rows.size[None, :] * anchors.size[:, None]) + 1e-6)
    return about - reach, about + reach


def exact_scores(anchors: Anchors, rows: Rows, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = np.einsum("ij,ij->i", anchors.vectors[a[part]], rows.vectors[r[part]])
    return out


class Best:
    """The best `most` (score, id) of each group, by falling score, then id."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(groups, _LEAST)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = score >= self.floor[group]
        if not better.any():
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group[better]), (self.score, score[better]),
                                                         (self.id, ids[better])))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.most
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        last = place == self.most - 1
        self.floor[group[last]] = score[last]


def _kth(bounds: np.ndarray, most: int) -> np.ndarray:
    """The `most`-th largest of each row, or minus infinity."""
    if bounds.shape[1] < most:
        return np.full(len(bounds), -np.inf)
    return -np.partition(-bounds, most - 1, axis=1)[:, most - 1]


def _tiles(n: int) -> Iterator[slice]:
    for at in range(0, n, ANCHORS):
        yield slice(at, min(at + ANCHORS, n))


def best_positives(anchors: Anchors, rows: Rows, best: Best) -> None:
    """Adds to `best` (a group per anchor) what `rows` has of the anchors' own labels."""
    for tile in _tiles(len(anchors.ids)):
        own = anchors.part(tile)
        low, high = intervals(own, rows)
        fits = (own.labels[:, None] == rows.labels[None, :]) & (own.ids[:, None] != rows.ids[None, :])
        least = np.maximum(best.floor[tile], _kth(np.where(fits, low, -np.inf), best.most))
        a, r = np.nonzero(fits & (high >= least[:, None]))
        best.add(a + tile.start, exact_scores(own, rows, a, r), rows.ids[r])


def best_negatives(anchors: Anchors, rows: Rows, best: Best, bounds: tuple[int, int]) -> None:
    """Adds to `best` (a group per anchor and positive) the rows of other labels whose score lies in the range."""
    slots = anchors.scores.shape[1]
    for tile in _tiles(len(anchors.ids)):
        own = anchors.part(tile)
        low, high = intervals(own, rows)
        differs = own.labels[:, None] != rows.labels[None, :]
        # 100 * score >= LOW * positive, 100 * score <= HIGH * positive, in whole numbers
        bottom, top = -((-bounds[0] * own.scores) // 100), bounds[1] * own.scores // 100
        floors = best.floor.reshape(-1, slots)[tile]
        asked = np.zeros(differs.shape, bool)
        for k in range(slots):
            sure = differs & (low >= bottom[:, k, None]) & (high <= top[:, k, None])
            least = np.maximum(np.maximum(bottom[:, k], floors[:, k]), _kth(np.where(sure, low, -np.inf), best.most))
            asked |= differs & (high >= least[:, None]) & (low <= top[:, k, None]) & (own.positives[:, k, None] >= 0)
        a, r = np.nonzero(asked)
        score, ids = exact_scores(own, rows, a, r), rows.ids[r]
        for k in range(slots):
            inside = (score >= bottom[a, k]) & (score <= top[a, k]) & (own.positives[a, k] >= 0)
            best.add((a[inside] + tile.start) * slots + k, score[inside], ids[inside])


def _search(shared, most: int, size: int, names: list[str], step: Callable[[Anchors, Rows, Best], None], groups: int,
            named: Callable[[Anchors, np.ndarray], list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, anchors = Best(groups, most), shared.value
        for rows in _rows(batches, size):
            step(anchors, rows, best)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int64()) for x in named(anchors, best.group)), pa.array(best.id), pa.array(best.score)],
            names)

    return run


def _ranked(found: DataFrame, keys: list[str], score: str, id_: str, most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id_)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mined_block(table: DataFrame, asked: DataFrame, size: int, positives: int, negatives: int, bounds: tuple[int, int],
                bits: int) -> DataFrame | None:
    """Negatives of one block of anchors; None if it is empty."""
    spark = table.sparkSession
    block = asked.select("vec_id", "label", "vector").orderBy("vec_id").toArrow()
    if not block.num_rows:
        return None
    anchors = prepared(block, size, bits)
    first = _search(spark.sparkContext.broadcast(anchors), positives, size, ["anchor_id", "positive_id", "positive_score"],
                    best_positives, len(anchors.ids), lambda a, group: [a.ids[group]])
    found = table.mapInArrow(first, "anchor_id long, positive_id long, positive_score long")
    # at most `positives` rows per anchor of a bounded block
    chosen = (_ranked(found, ["anchor_id"], "positive_score", "positive_id", positives)
              .select("anchor_id", "positive_id", "positive_score", "rank").toArrow())
    place = np.searchsorted(anchors.ids, chosen["anchor_id"].to_numpy())
    # ids may be negative, so a slot's place in the block tells that it is filled
    filled, ids, scores = (np.full((len(anchors.ids), positives), x, np.int64) for x in (-1, 0, 0))
    slot = chosen["rank"].to_numpy() - 1
    filled[place, slot] = place
    ids[place, slot] = chosen["positive_id"].to_numpy()
    scores[place, slot] = chosen["positive_score"].to_numpy()
    known = spark.sparkContext.broadcast((ids, scores))

    def named(a: Anchors, group: np.ndarray) -> list[np.ndarray]:
        own, k = group // positives, group % positives
        return [a.ids[own], known.value[0][own, k], known.value[1][own, k]]

    second = _search(spark.sparkContext.broadcast(anchors._replace(positives=filled, scores=scores)), negatives, size,
                     ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
                     lambda a, rows, best: best_negatives(a, rows, best, bounds), len(anchors.ids) * positives, named)
    found = table.mapInArrow(second, "anchor_id long, positive_id long, positive_score long, negative_id long, "
                                     "negative_score long")
    return _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   bounds: tuple[int, int] = (LOW, HIGH), scale: float = SCALE, levels: int = LEVELS, bits: int = BITS,
                   block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` has vec_id, label and vector (numbers), `anchor` says which rows are anchors. Of an anchor's `positives` best other
    rows of its label each gets the `negatives` best rows of other labels with
    bounds[0] * positive score <= 100 * score <= bounds[1] * positive score.
    """
    spark = rows.sparkSession
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        "vector").where("vec_id IS NOT NULL AND label IS NOT NULL")
    known, size = _vectors.of_one_length(_vectors.usable(known, "vector"), "vector")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size:
        return spark.createDataFrame([], schema)
    if not known.groupBy("vec_id").count().where("count > 1").isEmpty():
        known = (known.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("first"))
                 .select("vec_id", "first.label", "first.vector"))
    table = coded(known, size, scale, levels)
    asked = table.where(anchor)
    blocks = max(1, -(-asked.count() // block))
    path = scratch_path(spark, "negatives")
    for number in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number) if blocks > 1 else asked
        found = mined_block(table, own, size, positives, negatives, bounds, bits)
        if found is not None:
            found.select(columns).write.mode("append").parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
