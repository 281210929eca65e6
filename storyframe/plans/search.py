"""Search of many queries in a catalogue through an index of trigrams.

The index lists for each run of up to three characters the rows that hold it, in blocks of rows by the hash of their key: a
list is places in a block, as bits or as numbers, whichever is shorter. A query is looked up by its rarest runs, but not by one
that is much more frequent than the first: rows must be listed under each of them, and only those are compared with all its
words. A word of one or two characters is a run itself, so no length needs a scan. Lists are met within their block, where every
query comes by, so no list and no pair of a query and a row that it may find is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3
# Runs of a query that are looked up, at most, and how many times the rows of the rarest one the others may have.
RAREST = 3
MORE = 2
# Rows of a block of the index, about, and pairs in one batch that a task gives.
BLOCK_ROWS = 20_000
PAIRS = 100_000
# What a task gets of a block, in this order.
_LIST, _TEXT, _QUERY = 0, 1, 2


def _runs(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of `sizes` characters of a text."""
    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))

    parts = [of(size) for size in sizes]
    return F.array_distinct(F.filter(F.concat(*parts), lambda run: run != ""))


def index(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`block, run, n, places, <key>`: which rows hold which run in some field, in lower case; all are listed under the empty run.

    A list has a `run`, the number `n` of its rows and their `places` in the block, a row without a run tells the key at place
    `n`. Rows without a key are left out.
    """
    spark = rows.sparkSession
    given = rows.filter(F.col(key).isNotNull())
    blocks = given.count() // BLOCK_ROWS + 1
    dealt = given.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), key, *[
        F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"__{i}") for i, f in enumerate(fields)])
    tasks = min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = dealt.repartition(tasks, "block").sortWithinPartitions("block", key)
    found = [_runs(F.col(f"__{i}"), list(range(1, LONGEST + 1))) for i in range(len(fields))]
    every = F.array_union(F.array(F.lit("")), F.array_distinct(F.concat(*found)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            for number, part in _parts(batch, ["block"]):
                if held and number[0] != block:
                    yield from _lists(block, pa.Table.from_batches(held).combine_chunks(), key)
                    held = []
                block = number[0]
                held.append(part)
        if held:
            yield from _lists(block, pa.Table.from_batches(held).combine_chunks(), key)

    type_ = rows.schema[key].dataType.simpleString()
    return ordered.select("block", key, every.alias("runs")).mapInArrow(
        packed, f"block bigint, run string, n bigint, places binary, `{key}` {type_}")


def _parts(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """A batch in parts of equal numbers in `columns` that follow each other."""
    if not batch.num_rows:
        return
    values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
    cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        yield tuple(values[:, begin].tolist()), batch.slice(begin, end - begin)


def _lists(block: int, rows: pa.Table, key: str) -> Iterator[pa.RecordBatch]:
    """The lists of a block and the keys at its places, from its rows in order of their keys. Rows of one key share a place."""
    keys, runs = (rows.column(c).combine_chunks() for c in (key, "runs"))
    keys, runs = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (keys, runs))
    new = np.ones(len(keys), bool)
    new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    size = int(new.sum())
    place = np.repeat(np.cumsum(new) - 1, pc.list_value_length(runs).to_numpy(zero_copy_only=False))
    coded = runs.flatten().dictionary_encode()
    both = np.sort(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * size + place)
    code, place = both // size, both % size
    cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    names = ["block", "run", "n", "places", key]
    counts, places = [], []
    for begin, end in zip(cuts, cuts[1:], strict=False):
        counts.append(end - begin)
        places.append(_written(place[begin:end], size))
    yield pa.RecordBatch.from_arrays([
        pa.array([block] * len(counts), pa.int64()), coded.dictionary.take(pa.array(code[cuts[:-1]])), pa.array(counts, pa.int64()),
        pa.array(places, pa.binary()), pa.nulls(len(counts), keys.type)], names)
    yield pa.RecordBatch.from_arrays([
        pa.array([block] * size, pa.int64()), pa.nulls(size, pa.string()), pa.array(np.arange(size)),
        pa.nulls(size, pa.binary()), keys.take(pa.array(np.flatnonzero(new)))], names)


def _written(places: np.ndarray, size: int) -> bytes:
    """Places below `size` in order, as bits or as numbers; the first byte tells which, and whether some come several times."""
    again = bool((places[1:] == places[:-1]).any())
    width = 2 if size <= 1 << 16 else 4
    if again or len(places) * width * 8 < size:
        return bytes([width + 8 * again]) + places.astype(f"<u{width}").tobytes()
    bits = np.zeros(size, bool)
    bits[places] = True
    return b"\0" + np.packbits(bits).tobytes()


def _read(places: bytes) -> np.ndarray:
    data, width = np.frombuffer(places, np.uint8, offset=1), places[0] & 7
    return data.view(f"<u{width}").astype(np.int64) if width else np.flatnonzero(np.unpackbits(data))


def words(query: Column) -> Column:
    """The distinct words of a query in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != ""))


def normal(query: Column) -> Column:
    """The words of a query in order with a blank between them; queries that are equal in this form find the same rows."""
    return F.array_join(F.array_sort(words(query)), " ")


def _query_runs(found: Column) -> Column:
    """What a row must be listed under: the trigrams of longer words, shorter words, or the empty run without any words."""
    own = F.flatten(F.transform(found, lambda w: F.when(F.length(w) <= LONGEST, F.array(w)).otherwise(_runs(w, [LONGEST]))))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(own))


def search(queries: DataFrame, rows: DataFrame, postings: DataFrame, key: str, fields: list[str],
           rarest: int = RAREST) -> DataFrame:
    """`query_id, <key>`: rows in which every word of a query is part of some field, in any case.

    `queries` has `query_id` and `query`, one row per id; `postings` is the `index` of `rows`, best a written table. Rows of one
    block are in one task, with the queries one after the other.
    """
    spark = rows.sparkSession
    asked = queries.select("query_id", words(F.col("query")).alias("words"))
    runs = asked.select("query_id", "words", F.explode(_query_runs(F.col("words"))).alias("run"))
    # how many rows each run of the queries is listed for
    held = postings.join(runs.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.sum("n").alias("n"))
    chosen = runs.join(held, "run", "left").groupBy("query_id", "words").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))), 1, rarest).alias("runs"))
    rare = F.filter("runs", lambda r: r["n"] <= MORE * F.get("runs", F.lit(0))["n"])
    # a run that no row holds has no rows in any block
    wanted = chosen.filter(F.get("runs", F.lit(0))["n"] > 0).select("query_id", "words", rare["run"].alias("runs"))
    text = F.concat_ws("\n", *[F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    # the index has each key once
    directory = postings.filter("run IS NULL").select("block", F.col("n").alias("place"), key).hint("merge")
    texts = directory.join(rows.select(key, text.alias("text")), key)
    # one row for many thousand rows of the catalogue
    blocks = postings.select("block").distinct().hint("broadcast")
    kinds = {f.name: f.dataType.simpleString() for f in (queries.schema["query_id"], rows.schema[key])}
    shape = {"block": "bigint", "kind": "int", "place": "bigint", "run": "string", "places": "binary", "text": "string",
             "words": "array<string>", "runs": "array<string>", "found": kinds[key], "query_id": kinds["query_id"]}

    def part(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
        own = {"kind": F.lit(kind), **columns}
        return df.select(*[own.get(c, F.col(c) if c in df.columns and c != "found" else F.lit(None)).cast(t).alias(c)
                           for c, t in shape.items()])

    every = part(postings.filter("run IS NOT NULL"), _LIST, place=F.lit(0)).unionByName(
        part(texts, _TEXT, found=F.col(key))).unionByName(part(wanted.crossJoin(blocks), _QUERY, place=F.lit(0)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = every.repartition(tasks, "block").sortWithinPartitions("block", "kind", "place")
    return ordered.mapInArrow(_judged, f"query_id {kinds['query_id']}, found {kinds[key]}").withColumnRenamed("found", key)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries and the keys of the rows that hold all their words, from blocks in order, each of which is held at a time."""
    block, at = None, None
    for batch in batches:
        for (number, kind), part in _parts(batch, ["block", "kind"]):
            if number != at:
                block, at = _Block(), number
            if kind == _LIST:
                block.lists.update(zip(part.column("run").to_pylist(), part.column("places").to_pylist(), strict=True))
            elif kind == _TEXT:
                block.texts += part.column("text").to_pylist()
                block.places.append(part.column("place").to_numpy(zero_copy_only=False))
                block.keys.append(part.column("found"))
            else:
                yield from block.answers(part)


class _Block:
    """Lists and texts of some rows."""

    def __init__(self) -> None:
        self.lists: dict[str, bytes] = {}
        self.texts: list[str] = []
        self.places: list[np.ndarray] = []
        self.keys: list[pa.Array] = []

    def answers(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        if len(self.keys) > 1:
            self.keys, self.places = [pa.concat_arrays(self.keys)], [np.concatenate(self.places)]
        self.size = int(_read(self.lists[""])[-1]) + 1
        self.whole = np.array_equal(self.places[0], np.arange(self.size))
        ids, met, n = [], [], 0
        asked = zip(*(queries.column(c).to_pylist() for c in ("words", "runs")), strict=True)
        for i, (words, runs) in enumerate(asked):
            found = self.holding(words, runs)
            if len(found):
                ids.append(i)
                met.append(found)
                n += len(found)
            if n >= PAIRS:
                yield self.pairs(queries, ids, met)
                ids, met, n = [], [], 0
        if n:
            yield self.pairs(queries, ids, met)

    def pairs(self, queries: pa.RecordBatch, ids: list[int], met: list[np.ndarray]) -> pa.RecordBatch:
        which = np.repeat(ids, [len(x) for x in met])
        return pa.RecordBatch.from_arrays([queries.column("query_id").take(pa.array(which)),
                                           self.keys[0].take(pa.array(np.concatenate(met)))], ["query_id", "found"])

    def holding(self, words: list[str], runs: list[str]) -> np.ndarray:
        """Numbers of the texts that hold all the words, among those listed under all the runs."""
        lists = [self.lists.get(run) for run in runs]
        if any(x is not None and x[0] & 8 for x in lists):
            # A key of several rows is taken if it is listed as often as there are runs.
            counts = sum(np.bincount(_read(x), minlength=self.size) for x in lists if x is not None)
            listed = np.flatnonzero(counts == len(runs))
        elif None in lists:
            return np.zeros(0, np.int64)
        else:
            first, *others = sorted(lists, key=len)
            listed = _read(first)
            for other in others:
                has = np.zeros(self.size, bool)
                has[_read(other)] = True
                listed = listed[has[listed]]
            # a short word that is a run of its own is in what the run lists
            words = [w for w in words if w not in runs]
        if not self.whole:
            has = np.zeros(self.size, bool)
            has[listed] = True
            listed = np.flatnonzero(has[self.places[0]])
        if not words or not len(listed):
            return listed
        texts, left = self.texts, listed.tolist()
        for word in words:
            left = [i for i in left if word in texts[i]]
        return np.array(left, np.int64)
