"""Mixing sources to target weights, in blocks of words.

Each source's documents, in a pseudorandom but fixed order, are one stream of words, cut into blocks of `block_words`
(the last one is shorter). A source with target t, size s and n blocks is to fill round(t * n / s) places of the output.

1. The output is cut into shards of `shard_blocks` places, the last one shorter. Every shard draws how many places each
   source fills: the whole part of its share, and a multinomial draw over what the parts left over weigh, so that the totals
   stay near the targets. Sources are drawn in strata of `stratum` sources; how many places a stratum has in a shard is
   fixed by one uniform number per shard, so no task holds more sources than that.
2. The places of a source, counted through all shards, are its indices. Index j takes block p(j mod n), where p is a
   pseudorandom permutation of the source's block numbers, another one for each round j div n. A block is thus taken equally
   often, give or take one. A source drawn beyond `max_repeats` rounds leaves the places behind them empty.
3. Indices and blocks are joined by (source, block).

Targets: sources in order of code points, null last, weigh weights[0], weights[1], ... in turn and share the sum of all
sizes. What exceeds max_repeats times a source's size goes to the others by weight until none exceeds it.

Everything is a function of the rows, the parameters and the seed, so reruns agree. A large source is packed in slices of its
own and its indices are drawn by shard: nothing needs a source in one task. Collected are counts and sums only. The table
of sources is broadcast up to `SMALL_BYTES`; a larger one is joined with its hot keys salted.

Defined cases: null texts have size 0; documents without words are taken 0 times. A null source is a source. Rows with
equal doc_id are documents of their own; repeated rows tie and are packed next to each other. Sources of size 0 get target 0.
An empty table gives no rows. Very long texts lie in many blocks. Columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyframe.llm import _text as T
from storyframe.operators.skew import join_hot, numbered, running_total
from storyframe.session import cut_lineage

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3.0
BLOCK_WORDS = 64
SHARD_BLOCKS = 1 << 14
STRATUM = 4096  # sources that a shard draws together
SHARDS_AT_ONCE = 64  # shards that one row draws
TASK_SHARDS, TASK_SLOTS = 1 << 10, 1 << 17  # shards and slots of a task
SMALL_BYTES = 8 << 20  # of a table of sources that is broadcast
SLICE_DOCS = 1 << 11  # documents that are packed together
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash) per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.xxhash64(text).alias("text_hash"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, number, source_size, docs, weight, target) per source of `sizes` (source, size)."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ordered = per_source.withColumn("last", F.col("source").isNull())
    placed = numbered(ordered, [], ["last", "source"], "number").drop("last")
    turn = F.pmod(F.col("number") - 1, F.lit(len(weights)))
    placed = cut_lineage(placed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                                   (turn + 1).cast("int"))))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    rate = 0.0
    while True:
        # sources above their cap at this rate keep the cap, the others share the rest by weight
        full = cap <= F.col("weight") * F.lit(rate)
        total, capped, free = placed.agg(F.sum("source_size"), F.sum(F.when(full, cap)),
                                         F.sum(F.when(~full, F.col("weight")))).first()
        new = ((total or 0) - (capped or 0.0)) / free if free else rate
        if not free or new <= rate:
            break
        rate = new
    return placed.withColumn("target", F.least(cap, F.col("weight") * F.lit(rate)))


def _attached(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """`rows` joined with a table of one row per source."""
    widths = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in small.schema.fields if f.dataType.typeName() == "string"]
    held = small.agg(F.sum(sum(widths, F.lit(64)))).first()[0] or 0
    if held <= SMALL_BYTES:
        return rows.join(F.broadcast(small), on)
    return join_hot(rows, small, on, right_at_most=1)


def pack(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each document lies in its source: (number, doc_id, size, text_hash, begin), begin counted in words."""
    name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    known = sources.select(name["none"].alias("none"), name["name"].alias("name"), "number",
                           F.ceil(F.col("docs") / SLICE_DOCS).alias("slices"))
    named = sizes.select(name["none"].alias("none"), name["name"].alias("name"), "doc_id", "size", "text_hash")
    placed = _attached(named, known, ["none", "name"]).select(
        "number", "doc_id", "size", "text_hash", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("slices")).alias("slice"))
    slices = placed.groupBy("number", "slice").agg(F.sum("size").alias("words"))
    offsets = running_total(slices, ["number"], ["slice"], "words", "offset").drop("words")
    inside = (Window.partitionBy("number", "slice").orderBy("doc_id", "text_hash")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(offsets, ["number", "slice"])
            .select("number", "doc_id", "size", "text_hash", (F.col("offset") + F.col("inside")).alias("begin")))


def pieces(packed: DataFrame, block_words: int) -> DataFrame:
    """Per block that a document lies in: the document, its first word there and how many."""
    size = F.lit(block_words)
    blocks = F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("begin") + F.col("size") - 1) / size))
    each = packed.where("size > 0").select("*", F.explode(blocks).alias("block"))
    low = F.greatest(F.col("begin"), F.col("block") * size)
    high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * size)
    return each.select("number", "block", "begin", "doc_id", "size", "text_hash", (low - F.col("begin")).alias("first_word"),
                       (high - low).alias("words"))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index under the permutation of range(n) that `key` names: a Feistel network with cycle walking."""
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in T.stream(53, 4):
            left, right = right, left ^ (T.mix(right ^ key[todo] ^ turn) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _drawn(total: int, shards: int, shard_blocks: int, seed: int):
    """Places of each source in shards that are asked for by stratum and first shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number = np.array([m["number"] for m in row["members"]])
                share = np.array([m["slots"] for m in row["members"]], np.float64)
                low, high = row["low"], row["low"] + int(share.sum())
                share /= share.sum()
                for shard in range(row["start"], min(row["start"] + SHARDS_AT_ONCE, shards)):
                    places = min(shard_blocks, total - shard * shard_blocks)
                    turn = np.random.default_rng([seed, shard]).random()
                    begin, end = (places if x == total else int(x * places / total + turn) for x in (low, high))
                    wanted = share * (end - begin)
                    times = np.floor(wanted).astype(np.int64)
                    rest, left = end - begin - int(times.sum()), wanted - times
                    if rest > 0:
                        times += np.random.default_rng([seed, shard, row["stratum"]]).multinomial(
                            rest, left / left.sum() if left.sum() > 0 else share)
                    some = times > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number[some]), pa.array(np.full(some.sum(), shard)), pa.array(times[some])],
                        ["number", "shard", "times"])

    return run


def shard_counts(sources: DataFrame, block_words: int, shard_blocks: int, seed: int, max_repeats: float = MAX_REPEATS,
                 stratum: int = STRATUM) -> DataFrame:
    """(number, n, shard, times, first): the indices `first`, ... `first + times - 1` of a source of n blocks fill a shard."""
    n = F.ceil(F.col("source_size") / block_words)
    planned = cut_lineage(sources.where("source_size > 0").select(
        "number", n.alias("n"), F.round(F.col("target") * n / F.col("source_size")).cast("long").alias("slots"))
        .where("slots > 0"))
    total = planned.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    strata = running_total(planned, [], ["number"], "slots", "low").groupBy(
        F.floor((F.col("number") - 1) / stratum).alias("stratum")).agg(
        F.min("low").alias("low"), F.array_sort(F.collect_list(F.struct("number", "slots"))).alias("members"))
    asked = strata.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(SHARDS_AT_ONCE))).alias("start"))
    drawn = cut_lineage(asked.repartition(-(-shards // TASK_SHARDS), "stratum", "start").mapInArrow(
        _drawn(total, shards, shard_blocks, seed), "number long, shard long, times long"))
    placed = _attached(running_total(drawn, ["number"], ["shard"], "times", "first"), planned.select("number", "n"), ["number"])
    ends = F.floor(F.col("n") * F.lit(float(max_repeats)) + 1e-9)
    return placed.withColumn("times", F.least("times", ends - F.col("first"))).where("times > 0").select(
        "number", "n", "shard", "times", "first")


def slots(sources: DataFrame, block_words: int, shard_blocks: int, seed: int, max_repeats: float = MAX_REPEATS,
          stratum: int = STRATUM) -> DataFrame:
    """(number, slot, shard, block) of the whole mix; a slot is an index of its source."""
    counts = cut_lineage(shard_counts(sources, block_words, shard_blocks, seed, max_repeats, stratum))
    counts_of = counts.columns
    total = counts.agg(F.sum("times")).first()[0] or 0

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, n, shard, times, first in zip(*(batch.column(c).to_pylist() for c in counts_of), strict=True):
                slot = np.arange(first, first + times, dtype=np.int64)
                turn = T.mix((slot // n).astype(np.uint64) ^ T.stream(seed * 1_000_003 + number, 1)[0])
                block = permuted(slot % n, np.full(times, n), turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(times, number)), pa.array(slot), pa.array(np.full(times, shard)), pa.array(block)],
                    ["number", "slot", "shard", "block"])

    return counts.repartition(max(1, -(-total // TASK_SLOTS)), "number", "shard").mapInArrow(
        draw, "number long, slot long, shard long, block long")


def mix_report(docs: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS, block_words: int = BLOCK_WORDS,
               shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) per document; taken: its words in the mix, repeats counted."""
    sources, packed = _planned(docs, weights, max_repeats, block_words)
    drawn = slots(sources, block_words, shard_blocks, seed, max_repeats).groupBy("number", "block").agg(
        F.count(F.lit(1)).alias("times"))
    # (number, begin) tells documents with words apart
    taken = (pieces(packed, block_words).join(drawn, ["number", "block"], "left")
             .groupBy("number", "begin", "doc_id", "size")
             .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")))
    empty = packed.where("size = 0").select("number", "begin", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    known = sources.select("number", "source", "source_size", "target")
    return _attached(taken.union(empty), known, ["number"]).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_spans(docs: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS, block_words: int = BLOCK_WORDS,
              shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> DataFrame:
    """(shard, source, slot, block, doc_id, text_hash, first_word, words): what each slot of the mix is made of."""
    sources, packed = _planned(docs, weights, max_repeats, block_words)
    drawn = slots(sources, block_words, shard_blocks, seed, max_repeats)
    spans = pieces(packed, block_words).join(drawn, ["number", "block"])
    return (_attached(spans, sources.select("number", "source"), ["number"])
            .select("shard", "source", "slot", "block", "doc_id", "text_hash", "first_word", "words"))


def _planned(docs: DataFrame, weights, max_repeats: float, block_words: int):
    sizes = cut_lineage(sized(docs))
    sources = cut_lineage(targets(sizes, weights, max_repeats))
    return sources, cut_lineage(pack(sizes, sources))
