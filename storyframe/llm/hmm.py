"""Hidden Markov language model over words: Baum-Welch training on all training texts, exact likelihood of each text.

Tokens of a text: its words with A-Z lower-cased, then one end. The `classes` most frequent words are symbols of their
own, every other word shares one of `endings` symbols by its last bytes, and the end is a symbol. A hidden state emits a
symbol; a shared symbol then gives the word with chance (c + 1) / (C + V + 1), where c is the word's count in training, C
and V the symbol's tokens and distinct words, and the last 1 stands for all unseen words.

Training: each round, tasks run scaled forward and backward recursions over stretches of at most `STRETCH` tokens of the
training texts and return expected counts of starts, transitions and emissions, which are summed over all tasks. States
begin from random emissions; a few rounds on a bounded sample of stretches pull them apart before the rounds on all data.

Scoring: the scaled forward recursion runs over the whole text, step by step for all texts of a slice at once. Chances
of words in shared symbols are multiplied in. Words are told apart by 64-bit hashes; counts of the `table_words` most
frequent ones are broadcast, all others are joined.

Defined cases: a null text is empty and has one token, the end. Repeated rows count and are scored each. A null doc_id
is in no held-out fold, so it belongs to training. Without training texts all symbols are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.llm import _text as T
from storyframe.session import cut_lineage, scratch_path

STATES = 8
CLASSES = 4096
ENDINGS = 255
TABLE_WORDS = 1 << 18
STRETCH = 128
WARM_STRETCHES, WARM_ROUNDS, ROUNDS = 4096, 12, 3
PRIOR = 20.0  # pseudo-counts per state, spread like the symbols of all states together
HELD = 1 << 20  # distinct words a task holds before it passes counts on
END = T.stream(71, 1)


class Vocabulary(NamedTuple):
    """Hashes of frequent words in order with count and symbol; per shared symbol tokens and distinct words."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    tokens: np.ndarray
    distinct: np.ndarray
    classes: int
    endings: int
    all_tokens: int
    all_words: int

    @property
    def size(self) -> int:
        return self.classes + self.endings + 1


class Model(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _tokens(column: pa.Array, endings: int):
    """Per token, ends included: text, hash, ending (-1 for an end); and tokens per text."""
    found = T.words(column)
    n = len(found.counts)
    span = np.minimum(found.end - found.start, 3)
    ending = (T.spans_hash(found.data, found.end - span, found.end) % np.uint64(endings)).astype(np.int64)
    at = np.cumsum(found.counts)
    return (np.insert(found.text, at, np.arange(n)), np.insert(found.hash, at, END[0]), np.insert(ending, at, -1),
            found.counts + 1)


def _count(endings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged(parts):
            word, ending, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            word, first, place = np.unique(word, return_index=True, return_inverse=True)
            return word, ending[first], np.bincount(place, count, len(word)).astype(np.int64)

        def passed_on(part):
            return pa.RecordBatch.from_arrays([pa.array(T.signed(part[0])), pa.array(part[1]), pa.array(part[2])],
                                              ["word", "ending", "count"])

        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column):
                _, word, ending, _ = _tokens(column.slice(a, b - a), endings)
                held.append(merged([(word, ending, np.ones(len(word)))]))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield passed_on(held[0])
                        held, size = [], 0
        if held:
            yield passed_on(merged(held))

    return run


def count_words(texts: DataFrame, endings: int = ENDINGS) -> DataFrame:
    """(word, ending, count) of every distinct token of `texts` (text)."""
    return cut_lineage(texts.select(F.coalesce("text", F.lit("")).alias("text"))
                       .mapInArrow(_count(endings), "word long, ending long, count long")
                       .groupBy("word").agg(F.first("ending").alias("ending"), F.sum("count").alias("count")))


def vocabulary(counts: DataFrame, classes: int = CLASSES, endings: int = ENDINGS,
               table_words: int = TABLE_WORDS) -> Vocabulary:
    end = int(T.signed(END)[0])
    top = counts.where(F.col("word") != end).orderBy(F.desc("count"), "word").limit(max(table_words, classes)).toArrow()
    word = top["word"].to_numpy().view(np.uint64)
    symbol = np.where(np.arange(len(word)) < classes, np.arange(len(word)), classes + top["ending"].to_numpy())
    tokens, distinct = np.zeros(endings, np.int64), np.zeros(endings, np.int64)
    own = pa.table({"word": top["word"].slice(0, classes)})
    named = counts.sparkSession.createDataFrame(own) if own.num_rows else counts.select("word").limit(0)
    # sums per shared symbol over all words without a symbol of their own
    rest = counts.where(F.col("word") != end).join(F.broadcast(named), "word", "left_anti")
    for row in rest.groupBy("ending").agg(F.sum("count"), F.count(F.lit(1))).collect():
        tokens[row[0]], distinct[row[0]] = row[1], row[2]
    total = counts.agg(F.sum("count"), F.count(F.lit(1))).first()
    ends = counts.where(F.col("word") == end).agg(F.sum("count")).first()[0] or 0
    word = np.append(word, END)
    order = np.argsort(word)
    return Vocabulary(word[order], np.append(top["count"].to_numpy(), ends)[order],
                      np.append(symbol, classes + endings)[order], tokens, distinct, classes, endings,
                      total[0] or 0, total[1])


def _encode(known: Vocabulary, word: np.ndarray, ending: np.ndarray):
    """Symbol of each token, its count, and whether the table has it."""
    place = np.minimum(np.searchsorted(known.words, word), len(known.words) - 1)
    hit = known.words[place] == word
    symbol = np.where(hit, known.symbols[place], known.classes + ending)
    return symbol, np.where(hit, known.counts[place], 0), hit


def _stretches(shared):
    """Training texts as symbols: one row per stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column):
                _, word, ending, counts = _tokens(column.slice(a, b - a), known.endings)
                symbol, _, _ = _encode(known, word, ending)
                begin = np.cumsum(counts) - counts
                pieces = -(-counts // STRETCH)
                owner = np.repeat(np.arange(len(counts)), pieces)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                cut = np.append(begin[owner] + place * STRETCH, len(symbol)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(cut), pa.array(symbol.astype(np.int32)))], ["symbols"])

    return run


def _expected(symbols: np.ndarray, cut: np.ndarray, model: Model):
    """Expected starts, transitions and emissions of stretches, by scaled forward and backward recursions."""
    length = np.diff(cut)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], cut[:-1][order]
    n, k, steps = len(length), len(model.start), int(length[0]) if len(length) else 0
    emit = np.ascontiguousarray(model.emit.T)
    width = np.searchsorted(-length, -np.arange(steps), side="left")
    forward, shown = [], []
    state = None
    for t in range(steps):
        w = width[t]
        shown.append(symbols[begin[:w] + t])
        state = (model.start if t == 0 else state[:w] @ model.move) * emit[shown[-1]]
        state = state / state.sum(axis=1, keepdims=True)
        forward.append(state)
    counted = np.zeros((model.emit.shape[1], k))
    moves = np.zeros((k, k))
    back = np.ones((n, k))
    for t in range(steps - 1, -1, -1):
        w = width[t]
        held = forward[t] * back[:w]
        held /= held.sum(axis=1, keepdims=True)
        for i in range(k):
            counted[:, i] += np.bincount(shown[t], held[:, i], len(counted))
        if t:
            pull = emit[shown[t]] * back[:w]
            before = forward[t - 1][:w]
            scale = ((before @ model.move) * pull).sum(axis=1, keepdims=True)
            moves += model.move * (before.T @ (pull / scale))
            back[:w] = pull @ model.move.T
            back[:w] /= back[:w].sum(axis=1, keepdims=True)
    return held.sum(axis=0) if steps else np.zeros(k), moves, counted.T


def _expect(shared):
    """A task's expected counts, as (part, state, values): emissions in pieces, transitions and starts whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            lists = batch.column("symbols")
            flat, cut = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            got = _expected(flat, cut - cut[0], shared.value)
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is None:
            return
        start, moves, emissions = total
        state, symbol = np.nonzero(emissions)
        k = len(start)
        # symbols from 0 on; -1 - j is a transition to j; -1 - k a start
        index = np.concatenate((symbol, np.tile(-1 - np.arange(k), k), np.full(k, -1 - k)))
        states = np.concatenate((state, np.repeat(np.arange(k), k), np.arange(k)))
        value = np.concatenate((emissions[state, symbol], moves.ravel(), start))
        yield pa.RecordBatch.from_arrays([pa.array(states), pa.array(index), pa.array(value)],
                                         ["state", "index", "value"])

    return run


def _maximised(start: np.ndarray, moves: np.ndarray, emissions: np.ndarray) -> Model:
    shared = (emissions.sum(axis=0) + 0.1) / (emissions.sum() + 0.1 * emissions.shape[1])
    emit = emissions + PRIOR * shared
    return Model((start + 1) / (start + 1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True),
                 emit / emit.sum(axis=1, keepdims=True))


def train(stretches: DataFrame, symbols: int, states: int = STATES, warm: int = WARM_ROUNDS, rounds: int = ROUNDS,
          seed: int = 1) -> Model:
    """`stretches` (symbols array<int>) is read once per round; bounded sums come back to the driver."""
    random = np.random.default_rng(seed)
    sample = stretches.orderBy(F.xxhash64("symbols"), "symbols").limit(WARM_STRETCHES).toArrow()["symbols"]
    lists = sample.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    flat = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int32)
    cut = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)
    base = np.bincount(flat, minlength=symbols) + 0.1
    emissions = base * random.gamma(2.0, 1.0, (states, symbols))
    model = _maximised(np.ones(states), np.eye(states) * 20 + 1, emissions)
    for _ in range(warm if len(flat) else 0):
        model = _maximised(*_expected(flat, cut - cut[0], model))
    context = stretches.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(model)
        sums = (stretches.mapInArrow(_expect(shared), "state long, index long, value double")
                .groupBy("state", "index").agg(F.sum("value").alias("value")).toArrow())
        state, index, value = (sums[c].to_numpy() for c in ("state", "index", "value"))
        start, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols))
        is_start, is_move = index == -1 - states, (index < 0) & (index > -1 - states)
        start[state[is_start]] = value[is_start]
        moves[state[is_move], -1 - index[is_move]] = value[is_move]
        emissions[state[index >= 0], index[index >= 0]] = value[index >= 0]
        model = _maximised(start, moves, emissions)
        shared.unpersist()
    return model


def log_likelihood(symbols: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    """Natural log of the chance of each text's symbols, by the scaled forward recursion."""
    order = np.argsort(-counts, kind="stable")
    length, begin = counts[order], (np.cumsum(counts) - counts)[order]
    steps = int(length[0]) if len(length) else 0
    width = np.searchsorted(-length, -np.arange(steps), side="left")
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(length))
    state = np.tile(model.start, (len(length), 1))
    for t in range(steps):
        w = width[t]
        state = (state if t == 0 else state[:w] @ model.move) * emit[symbols[begin[:w] + t]]
        scale = state.sum(axis=1)
        total[:w] += np.log(scale)
        state /= scale[:, None]
    out = np.empty(len(length))
    out[order] = total
    return out


def score(docs: DataFrame, counts: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """`key`, n_tokens, n_known, base_score and score for each row of `docs` (key, text)."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((known, model))
    kind = docs.schema["key"].dataType.simpleString()
    base_rate = np.log10(known.all_tokens + 1.0 * (known.all_words + 1))
    symbol_rate = np.log10(known.tokens + known.distinct + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column, 4 * T.SLICE_BYTES):
                n = b - a
                text, word, ending, sizes = _tokens(column.slice(a, n), known.endings)
                symbol, count, hit = _encode(known, word, ending)
                common = symbol >= known.classes
                common &= symbol < known.classes + known.endings
                seen = np.log10(count + 1.0)
                model_part = log_likelihood(symbol, sizes, model) / np.log(10)
                model_part -= np.bincount(text[common], symbol_rate[symbol[common] - known.classes], n)
                model_part += np.bincount(text[common], seen[common], n)
                base = np.bincount(text, seen, n) - sizes * base_rate
                rare_text, rare, times = T.bag(text[~hit], word[~hit])
                cut = np.searchsorted(rare_text, np.arange(n + 1)).astype(np.int32)
                rare_lists = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(
                    [pa.array(T.signed(rare)), pa.array(times)], ["word", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, n), batch.column("text_hash").slice(a, n), pa.array(sizes),
                     pa.array(np.bincount(text, count > 0, n).astype(np.int64)), pa.array(base), pa.array(model_part),
                     rare_lists], ["key", "text_hash", "n_tokens", "n_known", "base_score", "score", "rare"])

    scored = cut_lineage(docs.select("key", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text")).mapInArrow(run, f"key {kind}, text_hash long, n_tokens long, n_known long, "
                                                         "base_score double, score double, "
                                                         "rare array<struct<word:long,times:long>>"))
    rare = scored.where(F.size("rare") > 0)
    # equal texts share one sum, so copies are joined once
    words = (rare.groupBy("text_hash").agg(F.first("rare").alias("rare"))
             .select("text_hash", F.explode("rare").alias("r")).select("text_hash", "r.word", "r.times"))
    sums = (words.join(counts.select("word", "count"), "word").groupBy("text_hash")
            .agg(F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("more"), F.sum("times").alias("found")))
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return scored.drop("rare").join(sums, "text_hash", "left").select(
        "key", "n_tokens", (F.col("n_known") + found).alias("n_known"), (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"))


def report(docs: DataFrame, held_out: Column, states: int = STATES, classes: int = CLASSES, endings: int = ENDINGS,
           table_words: int = TABLE_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; trains on rows not held out."""
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    training = docs.where(~held).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = count_words(training, endings)
    known = vocabulary(counts, classes, endings, table_words)
    path = scratch_path(spark, "stretches")
    training.mapInArrow(_stretches(spark.sparkContext.broadcast(known)), "symbols array<int>").write.parquet(path)
    model = train(spark.read.schema("symbols array<int>").parquet(path), known.size, states, rounds=rounds)
    keyed = docs.select(F.struct("doc_id", held.alias("held_out")).alias("key"), "text")
    return score(keyed, counts, known, model).select(
        "key.doc_id", "key.held_out", "n_tokens", "n_known", F.lit(known.all_tokens).cast("long").alias("train_tokens"),
        "base_score", "score")
