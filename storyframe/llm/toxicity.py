"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence is what stands between `.`, `!`, `?` or \\n; its words are runs of bytes other than white space and ASCII
punctuation, with A-Z lower-cased. Its features are its distinct words and, as words are inflected, their beginnings of 4
to 8 bytes. A sentence is toxic with p = sigmoid(bias + sum of the weights of its features), and a document with 1 - prod(1 - p), the noisy-or of its sentences. Weights and bias are fitted to document labels by
gradient descent on the log-likelihood, with a penalty on squared weights. Only features that tell the labels
apart take part: those whose likelihood ratio over documents is at least `LEAST_RATIO`. The sentences with the highest p are the
offending ones.

Fitting reads a bounded sample, at most `max_docs` labelled rows of each label in hash order of their ids. All labelled
rows are counted, and each sampled row weighs in the likelihood as much as its label does among all of them, so the share of
toxic rows the model expects does not depend on the bound. Likelihood ratios and first weights compare rates within
labels, where the drawn share cancels out. Scoring reads whole texts, task by task, with a table of at most `max_words`
weights.

Defined cases: null texts are empty and, as texts without words, score 0. Without labelled rows of both kinds the model
knows only the share of toxic rows: words weigh nothing. Of several labels for a doc_id the highest holds; null labels
are none. Repeated rows are scored each. A null doc_id has no label. Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.llm import _text as T
from storyframe.session import cut_lineage

MAX_DOCS = 3000
MAX_WORDS = 1 << 16
LEAST_RATIO = 10.0
STEPS, RATE, PENALTY = 200, 0.05, 1e-4
BEGINNINGS = (4, 5, 6, 7, 8)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True
_GAP = T.SPACE.copy()
_GAP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Model(NamedTuple):
    """Hashes of features in order, their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def _sentences(column: pa.Array) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """Words of the texts, the sentence of each word, numbered over all texts, and the text of each sentence."""
    found = T.words(column, space=_GAP)
    breaks = np.cumsum(_BREAK[found.data])[found.start] if len(found.start) else np.zeros(0, np.int64)
    new = np.ones(len(found.start), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (found.text[1:] != found.text[:-1])
    return found, np.cumsum(new) - 1, found.text[new]


def _features(found: T.Words, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence and hash of each word and of each beginning of a word."""
    sentences, hashes = [sentence], [found.hash]
    for size in BEGINNINGS:
        long = found.end - found.start > size
        begin = T.spans_hash(found.data, found.start[long], found.start[long] + size)
        sentences.append(sentence[long])
        hashes.append(T.mix(begin ^ T.stream(61, size)[-1]))
    return np.concatenate(sentences), np.concatenate(hashes)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature the documents, and the toxic ones, of a slice that have it."""
    for batch in batches:
        column, toxic = batch.column("text"), batch.column("toxic").to_numpy()
        for a, b in T.slices(column):
            found, sentence, of = _sentences(column.slice(a, b - a))
            owner, feature = _features(found, sentence)
            text, feature, _ = T.bag(of[owner], feature)
            distinct, place = np.unique(feature, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.signed(distinct)), pa.array(np.bincount(place, minlength=len(distinct)).astype(np.int64)),
                 pa.array(np.bincount(place, toxic[a:b][text], len(distinct)).astype(np.int64))],
                ["feature", "seen", "seen_toxic"])


def _examples(words: np.ndarray):
    """Per document its sentences, and its distinct (sentence, place in `words`) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column):
                n = b - a
                found, sentence, of = _sentences(column.slice(a, n))
                s, w = _known(words, *_features(found, sentence))
                offsets = np.searchsorted(of[s], np.arange(n + 1)).astype(np.int32)
                first = np.searchsorted(of, np.arange(n))
                lists = (pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (s - first[of[s]], w))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(a, n), pa.array(np.bincount(of, minlength=n)), *lists],
                    ["toxic", "n_sentences", "sentences", "words"])

    return run


def _known(words: np.ndarray, owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of owner and place in `words`, for the features that are there."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(words, feature), len(words) - 1)
    hit = words[place] == feature
    return T.bag(owner[hit], place[hit])[:2]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, toxic).

    The sample stays with the tasks: at most `max_words` features come to the driver, and which sentences have them.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.join(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id")
    totals = {row["toxic"]: row["count"] for row in known.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    draw = [F.xxhash64("doc_id"), "doc_id"]
    drawn = known.where("toxic = 1").orderBy(*draw).limit(max_docs).union(
        known.where("toxic = 0").orderBy(*draw).limit(max_docs))
    # at most 2 * max_docs ids are broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    sample = cut_lineage(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"))
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n_toxic = n_toxic or 0
    if not 0 < n_toxic < n:
        share = min(max(n_toxic / n if n else 0.0, 1e-4), 1 - 1e-4)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    counts = (sample.mapInArrow(_feature_counts, "feature long, seen long, seen_toxic long").groupBy("feature")
              .agg(F.sum("seen").alias("seen"), F.sum("seen_toxic").alias("seen_toxic")))
    seen_clean = F.col("seen") - F.col("seen_toxic")
    ratio = 2 * (_log_likelihood(F.col("seen_toxic"), n_toxic) + _log_likelihood(seen_clean, n - n_toxic)
                 - _log_likelihood(F.col("seen"), n))
    odds = F.log((F.col("seen_toxic") + 0.5) / (n_toxic + 1.0)) - F.log((seen_clean + 0.5) / (n - n_toxic + 1.0))
    telling = (counts.select("feature", ratio.alias("ratio"), odds.alias("odds")).where(F.col("ratio") >= LEAST_RATIO)
               .orderBy(F.desc("ratio"), "feature").limit(max_words).toArrow())
    words = telling["feature"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, odds = words[order], telling["odds"].to_numpy()[order]
    # rows in a fixed order, so that sums of floats agree between runs
    found = sample.orderBy(F.xxhash64("text"), "toxic").mapInArrow(
        _examples(words), "toxic int, n_sentences long, sentences array<long>, words array<long>").toArrow()
    labelled = sum(totals.values())
    weigh = (totals[0] * n / (labelled * (n - n_toxic)), totals[1] * n / (labelled * n_toxic))
    return _descend(found, words, odds, weigh)


def _log_likelihood(hits: Column, of: int) -> Column:
    share = F.greatest(F.least(hits / of, F.lit(1 - 1e-12)), F.lit(1e-12))
    return hits * F.log(share) + (of - hits) * F.log1p(-share)


def _descend(found: pa.Table, words: np.ndarray, odds: np.ndarray, weigh: tuple[float, float]) -> Model:
    """`weigh`: what a clean and a toxic document count for; over all documents it is 1 on average."""
    toxic = found["toxic"].to_numpy().astype(np.float64)
    weight = np.where(toxic > 0, weigh[1], weigh[0])
    per_doc = found["n_sentences"].to_numpy()
    n, n_words, n_sentences = len(toxic), len(words), int(per_doc.sum())
    of = np.repeat(np.arange(n), per_doc)
    begin = np.cumsum(per_doc) - per_doc
    size = np.array([len(x) for x in found["words"]])
    place = np.concatenate([x.values.to_numpy() for x in found["words"]])
    row = np.concatenate([x.values.to_numpy() for x in found["sentences"]]) + np.repeat(begin, size)
    theta = np.append(odds, np.log((weight * toxic).sum() / max((weight * per_doc).sum(), 1e-9)) - 2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(row, theta[place], n_sentences) + theta[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(of, np.logaddexp(0, z), n))
        slope = p * (weight * (1 - toxic / np.maximum(1 - clean, 1e-9)))[of]
        gradient = np.append(np.bincount(place, slope[row], n_words), slope.sum()) / n
        gradient[:-1] += PENALTY * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    heavy = np.abs(theta[:-1]) > 1e-3
    return Model(words[heavy], theta[:-1][heavy], float(theta[-1]))


def _sentence_odds(column: pa.Array, model: Model):
    """Words, first word of each sentence, text of each sentence, and log-odds of each sentence."""
    found, sentence, of = _sentences(column)
    z = np.full(len(of), model.bias)
    s, w = _known(model.words, *_features(found, sentence))
    z += np.bincount(s, model.weights[w], len(of))
    starts = np.searchsorted(sentence, np.arange(len(of) + 1))
    return found, starts, of, z


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`row` (the whole input row), score, n_sentences, and the span in code points of the most toxic sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column):
                n = b - a
                found, starts, of, z = _sentence_odds(column.slice(a, n), shared.value)
                chance = -np.expm1(-np.bincount(of, np.logaddexp(0, z), n))
                counts = np.bincount(of, minlength=n)
                order = np.lexsort((-np.arange(len(z)), z, of))
                has = counts > 0
                worst = order[np.cumsum(counts)[has] - 1]
                span = np.zeros((2, n), np.int64)
                if len(worst):
                    chars = T.chars_before(found.data, np.arange(len(found.data) + 1))
                    begin = chars[found.offsets[:-1][has]]
                    span[0, has] = chars[found.start[starts[worst]]] - begin
                    span[1, has] = chars[found.end[starts[worst + 1] - 1]] - begin
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, n), pa.array(chance), pa.array(counts), pa.array(span[0]),
                     pa.array(span[1])], ["key", "score", "n_sentences", "worst_start", "worst_end"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, score double, n_sentences long, worst_start long, worst_end long")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score): spans in code points of the sentences with p of at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column):
                found, starts, of, z = _sentence_odds(column.slice(a, b - a), shared.value)
                p = 1 / (1 + np.exp(-z))
                hit = np.flatnonzero(p >= least)
                chars = T.chars_before(found.data, np.arange(len(found.data) + 1))
                begin = chars[found.offsets[of[hit]]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(a + of[hit])),
                     pa.array(chars[found.start[starts[hit]]] - begin),
                     pa.array(chars[found.end[starts[hit + 1] - 1]] - begin), pa.array(p[hit])],
                    ["doc_id", "start", "end", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, start long, end long, score double")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's digits, modulo `parts`; a null id falls in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, limit: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `limit`; labels are learned from rows that are not held out."""
    model = fit(docs.where(~held_out), labels)
    keyed = docs.select(F.struct(*docs.columns).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return score(keyed, model).where(F.col("score") < limit).select(*[F.col("key")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted, ...) per row; labels are learned from rows that are not held out."""
    model = fit(docs.where(~held_out), labels)
    keyed = docs.select(F.struct("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out")).alias("key"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return score(keyed, model).select(
        "key.doc_id", "key.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences",
        "worst_start", "worst_end")
