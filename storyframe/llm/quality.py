"""Quality by attention over passages: passages are encoded, documents are labelled.

A passage is `PASSAGE` words in a row (runs of bytes other than white space), the last one of a text what is left. Its
features are the shares of each ASCII character and of all others among its bytes, and what its words are like: how many, how
long, distinct, repeated, in capitals, without letters, with a mark at the end, at the start of a line. A layer with tanh
encodes them as h. Gated attention gives a passage the weight softmax(w . (tanh(V h) * sigmoid(U h))) among those of
its document, and sigmoid(c . z + b) of the weighted sum z of all h is the score. Encoder, attention and output are fitted together to
document labels by gradient descent on the log-likelihood (Adam, batches of documents, squared weights penalised).
The passages with the highest weights are the ones that decide.

Fitting reads a sample of labelled rows, drawn by the hash of their ids: of each label about `max_docs` documents and
`max_chars` characters at most, of documents of up to `longest` characters. All labelled rows are counted, and a sampled
row weighs in the likelihood as much as its label does among all of them, so scores do not depend on the bound. Scoring
reads whole texts, task by task, and memory follows a slice, or one text if that is longer.

Defined cases: null texts are empty; a text without words is one passage without words and is scored as such. Without labelled
rows of both kinds the score is the share of label 1 among them, one half if there are none. Of several labels
for a doc_id the highest holds; null labels, and those other than 0 and 1, are none. Rows that repeat a doc_id are examples each, with whatever texts they have, and are
scored each; equal texts score the same. A null doc_id has no label. Empty tables give no rows, other columns are ignored. Labels, lang,
source and doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.llm import _text as T

PASSAGE = 64
MAX_DOCS, MAX_CHARS, LONGEST = 3000, 6_000_000, 1 << 20
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, PENALTY = 20, 32, 3e-3, 1e-4
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 11, 15])
_CHARS = 129
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_MARK = ~(_UPPER | _LOWER | _DIGIT | T.SPACE)
_MARK[128:] = False
FEATURES = _CHARS + 10 + len(_LENGTHS)


class Model(NamedTuple):
    """Mean and scale of the features, and the layers."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    shift: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    out: np.ndarray
    bias: float


def _per_word(found: T.Words, of_byte: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.bincount(of_byte[mask], minlength=len(found.start))


def features(column: pa.Array, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage and its text; every text has at least one passage."""
    n = len(column)
    found = T.words(column, lower=False)
    per_text = np.maximum(-(-found.counts // size), 1)
    first = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(n), per_text)
    begin = np.cumsum(found.counts) - found.counts
    words = len(found.hash)
    place = np.arange(words) - begin[found.text]
    passage = first[found.text] + place // size
    out = np.zeros((len(text), FEATURES), np.float32)
    if not words:
        return out, text
    data = found.data
    solid = ~T.SPACE[data]
    at = np.flatnonzero(solid)
    length = found.end - found.start
    of_byte = np.repeat(np.arange(words), length)
    byte = data[at]
    kind = np.minimum(byte, 128).astype(np.int64)
    chars = np.bincount(passage[of_byte] * _CHARS + kind, minlength=len(text) * _CHARS).reshape(-1, _CHARS)
    out[:, :_CHARS] = np.sqrt(chars / np.maximum(chars.sum(axis=1, keepdims=True), 1))
    upper, lower, mark = (_per_word(found, of_byte, table[byte]) for table in (_UPPER, _LOWER, _MARK))
    other = _per_word(found, of_byte, byte >= 128)
    again = np.zeros(words, bool)
    again[1:] = (found.hash[1:] == found.hash[:-1]) & (passage[1:] == passage[:-1])
    pair = T.mix(found.hash + np.append(found.hash[1:], np.uint64(0)) * np.uint64(3))
    new_line = np.zeros(words, bool)
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    new_line[1:] = (breaks[found.start[1:]] > breaks[found.end[:-1]]) & (passage[1:] == passage[:-1])
    counted = np.bincount(passage, minlength=len(text))
    share = 1 / np.maximum(counted, 1)

    def distinct(value: np.ndarray) -> np.ndarray:
        return np.bincount(T.bag(passage, value)[0], minlength=len(text))

    def rate(value: np.ndarray) -> np.ndarray:
        return np.bincount(passage, value, len(text)) * share

    columns = [counted / size, np.log1p(rate(length)), distinct(found.hash) * share, distinct(pair) * share, rate(again),
               rate((upper > 0) & (lower == 0)), rate((upper + lower + other) == 0), rate(_MARK[data[found.end - 1]]),
               rate(mark > 1), rate(new_line)]
    bins = np.searchsorted(_LENGTHS, length, side="right") - 1
    columns += [rate(bins == k) for k in range(len(_LENGTHS))]
    out[:, _CHARS:] = np.stack(columns, axis=1)
    return out, text


def _attended(model: Model, x: np.ndarray, text: np.ndarray, n: int):
    """Encoded passages, both halves of the gate, weights of the passages, weighted sums of the texts."""
    h = np.tanh(x @ model.encode + model.shift)
    left, right = np.tanh(h @ model.tanh), 1 / (1 + np.exp(-(h @ model.gate)))
    force = (left * right) @ model.weigh
    # the largest of a text is taken off, so that no exponential overflows
    starts = np.searchsorted(text, np.arange(n))
    force = np.exp(force - np.maximum.reduceat(force, starts)[text])
    share = force / np.add.reduceat(force, starts)[text]
    return h, left, right, share, np.add.reduceat(share[:, None] * h, starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _gradient(model: Model, x: np.ndarray, text: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Slopes of the weighted log-loss for encode, shift, tanh, gate, weigh, out and bias."""
    h, left, right, share, z = _attended(model, x, text, len(label))
    slope = weight * (_sigmoid(z @ model.out + model.bias) - label) / len(label)
    to_z = slope[:, None] * model.out
    per_passage = to_z[text]
    # softmax: a passage's force counts by how its h differs from the weighted sum
    force = share * ((h - z[text]) * per_passage).sum(axis=1)
    to_left, to_right = force[:, None] * model.weigh * right * (1 - left**2), force[:, None] * model.weigh * left * right * (1 - right)
    to_h = share[:, None] * per_passage + to_left @ model.tanh.T + to_right @ model.gate.T
    inner = to_h * (1 - h**2)
    return [x.T @ inner, inner.sum(axis=0), h.T @ to_left, h.T @ to_right, (left * right).T @ force, z.T @ slope, slope.sum()]


def train(x: np.ndarray, text: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS,
          seed: int = 3) -> Model:
    """A model fitted to passages `x` of the texts `text`, which have a label and a weight each."""
    random = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, np.inf)
    x = ((x - mean) / scale).astype(np.float32)
    size = x.shape[1]
    share = float(np.clip((weight * label).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    parts = [random.standard_normal((size, HIDDEN)) / np.sqrt(size), np.zeros(HIDDEN),
             random.standard_normal((HIDDEN, GATE)) / np.sqrt(HIDDEN), random.standard_normal((HIDDEN, GATE)) / np.sqrt(HIDDEN),
             np.zeros(GATE), random.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.array(np.log(share / (1 - share)))]
    parts = [p.astype(np.float32) for p in parts]
    first, second = ([np.zeros_like(p) for p in parts] for _ in range(2))
    starts = np.searchsorted(text, np.arange(len(label) + 1))
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(label))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            count = starts[chosen + 1] - starts[chosen]
            rows = np.repeat(starts[chosen] - np.cumsum(count) + count, count) + np.arange(count.sum())
            model = Model(mean, scale, *parts)
            slopes = _gradient(model, x[rows], np.repeat(np.arange(len(chosen)), count), label[chosen], weight[chosen])
            step += 1
            for k, slope in enumerate(slopes):
                slope = slope + PENALTY * parts[k] if parts[k].ndim else slope
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                parts[k] = (parts[k] - rate * (first[k] / (1 - 0.9**step))
                            / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, *parts[:-1], float(parts[-1]))


def constant(share: float) -> Model:
    """The model whose score is always `share`."""
    share = min(max(share, 1e-4), 1 - 1e-4)
    return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros((1, 1)),
                 np.zeros((1, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its passages' features, one after the other, in half precision."""
    for batch in batches:
        column = batch.column("text")
        for a, b in T.slices(column):
            x, text = features(column.slice(a, b - a))
            flat, cut = x.astype(np.float16), np.searchsorted(text, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(a, b - a), batch.column("mark").slice(a, b - a),
                 pa.array([flat[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                ["label", "mark", "passages"])


def drawn(docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int, longest: int) -> tuple[DataFrame, dict]:
    """Sampled rows (text, label, mark), and the labelled rows of each label."""
    known = (labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id")
             .agg(F.max(F.col("label").cast("int")).alias("label")))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = F.length("text")
    sizes = (texts.select("doc_id", chars.alias("chars")).join(known, "doc_id").groupBy("label")
             .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("chars") <= longest).alias("short"),
                  F.sum(F.when(F.col("chars") <= longest, F.col("chars"))).alias("chars")).collect())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40))
    part = F.lit(False)
    for row in sizes:
        share = min(1.0, max_docs / max(row["short"], 1), max_chars / max(row["chars"] or 0, 1))
        part |= (F.col("label") == row["label"]) & (draw < int(share * (1 << 40)))
    # about `max_docs` ids of each label
    chosen = F.broadcast(known.where(part))
    sample = texts.where(chars <= longest).join(chosen, "doc_id").select("text", "label", F.xxhash64("text").alias("mark"))
    return sample, {row["label"]: row["rows"] for row in sizes}


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS,
        longest: int = LONGEST) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, label)."""
    sample, totals = drawn(docs, labels, max_docs, max_chars, longest)
    if len(totals) < 2:
        return constant(float(next(iter(totals), 0.5)))
    found = sample.mapInArrow(_examples, "label int, mark long, passages binary").toArrow()
    # in a fixed order, so that runs agree
    label, mark = found["label"].to_numpy(), found["mark"].to_numpy()
    order = np.lexsort((label, mark))
    passages = found["passages"].combine_chunks().take(pa.array(order)).to_pylist()
    label = label[order].astype(np.float32)
    if not 0 < label.sum() < len(label):
        return constant(totals[1] / sum(totals.values()))
    x = np.frombuffer(b"".join(passages), np.float16).reshape(-1, FEATURES).astype(np.float32)
    text = np.repeat(np.arange(len(label)), [len(p) // (2 * FEATURES) for p in passages])
    counts, n = (len(label) - label.sum(), label.sum()), sum(totals.values())
    weigh = [totals[k] / n * len(label) / counts[k] for k in (0, 1)]
    return train(x, text, label, np.where(label > 0, weigh[1], weigh[0]).astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(key, score, n_passages, top_passage, top_weight) of each row of `docs` (key, text).

    top_passage is the number of the passage with the largest weight, from 0, the first of equal ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column):
                n = b - a
                x, text = features(column.slice(a, n))
                *_, share, z = _attended(own, (x - own.mean) / own.scale, text, n)
                starts = np.searchsorted(text, np.arange(n + 1))
                top = np.lexsort((-np.arange(len(share)), share, text))[starts[1:] - 1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, n), pa.array(_sigmoid(z @ own.out + own.bias).astype(np.float64)),
                     pa.array(np.diff(starts)), pa.array(top - starts[:-1]), pa.array(share[top].astype(np.float64))],
                    ["key", "score", "n_passages", "top_passage", "top_weight"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, score double, n_passages long, top_passage long, top_weight double")


def report(docs: DataFrame, labels: DataFrame, held_out: Column, least: float = 0.3, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted, ...) per row; labels (doc_id, label) are learned from rows not held out."""
    held_out = F.coalesce(held_out, F.lit(False))
    model = fit(docs.where(~held_out), labels, **bounds)
    keyed = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return score(keyed, model).select(
        "key.doc_id", "key.held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), "n_passages",
        "top_passage", "top_weight")
