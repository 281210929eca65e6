"""Repeated passages: stretches of text that several documents share, exactly or nearly.

Paragraphs here are windows of `WINDOW` words that begin at winnowed words: of any `GAP` words in a row, the one with the
smallest hash begins a window. So a passage of WINDOW + GAP words has at least one window at the same words in every
document, wherever it stands, and lines and sentences do not matter.

1. Equal windows are one item, told apart by a hash of their words. The MinHash of an item's five-word shingles is banded with
   few registers per band, for high recall; items that share a key and whose shingles have an exact Jaccard likeness of at least
   0.8 are linked, and links join items to classes.
2. Every window is held against the first document that has the same item, or else, if it is that document's own, against the
   first document of its class. Windows of a document that lie as far from their counterparts in the same document are
   one run. Only at the two ends of a run are words compared: it is extended by ungapped agreement, in which a differing
   word costs five agreeing ones, by at most `reach` words. Runs of fewer than `MIN_WORDS` words are no passages.
3. A passage is what runs of a document cover without a gap: all its words stand in a smaller doc_id. What the first document
   of a class shares with others is reported as kept.

Texts are not shuffled for the search: only holders of items that share keys, and documents with ends of runs, are fetched. No
item is compared with more than the items that share its keys, and no window with more than one other.

Defined cases: null texts are empty. A text shorter than a window has none. Copies of a document share all passages. A
passage repeated within one document only is no repeat across documents and stays unmentioned. A document is a row's
doc_id; rows with a null doc_id are left out, as they cannot be told apart, and rows that repeat a doc_id count as one document,
of which each text is searched. Of several places in a document with the same item, the first is the counterpart. Long texts
are read whole. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyframe.llm import _linking
from storyframe.llm import _text as T

WINDOW, GAP = 24, 27
MIN_WORDS = 50
SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 3, 2
COST = 5


def anchors(found: T.Words, window: int, gap: int) -> np.ndarray:
    """Indices of the words that begin a window: the smallest hash of each `gap` starts in a row, the first if equal."""
    n = len(found.hash)
    begin = np.cumsum(found.counts) - found.counts
    last = (begin + found.counts - window)[found.text]
    place = np.arange(n)
    open_ = place <= last
    # mixed with the next word, so frequent words do not all begin windows
    value = T.mix(found.hash + np.append(found.hash[1:], np.uint64(0)) * np.uint64(3)) >> np.uint64(1)
    value = np.where(open_, value, np.uint64(2**63))
    reach = n - gap + 1
    chosen = np.zeros(n, bool)
    if reach > 0:
        inside = (found.text[:reach] == found.text[gap - 1:]) & open_[gap - 1:]
        least = np.where(inside, _sliding(value, gap, np.minimum), 0)
        # what is the least of a reach is the largest of the least of all reaches it stands in
        around = np.concatenate((np.zeros(gap - 1, np.uint64), least, np.zeros(gap - 1, np.uint64)))
        at = np.flatnonzero(open_ & (value == _sliding(around, gap, np.maximum)))
        chosen[at[_first(value[at], at, around, gap)]] = True
    # texts with fewer starts than `gap`: one window at the smallest
    starts = found.counts - window + 1
    for text in np.flatnonzero((starts > 0) & (starts < gap)):
        chosen[begin[text] + value[begin[text]:begin[text] + starts[text]].argmin()] = True
    return np.flatnonzero(chosen)


def _sliding(value: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """The least or largest of each `size` values in a row."""
    width = 1
    while width < size:
        step = min(width, size - width)
        value, width = pick(value[:-step], value[step:]), width + step
    return value


def _first(value: np.ndarray, at: np.ndarray, around: np.ndarray, gap: int) -> np.ndarray:
    """Which of the places `at` come first among equal values in some reach whose least they are."""
    order = np.lexsort((at, value))
    tied = np.zeros(len(at), bool)
    tied[1:] = (value[order][1:] == value[order][:-1]) & (at[order][1:] - at[order][:-1] < gap)
    out = np.ones(len(at), bool)
    for k in range(0, int(tied.sum()), 1 << 14):
        later = np.flatnonzero(tied)[k:k + (1 << 14)]
        here, before = at[order[later]], at[order[later - 1]]
        # the reaches that begin behind the one before, `gap` - 1 further on in `around`
        starts = here[:, None] - np.arange(gap)
        alone = (starts > before[:, None]) & (around[starts + gap - 1] == value[order[later]][:, None])
        out[order[later]] = alone.any(axis=1)
    return out


def _shingle_matrix(found: T.Words, at: np.ndarray, window: int, size: int) -> np.ndarray:
    weight = T.stream(11, size)
    total = np.zeros(len(found.hash), np.uint64)
    for k in range(size):
        total[:max(len(total) - k, 0)] += found.hash[k:] * weight[k]
    return T.mix(total)[at + np.arange(window - size + 1)[:, None]]


def window_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of the bands of windows, which are the columns of `shingles`."""
    keys = np.zeros((bands, shingles.shape[1]), np.uint64)
    factor = T.stream(113, bands * rows) | np.uint64(1)
    for band in range(bands):
        for row in range(rows):
            k = band * rows + row
            keys[band] += T.mix((shingles * factor[k]).min(axis=0)) * factor[k]
    return T.signed(T.mix(keys + T.stream(127, bands)[:, None]))


def _items(found: T.Words, at: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words of each window."""
    total = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(T.stream(131, window)):
        total += found.hash[at + k] * factor
    return T.mix(total)


def _windows(window: int, gap: int, bands: int, rows: int):
    """Per window its item and first word, and with bands its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column):
                found = T.words(column.slice(a, b - a))
                at = anchors(found, window, gap)
                owner = batch.column("doc_id").take(pa.array(a + found.text[at]))
                item = pa.array(T.signed(_items(found, at, window)))
                word = (at - (np.cumsum(found.counts) - found.counts)[found.text[at]]).astype(np.int32)
                keys = window_keys(_shingle_matrix(found, at, window, SHINGLE), bands, rows) if bands else ()
                yield pa.RecordBatch.from_arrays(
                    [owner, item, pa.array(word), *(pa.array(k) for k in keys)],
                    ["doc_id", "node", "word", *(f"k{k}" for k in range(bands))])

    return run


def _asked(batch: pa.RecordBatch, a: int, b: int) -> tuple[T.Words, np.ndarray, list[np.ndarray]]:
    """Words of the texts of a slice, the text of each place asked for, and the fields of the places."""
    found = T.words(batch.column("text").slice(a, b - a))
    places = batch.column("places").slice(a, b - a)
    text = np.repeat(np.arange(b - a), np.diff(places.offsets.to_numpy()))
    flat = places.flatten()
    return found, text, [flat.field(k).to_numpy() for k in range(flat.type.num_fields)]


def _hashes(found: T.Words, text: np.ndarray, index: np.ndarray) -> np.ndarray:
    """32 bits of the hashes of words, counted from the begin of their text; 0 outside of it."""
    begin = (np.cumsum(found.counts) - found.counts)[text][:, None]
    valid = (index >= 0) & (index < found.counts[text][:, None])
    near = found.hash[np.clip(begin + index, 0, max(len(found.hash) - 1, 0))] >> np.uint64(32) if len(found.hash) else 0
    return np.where(valid, near, 0).astype(np.uint32)


def _flat(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(matrix))])


def _item_words(window: int):
    """For windows asked for by first word and item: hashes of their words.

    Texts with one doc_id follow each other, and each item is told once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(0, np.int64)
        for batch in batches:
            doc = batch.column("doc_id").to_numpy()
            for a, b in T.slices(batch.column("text")):
                found, text, (word, node) = _asked(batch, a, b)
                here = found.counts[text] >= word + window
                text, word, node = text[here], word[here], node[here]
                start = (np.cumsum(found.counts) - found.counts)[text] + word
                # of several texts with one doc_id only some hold the item there
                same = T.signed(_items(found, start, window)) == node
                new = np.zeros(len(node), bool)
                holds = np.flatnonzero(same)
                new[holds[np.unique(node[holds], return_index=True)[1]]] = True
                same &= new & ((doc[a + text] != last) | ~np.isin(node, seen))
                told = node[same & (doc[a + text] == doc[b - 1])]
                last, seen = doc[b - 1], np.concatenate((seen, told)) if doc[b - 1] == last else told
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[same]), _flat(_hashes(found, text[same], word[same][:, None] + np.arange(window)))],
                    ["node", "words"])

    return run


def _ends(reach: int):
    """For runs asked for by first and last word: hashes of the `reach` words before and after them.

    Texts with one doc_id follow each other; the first one is read.
    """
    before, after = np.arange(-reach, 0), np.arange(reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            doc = batch.column("doc_id").to_numpy()
            if len(doc):
                again = np.concatenate(([doc[0] == last], doc[1:] == doc[:-1]))
                last, batch = doc[-1], batch.filter(pa.array(~again))
            for a, b in T.slices(batch.column("text")):
                found, text, (begin, end) = _asked(batch, a, b)
                places = np.concatenate((begin[:, None] + before, end[:, None] + after), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(a + text)), pa.array(begin), pa.array(end),
                     _flat(_hashes(found, text, places))], ["doc_id", "begin", "end", "around"])

    return run


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The words of rows that all have as many."""
    parts = []
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(part):
            kind = np.int64 if pa.types.is_large_binary(part.type) else np.int32
            ends = np.frombuffer(part.buffers()[1], kind)[part.offset:part.offset + len(part) + 1]
            parts.append(np.frombuffer(part.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.uint32).reshape(len(part), -1))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def extents(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Words that agree before and after two runs, for rows of `a` with those of `b`: (left, right) extensions."""
    gain = np.where((a == b) & (a != 0), 1, -COST).astype(np.int32)
    out = np.zeros((2, len(gain)), np.int32)
    for k, side in enumerate((gain[:, :reach][:, ::-1], gain[:, reach:])):
        if side.size:
            total = np.cumsum(side, axis=1)
            out[k] = np.where(total.max(axis=1) > 0, total.argmax(axis=1) + 1, 0)
    return out


def _extended(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = extents(_matrix(batch.column("own")), _matrix(batch.column("other")), reach)
                kept = [batch.column(c) for c in ("doc_id", "partner", "diag", "class", "first_doc")]
                begin, end = (batch.column(c).to_numpy() for c in ("begin", "end"))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(begin - left), pa.array(end + right)], _SPAN)

    return run


_SPAN = ["doc_id", "partner", "diag", "class", "first_doc", "begin", "end"]


def windows_like(least: float) -> _linking.Compare:
    """Jaccard likeness of the shingles of two windows of at least `least`."""

    def shingle_rows(words: np.ndarray):
        inner, weight = words.astype(np.uint64), T.stream(11, SHINGLE)
        count = words.shape[1] - SHINGLE + 1
        total = sum(inner[:, k:count + k] * weight[k] for k in range(SHINGLE))
        rows, ids, _ = T.bag(np.repeat(np.arange(len(inner)), count), total.ravel())
        return rows, ids, np.bincount(rows, minlength=len(inner))

    def compare(a: pa.Table, b: pa.Table) -> np.ndarray:
        rows_a, ids_a, size_a = shingle_rows(_matrix(a["words"]))
        rows_b, ids_b, size_b = (rows_a, ids_a, size_a) if a is b else shingle_rows(_matrix(b["words"]))
        common = _linking.overlaps(rows_a, ids_a, len(size_a), rows_b, ids_b, len(size_b))
        return common * (1 + least) + 1e-6 >= least * (size_a[:, None] + size_b[None, :])

    return compare


def pairs_like(least: float) -> _linking.Pairs:
    """The same for pairs of rows of one table."""

    def like(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        words, back = np.unique(np.concatenate((i, j)), return_inverse=True)
        inner, weight = _matrix(table["words"].take(pa.array(words))).astype(np.uint64), T.stream(11, SHINGLE)
        count = inner.shape[1] - SHINGLE + 1
        # a row per place in the windows, a column per window
        total = np.ascontiguousarray(np.sort(sum(inner[:, k:count + k] * weight[k] for k in range(SHINGLE)), axis=1).T)
        # a shingle that comes again in its window counts once
        first = np.ones(total.shape, bool)
        first[1:] = total[1:] != total[:-1]
        size, a, b = first.sum(axis=0), back[:len(i)], back[len(i):]
        common = np.zeros(len(i), np.int64)
        # so many pairs at a time as stay near
        for at in range(0, len(i), 1 << 11):
            part = slice(at, at + (1 << 11))
            own, other, new = total[:, a[part]], total[:, b[part]], first[:, a[part]]
            for k in range(count):
                common[part] += new[k] & (own[k] == other).any(axis=0)
        return common * (1 + least) + 1e-6 >= least * (size[a] + size[b])

    return like


def _places(rows: DataFrame, texts: DataFrame, fields: list[str]) -> DataFrame:
    """The texts of the documents in `rows`, each with the distinct places asked for."""
    asked = rows.groupBy("doc_id").agg(F.collect_set(F.struct(*fields)).alias("places"))
    return texts.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "places")


def shared_windows(docs: DataFrame, window: int = WINDOW, gap: int = GAP, likeness: float = LIKENESS, bands: int = BANDS,
                   rows: int = ROWS) -> DataFrame:
    """(doc_id, word, node, class, first_doc, low): windows whose class lies in several documents.

    `first_doc` is the smallest document of the class, `low` the smallest with the same item.
    """
    texts = _texts(docs)
    keys = [f"k{k}" for k in range(bands)]
    found = texts.mapInArrow(_windows(window, gap, bands, rows), "doc_id long, node long, word int, " + ", ".join(
        f"{k} long" for k in keys))
    # of an item's places in its first document any will do, as all hold the same words
    items = _linking.written(found.groupBy("node").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min_by("word", "doc_id").alias("word"),
        *[F.max(k).alias(k) for k in keys]), "items")
    whole = ["node", "low", "high"]
    common = _linking.written(items.where("low < high").select(whole), "common")
    # first the keys alone, then what else is told of the few items that share one
    held = _linking.written(_linking.shared(items.select("node", F.explode(F.array(*keys)).alias("bucket"))), "held")
    sketches = _linking.written(
        items.select(*whole, "word").join(held.select("node").distinct().hint("shuffle_hash"), "node"), "sketches")
    _linking.dropped(items)
    # the words of an item are looked up in the first document that holds it
    words = _places(sketches.select(F.col("low").alias("doc_id"), "word", "node"), texts, ["word", "node"]) \
        .mapInArrow(_item_words(window), "node long, words binary")
    classes = _linking.held_classes(held.withColumn("weight", F.lit(window).cast("long")), words, windows_like(likeness),
                                    pairs=pairs_like(likeness))
    of = common.unionByName(sketches.where("low = high").select(whole))
    of = _linking.written(of.join(classes.hint("shuffle_hash"), "node", "left").where("low < high OR class IS NOT NULL").withColumn(
        "class", F.coalesce("class", "node")), "of")
    _linking.dropped(common, sketches, classes)
    across = _linking.written(of.groupBy("class").agg(F.min("low").alias("first_doc"), F.max("high").alias("last_doc")).where(
        "first_doc < last_doc").drop("last_doc"), "across")
    active = _linking.written(of.select("node", "low", "class").join(across.hint("shuffle_hash"), "class"), "active")
    _linking.dropped(of, across)
    every = texts.mapInArrow(_windows(window, gap, 0, 0), "doc_id long, node long, word int")
    placed = _linking.written(every.join(active.hint("shuffle_hash"), "node"), "placed")
    _linking.dropped(active)
    return placed


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, gap: int = GAP, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """(doc_id, partner, diag, class, first_doc, begin, end): words that a document shares with its `partner`.

    They stand `diag` words further on in the document. Words are counted from 0, `end` is the first one behind.
    """
    placed = shared_windows(docs, window, gap, **options)
    # counterparts: the first place of the item in its first document, or of the class in its
    # as tables, so that Spark can split what many windows of one item or class are joined with
    same = _linking.written(placed.where("doc_id = low").groupBy("node").agg(F.min("word").alias("place")), "same")
    near = _linking.written(placed.where("doc_id = first_doc").groupBy("class").agg(F.min("word").alias("place")), "near")
    copies = placed.where("doc_id > low").join(same.hint("shuffle_hash"), "node").withColumn("partner", F.col("low"))
    others = placed.where("doc_id = low").join(near.hint("shuffle_hash"), "class").withColumn("partner", F.col("first_doc"))
    pairs = copies.select(others.columns).union(others).withColumn("diag", F.col("word") - F.col("place")).where(
        "doc_id <> partner OR diag <> 0")
    order = Window.partitionBy("doc_id", "partner", "diag").orderBy("word")
    apart = F.coalesce(F.col("word") - F.lag("word").over(order) > gap, F.lit(True))
    numbered = pairs.withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = _linking.written(numbered.groupBy("doc_id", "partner", "diag", "run").agg(
        F.min("class").alias("class"), F.min("first_doc").alias("first_doc"), F.min("word").cast("long").alias("begin"),
        (F.max("word") + window).cast("long").alias("end")).withColumn("diag", F.col("diag").cast("long")).drop("run"), "runs")
    _linking.dropped(placed, same, near)
    reach = max(min_words - window, gap - 1, 0)
    there = (F.col("begin") - F.col("diag")).alias("begin"), (F.col("end") - F.col("diag")).alias("end")
    asked = runs.select("doc_id", "begin", "end").union(runs.select(F.col("partner").alias("doc_id"), *there))
    ends = _linking.written(
        _places(asked, _texts(docs), ["begin", "end"])
        .mapInArrow(_ends(reach), "doc_id long, begin long, end long, around binary"), "ends")
    own = ends.withColumnRenamed("around", "own")
    other = ends.select(F.col("doc_id").alias("partner"), F.col("begin").alias("from"), F.col("end").alias("to"),
                        F.col("around").alias("other"))
    both = runs.withColumns({"from": F.col("begin") - F.col("diag"), "to": F.col("end") - F.col("diag")}) \
        .join(own.hint("merge"), ["doc_id", "begin", "end"]).join(other.hint("merge"), ["partner", "from", "to"])
    shape = ", ".join(f"{c} long" for c in _SPAN)
    found = both.select("doc_id", "partner", "diag", "class", "first_doc", "begin", "end", "own", "other")
    spans = _linking.written(found.mapInArrow(_extended(reach), shape).where(F.col("end") - F.col("begin") >= min_words), "spans")
    _linking.dropped(runs, ends)
    return spans


def repeated_passages(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, first_word, n_words, class_id, first_doc, keep) per passage, in words of the document.

    `keep` marks passages of the first document of their class; the others are what deduplication removes.
    """
    runs = repeated_runs(docs, window, **options)
    gone = runs.where("doc_id <> first_doc").withColumn("keep", F.lit(False))
    stays = runs.where("partner = first_doc").withColumns({
        "begin": F.col("begin") - F.col("diag"), "end": F.col("end") - F.col("diag"), "doc_id": F.col("partner"),
        "keep": F.lit(True)})
    spans = gone.union(stays.select(gone.columns))
    order = Window.partitionBy("doc_id", "keep").orderBy("begin", "end", "class")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("begin") > reached, F.lit(True))
    joined = spans.select("doc_id", "keep", "begin", "end", "class", "first_doc").distinct().withColumn(
        "run", F.sum(F.when(apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("doc_id", "keep", "run").agg(
        F.min("begin").alias("first_word"), (F.max("end") - F.min("begin")).alias("n_words"),
        F.min("class").alias("class_id"), F.min("first_doc").alias("first_doc")).select(
        "doc_id", "first_word", "n_words", "class_id", "first_doc", "keep")
