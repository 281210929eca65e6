"""Repeated lines: all but the last document that holds a line lose it.

Lines are split at \\n. A line's key is the line without [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased. A key of at
least `min_chars` code points that at least `min_docs` documents hold loses all its lines except in the largest doc_id
that holds it.

Hashes of keys are range-partitioned together with the doc_id, so a frequent line spreads over partitions, and sorted by
hash, doc_id from the largest on, and position. A task streams through: the first document of a run keeps its lines, and
the rest are dropped if the run has enough documents. Runs at the ends of a partition may go on in the next one; their
counts are summed afterwards, two per partition at most. Texts are not shuffled for this: the result is one compressed
bitmap of kept lines per document.

Defined cases: null and empty texts are one empty line. A document is a doc_id; rows that share one count once and keep
or lose a line together. A null doc_id counts as one document, smaller than all others. Empty tables give no rows. Other
columns of the input stay as they are.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.session import cut_lineage

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"
_PENDING = "h1 long, h2 int, doc_id long, text_hash long, n_lines int, pos int, first boolean, docs int, part int, final boolean"


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Hashes of all keys that are long enough, with where they stand."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text()).alias("text_hash"),
                        F.split(F.translate(_text(), string.ascii_uppercase, string.ascii_lowercase), "\n").alias("lines"))
    each = parts.select("doc_id", "text_hash", F.size("lines").alias("n_lines"),
                        F.posexplode("lines").alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    return (each.select("doc_id", "text_hash", "n_lines", "pos", key.alias("key")).where(F.length("key") >= min_chars)
            .select(F.xxhash64("key").alias("h1"), F.hash(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "n_lines",
                    "pos"))


def _stream(min_docs: int):
    """Rows of one partition, sorted, with what is known of their run; rows that surely stay are left out."""

    def emit(run: list[pa.Table], docs: int, first, whole: bool) -> Iterator[pa.RecordBatch]:
        if whole and docs < min_docs:
            return
        for table in run:
            ids = table["doc_id"]
            head = ids.is_null() if first is None else pc.equal(ids, first).fill_null(False)
            out = table.append_column("first", head).append_column(
                "docs", pa.array(np.full(len(table), docs, np.int32))).append_column(
                "part", pa.array(np.full(len(table), TaskContext.get().partitionId(), np.int32))).append_column(
                "final", pa.array(np.full(len(table), whole)))
            if whole:
                out = out.filter(pc.invert(head))
            yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, docs, first, last, opening = None, [], 0, None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            new_key = np.ones(len(h1), bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_key.copy()
            new_doc[1:] |= (ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1])
            at = np.append(np.flatnonzero(new_key), len(h1))
            table = pa.Table.from_batches([batch])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                mine, n = (h1[a], h2[a]), int(new_doc[a:b].sum())
                top = None if missing[a] else int(ids[a])
                if mine != key:
                    if key is not None:
                        yield from emit(held, docs, first, not opening)
                        opening = False
                    key, held, docs, first = mine, [], 0, top
                elif top == last:
                    n -= 1
                docs += n
                last = None if missing[b - 1] else int(ids[b - 1])
                held.append(table.slice(a, b - a))
        if key is not None:
            yield from emit(held, docs, first, False)

    return run


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) for the documents that lose lines; keep: zlib of packed bits."""
    lines = _lines(docs, min_chars)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal (key, doc_id) stay in one partition, so counts of documents add up
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last()]
    found = cut_lineage(lines.repartitionByRange(partitions, *order)
                        .sortWithinPartitions(*order, "text_hash", "pos").mapInArrow(_stream(min_docs), _PENDING))
    pending = found.where("NOT final")
    # runs at the two ends of each partition: at most two rows per partition
    pieces = pending.groupBy("h1", "h2", "part").agg(F.max("docs").alias("docs"), F.max("doc_id").alias("top"))
    runs = pieces.groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("top").alias("top")).where(
        F.col("all_docs") >= min_docs)
    late = pending.join(F.broadcast(runs), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    columns = ["doc_id", "text_hash", "n_lines", "pos"]
    dropped = found.where("final").select(*columns).union(late.select(*columns))
    # rows of equal doc_id and text repeat their positions
    per_doc = dropped.groupBy("doc_id", "text_hash", "n_lines").agg(F.collect_set("pos").alias("gone"))
    return per_doc.mapInArrow(_pack, "doc_id long, text_hash long, n_lines int, n_dropped int, keep binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, gone = [], batch.column("gone")
        for i, n in enumerate(batch.column("n_lines").to_pylist()):
            bits = np.ones(n, bool)
            bits[gone[i].values.to_numpy()] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "text_hash", "n_lines")),
             pa.array([len(g) for g in gone], pa.int32()), pa.array(keep, pa.binary())],
            ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])


def kept_lines(text: str, keep: bytes | None, n_lines: int) -> str:
    """The lines of `text` that the bitmap keeps, joined by \\n."""
    if keep is None:
        return text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    return "\n".join(line for line, stays in zip(text.split("\n"), bits, strict=True) if stays)


def _with_bitmaps(docs: DataFrame, **limits: int) -> DataFrame:
    """Each row as `row`, with n_dropped and keep of its bitmap."""
    maps = line_bitmaps(docs, **limits)
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (
        F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))) == F.col("text_hash"))
    return docs.select(F.struct(*docs.columns).alias("row")).join(maps, same, "left").select(
        "row", "n_lines", "n_dropped", "keep")


def drop_repeated_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """`docs` with the repeated lines taken out of `text` and, where it exists, `n_chars` brought up to date."""

    @F.pandas_udf("string")
    def rest(text: pd.Series, keep: pd.Series, n_lines: pd.Series) -> pd.Series:
        return pd.Series([t if k is None else kept_lines(t, k, int(n))
                          for t, k, n in zip(text, keep, n_lines, strict=True)], dtype=object)

    touched = F.col("keep").isNotNull()
    text = F.when(touched, rest("row.text", "keep", "n_lines")).otherwise(F.col("row.text"))
    out = _with_bitmaps(docs, **limits).select("row", touched.alias("touched"), text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("touched"), F.length("text")).otherwise(F.col("row.n_chars"))
               if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c].cast(docs.schema[c].dataType) if c in changed else F.col("row")[c]).alias(c)
                        for c in docs.columns])


def line_report(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_lines, gone, sha = batch.column("doc_id"), [], [], []
            for text, keep, n in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(),
                                     batch.column("n_dropped").to_pylist(), strict=True):
                total = text.count("\n") + 1
                n_lines.append(total)
                gone.append(n or 0)
                sha.append(hashlib.sha256(kept_lines(text, keep, total).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select("doc_id", _text().alias("text"))
    return _with_bitmaps(slim, **limits).select("row.*", "keep", "n_dropped").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
