"""Token counts per section of a document, from one encoding of the whole document.

A document is encoded once. Its tokens' byte spans become character spans, which are joined with the spans of its
sections by binary search. A token that crosses sections counts for one of them, by rule:

- "most": the section that holds most of its characters, the earlier one if several do;
- "first": the section of its first character.

Sections are lines with their \\n (`line_tokens`) or named columns (`field_tokens`). A character that several tokens
share counts for the span of each. Encoding section by section would give other counts, as tokens form across borders.

Defined cases: null texts are empty and have one section without tokens (`line_tokens`) or an empty section
(`field_tokens`). Each row is counted by itself. Empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text before its parts are encoded, published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "first")
_ENCODERS: dict[int, tuple[tiktoken.Encoding, np.ndarray]] = {}


def read_vocabulary(path: str = TOKENIZER) -> bytes:
    """The vocabulary file, read where the job starts; about a megabyte."""
    with open(path, "rb") as file:
        return file.read()


def encoder(vocabulary: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the bytes of each token, once per process and vocabulary."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODERS[key]


def token_spans(text: str, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token."""
    encoding, sizes = encoder(vocabulary)
    ids = np.asarray(encoding.encode_ordinary(text), np.int64)
    end = np.cumsum(sizes[ids])
    start = end - sizes[ids]
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        return start, end
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[start], char[end - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, begins: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section and how many cross a border. Section i is [begins[i], begins[i + 1]), the last one is open."""
    first = np.searchsorted(begins, start, side="right") - 1
    last = np.searchsorted(begins, end - 1, side="right") - 1
    crossing = np.flatnonzero(last > first)
    place = first.copy()
    if rule == "most":
        for t in crossing:
            edges = np.concatenate(([start[t]], begins[first[t] + 1:last[t] + 1], [end[t]]))
            place[t] = first[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(place, minlength=len(begins)), len(crossing)


def _counted(rows: DataFrame, vocabulary: bytes, rule: str) -> DataFrame:
    """`rows` has row, text and ends (characters of each section); adds n_chars, n_tokens, n_crossing, section_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, tokens, crossing, counts = [], [], [], []
            for text, sizes in zip(batch.column("text").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                if sizes is None:
                    sizes = [len(line) + 1 for line in text.split("\n")]
                start, end = token_spans(text, shared.value)
                per_section, over = allocate(start, end, np.cumsum([0, *sizes[:-1]]), rule)
                chars.append(len(text))
                tokens.append(len(start))
                crossing.append(over)
                counts.append(per_section.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([len(c) for c in counts], pa.int64()), pa.array(crossing, pa.int64()),
                 pa.array(counts, pa.list_(pa.int32()))],
                ["key", "n_chars", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_chars long, n_tokens long, n_sections long, n_crossing long, "
                                "section_tokens array<int>")


def line_tokens(docs: DataFrame, vocabulary: bytes, rule: str = "most", key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Per row: `key`, n_chars, n_tokens, n_sections, n_crossing and section_tokens, the tokens of each line in order."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.lit(None).cast("array<long>").alias("sizes"))
    return _counted(rows, vocabulary, rule).withColumnRenamed("key", key)


def field_tokens(df: DataFrame, fields: list[str], vocabulary: bytes, rule: str = "most", key: str = "doc_id",
                 separator: str = "\n") -> DataFrame:
    """The same with columns as sections; all but the last take the separator after them along."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    rows = df.select(F.col(key).alias("key"), F.concat_ws(separator, *values).alias("text"),
                     F.array(*[(F.length(v) + len(separator)).cast("long") for v in values]).alias("sizes"))
    return _counted(rows, vocabulary, rule).withColumnRenamed("key", key)
