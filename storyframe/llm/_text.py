"""Words, hashes and shingles of whole columns of texts as numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Nulls read as
empty texts. Work goes slice by slice, so memory follows the slice (or one text, if that is longer), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
# Words of up to so many bytes are hashed together.
NEAR = 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """The first `n` numbers of the random stream `seed`."""
    start = np.uint64((seed * 0xD1342543DE82EF95 + 1) % (1 << 64))
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * _STEP)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, at least one row each."""
    offsets = raw(column)[1]
    start, n = 0, len(column)
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def _filled(column: pa.Array) -> pa.Array:
    return column.fill_null("") if column.null_count else column


def chars_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte position of `data`."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more entry than texts)."""
    column = _filled(column)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = int(offsets[0])
    return data[first:int(offsets[-1])], offsets.astype(np.int64) - first


class Words(NamedTuple):
    """Words of several texts in order: text index, byte range in `data`, hash; `counts` holds words per text."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    counts: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def words(column: pa.Array, lower: bool = True, space: np.ndarray = SPACE) -> Words:
    """The words of all texts; `space` marks the bytes that separate words."""
    data, offsets = raw(column)
    if lower:
        data = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    n = len(offsets) - 1
    # bytes below 9 wrap around
    solid = (data != 32) & (data - np.uint8(9) > 4) if space is SPACE else (~space).take(data)
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = solid[edges]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return Words(np.repeat(np.arange(n), counts), start, end, _word_hashes(data, start, end), counts, data, offsets)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What `spans_hash` gives, byte by byte of all words that are as long; long words are left to it."""
    length = end - start
    near = np.minimum(length, NEAR + 1)
    order = np.argsort(near.astype(np.uint8), kind="stable")[::-1]
    longer = len(near) - np.cumsum(np.bincount(near, minlength=NEAR + 2))
    factor = stream(7, NEAR + 1)
    at = start[order]
    # every byte counts one more than its value
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(factor)))[near[order]]
    for k in range(int(near.max(initial=0))):
        total[:longer[k]] += data[at[:longer[k]]] * factor[k]
        at[:longer[k]] += 1
    out = np.empty(len(total), np.uint64)
    out[order] = total
    out = mix(out + length.astype(np.uint64))
    long = np.flatnonzero(length > NEAR)
    out[long] = spans_hash(data, start[long], end[long])
    return out


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges must not be empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    begin = np.cumsum(length) - length
    return _hashed(data[np.repeat(start - begin, length) + np.arange(int(length.sum()))], length)


def _hashed(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hashes of byte ranges of these lengths that follow each other."""
    if not len(length):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(begin, length)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= stream(7, int(length.max())).take(place)
    return mix(np.add.reduceat(terms, begin) + length.astype(np.uint64))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each run of `size` words; a shorter text with any word is one shingle."""
    n = len(found.hash)
    weight = stream(11, size)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total[:max(n - k, 0)] += found.hash[k:] * weight[k]
    begin = np.concatenate(([0], np.cumsum(found.counts)[:-1]))
    whole = found.counts[found.text] >= size
    place = np.arange(n) - begin[found.text]
    full = whole & (place <= found.counts[found.text] - size)
    short = np.flatnonzero((found.counts > 0) & (found.counts < size))
    text, value = found.text[full], mix(total[full])
    if len(short):
        own = np.array([(found.hash[begin[i]:begin[i] + found.counts[i]] * weight[:found.counts[i]]).sum()
                        for i in short], np.uint64)
        text, value = np.concatenate((text, short)), np.concatenate((value, mix(own ^ _STEP)))
        order = np.argsort(text, kind="stable")
        text, value = text[order], value[order]
    return text, value


def bag(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs in order, and how often each occurs."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))
