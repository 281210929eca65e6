"""Benchmark passages in documents, up to small edits.

Texts are compared with A-Z lower-cased and each run of white space as one space. CGK embedding: a shared random walk
reads a string from left to right, and at each step writes the character it stands on and moves on or stays, as a random
function of step and character says; strings a few edits apart fall into step again, so edit distance becomes Hamming
distance. The walk's first outputs depend on the first characters only, so the windows of all item sizes that begin at a
word share one walk, and windows with the same first bytes share its begin. Bit-sampling LSH takes the outputs at random steps as a key; this is repeated with other walks.

Every word of every document begins a window, and so does every word of an item that has `LEAST_CHARS` characters after
it, so keys are spread over its whole length; equal keys propose where the item would lie. One intact stretch anywhere in
the passage is enough. A walk is looked up by its first steps, several times, and only what may match walks on. Items are sorted into
classes by length, as shorter ones have fewer stretches; for each class the cheapest of `SETTINGS` is taken that finds at
least `recall` of a sample of its items, drawn from all items, after as many random edits as `max_edits` allows. A class for
which none does is compared with every part of every text. Proposals are verified exactly, many at a time: the smallest edit
distance between the item and any piece of the text around that place must not exceed `max_edits` of the item's length.
Items of fewer than `LEAST_CHARS` characters must stand in the text as they are, between white space.

Items go to the tasks in blocks of at most `BLOCK_CHARS` characters, and documents are read once per block, so nothing
unbounded is broadcast. A proposal is made and verified where the document lies: there is no shuffle.

Defined cases: null texts are empty. Items without any character match nothing. Items with null item_id are used like others,
and so are rows with a null doc_id. Repeated documents are reported each, equal items too. Of equally good places of an item in
a document, the first counts. Long texts are read whole, and memory follows a slice, or one text if that is longer. Empty
tables give no rows; other columns are ignored, and kept by `clean`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm import _text as T

STEPS, SAMPLED, REPEATS = 40, 24, 2
# Steps, sampled steps and repeats, by rising recall and cost.
SETTINGS = ((STEPS, SAMPLED, REPEATS), (32, 20, 4), (28, 18, 4), (24, 16, 4), (20, 14, 4), (16, 12, 6), (13, 10, 8))
# Characters from which an item is of the next class.
CLASSES = (48, 96)
RECALL, RECALL_ITEMS = 0.9, 200
LEAST_CHARS = 24
MAX_EDITS = 0.2
BLOCK_CHARS = 4_000_000
FILTER_BITS = 18
# Bytes around a place beside those that edits may add, for characters of several bytes.
REACH = 16
# Bytes of text that are searched at a time, and those whose proposals are verified together.
SLICE_BYTES, BATCH_BYTES = 4 << 20, 16 << 20
WALKED = 1 << 15
# Bytes of a window that are walked once for all windows that begin with them.
BEGUN = 8
# Parts of a walk after which it is looked up.
SCREENED = (0.25, 0.35, 0.5, 0.65)
# Pairs that are verified at a time.
VERIFIED = 1 << 12
_FOUND = "start long, end long, edits long"


class Beginnings(NamedTuple):
    """The different first `BEGUN` bytes of windows, one after the other, and which of them each window has."""

    data: np.ndarray
    of: np.ndarray


def beginnings(data: np.ndarray, start: np.ndarray) -> Beginnings:
    padded = np.concatenate((data, np.zeros(BEGUN, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, BEGUN)[start].view("<u8")[:, 0]
    of, different = pd.factorize(eight)
    return Beginnings(different.view(np.uint8), of)


class Walks:
    """Random functions and sampled steps of all repeats."""

    def __init__(self, steps: int = STEPS, sampled: int = SAMPLED, repeats: int = REPEATS, seed: int = 1):
        random = np.random.default_rng(seed)
        self.moves = random.integers(0, 2, (repeats, steps, 256), dtype=np.int32)
        self.sampled = [set(random.choice(steps, sampled, replace=False).tolist()) for _ in range(repeats)]

    def keys(self, data: np.ndarray, start: np.ndarray, repeat: int, screens: tuple[np.ndarray, ...] = (),
             begun: Beginnings | None = None):
        """(places in `start`, keys) of the windows that begin at `start`; behind the end are zeros.

        `screens` have a bit per beginning of a key, one for each of `SCREENED`; windows that they rule out are left out.
        With `begun`, the beginnings of these windows, what `BEGUN` steps read is walked once for equal ones.
        """
        steps, salt = self.moves.shape[1], T.stream(83, repeat + 1)[-1]
        stops = {int(part * steps): screen for part, screen in zip(SCREENED, screens, strict=False)}
        padded = np.concatenate((data, np.zeros(steps, np.uint8)))
        first, place, at = 0, np.arange(len(start)), start.astype(np.int32)
        key = np.zeros(len(start), np.uint64)
        if begun is not None and steps >= BEGUN:
            first, low = BEGUN, np.arange(0, len(begun.data), BEGUN, dtype=np.int32)
            which, moved, walked = self._walked(begun.data, np.arange(len(low)), low, key[:len(low)], repeat, 0, first, stops)
            row = np.full(len(low), -1)
            row[which] = np.arange(len(which))
            own = row.take(begun.of)
            place = np.flatnonzero(own >= 0)
            own = own[place]
            at, key = at[place] + (moved - low[which])[own], walked[own]
        parts = []
        for a in range(0, len(place), WALKED):
            part = slice(a, a + WALKED)
            went, _, found = self._walked(padded, place[part], at[part], key[part], repeat, first, steps, stops)
            parts.append((went, T.mix(found + salt)))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty

    def _walked(self, data: np.ndarray, place: np.ndarray, at: np.ndarray, key: np.ndarray, repeat: int, first: int, last: int,
                stops: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, at, key) after the steps from `first` up to `last`, without the walks that `stops` rule out."""
        moves, sampled = self.moves[repeat], self.sampled[repeat]
        at, key = at.copy(), key.copy()
        for step in range(first, last):
            char = data.take(at)
            if step in sampled:
                key *= np.uint64(0x100000001B3)
                key += char
            at += moves[step].take(char)
            if step + 1 in stops:
                kept = np.flatnonzero(stops[step + 1].take(_spot(key)))
                at, place, key = at.take(kept), place.take(kept), key.take(kept)
        return place, at, key

    def screens(self, data: np.ndarray, start: np.ndarray, repeat: int) -> tuple[np.ndarray, ...]:
        """Bits of the keys of the first parts of the walks."""
        steps, out = self.moves.shape[1], []
        padded = np.concatenate((data, np.zeros(steps, np.uint8)))
        for part in SCREENED:
            at, key = start.astype(np.int32), np.zeros(len(start), np.uint64)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[_spot(self._walked(padded, np.arange(len(start)), at, key, repeat, 0, int(part * steps), {})[2])] = True
            out.append(bits)
        return tuple(out)


def _spot(key: np.ndarray) -> np.ndarray:
    """The bit of a screen for the key of a walk so far."""
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).view(np.int64)


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts folded, one after the other: bytes, where each text begins, starts of words, text of each word."""
    data, offsets = T.raw(column)
    space = T.SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = ~space[edges]
    # of a run of white space the first one stays, unless the text begins with it
    stays = ~space
    stays[1:] |= ~space[:-1]
    stays[edges] = ~space[edges]
    place = np.concatenate(([0], np.cumsum(stays)))
    out = T.LOWER[data[stays]]
    out[space[stays]] = 32
    starts = np.flatnonzero(first)
    words = np.diff(np.searchsorted(starts, offsets))
    return out, place[offsets], place[starts], np.repeat(np.arange(len(words)), words)


def _ramp(length: np.ndarray) -> np.ndarray:
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


def _class(chars: int) -> int:
    """The class of an item of so many characters; -1 for those that are looked for as they are."""
    return -1 if chars < LEAST_CHARS else sum(chars >= c for c in CLASSES)


class Search(NamedTuple):
    """Windows of the items of a class: the repeat's keys in order, whose they are, and how far into the item."""

    walks: Walks
    screens: list[tuple[np.ndarray, ...]]
    keys: list[np.ndarray]
    of: list[np.ndarray]
    into: list[np.ndarray]


class Items:
    """Folded benchmark items, and how those of each class are looked for; a class without walks is compared throughout."""

    def __init__(self, ids: list, texts: pa.Array, walks: Walks | dict[int, Walks | None]):
        if isinstance(walks, Walks):
            walks = dict.fromkeys(range(len(CLASSES) + 1), walks)
        data, offsets, begin, of = folded(texts)
        self.ids = ids
        self.texts = [data[a:b].tobytes().decode().rstrip(" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.sizes = np.diff(offsets)
        kinds = np.array([_class(len(t)) for t in self.texts], np.int64)
        self.searches, self.everywhere = [], []
        for kind in sorted(set(kinds[kinds >= 0].tolist())):
            if walks[kind] is None:
                self.everywhere += np.flatnonzero(kinds == kind).tolist()
                continue
            use = (kinds[of] == kind) & ((offsets[of + 1] - begin >= LEAST_CHARS) | (begin == offsets[of]))
            own, whose = begin[use], of[use]
            found = [walks[kind].keys(data, own, r) for r in range(len(walks[kind].moves))]
            order = [np.argsort(key, kind="stable") for _, key in found]
            self.searches.append(Search(
                walks[kind], [walks[kind].screens(data, own, r) for r in range(len(found))],
                [k[1][o] for k, o in zip(found, order, strict=True)],
                [whose[o] for o in order], [(own - offsets[whose])[o] for o in order]))
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i in np.flatnonzero(kinds < 0).tolist():
            if text := self.texts[i].encode():
                self.short.setdefault(len(text), {}).setdefault(text, []).append(i)

    def proposals(self, data: np.ndarray, begin: np.ndarray):
        """(word, item, bytes from the item's start to the word) of all windows with equal keys."""
        begun = beginnings(data, begin)
        for search in self.searches:
            for repeat, screens in enumerate(search.screens):
                word, keys = search.walks.keys(data, begin, repeat, screens, begun)
                own = search.keys[repeat]
                low, high = (np.searchsorted(own, keys, side=side) for side in ("left", "right"))
                times = high - low
                entry = np.repeat(low, times) + _ramp(times)
                yield np.repeat(word, times), search.of[repeat][entry], search.into[repeat][entry]

    def as_they_are(self, data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, of: np.ndarray):
        """(text, item, first byte) of the first place of each short item in each text that has it between white space."""
        last = offsets[of + 1]
        for size, texts in self.short.items():
            fits = begin + size <= last
            fits[fits] &= (begin[fits] + size == last[fits]) | (data[np.minimum(begin[fits] + size, len(data) - 1)] == 32)
            at, owner = begin[fits], of[fits]
            wanted = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, size)
            hashes = T.spans_hash(wanted.ravel(), *(np.arange(len(wanted)) * size + k for k in (0, size)))
            here = np.flatnonzero(np.isin(T.spans_hash(data, at, at + size), hashes))
            seen = set()
            for k in here.tolist():
                for i in texts.get(data[at[k]:at[k] + size].tobytes(), []):
                    if (int(owner[k]), i) not in seen:
                        seen.add((int(owner[k]), i))
                        yield int(owner[k]), i, int(at[k])


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of `pattern` to any piece of `text`, and where the first such piece ends (bit-parallel)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = ones, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        x = eq | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & ones
        plus, minus = down | ~(diagonal | up) & ones, up & diagonal
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = plus << 1 & ones, minus << 1 & ones
        up, down = (minus | ~(x | plus)) & ones, plus & x
        if distance < best:
            best, end = distance, j
    return best, end


@functools.lru_cache(maxsize=4096)
def _table(pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a pattern in order, and for none and each of them the bits of the places it stands at, by words."""
    codes = np.frombuffer(pattern.encode("utf-32-le"), np.uint32)
    letters, number = np.unique(codes, return_inverse=True)
    bits = np.zeros((len(letters) + 1, -(-len(codes) // 64) * 64), np.uint8)
    bits[number + 1, np.arange(len(codes))] = 1
    return letters, np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64).T.copy()


def best_matches(pairs: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """`best_match` of all pairs, bit-parallel over many at a time."""
    out = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (-(-len(pairs[k][0]) // 64), len(pairs[k][1])))
    while order:
        words, longest, chunk = -(-len(pairs[order[-1]][0]) // 64), len(pairs[order[-1]][1]), []
        # pairs of like size go together, the largest first
        while order and len(chunk) < VERIFIED:
            pattern, piece = pairs[order[-1]]
            if len(chunk) >= 64 and (len(pattern) <= 64 * (words - 1) or len(piece) < 0.75 * longest):
                break
            longest = max(longest, len(piece))
            chunk.append(order.pop())
        for k, found in zip(chunk, _matched([pairs[k] for k in chunk], words, longest), strict=True):
            out[k] = found
    return out


def _matched(pairs: list[tuple[str, str]], words: int, longest: int) -> list[tuple[int, int]]:
    n, one, high = len(pairs), np.uint64(1), np.uint64(63)
    tables = [_table(pattern) for pattern, _ in pairs]
    base = np.cumsum([0, *(t.shape[1] for _, t in tables)])
    equal = np.zeros((words, base[-1]), np.uint64)
    # behind a text stand characters that no pattern has; they bring no better match
    text = np.tile(base[:-1], (longest, 1))
    for k, ((letters, table), (_, piece)) in enumerate(zip(tables, pairs, strict=True)):
        equal[:len(table), base[k]:base[k + 1]] = table
        codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        place = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
        text[:len(codes), k] += np.where(letters[place] == codes, place + 1, 0)
    size = np.array([len(p) for p, _ in pairs])
    top_word, top = (size - 1) >> 6, one << ((size - 1) & 63).astype(np.uint64)
    last = top_word * n + np.arange(n)
    distance, best, end = size.copy(), size.copy(), np.zeros(n, np.int64)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    eq, x, both, total, plus, minus = (np.empty((words, n), np.uint64) for _ in range(6))
    for j in range(longest):
        for w in range(words):
            equal[w].take(text[j], out=eq[w])
        np.bitwise_or(eq, down, out=x)
        np.bitwise_and(eq, up, out=both)
        np.add(both, up, out=total)
        if words > 1:
            over = total < both
            for w in range(1, words):
                total[w] += over[w - 1]
                # a word of ones becomes nothing when one is carried into it
                over[w] |= over[w - 1] & (total[w] == 0)
        total ^= up
        total |= eq
        np.bitwise_or(total, up, out=plus)
        np.invert(plus, out=plus)
        plus |= down
        np.bitwise_and(up, total, out=minus)
        distance += (plus.take(last) & top) != 0
        distance -= (minus.take(last) & top) != 0
        if words > 1:
            np.right_shift(plus, high, out=both)
            np.right_shift(minus, high, out=total)
        plus <<= one
        minus <<= one
        if words > 1:
            plus[1:] |= both[:-1]
            minus[1:] |= total[:-1]
        np.bitwise_and(plus, x, out=down)
        np.bitwise_or(x, plus, out=up)
        np.invert(up, out=up)
        up |= minus
        better = distance < best
        np.copyto(best, distance, where=better)
        end[better] = j + 1
    return list(zip(best.tolist(), end.tolist(), strict=True))


def _search(shared, max_edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            column = batch.column("text")
            for a, b in T.slices(column, BATCH_BYTES):
                rows, which, starts, ends, edits = _verified(items, column.slice(a, b - a), max_edits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(a + np.array(rows, np.int64))),
                     pa.array([items.ids[i] for i in which], batch_id_type(items)),
                     pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(edits, pa.int64())],
                    ["doc_id", "item_id", "start", "end", "edits"])

    return run


def batch_id_type(items: Items) -> pa.DataType:
    return pa.string() if any(isinstance(i, str) for i in items.ids) else pa.int64()


def _verified(items: Items, column: pa.Array, max_edits: float):
    parts, regions, best = [], [], {}
    # texts are searched slice by slice, and what is proposed in several slices is verified together
    for a, b in T.slices(column, SLICE_BYTES):
        data, offsets, begin, of = folded(column.slice(a, b - a))
        parts.append((a, data, offsets, list(items.as_they_are(data, offsets, begin, of))))
        regions += [(len(parts) - 1, *x) for x in _proposed(items, data, offsets, begin, of, max_edits)]
        if b == len(column) or sum(len(piece) for *_, piece in regions) > BATCH_BYTES:
            _judged(items, parts, regions, max_edits, best)
            regions = []
    for a, data, offsets, exact in parts:
        for text, i, at in exact:
            before = len(data[offsets[text]:at].tobytes().decode("utf-8", "ignore"))
            best[a + text, i] = 0, before, before + len(items.texts[i])
    rows, which = (list(x) for x in zip(*sorted(best), strict=True)) if best else ([], [])
    edits, starts, ends = (list(x) for x in zip(*(best[k] for k in sorted(best)), strict=True)) if best else ([], [], [])
    return rows, which, starts, ends, edits


def _judged(items: Items, parts: list[tuple], regions: list[tuple], max_edits: float,
            best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Note in `best`, by text and item, the smallest distance of the item in `regions`, and where it lies."""
    matches = best_matches([(items.texts[i], piece) for *_, i, _, piece in regions])
    for (part, text, i, x, piece), (distance, end) in zip(regions, matches, strict=True):
        (a, data, offsets, _), pattern = parts[part], items.texts[i]
        if distance <= int(max_edits * len(pattern)) and ((a + text, i) not in best or distance < best[a + text, i][0]):
            tail = best_match(pattern[::-1], piece[:end][::-1])[1]
            before = len(data[offsets[text]:offsets[text] + x].tobytes().decode("utf-8", "ignore"))
            best[a + text, i] = distance, before + end - tail, before + end


def _proposed(items: Items, data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, of: np.ndarray, max_edits: float):
    """(text, item, first byte, piece of the text) wherever an item may lie."""
    found: dict[tuple[int, int], set[int]] = {}
    for word, item, into in items.proposals(data, begin) if len(begin) else ():
        place = begin[word] - offsets[of[word]] - into
        for text, i, spot in np.unique(np.stack((of[word], item, place)), axis=1).T.tolist():
            found.setdefault((text, i), set()).add(spot)
    for i in items.everywhere:
        for text in np.unique(of).tolist():
            found[text, i] = set(range(0, int(offsets[text + 1] - offsets[text]), max(int(items.sizes[i]), 1)))
    for (text, i), spots in sorted(found.items()):
        size, whole = int(items.sizes[i]), data[offsets[text]:offsets[text + 1]]
        reach = int(max_edits * size) + REACH
        # neighbouring places are one region; each region is the item's size and what edits may add, on both sides
        for low, high in _regions(sorted(spots), max(size // 4, 1)):
            x, y = max(low - reach, 0), high + size + reach
            yield text, i, x, whole[x:y].tobytes().decode("utf-8", "ignore")


def edited(text: str, edits: int, random: np.random.Generator) -> str:
    """`text` after random inserts, deletions and substitutions of single characters."""
    chars = list(text)
    for kind, place, char in zip(random.integers(0, 3, edits), random.random(edits), random.integers(96, 123, edits),
                                 strict=True):
        at = int(place * len(chars))
        chars[at:at + (kind > 0)] = [] if kind == 1 else [chr(char) if char > 96 else " "]
    return "".join(chars)


def measured_recall(texts: list[str], walks: Walks, max_edits: float) -> float:
    """Share of `texts`, items of one class, that are found after `max_edits` of their length in random edits."""
    if not texts:
        return 1.0
    items = Items(list(range(len(texts))), pa.array(texts, pa.string()), walks)
    random = np.random.default_rng(5)
    column = pa.array([edited(t, int(max_edits * len(t)), random) for t in items.texts], pa.string())
    rows, which, *_ = _verified(items, column, max_edits)
    # equal items stand for each other
    return len({row for row, i in zip(rows, which, strict=True) if items.texts[i] == items.texts[row]}) / len(texts)


def tuned(samples: dict[int, list[str]], max_edits: float, recall: float) -> dict[int, Walks | None]:
    """For each class the walks of the cheapest setting that meets `recall` on its sample; None if none does."""
    out = {}
    for kind in range(len(CLASSES) + 1):
        tried = (Walks(*setting) for setting in SETTINGS)
        out[kind] = next((w for w in tried if measured_recall(samples.get(kind, []), w, max_edits) >= recall), None)
    return out


def _regions(spots: list[int], gap: int) -> Iterator[tuple[int, int]]:
    low = high = spots[0]
    for spot in spots[1:]:
        if spot > high + gap:
            yield low, high
            low = spot
        high = spot
    yield low, high


def _blocks(benchmark: DataFrame, block_chars: int, max_edits: float, recall: float) -> Iterator:
    """Broadcasts of the items, a bounded number of characters each."""
    kind = _id_kind(benchmark)
    items = benchmark.select(F.col("item_id").cast(kind).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # of each class a sample in order of hashes, whatever the blocks
    chars = F.length("text")
    limits = (LEAST_CHARS, *CLASSES, 2**31 - 1)
    samples = {}
    for number, (low, high) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
        drawn = items.where((chars >= low) & (chars < high)).select("text").distinct().orderBy(F.xxhash64("text"), "text")
        samples[number] = [row[0] for row in drawn.limit(RECALL_ITEMS).collect()]
    walks = tuned({k: [t for t in texts if _class(len(" ".join(t.split()))) == k] for k, texts in samples.items()}, max_edits, recall)
    total = items.agg(F.sum(chars)).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        texts = pa.concat_arrays(part["text"].chunks) if part.num_rows else pa.array([], pa.string())
        yield benchmark.sparkSession.sparkContext.broadcast(Items(part["item_id"].to_pylist(), texts, walks))


def _id_kind(benchmark: DataFrame) -> str:
    return "string" if benchmark.schema["item_id"].dataType.simpleString() == "string" else "long"


def find_passages(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS,
                  block_chars: int = BLOCK_CHARS, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the best match of each item in each document that holds it.

    start and end are code points of the folded text. `benchmark` has item_id and text.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id long, item_id {_id_kind(benchmark)}, {_FOUND}"
    found = [slim.mapInArrow(_search(shared, max_edits), schema) for shared in _blocks(benchmark, block_chars, max_edits, recall)]
    return functools.reduce(DataFrame.union, found)


def clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS,
          block_chars: int = BLOCK_CHARS, recall: float = RECALL) -> DataFrame:
    """The rows of `docs` that hold no benchmark passage; each row is judged where it lies."""
    for shared in _blocks(benchmark, block_chars, max_edits, recall):
        docs = docs.where(~_holder(shared, max_edits)(F.coalesce("text", F.lit(""))))
    return docs


def _holder(shared, max_edits: float):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        column, out = pa.array(texts, pa.string()), np.zeros(len(texts), bool)
        for a, b in T.slices(column, BATCH_BYTES):
            rows = _verified(shared.value, column.slice(a, b - a), max_edits)[0]
            out[a + np.array(rows, np.int64)] = True
        return pd.Series(out)

    return holds
