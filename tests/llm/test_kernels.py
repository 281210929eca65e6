"""Kernels without Spark, against plain versions."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from storyframe.llm import _linking, decontam, editprint, hmm, mixing, neardup, passages, tokencount, urlfilter
from storyframe.llm import _text as T

TEXTS = ["Ab cd\tef", None, "", " \n ", "x", "éa b é", "a\x0bB\x0c\rC  ", "one two three four five six"]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_and_shingles():
    found = T.words(pa.array(TEXTS))
    assert found.counts.tolist() == [len(tokens(t)) for t in TEXTS]
    assert [bytes(found.data[a:b]).decode() for a, b in zip(found.start, found.end)] == [
        w for t in TEXTS for w in tokens(t)]
    text, _ = T.shingles(found, 5)
    assert np.bincount(text, minlength=len(TEXTS)).tolist() == [
        0 if not tokens(t) else max(1, len(tokens(t)) - 4) for t in TEXTS]
    assert [b - a for a, b in T.slices(pa.array(TEXTS), 4)] and sum(b - a for a, b in T.slices(pa.array(TEXTS), 4)) == 8


def test_bag_signature_estimates_weighted_jaccard():
    one, two = {1: 3, 2: 1, 3: 7, 4: 2, 5: 1, 6: 5}, {1: 2, 2: 1, 3: 9, 4: 2, 7: 1, 6: 5}
    text = np.array([0] * 6 + [1] * 6)
    value = T.mix(np.array([*one, *two], np.uint64))
    count = np.array([*one.values(), *two.values()])
    got = neardup.bag_signatures(text, value, count, 2, 4000)
    keys = one.keys() | two.keys()
    exact = sum(min(one.get(k, 0), two.get(k, 0)) for k in keys) / sum(max(one.get(k, 0), two.get(k, 0)) for k in keys)
    assert abs((got[0] == got[1]).mean() - exact) < 0.04


def test_overlaps_count_common_ids():
    a, b = [{1, 2, 3}, {9}, {2, 9, 4}], [{2, 3}, {4, 9}]
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(s) for s in sets]),
                         np.array([x for s in sets for x in sorted(s)], np.uint64), len(sets))
    assert _linking.overlaps(*flat(a), *flat(b), columns=2).tolist() == [[len(x & y) for y in b] for x in a]


def brute_distance(a, b, free_start):
    row = [0 if free_start else j for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        new = [i]
        for j in range(1, len(b) + 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1])))
        row = new
    return row


def test_edit_distances():
    draw = random.Random(3)
    for _ in range(150):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randint(1, 70))) for _ in range(2))
        row = brute_distance(a, b, True)
        assert decontam.best_match(a, b) == (min(row), row.index(min(row)))
        assert editprint.edit_distance(a, b) == brute_distance(a, b, False)[-1]
    assert editprint.edit_distance("", "abc") == 3


def test_leaks_are_found_with_edits():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9)))
    items = [" ".join(word() for _ in range(30)) for _ in range(40)]
    index = decontam.Items(list(range(40)), pa.array(items), decontam.Walks())
    texts = []
    for item in items:
        edited = "".join(draw.choice("xyz") if draw.random() < 0.05 else c for c in item)
        texts.append(" ".join(word() for _ in range(50)) + "\n " + edited.title() + " " + " ".join(word() for _ in range(50)))
    rows, which, starts, ends, edits = decontam._verified(index, pa.array([*texts, None, "", "short"]), 0.2)
    assert sum(r == w for r, w in zip(rows, which)) >= 0.9 * 40 and all(r == w for r, w in zip(rows, which))
    folded = [" ".join(t.lower().split()) for t in texts]
    for r, s, e, d in zip(rows, starts, ends, edits):
        assert brute_distance(items[r], folded[r][s:e], False)[-1] == d


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 64, 1000):
        for key in (0, 12345):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))


def test_hmm_likelihood_and_counts_match_sums_over_paths():
    random_ = np.random.default_rng(0)
    start, move, emit = (random_.dirichlet(np.ones(k), n) for n, k in ((1, 2), (2, 2), (2, 3)))
    model = hmm.Model(start[0], move, emit)
    texts = [[0, 2, 1], [1], [2, 2, 0, 1]]
    flat, sizes = np.array(sum(texts, [])), np.array([len(t) for t in texts])
    want, moves, starts, emissions = [], np.zeros((2, 2)), np.zeros(2), np.zeros((2, 3))
    for text in texts:
        paths = {}
        for path in itertools.product((0, 1), repeat=len(text)):
            p = model.start[path[0]] * emit[path[0], text[0]]
            for i in range(1, len(text)):
                p *= move[path[i - 1], path[i]] * emit[path[i], text[i]]
            paths[path] = p
        total = sum(paths.values())
        want.append(np.log(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for i, state in enumerate(path):
                emissions[state, text[i]] += p / total
                if i:
                    moves[path[i - 1], state] += p / total
    assert np.allclose(hmm.log_likelihood(flat, sizes, model), want)
    got = hmm._expected(flat, np.concatenate(([0], np.cumsum(sizes))), model)
    assert all(np.allclose(a, b) for a, b in zip(got, (starts, moves, emissions)))


def test_anchors_leave_no_gap():
    draw = random.Random(2)
    text = " ".join(str(draw.randint(0, 500)) for _ in range(400))
    at = passages.anchors(T.words(pa.array([text, "a b", None])), 24, 27)
    assert at[0] < 27 and max(np.diff(at)) <= 27 and at[-1] >= 400 - 24 - 27


def test_equal_texts_have_equal_prints_and_edits_stay_near():
    draw = random.Random(4)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(600))
    other = text[::-1]
    slots = editprint.prints([text, text, text[:2000] + "Z" + text[2000:], other, "", "", "a" * 5000])
    near = lambda i, j: (slots[i] == slots[j]).mean()
    assert near(0, 1) == 1 and near(4, 5) == 1 and near(0, 2) > 0.6 and near(0, 3) < 0.2 and near(0, 4) == 0


def test_token_spans_and_rules():
    vocabulary = tokencount.read_vocabulary()
    text = "Wort für\n\n\nWört 日本語 end\n"
    start, end = tokencount.token_spans(text, vocabulary)
    assert start[0] == 0 and end[-1] == len(text) and (np.diff(start) >= 0).all()
    begins = np.array([0, 4, 6])
    counts, crossing = tokencount.allocate(np.array([0, 3]), np.array([3, 9]), begins, "most")
    assert crossing == 1 and counts.tolist() == [1, 0, 1]
    assert tokencount.allocate(np.array([0, 3]), np.array([3, 9]), begins, "first")[0].tolist() == [2, 0, 0]
    # of two sections with as many characters the earlier one
    assert tokencount.allocate(np.array([3]), np.array([5]), begins, "most")[0].tolist() == [1, 0, 0]


def test_trie_agrees_with_all_rules():
    draw = random.Random(9)
    rules = [urlfilter.Rule(draw.choice(["allow", "block"]), h, p) for h in ("", "com", "a.com", "b.a.com")
             for p in ("", "/", "/x", "/x/", "/x/y", "/x/yz/w") if draw.random() < 0.7]
    trie = urlfilter.build_trie(rules)
    for host, path in itertools.product(["", "com", "a.com", "b.a.com", "xa.com"],
                                        ["", "/", "/x", "/xx", "/x/", "/x/yy", "/x/yz/w/", "/x/yz"]):
        fit = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        want = max(fit, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "block"), default=None)
        assert urlfilter.longest_rule(trie, host, path) == (tuple(want) if want else None), (host, path)
    with pytest.raises(ValueError):
        urlfilter.build_trie([urlfilter.Rule("maybe", "a", "")])


def test_bag_counts():
    text, value, count = T.bag(np.array([1, 0, 1, 1]), np.array([5, 5, 5, 6], np.uint64))
    assert collections.Counter(zip(text.tolist(), value.tolist(), count.tolist())) == {(0, 5, 1): 1, (1, 5, 2): 1, (1, 6, 1): 1}


def test_anchors_are_the_first_least_words_of_each_gap():
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(list("abc")[:k], n)) for k in (1, 2, 3) for n in draw.integers(0, 90, 40)]
    for window, gap in ((5, 7), (3, 1), (6, 27)):
        found = T.words(pa.array(texts))
        value = T.mix(found.hash + np.append(found.hash[1:], np.uint64(0)) * np.uint64(3)) >> np.uint64(1)
        wanted, begin = set(), 0
        for n in found.counts.tolist():
            starts = n - window + 1
            for a in range(begin, begin + max(starts - gap + 1, starts > 0)):
                wanted.add(a + int(value[a:min(a + gap, begin + starts)].argmin()))
            begin += n
        assert passages.anchors(found, window, gap).tolist() == sorted(wanted)
        assert len(passages._sliding(value, gap, np.minimum)) == len(value) - gap + 1


def test_word_hashes_byte_by_byte():
    """Words of all lengths, long ones too, have the hashes that their byte ranges have on their own."""
    rows = ["Ab  AZ@[`{ \t" + " ".join("x" * k + "É" for k in range(60)), None, "", " \x08\x0e\x1f ", "q" * 500, "a"]
    found = T.words(pa.array(rows, pa.string()))
    lowered = [(r or "").translate({c: c + 32 for c in range(65, 91)}).encode() for r in rows]
    assert found.counts.tolist() == [len(re.split(rb"[ \t-\r]+", r.strip(b" \t\n\x0b\x0c\r"))) if r.strip() else 0 for r in lowered]
    assert bytes(found.data) == b"".join(lowered)
    assert (T._word_hashes(found.data, found.start, found.end) == T.spans_hash(found.data, found.start, found.end)).all()
    assert (found.hash == T.spans_hash(found.data, found.start, found.end)).all()
