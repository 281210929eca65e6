"""Benchmark leaks: recall by length and edits against the limit, short items, blocks, and verification in batches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyframe.llm import decontam

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(draw, chars):
    text = ""
    while len(text) < chars:
        text += "".join(draw.choice(LETTERS) for _ in range(draw.randint(2, 9))) + " "
    return text[:chars].strip().ljust(chars, "x")


def edited(draw, text, share):
    chars = list(text)
    for _ in range(int(share * len(text))):
        at, kind = draw.randrange(len(chars)), draw.randrange(3)
        chars[at:at + (kind > 0)] = [] if kind == 1 else [draw.choice(LETTERS + " ")]
    return "".join(chars)


@pytest.mark.parametrize("low, high", [(24, 40), (60, 90), (150, 400)])
def test_recall_by_length(spark, low, high):
    draw = random.Random(low)
    items = [(i, words(draw, draw.randint(low, high))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for share in (0.0, 0.1, 0.15, 0.2):
        rows = [(i, words(draw, 120) + " " + edited(draw, t, share) + " " + words(draw, 120)) for i, t in items]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = {(r.doc_id, r.item_id) for r in decontam.find_passages(docs, bench).collect()}
        assert sum((i, i) in found for i, _ in items) >= (0.9 if share else 1) * len(items)
    clean = spark.createDataFrame([(i, words(draw, 3000)) for i in range(30)], "doc_id long, text string")
    assert decontam.find_passages(clean, bench).count() == 0 and decontam.clean(clean, bench).count() == 30


def test_every_part_is_compared_where_no_walk_will_do(spark):
    draw = random.Random(2)
    items = [words(draw, 30) for _ in range(20)]
    texts = [words(draw, 500) + " " + edited(draw, t, 0.2) + " " + words(draw, 500) for t in items]
    index = decontam.Items(list(range(20)), pa.array(items), dict.fromkeys(range(3)))
    assert index.everywhere == list(range(20))
    rows, which, starts, ends, edits = decontam._verified(index, pa.array(texts), 0.2)
    assert [(r, i) for r, i in zip(rows, which) if r == i] == [(i, i) for i in range(20)]
    for r, i, s, e, d in zip(rows, which, starts, ends, edits):
        plain = decontam.best_match(items[i], " ".join(texts[r].split()))
        assert (d, e) == plain


def test_short_items_stand_as_they_are(spark):
    bench = spark.createDataFrame([(1, "Twelve chars"), (2, "Seven  letters here"), (3, "x"), (4, "é\tü"), (5, " \n"), (6, "x")],
                                  "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "so TWELVE\n chars it is"), (2, "twelve charsx"), (3, "atwelve chars"), (4, "seven letters  here"), (5, "x y"),
         (6, "xy yx"), (7, "a É ü é ü"), (8, None), (9, "twelve chars"), (10, "y x x")], "doc_id long, text string")
    got = decontam.find_passages(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in got) == [
        (1, 1, 3, 15, 0), (4, 2, 0, 18, 0), (5, 3, 0, 1, 0), (5, 6, 0, 1, 0), (7, 4, 6, 9, 0), (9, 1, 0, 12, 0),
        (10, 3, 2, 3, 0), (10, 6, 2, 3, 0)]
    rest = decontam.clean(docs.withColumn("item_id", F.lit(1)), bench)
    assert sorted(r.doc_id for r in rest.collect()) == [2, 3, 6, 8] and rest.columns == ["doc_id", "text", "item_id"]


def test_results_do_not_depend_on_blocks(spark):
    draw = random.Random(9)
    items = [(i, words(draw, draw.choice((20, 35, 70, 200)))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, words(draw, 50) + " " + edited(draw, t, 0.18 if len(t) > 24 else 0)) for i, t in items],
                                 "doc_id long, text string")
    whole = sorted(map(str, decontam.find_passages(docs, bench).collect()))
    assert len(whole) >= 36 and sorted(map(str, decontam.find_passages(docs, bench, block_chars=500).collect())) == whole


def test_matches_in_batches_equal_single_ones():
    draw = random.Random(4)
    pairs = [("".join(draw.choice("abcé😀") for _ in range(draw.choice((1, 63, 64, 65, 128, 200)))),
              "".join(draw.choice("abcdé") for _ in range(draw.randrange(300)))) for _ in range(300)]
    pairs += [("a" * 200, "a" * 300), ("a" * 64, ""), ("ab" * 70, "ba" * 90)]
    assert decontam.best_matches(pairs) == [decontam.best_match(*p) for p in pairs]
    assert decontam.best_matches([]) == []


def test_equal_beginnings_share_a_walk_and_lose_no_key():
    draw = random.Random(6)
    some = [words(draw, 60) for _ in range(30)]
    texts = pa.array([" ".join(draw.choice(some) for _ in range(4)) for _ in range(50)] + ["", "é", "ab"])
    data, _, begin, _ = decontam.folded(texts)
    begun = decontam.beginnings(data, begin)
    assert len(begun.data) < len(begin) * decontam.BEGUN and len(begun.of) == len(begin)
    items, _, own, _ = decontam.folded(pa.array(some[:3]))
    for setting in decontam.SETTINGS:
        walks = decontam.Walks(*setting)
        for repeat in range(len(walks.moves)):
            wanted = walks.keys(items, own, repeat)[1]
            every, screened = walks.keys(data, begin, repeat), walks.keys(data, begin, repeat, walks.screens(items, own, repeat), begun)
            hits = [{(p, k) for p, k in zip(*(x.tolist() for x in found), strict=True) if k in set(wanted.tolist())}
                    for found in (every, screened)]
            assert hits[0] == hits[1] != set() and len(screened[0]) < len(every[0])


def test_slices_are_verified_together(monkeypatch):
    draw = random.Random(8)
    some = [words(draw, draw.choice((20, 60, 150))) for _ in range(20)]
    items = decontam.Items(list(range(20)), pa.array(some), decontam.Walks())
    column = pa.array([words(draw, 300) + " " + t + " " + words(draw, 50) for t in some])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20)), column], ["doc_id", "text"])
    search = decontam._search(type("Shared", (), {"value": items}), 0.2)
    whole, calls, verify = [b.to_pylist() for b in search([batch])], [], decontam.best_matches
    monkeypatch.setattr(decontam, "best_matches", lambda pairs: calls.append(len(pairs)) or verify(pairs))
    monkeypatch.setattr(decontam, "SLICE_BYTES", 1000)
    assert [b.to_pylist() for b in search([batch])] == whole and len(whole[0]) == 20 and len(calls) == 1
    monkeypatch.setattr(decontam, "BATCH_BYTES", 1000)
    assert sum((b.to_pylist() for b in search([batch])), []) == whole[0] and len(calls) > 2
