"""Quality by attention: accuracy on held-out rows, gradients against differences, features against a plain version, odd rows."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyframe.llm import quality, queries
from tests.conftest import SF_DIR


def texts_of_two_kinds(n, seed=4):
    random = np.random.default_rng(seed)
    out = []
    for i in range(n):
        body = " ".join("".join(random.choice(list("abcdefgh"), 5)) for _ in range(int(random.integers(5, 300))))
        out.append((i, body if i % 3 else body + " $$$ ###" * int(random.integers(20, 40)), int(i % 3 > 0)))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    rows = texts_of_two_kinds(400)
    docs = spark.createDataFrame([(i, t, "k", "p") for i, t, _ in rows], "doc_id long, text string, key string, label string")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, label int")


def test_held_out_rows_are_told_apart(frames):
    docs, labels = frames
    held = F.col("doc_id") % 5 == 0
    for bounds in ({}, {"max_docs": 60}, {"max_chars": 60_000}):
        got = quality.report(docs, labels, held, **bounds).join(labels, "doc_id").where("held_out").collect()
        assert sum((r.score >= 0.5) == (r.label == 1) for r in got) / len(got) > 0.95


def test_attention_finds_the_passages_that_decide(spark, frames):
    docs, labels = frames
    model = quality.fit(docs, labels)
    text = " ".join(["abcde"] * 640 + ["$$$ ###"] * 32 + ["fghab"] * 640)
    got = quality.score(spark.createDataFrame([(1, text)], "key long, text string"), model).first()
    assert got.n_passages == 21 and got.top_passage == 10 and got.top_weight > 1 / 21


def test_query_over_the_table(spark):
    got = queries.REGISTRY["op11_quality"](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert got.count() == docs.count()
    again = {(r.doc_id, r.score) for r in queries.REGISTRY["op11_quality"](spark, SF_DIR).collect()}
    assert {(r.doc_id, r.score) for r in got.collect()} == again
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    judged = got.join(labels, "doc_id")
    assert judged.where("quality = 1").selectExpr("avg(predicted)").first()[0] > 0.95
    assert judged.where("quality = 0").selectExpr("avg(predicted)").first()[0] < 0.4


def test_prior_does_not_depend_on_the_bound(spark):
    """A mark is in half of 100 poor and a tenth of 900 good texts: 90 of the 140 that have it are good."""
    rows = [(i, "an odd ## thing" if (i % 2 if i < 100 else i % 10 == 0) else "a calm new day") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(1000)], "doc_id long, label int")
    for bound in (1000, 200):
        model = quality.fit(docs, labels, max_docs=bound)
        got = {r.key: r.score for r in quality.score(docs.where("doc_id < 2").select(F.col("doc_id").alias("key"), "text"), model).collect()}
        assert 0.4 < got[1] < 0.85 < got[0]


def test_odd_rows(spark, frames):
    docs, labels = frames
    odd = spark.createDataFrame([(None, "x"), (None, None), (1, ""), (1, " \n\t"), (2, None), (3, "é" * 300_000), (3, "ab " * 100_000),
                                 (4, "same"), (4, "same")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd)
    more = labels.union(spark.createDataFrame([(None, 1), (1, None), (1, 7), (2, 0), (2, 1)], "doc_id long, label int"))
    got = quality.report(rows, more, F.col("doc_id") % 5 == 0).collect()
    assert len(got) == 409 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    model = quality.fit(rows, more)
    keyed = odd.select(F.struct("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    scored = [(r.key.text, r.score, r.n_passages) for r in quality.score(keyed, model).collect()]
    assert len({s for t, s, _ in scored if not (t or "").strip()}) == 1 == len({s for t, s, _ in scored if t == "same"})
    assert {n for t, _, n in scored if t == "ab " * 100_000} == {-(-100_000 // 64)}


def test_without_labels_of_both_kinds(spark, frames):
    docs, labels = frames
    for some, want in ((labels.limit(0), 0.5), (labels.where("label = 1"), 0.9999), (labels.where("label = 0"), 0.0001)):
        assert {round(r.score, 6) for r in quality.report(docs, some, F.lit(False)).collect()} == {want}
    none = docs.limit(0)
    assert quality.report(none, labels, F.lit(False)).count() == 0 == quality.report(none, labels.limit(0), F.lit(False)).count()


def test_gradient_against_differences():
    random = np.random.default_rng(8)
    x, text = random.standard_normal((9, 5)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 2])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    parts = [random.standard_normal(s) for s in ((5, 4), 4, (4, 3), (4, 3), 3, 4)] + [np.array(0.3)]

    def loss(values):
        model = quality.Model(None, None, *values)
        p = quality._sigmoid(quality._attended(model, x, text, 3)[-1] @ model.out + model.bias)
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / 3

    slopes = quality._gradient(quality.Model(None, None, *parts), x, text, label, weight)
    for k, part in enumerate(parts):
        for place in np.ndindex(part.shape):
            up, down = ([p.copy() for p in parts] for _ in range(2))
            up[k][place] += 1e-5
            down[k][place] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - np.asarray(slopes[k])[place]) < 1e-6


def test_features_against_a_plain_version():
    texts = ["One two TWO two two,\nthree 4 ## é\n\n" + "word " * 70, "", "  \n ", "a"]
    got, text = quality.features(pa.array(texts))
    assert text.tolist() == [0, 0, 1, 2, 3]
    words = texts[0].split()
    for at, part in ((0, words[:64]), (1, words[64:])):
        data = "".join(part).encode()
        counts = collections.Counter(min(b, 128) for b in data)
        assert np.allclose(got[at, :129], [np.sqrt(counts[b] / len(data)) for b in range(129)], atol=1e-6)
        own = got[at, 129:]
        assert np.isclose(own[0], len(part) / 64) and np.isclose(own[2], len(set(part)) / len(part))
        assert np.isclose(own[1], np.log1p(sum(len(w.encode()) for w in part) / len(part)), atol=1e-6)
        assert np.isclose(own[4], sum(a == b for a, b in zip(part, part[1:])) / len(part))
        assert np.isclose(own[5], sum(w == w.upper() != w.lower() and w.isascii() for w in part) / len(part))
    # after a line end begin `three`, and the first `word`
    assert np.isclose(got[0, 129 + 9], 2 / 64) and not got[2].any()
