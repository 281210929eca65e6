"""Whitening and hard negatives against plain versions, and their defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyframe.llm import negatives, queries, whitening
from tests.conftest import SF_DIR

NAN, INF = float("nan"), float("inf")


def vectors(n, size, seed=1):
    return np.random.default_rng(seed).standard_normal((n, size)).astype(np.float32)


def plain_whitening(entries, scale=1024, shift=100_000):
    x = np.floor(np.asarray(entries, float) * scale).astype(np.int64) + shift
    n, total = len(x), x.sum(axis=0)
    apart = x - total / n
    values, components = np.linalg.eigh(apart.T @ apart / n)
    values, components = values[::-1], components[:, ::-1]
    deviation = [sum(int(n * v - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    return deviation, apart @ components / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_whitening_equals_a_plain_decomposition(spark):
    x = vectors(300, 10) * np.linspace(5, 0.5, 10, dtype=np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<float>, component string, n int").repartition(5)
    got = by_component(whitening.whitened(rows, most=4).collect())
    deviation, white, share = plain_whitening(x)
    sign = {c: math.copysign(1, got[0][c].whitened * white[0, c - 1]) for c in range(1, 5)}
    for i, own in got.items():
        assert sorted(own) == [1, 2, 3, 4]
        for c, r in own.items():
            assert r.n == 300 and int(r.deviation) == deviation[i] and r.identity_error < 1e-9
            assert abs(r.explained - share[c - 1]) < 1e-9 and abs(r.whitened * sign[c] - white[i, c - 1]) < 1e-8


def test_whitening_query(spark):
    got = by_component(queries.REGISTRY["op12_whitening"](spark, SF_DIR).collect())
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").toPandas()
    deviation, _, share = plain_whitening(np.stack(table["embedding"].to_numpy()))
    for i, d in zip(table["vec_id"], deviation, strict=True):
        assert got[i][1].deviation == d and sorted(got[i]) == list(range(1, 9))
        assert abs(got[i][8].explained - share[7]) < 1e-9


def test_whitening_takes_what_is_usable(spark):
    schema = "vec_id long, embedding array<double>, extra string"
    bad = [(1, None, "a"), (2, [1.0, None, 2.0], "a"), (3, [NAN, 0.0, 1.0], "a"), (4, [INF, 0.0, 1.0], "a"), (5, [], "a"),
           (6, [1.0], "a")]
    good = [(None, [0.0, 0.0, 7.0], "a"), (8, [1.0, 2.0, 7.0], "a"), (8, [1.0, 2.0, 7.0], None), (9, [-4.0, 1.0, 7.0], "b")]
    got = whitening.whitened(spark.createDataFrame(bad + good, schema)).collect()
    # the third dimension is constant, so there are two components; repeated rows count each
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (8, 1), (8, 1), (8, 2), (8, 2), (9, 1), (9, 2)]
    assert all(r.n == 4 for r in got) and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12
    for rows in (bad[:5], [], [good[0]], [good[1], good[2]]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []


def test_whitening_is_exact_for_large_entries(spark):
    x = [[3e8, 1.0], [-3e8, 2.0], [1e8, 3.5]]
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = by_component(whitening.whitened(rows).collect())
    assert [int(got[i][1].deviation) for i in range(3)] == plain_whitening(x)[0]
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(huge).collect()} <= {1, 2}


@pytest.mark.parametrize("size", [1, 2, 5, 8])
def test_factors(size):
    random = np.random.default_rng(size)
    matrix = random.standard_normal((size, max(size - 2, 1)))
    matrix = matrix @ matrix.T
    factor, order = whitening.pivoted_cholesky(matrix)
    assert factor.shape[1] == max(size - 2, 1) and np.allclose(factor @ factor.T, matrix[order][:, order])
    turned = whitening.jacobi(factor)
    products = turned.T @ turned
    assert np.allclose(products, np.diag(np.diagonal(products)), atol=1e-12 * max(1, products.max()))
    assert np.allclose(turned @ turned.T, factor @ factor.T)
    model = whitening.components(matrix, size)
    assert np.allclose(model.components * model.values @ model.components.T, matrix)


def plain_negatives(rows, anchors, positives=5, negatives_=10, low=30, high=90, scale=256):
    whole = {i: (label, np.floor(np.asarray(v, float) * scale).astype(np.int64)) for i, label, v in rows}
    out = set()
    for a in anchors:
        label, v = whole[a]
        scored = sorted((-int(v @ w), i, other == label) for i, (other, w) in whole.items() if i != a)
        for p_score, p, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and -low * p_score <= -100 * s[0] <= -high * p_score]
            out |= {(a, p, k, n, -p_score, -s) for k, (s, n, _) in enumerate(fits[:negatives_], 1)}
    return out


def mined(rows, anchor, **options):
    frame = negatives.hard_negatives(rows, anchor, **options)
    return [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in frame.collect()]


@pytest.mark.parametrize("options", [{}, {"block": 7}, {"levels": 1, "bits": 2}, {"positives": 2, "negatives": 3}])
def test_negatives_equal_brute_force(spark, options):
    x = vectors(600, 70, 5)
    x[100:140] = x[100]
    x[300:330] = 0
    rows = [(i - 50, i * 7 % 4, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>").repartition(6)
    got = mined(frame, F.col("vec_id") % 20 == 0, **options)
    counts = {k.replace("negatives", "negatives_"): v for k, v in options.items() if k in ("positives", "negatives")}
    want = plain_negatives(rows, [i for i, *_ in rows if i % 20 == 0], **counts)
    assert len(got) == len(set(got)) and set(got) == want


def test_negatives_with_gaps_ties_and_copies(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 2, [1.0, 5.0]), (4, 2, [1.0, -3.0]), (5, 2, [1.5, 0.0]),
            (6, 2, [3.0, 0.0]), (7, 3, [0.0, 1.0]), (8, 2, [-1.0, 0.0]), (100, 9, [1.0, 1.0])]
    odd = [(None, 1, [9.0, 0.0]), (10, None, [1.0, 0.0]), (11, 2, None), (12, 2, [None, 1.0]), (13, 2, [NAN, 1.0]),
           (14, 1, [INF, 1.0]), (15, 2, [1.0]), (16, 2, []), (3, 2, [1.0, 5.0]), (3, 4, [9.0, 9.0])]
    schema = "vec_id long, label int, vector array<double>"
    frame = spark.createDataFrame(rows + odd, schema).withColumn("code", F.lit("x")).withColumn("rank", F.lit(1))
    anchor = F.col("vec_id") % 100 == 0
    got = mined(frame, anchor)
    assert set(got) == plain_negatives(rows, [0, 100])
    assert [g[3] for g in sorted(got) if g[1] == 1] == [5, 3, 4, 100]
    assert mined(spark.createDataFrame([], schema), anchor) == []
    assert mined(spark.createDataFrame(rows[1:-1], schema), anchor) == []
    assert mined(spark.createDataFrame(odd[:2], schema), anchor) == []


def test_intervals_hold_and_rule_out(spark):
    rows = [(i, i % 10, v.tolist()) for i, v in enumerate(vectors(500, 64, 9) / 8)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, vector array<double>")
    table = negatives.coded(frame, 64, 256.0, negatives.LEVELS)
    anchors = negatives.prepared(table.where("vec_id < 50").orderBy("vec_id").toArrow(), 64, negatives.BITS)
    for part in negatives._rows(iter(table.toArrow().combine_chunks().to_batches()), 64):
        low, high = negatives.intervals(anchors, part)
        score = anchors.vectors @ part.vectors.T
        assert (low <= score).all() and (score <= high).all()
        # the width is a fraction of what scores spread over
        assert (high - low).mean() < 0.5 * anchors.size.mean() * part.size.mean()
        best = negatives.Best(len(anchors.ids), 5)
        negatives.best_positives(anchors, part, best)
        out_of_reach = high < best.floor[:, None]
        assert len(part.ids) == 500 and out_of_reach.mean() > 0.3
