"""Catalogue tables in buckets, search through the index, levels of interval joins."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyframe.operators.intervals import interval_join
from storyframe.operators.skew import numbered, running_total
from storyframe.plans import catalogue, search
from storyframe.session import cut_lineage
from storyframe.sources import catalogue as tables

SCHEMA = "id long, title string, status string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_of(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names
            if n.endswith(".parquet")}


def scanned(df):
    """Files that the scan of a collected frame read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).selectExpr("id", "concat('t', id) AS title", "'old' AS status")
    tables.write_table(rows, path, "id", buckets=16)
    return path


def test_upsert_replaces_rows_and_leaves_other_buckets(spark, table):
    before = files_of(table)
    assert len(before) == 16
    changes = spark.createDataFrame([(5, "five", "new"), (5000, "more", "new"), (None, "none", "new")], SCHEMA)
    tables.upsert(spark, table, changes, "id", buckets=16)
    once = rows_of(tables.read_table(spark, table))
    assert len(once) == 1002 and (5, "five", "new") in once and (5000, "more", "new") in once and (6, "t6", "old") in once
    after = files_of(table)
    kept = [f for f in before if after.get(f) == before[f]]
    assert 13 <= len(kept) < 16
    # run again, as after a failure
    tables.upsert(spark, table, changes.where("id IS NOT NULL"), "id", buckets=16)
    assert rows_of(tables.read_table(spark, table)) == once
    tables.upsert(spark, table, changes.limit(0), "id", buckets=16)
    assert rows_of(tables.read_table(spark, table)) == once


def test_point_reads_open_one_bucket(spark, table):
    for id_ in (7, "7"):
        one, again = (tables.by_id(spark, table, id_, "id", buckets=16) for _ in range(2))
        assert rows_of(one) == [(7, "t7", "old")] and scanned(again) == 1
    assert rows_of(tables.by_id(spark, table, 7000, "id", buckets=16)) == []
    plan = tables.by_id(spark, table, 7, "id", buckets=16)._jdf.queryExecution().toString()
    assert "EqualTo(id,7)" in plan
    ids = spark.createDataFrame([(3,), (3,), (999,), (-1,), (None,)], "id long")
    assert rows_of(tables.by_ids(spark, table, ids, "id", buckets=16)) == [(3, "t3", "old"), (999, "t999", "old")]


def test_search_through_the_index_equals_the_scan(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abAB é#1") for _ in range(n))
    rows = spark.createDataFrame([(i, text(rng.randrange(12)), rng.choice([None, text(9)])) for i in range(300)],
                                 "id long, title string, work string")
    queries = {i: text(rng.randrange(9)) for i in range(40)} | {40: "", 41: None, 42: "  ", 43: "aab b", 44: "zzz", 45: "é"}
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    fields = ["title", "work"]
    filled = rows.fillna("")
    for rarest in (1, 3):
        got = search.search(asked, rows, search.index(rows, "id", fields), "id", fields, rarest)
        found = sorted(map(tuple, got.collect()))
        want = sorted((i, r.id) for i, q in queries.items() for r in catalogue.searched(filled, q or "", fields).collect()) \
            if rarest == 1 else want
        assert found == want and len(found) > 900


def test_the_index_is_in_blocks_and_pairs_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abAB é#1") for _ in range(n))
    schema = "id long, title string, work string"
    rows = spark.createDataFrame([(i, text(rng.randrange(12)), rng.choice([None, text(9)])) for i in range(400)], schema)
    odd = rows.unionByName(rows.where("id % 7 = 0")).unionByName(spark.createDataFrame([(None, "ab", "ab")], schema))
    queries = {i: text(rng.randrange(9)) for i in range(30)} | {30: "", 31: None, 32: "zzz", 33: "é"}
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    fields, got = ["title", "work"], []
    for block_rows, pairs in ((10_000, 100_000), (30, 7)):
        monkeypatch.setattr(search, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(search, "PAIRS", pairs)
        postings = [cut_lineage(search.index(r, "id", fields)) for r in (rows, odd)]
        found = [search.search(asked, r, p, "id", fields) for r, p in zip((rows, odd), postings, strict=True)]
        got.append([rows_of(f) for f in found])
        # a list for each run of a block, and each key once
        blocks = postings[0].select("block").distinct().count()
        assert postings[0].where("run IS NULL").count() == 400 and (blocks > 5) == (block_rows == 30)
        lists = postings[0].where("run IS NOT NULL")
        assert lists.count() == lists.select("block", "run").distinct().count() < lists.agg(F.sum("n")).first()[0]
        # what is behind the comparison goes through no shuffle
        assert "Exchange" not in found[0]._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    filled = rows.fillna("")
    assert got[0] == got[1] and got[0][0] == sorted(
        ((i, r.id) for i, q in queries.items() for r in catalogue.searched(filled, q or "", fields).collect()), key=str)
    # a key of several rows is taken only if it is listed once for each run
    assert [x for x in got[0][1] if x[1] % 7] == [x for x in got[0][0] if x[1] % 7] and (30, 7) not in got[0][1]


@pytest.mark.parametrize("places, kind", [([0, 3], 2), (list(range(0, 500, 2)), 0), ([1, 1, 4], 10), ([7, 99_999], 4)])
def test_places_are_written_and_read(places, kind):
    size = 100_000 if kind == 4 else 500
    data = search._written(np.array(places), size)
    assert data[0] == kind and search._read(data).tolist() == places


def test_queries_of_equal_words_have_one_form_and_frequent_runs_are_not_looked_up(spark):
    asked = spark.createDataFrame([(1, "b  A"), (2, " a B\tb"), (3, None), (4, " ")], "query_id long, query string")
    assert [r[0] for r in asked.orderBy("query_id").select(search.normal(F.col("query"))).collect()] == ["a b", "a b", "", ""]
    rows = spark.range(100).selectExpr("id", "concat('common ', 100 + id) AS title")
    postings = cut_lineage(search.index(rows, "id", ["title"]))
    found = search.search(spark.createDataFrame([(1, "common 142")], "query_id long, query string"), rows, postings, "id", ["title"])
    assert rows_of(found) == [(1, 42)]
    # the index tells of one row for "142"; the runs of "common" have all rows
    listed = found._jdf.queryExecution().toString()
    assert "filter(runs" in listed


def test_a_long_interval_repeats_only_the_points_of_its_key(spark):
    spans = [(k, i, float(i), i + 1.0) for k in range(20) for i in range(10)] + [(0, 99, 0.0, 1e9)]
    intervals = spark.createDataFrame(spans, "k long, span long, begin double, stop double")
    points = spark.range(2000).selectExpr("id % 20 AS k", "id AS point", "cast(id % 97 AS double) / 7 AS at")
    joined = interval_join(intervals, points, ["k"], "begin", "stop", "at")
    got = rows_of(joined.select("span", "point"))
    plain = intervals.join(points.withColumnRenamed("k", "j"), F.expr("k = j AND begin <= at AND at < stop"))
    assert got == rows_of(plain.select("span", "point"))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "__levels" in plan
    # rows that points are exploded to: one level for each key, one more for the key of the long interval
    exploded = points.join(intervals.selectExpr("k", "ceil(log(8, greatest(stop - begin, 1))) AS level").distinct(), "k")
    assert exploded.count() == 2000 + 100


def test_whole_frames_are_not_numbered_by_one_task(spark, sizes):
    rows = spark.range(500).selectExpr("id * 37 % 500 AS a", "id AS b").repartition(7)
    got = numbered(rows, [], ["a", "b"], "n")
    # only the counts of the slices, one row each, meet in one task
    plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    alone = [i for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
    assert len(alone) == 1 and "HashAggregate(keys=[__slice" in plan[alone[0] + 1]
    assert [tuple(r) for r in got.select("a", "n").orderBy("n").collect()] == [(i, i + 1) for i in range(500)]


def test_running_totals(spark, sizes):
    rows = [(g, i, (i * 7 + g) % 5) for g in (1, 2, 3) for i in range(20 * g)]
    got = running_total(spark.createDataFrame(rows, "g int, i int, x long").repartition(6), ["g"], ["i"], "x", "before")
    assert rows_of(got) == sorted(((g, i, x, sum(y for h, j, y in rows if h == g and j < i)) for g, i, x in rows), key=str)
