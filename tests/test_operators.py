"""Operators against brute force, with plain and with split groups."""

import random

import pytest
from pyspark.sql import functions as F

from storyframe.operators import skew
from storyframe.operators import timeline as N
from storyframe.operators.intervals import interval_join
from storyframe.operators.skew import join_hot, numbered, with_previous


def insertion(scenes):
    """The list built by inserting one scene after the other."""
    order = [s["scene_id"] for s in scenes if s["marker"] not in ("INSERT_PAST", "FORWARD")]
    inserts = sorted((s for s in scenes if s["marker"] == "INSERT_PAST"),
                     key=lambda s: (s["chapter_rank"], s["scene_rank"], s["inner_rank"]))
    listed = [str(i) for i in order]
    for s in inserts:
        at = listed.index(s["target"]) + 1 if s["target"] in listed else len(listed)
        listed.insert(at, str(s["scene_id"]))
    return [int(i) for i in listed]


def random_project(rng, size):
    scenes = []
    for i in range(1, size + 1):
        target = rng.randint(1, size + 2)
        scenes.append({
            "scene_id": i, "marker": rng.choice(["INSERT_PAST", "INSERT_PAST", "FORWARD", "NONE", None]),
            "chapter_rank": float(rng.randint(1, 3)), "scene_rank": float(target),
            "inner_rank": float(rng.randint(1, 2)), "target": rng.choice([str(target), f"{target}.0", str(target)])})
    return scenes


def nested_project(rng, size, reach):
    """Flashbacks within flashbacks: each scene goes behind one of the last `reach` scenes."""
    return [{"scene_id": 1, "marker": "NONE", "chapter_rank": None, "scene_rank": None, "inner_rank": None,
             "target": None}] + [
        {"scene_id": i, "marker": "INSERT_PAST", "chapter_rank": 1.0, "scene_rank": float(i // 3), "inner_rank": 1.0,
         "target": str(rng.randint(max(1, i - reach), i - 1))} for i in range(2, size)]


@pytest.mark.parametrize("rounds", [None, 2])
def test_narrative_order_equals_insertion(spark, sizes, rounds, monkeypatch):
    """With few rounds of path joining, nested inserts are ranked by their neighbours."""
    if rounds is not None:
        monkeypatch.setattr(N, "PATH_ROUNDS", rounds)
    rng = random.Random(11)
    projects = {f"p{k}": random_project(rng, rng.randint(0, 25)) for k in range(150)}
    projects["chain"] = nested_project(rng, 40, 1)
    projects["bushes"] = nested_project(rng, 80, 6)
    projects["deep"] = nested_project(rng, 150, 1) if rounds is None else random_project(rng, 9)
    rows = [(p, "0", *s.values()) for p, scenes in projects.items() for s in scenes]
    df = spark.createDataFrame(rows, "project_id string, branch_key string, scene_id bigint, marker string, "
                                     "chapter_rank double, scene_rank double, inner_rank double, target string")
    got = {}
    for r in sorted(N.narrative_order(df).collect(), key=lambda r: r["narrative_index"]):
        got.setdefault(r["project_id"], []).append(r["scene_id"])
    assert got == {p: insertion(s) for p, s in projects.items() if insertion(s)}


def test_interval_join_equals_theta_join(spark, sizes):
    rng = random.Random(3)
    spans = [(rng.randint(0, 2), i, s, s + rng.choice([-1, 0, 0.25, 3, 60, 700, 90000]))
             for i in range(120) for s in [rng.choice([0.0, rng.uniform(-50, 3000)])]]
    points = [(rng.choice([0, 0, 0, 1]), i, rng.choice([0.0, rng.uniform(-100, 4000)])) for i in range(400)]
    spans += [(0, 1000, 5.0, 6.0)]
    points += [(0, 1000, 5.0), (0, 1001, 6.0)]
    left = spark.createDataFrame(spans, "k int, span int, s double, e double")
    right = spark.createDataFrame(points, "k int, point int, t double")
    got = interval_join(left, right, ["k"], "s", "e", "t").select("span", "point").collect()
    want = [(i, j) for k, i, s, e in spans for q, j, t in points if k == q and s <= t < e]
    assert sorted(map(tuple, got)) == sorted(want)


def test_interval_join_of_empty_spans(spark):
    left = spark.createDataFrame([(0, 1, 5.0, 0.0)], "k int, span int, s double, e double")
    right = spark.createDataFrame([(0, 1, 2.0)], "k int, point int, t double")
    assert interval_join(left, right, ["k"], "s", "e", "t").count() == 0


def groups(rng, size):
    """A third of all rows in one group, and a group of nulls."""
    return [(rng.choice(["hot", None, f"g{rng.randint(0, 9)}"]), rng.randint(0, 50), i) for i in range(size)]


def test_numbered(spark, sizes):
    rows = groups(random.Random(1), 900)
    df = spark.createDataFrame(rows, "g string, a int, i int")
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            want[r[2]] = n
    assert {r["i"]: r["n"] for r in numbered(df, ["g"], ["a", "i"], "n").collect()} == want
    everything = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: r[1:]), 1)}
    assert {r["i"]: r["n"] for r in numbered(df, [], ["a", "i"], "n").collect()} == everything


@pytest.mark.parametrize("descending", [False, True])
def test_with_previous(spark, sizes, descending):
    rows = groups(random.Random(2), 900)
    df = spark.createDataFrame(rows, "g string, a int, i int")
    want = {}
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:], reverse=descending)
        want.update({r[2]: before and before[2] for before, r in zip([None, *ordered], ordered)})
    got = with_previous(df, ["g"], ["a", "i"], {"before": "i"}, descending=descending)
    assert {r["i"]: r["before"] for r in got.collect()} == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_hot_equals_join(spark, sizes, how):
    rng = random.Random(4)
    left = spark.createDataFrame(groups(rng, 300), "g string, a int, i int")
    right = spark.createDataFrame([(r[0], r[2]) for r in groups(rng, 60)] + [("alone", 7)], "g string, j int")
    want = left.join(right, ["g"], how).collect()
    assert sorted(map(str, join_hot(left, right, ["g"], how).collect())) == sorted(map(str, want))


def test_every_hot_key_is_salted(spark, monkeypatch):
    """More hot keys than are broadcast."""
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 5)
    spark.conf.set("spark.storyframe.hotRows", "3")
    try:
        left = spark.createDataFrame([(k, i) for k in range(40) for i in range(5)], "k int, i int")
        salts, hint = skew._salt_table(left, ["k"], "n", None)
        assert (salts.count(), hint) == (40, "merge")
        assert join_hot(left, left.withColumnRenamed("i", "j"), ["k"]).count() == 40 * 25
    finally:
        spark.conf.unset("spark.storyframe.hotRows")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from workload import runs
    from tests.conftest import SF_DIR

    for name in ("scene_dialogues", "scene_highlights", "interval_bucketed", "scene_project", "status_changes"):
        text = plan(runs.REGISTRY[name](spark, SF_DIR))
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text, name
        assert "SinglePartition" not in text, name


def test_scan_reads_only_needed_columns(spark):
    from storyframe.plans import status
    from tests.conftest import SF_DIR
    from workload import inputs

    log = inputs.status_log(inputs.table(spark, SF_DIR, "events"))
    text = plan(status.changes(log).select("asset_id", "status"))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_linear_projects_and_branch_names(spark):
    rows = [("a", 1, "0", "0", "linear"), ("a", 2, "0", "0", "linear"), ("b", 1, "1", "1.0", "multi_branch"),
            ("b", 2, "1", "1", "multi_branch"), ("b", 3, "None", "None", "multi_branch")]
    df = spark.createDataFrame(
        rows, "project_id string, scene_id bigint, branch_key string, branch_name string, branch_type string")
    assert {r[0]: r[1] for r in N.linear_projects(df).collect()} == {"a": True, "b": False}
    assert {(r["project_id"], r["branch"]) for r in N.branch_names(df).collect()} == {
        ("a", "BRANCH_0"), ("b", "BRANCH_1.0"), ("b", "BRANCH_None")}


def test_branch_key(spark):
    ids = [("1", True), ("1.0", True), ("1.5", True), ("x", False), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, b struct<value:string,is_number:boolean>")
    got = [r["k"] for r in sorted(df.select("i", N.branch_key(F.col("b")).alias("k")).collect())]
    assert got == ["1", "1", "1.5", "x", "None"]
