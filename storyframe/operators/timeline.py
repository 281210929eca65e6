"""Narrative order with flashback insertion.

A list starts with the scenes that are neither inserted nor told ahead, by scene id. Inserted scenes then follow
in the order of their sort key, each going right behind its target, or to the end while the target is not listed.
The final list is a preorder walk: scenes hang below their target, the last one inserted first. So each scene
gets a path of sort keys and the list is the order of the paths:

- a listed scene, or an insert put at the end, starts a path of its own;
- any other insert extends the path of its target by its negated sort key.

Paths are as long as flashbacks are nested. Where they nest deeper than `2 ** PATH_ROUNDS`, the inserts below an
insert get their rank in the walk from linked neighbours instead, with rows of constant size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyframe.functions.labels import flat_number
from storyframe.operators.skew import join_hot, largest_group, numbered, with_previous
from storyframe.session import cut_lineage

LIST_KEY = ["project_id", "branch_key"]
RANKS = ["chapter_rank", "scene_rank", "inner_rank"]
_SORT = [*RANKS, "scene_id"]
PATH_ROUNDS = 6


def branch_key(branch_id: Column) -> Column:
    """Equal branch ids share a key: `1` and `1.0` are one branch, a missing id is `None`."""
    number = F.when(branch_id["is_number"], branch_id["value"].try_cast("double"))
    whole = F.when(number == F.floor(number), F.floor(number).cast("string"))
    return F.coalesce(whole, branch_id["value"], F.lit("None"))


def timeline_input(scenes: DataFrame) -> DataFrame:
    """The columns the ordering needs, from scenes with `branch` and `timeline_marker` structs."""
    marker = F.col("timeline_marker")
    return scenes.select(
        "project_id", "scene_id", branch_key(F.col("branch.id")).alias("branch_key"),
        F.col("branch.id").alias("branch_id"),
        F.coalesce(F.col("branch.id.value"), F.lit("None")).alias("branch_name"),
        F.col("branch.type").alias("branch_type"),
        F.col("branch.intersection_with").alias("intersection_with"),
        marker["type"].alias("marker"),
        flat_number(marker["insert_chapter_id"]).alias("chapter_rank"),
        flat_number(marker["insert_scene_id"]).alias("scene_rank"),
        flat_number(marker["inner_index"]).alias("inner_rank"),
        marker["insert_scene_id"]["value"].alias("target"),
    )


def narrative_order(scenes: DataFrame, keys: list[str] = LIST_KEY, at_most: int | None = None) -> DataFrame:
    """`keys`, `scene_id` and its 1-based `narrative_index` within each list.

    Scenes told ahead are not listed, nor are inserts whose place cannot be told (see `gaps`); those are rejects.
    `at_most` bounds the scenes of a list.
    """
    top = largest_group(scenes, keys) if at_most is None else at_most
    marker = F.coalesce(F.col("marker"), F.lit(""))
    zero = F.lit(0.0)
    base = scenes.filter(~marker.isin("INSERT_PAST", "FORWARD"))
    # Written once, as the inserts are read several times.
    harmless = cut_lineage(gaps(scenes, keys).filter("NOT compared").drop("compared"))
    placeable = scenes.filter((F.col("marker") == "INSERT_PAST") & ~_has_gap()).unionByName(harmless)
    # Fields that are still empty are so in all inserts they are compared with.
    inserts = placeable.withColumns({c: F.coalesce(c, zero) for c in RANKS})
    rooted = base.select(*keys, "scene_id", F.array(_step(0, zero, zero, zero, F.col("scene_id"))).alias("path"))
    paths = rooted.unionByName(_insert_paths(base, inserts, keys, top))
    return numbered(paths, keys, ["path"], "narrative_index", at_most=top).drop("path")


def gaps(scenes: DataFrame, keys: list[str] = LIST_KEY) -> DataFrame:
    """Inserts with an empty rank, and whether it is `compared` with a value.

    Ranks are compared in turn, up to the first that differ. So an empty one matters only if another insert of the list
    has equal ranks before it and a value there.
    """
    inserts = scenes.filter(F.col("marker") == "INSERT_PAST")
    found = inserts.filter(_has_gap()).withColumn("compared", F.lit(False))
    for i, rank in enumerate(RANKS):
        prefix = [*keys, *RANKS[:i]]
        valued = inserts.filter(F.col(rank).isNotNull()).select(*[F.col(c).alias(f"__{c}") for c in prefix]) \
            .distinct().withColumn("__valued", F.lit(True))
        met = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in prefix])
        joined = found.join(valued, met, "left")
        found = joined.withColumn(
            "compared", F.col("compared") | (F.col(rank).isNull() & F.col("__valued").isNotNull())
        ).drop("__valued", *[f"__{c}" for c in prefix])
    return found


def _has_gap() -> Column:
    return reduce(Column.__or__, [F.col(c).isNull() for c in RANKS])


def _step(appended: int, chapter: Column, scene: Column, inner: Column, scene_id: Column) -> Column:
    return F.struct(F.lit(appended).alias("f"), chapter.alias("c"), scene.alias("s"), inner.alias("i"),
                    scene_id.alias("n"))


def _insert_paths(base: DataFrame, inserts: DataFrame, keys: list[str], top: int) -> DataFrame:
    own = F.struct(*_SORT)
    id_ = F.col("scene_id")
    named = [*keys, id_.cast("string").alias("target"), id_.alias("target_id")]
    targets = inserts.select(*named, own.alias("target_sort")).unionByName(
        base.select(*named), allowMissingColumns=True)
    placed = join_hot(inserts.select(*keys, *_SORT, "target"), targets, [*keys, "target"], "left", left_at_most=top)
    below_base = F.col("target_id").isNotNull() & F.col("target_sort").isNull()
    below_insert = F.coalesce(F.col("target_sort") < own, F.lit(False))
    ranks = [F.col(c) for c in _SORT]
    child = _step(0, *[-c for c in ranks])
    zero = F.lit(0.0)
    state = cut_lineage(placed.select(
        *keys, *_SORT,
        F.when(below_base, F.array(_step(0, zero, zero, zero, F.col("target_id")), child))
        .when(below_insert, F.array(child))
        .otherwise(F.array(_step(1, *ranks))).alias("path"),
        F.when(below_insert, F.col("target_id")).alias("above"),
    ))
    paths = _joined_paths(state.select(*keys, "scene_id", "path", "above"), keys, top)
    return _ranked_paths(state, keys, top) if paths is None else paths


def _joined_paths(state: DataFrame, keys: list[str], top: int) -> DataFrame | None:
    """Complete the paths of inserts below inserts; each round doubles the length that is known.

    None if some are still incomplete after the last round.
    """
    for _ in range(PATH_ROUNDS):
        open_ = state.filter("above IS NOT NULL")
        if open_.isEmpty():
            return state.drop("above")
        upper = state.select(*keys, F.col("scene_id").alias("above"), F.col("path").alias("upper_path"),
                             F.col("above").alias("next_above"))
        longer = join_hot(open_, upper, [*keys, "above"], left_at_most=top, right_at_most=1).select(
            *keys, "scene_id", F.concat("upper_path", "path").alias("path"), F.col("next_above").alias("above"))
        state = cut_lineage(state.filter("above IS NULL").unionByName(longer))
    return state.drop("above") if state.filter("above IS NOT NULL").isEmpty() else None


def _ranked_paths(state: DataFrame, keys: list[str], top: int) -> DataFrame:
    """Paths made of that of the tree's first insert and the rank in the walk through the tree."""
    below = state.filter("above IS NOT NULL")
    first = state.filter("above IS NULL").select(*keys, "scene_id", "path")
    # The walk goes from an insert to the one placed last below it, else to what follows it: the one placed before
    # it on the same target, else what follows the target.
    beside = with_previous(below, [*keys, "above"], _SORT, {"after": "scene_id"}, at_most=top)
    after = _settled(beside.select(
        *keys, "scene_id", "after", F.when(F.col("after").isNull(), F.col("above")).alias("like")), keys)
    nearest = below.groupBy(*keys, F.col("above").alias("scene_id")).agg(
        F.max_by("scene_id", F.struct(*_SORT)).alias("nearest"))
    nodes = after.select(*keys, "scene_id", "after", F.lit(False).alias("is_first")).unionByName(
        first.select(*keys, "scene_id", F.lit(None).cast("long").alias("after"), F.lit(True).alias("is_first")))
    steps = nodes.join(nearest, [*keys, "scene_id"], "left").select(
        *keys, F.coalesce("nearest", "after").alias("scene_id"), F.col("scene_id").alias("back"),
        F.lit(1).cast("long").alias("rank"), "is_first").filter("scene_id IS NOT NULL")
    ranked = _counted(steps, keys).select(*keys, F.col("scene_id").alias("inner"), F.col("back").alias("scene_id"), "rank")
    zero = F.lit(0.0)
    place = _step(0, F.col("rank").cast("double"), zero, zero, F.lit(0).cast("long"))
    deep = join_hot(ranked, first, [*keys, "scene_id"], left_at_most=top, right_at_most=1).select(
        *keys, F.col("inner").alias("scene_id"), F.concat("path", F.array(place)).alias("path"))
    return first.unionByName(deep)


def _settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Resolve `after` of rows that share it with the row named `like`; no two rows name the same one."""
    rows = cut_lineage(rows)
    while not rows.filter("like IS NOT NULL").isEmpty():
        other = rows.select(*keys, F.col("scene_id").alias("like"), F.col("after").alias("their_after"),
                            F.col("like").alias("their_like"))
        moved = rows.filter("like IS NOT NULL").join(other, [*keys, "like"], "left").select(
            *keys, "scene_id", F.col("their_after").alias("after"), F.col("their_like").alias("like"))
        rows = cut_lineage(rows.filter("like IS NULL").unionByName(moved))
    return rows


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Follow `back` to the first row of each walk, adding up the steps; each round doubles their number."""
    rows = cut_lineage(rows)
    while not rows.filter("NOT is_first").isEmpty():
        other = rows.select(*keys, F.col("scene_id").alias("back"), F.col("back").alias("their_back"),
                            F.col("rank").alias("their_rank"), F.col("is_first").alias("theirs_is_first"))
        moved = rows.filter("NOT is_first").join(other, [*keys, "back"]).select(
            *keys, "scene_id", F.col("their_back").alias("back"), (F.col("rank") + F.col("their_rank")).alias("rank"),
            F.col("theirs_is_first").alias("is_first"))
        rows = cut_lineage(rows.filter("is_first").unionByName(moved))
    return rows


def linear_projects(scenes: DataFrame) -> DataFrame:
    """`is_linear` per project: every scene is on the main line."""
    return scenes.groupBy("project_id").agg(F.bool_and(F.col("branch_type") == "linear").alias("is_linear"))


def branch_names(scenes: DataFrame) -> DataFrame:
    """Name of each branch, spelled as by its first scene, and that scene's id, which orders the branches."""
    return scenes.groupBy(*LIST_KEY).agg(
        F.concat(F.lit("BRANCH_"), F.min_by("branch_name", "scene_id")).alias("branch"),
        F.min("scene_id").alias("first_scene"),
    )


def intersections(scenes: DataFrame) -> DataFrame:
    """Scenes where branches meet, with the ids of the branches."""
    return scenes.filter(F.size("intersection_with") > 0)
