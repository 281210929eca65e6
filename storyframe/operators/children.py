"""Lists of children per scene, kept in pieces so that no scene has to fit in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.operators.intervals import interval_join
from storyframe.operators.skew import largest_group, numbered
from storyframe.session import cut_lineage

PART_ROWS = 1000


def attach(scenes: DataFrame, children: DataFrame, order: list[str], same_chapter: bool,
           carry: tuple[str, ...] = (), unit: float = 1.0) -> DataFrame:
    """Children on the scenes that hold their start, numbered per scene and kind in `order`.

    Both frames have `project_id`, `chapter_id` and `start_seconds`; scenes also have `end_seconds`, children `kind`.
    With `same_chapter` a child only meets scenes of its own chapter. `carry` names scene columns to keep.
    """
    keys = ["project_id", "chapter_id"] if same_chapter else ["project_id"]
    spans = scenes.select(*keys, "scene_id", F.col("start_seconds").alias("scene_start"),
                          F.col("end_seconds").alias("scene_end"), *carry)
    points = children if same_chapter else children.drop("chapter_id")
    # No scene has more children than its key has points.
    top = largest_group(points, keys)
    matched = interval_join(spans, points, keys, "scene_start", "scene_end", "start_seconds", unit, top)
    placed = numbered(matched.drop("scene_start", "scene_end"), ["project_id", "scene_id", "kind"], order, "ordinal",
                      at_most=top)
    return placed.drop("chapter_id") if same_chapter else placed


def with_empty(scenes: DataFrame, attached: DataFrame) -> DataFrame:
    """Attached children and one row without a child for each scene that has none.

    The children are written once, since they are read twice; no scene's children have to meet in one task.
    """
    keys = ["project_id", "scene_id"]
    attached = cut_lineage(attached)
    empty = scenes.join(attached.select(*keys).distinct(), keys, "left_anti")
    return attached.unionByName(empty, allowMissingColumns=True)


def listed(rows: DataFrame, keys: list[str], ordinal: str, value: str, out: str, size: int = PART_ROWS) -> DataFrame:
    """Ordered arrays of `value` per key in parts of at most `size` items; part 0 holds the first ones."""
    part = F.floor((F.col(ordinal) - 1) / size).cast("long").alias("part")
    items = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(*keys, part).agg(F.transform(items, lambda x: x["v"]).alias(out))
