"""Interval join: points onto the half-open intervals that hold them.

Intervals are sorted into levels by length; a level's cells are eight times as wide as those of the level below
and at least as wide as its intervals. An interval is listed under the two or three cells it touches, a point
under its cell at every level that its key uses, and the two meet by an equi-join on the cell with the exact comparison as
residual. A pair is met once, and the candidates of an interval all lie within a few of its own lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.operators.skew import join_hot, largest_group
from storyframe.session import hot_rows

_CELL = ["__level", "__cell"]
_FANOUT = 8


def interval_join(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str,
                  unit: float = 1.0, points_at_most: int | None = None) -> DataFrame:
    """Inner join on `keys` where `start <= at < end`. `unit` is the width of the finest cells.

    Apart from the keys the two frames share no column. Empty and inverted intervals match nothing.
    `points_at_most` is the number of points of the largest key, if it is known.
    """
    length = F.greatest((F.col(end) - F.col(start)).cast("double") / unit, F.lit(1.0))
    level = F.ceil(F.log(float(_FANOUT), length)).cast("int")
    spans = intervals.filter(F.col(end) > F.col(start)).withColumn("__level", level)
    # The levels of each key: a key with one long interval lists its own points once more, and no others.
    counts = spans.groupBy(*keys, "__level").agg(F.count(F.lit(1)).alias("__n"))
    levels = counts.groupBy(*keys).agg(F.collect_list("__level").alias("__levels"))
    limit = hot_rows(intervals.sparkSession)
    top = largest_group(points, keys) if points_at_most is None else points_at_most
    hot = top > limit or (counts.agg(F.max("__n")).first()[0] or 0) > limit

    def cell(value, lvl):
        return F.floor(value / (F.lit(unit) * F.pow(F.lit(float(_FANOUT)), lvl)))

    touched = F.sequence(cell(F.col(start), F.col("__level")), cell(F.col(end), F.col("__level")))
    left = spans.withColumn("__cell", F.explode(touched))
    right = (
        join_hot(points, levels, keys, left_at_most=top, right_at_most=1)
        .withColumn("__level", F.explode("__levels")).drop("__levels")
        .withColumn("__cell", cell(F.col(at), F.col("__level")))
    )
    on = [*keys, *_CELL]
    joined = join_hot(left, right, on) if hot else left.join(right, on)
    return joined.filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop(*_CELL)
