"""Numbering, neighbour look-up and joins for groups that may hold a third of all rows.

Each function first asks for the size of the largest group, one aggregate with map-side combine that reads
the key columns only. Groups of at most `spark.storyframe.hotRows` rows get the plain Spark window or join.
Beyond that the hot groups are spread over many tasks: windows by range-partitioned slices, joins by salts.

A caller that knows a bound on the group size passes it as `at_most`; a bound that is small enough saves the
measurement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyframe.session import cut_lineage, hot_rows

SLICE = "__slice"
SALT = "__salt"
# Rows up to which the table of salted keys is broadcast.
MAX_HOT_KEYS = 4096


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group; 0 for an empty frame."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.max("__n")).first()[0] or 0


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, at_most: int | None = None) -> DataFrame:
    """Add `out`, the 1-based position of each row within its group.

    `order` should end in columns that make the position unique. An empty `group` numbers the whole frame.
    """
    if _fits(df, group, at_most):
        return df.withColumn(out, F.row_number().over(_window(group, order)).cast("long"))
    sliced = _sliced(df, group, order)
    before = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # Only a group that began in an earlier slice has an offset: at most one per slice.
    offsets = (
        sliced.groupBy(*group, SLICE).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.sum("__n").over(before))
        .filter("__offset IS NOT NULL").drop("__n")
    )
    local = sliced.withColumn(out, F.row_number().over(_window([*group, SLICE], order)))
    joined = _join_small(local, offsets, [*group, SLICE])
    shifted = F.col(out) + F.coalesce(F.col("__offset"), F.lit(0))
    return joined.withColumn(out, shifted).select(*df.columns, out)


def with_previous(df: DataFrame, group: list[str], order: list[str], columns: dict[str, str],
                  descending: bool = False, at_most: int | None = None) -> DataFrame:
    """Add to each row values of the row before it in its group: `columns` maps new names to source columns.

    With `descending` the row before is the one that follows in ascending order.
    """
    ordering = [F.col(c).desc() if descending else F.col(c) for c in order]
    if _fits(df, group, at_most):
        window = _window(group, ordering)
        return df.withColumns({out: F.lag(src).over(window) for out, src in columns.items()})
    sliced = _sliced(df, group, order)
    window = _window([*group, SLICE], ordering)
    edge_of = F.min_by if descending else F.max_by
    sources = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    across = Window.partitionBy(*group).orderBy(F.col(SLICE).desc() if descending else F.col(SLICE))
    # The last row of the slice before, for groups that began in an earlier slice: at most one per slice.
    carried = (
        sliced.groupBy(*group, SLICE).agg(edge_of(sources, F.struct(*order)).alias("__edge"))
        .withColumn("__carry", F.lag("__edge").over(across))
        .filter("__carry IS NOT NULL").drop("__edge")
    )
    local = sliced.withColumn("__first", F.row_number().over(window) == 1)
    local = local.withColumns({out: F.lag(src).over(window) for out, src in columns.items()})
    joined = _join_small(local, carried, [*group, SLICE])
    picked = {out: F.when(F.col("__first"), F.col("__carry")[out]).otherwise(F.col(out)) for out in columns}
    return joined.withColumns(picked).select(*df.columns, *columns)


def running_total(df: DataFrame, group: list[str], order: list[str], amount: str, out: str,
                  at_most: int | None = None) -> DataFrame:
    """Add `out`, the sum of `amount` over the rows before each row in its group; 0 for the first."""
    if _fits(df, group, at_most):
        return df.withColumn(out, _sum_before(amount, _window(group, order)))
    sliced = _sliced(df, group, order)
    # Only a group that began in an earlier slice has an offset: at most one per slice.
    offsets = (
        sliced.groupBy(*group, SLICE).agg(F.sum(amount).alias("__n"))
        .withColumn("__offset", _sum_before("__n", _window(group, [SLICE])))
        .filter("__offset <> 0").drop("__n")
    )
    local = sliced.withColumn(out, _sum_before(amount, _window([*group, SLICE], order)))
    joined = _join_small(local, offsets, [*group, SLICE])
    return joined.withColumn(out, F.col(out) + F.coalesce("__offset", F.lit(0))).select(*df.columns, out)


def _sum_before(amount: str, window) -> Column:
    return F.coalesce(F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
             left_at_most: int | None = None, right_at_most: int | None = None) -> DataFrame:
    """Equi-join that salts hot keys.

    A hot key of `left` is split by a hash of the row, and its rows in `right` are repeated once per split.
    For an inner join hot keys of `right` are treated the same way; other kinds keep `right` whole.
    """
    left_salts = _salt_table(left, on, "__left_salts", left_at_most)
    right_salts = _salt_table(right, on, "__right_salts", right_at_most) if how == "inner" else None
    if left_salts is None and right_salts is None:
        return left.join(right, on, how)
    left_salted, right_salted = left, right
    keys = list(on)
    for split, found in (("left", left_salts), ("right", right_salts)):
        if found is None:
            continue
        salts, salt = f"__{split}_salts", f"{SALT}_{split}"
        left_salted = _join_small(left_salted, found[0], on, found[1])
        right_salted = _join_small(right_salted, found[0], on, found[1])
        one = (F.pmod(_row_hash(left if split == "left" else right), F.coalesce(F.col(salts), F.lit(1)))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))
        left_salted = left_salted.withColumn(salt, one if split == "left" else every).drop(salts)
        right_salted = right_salted.withColumn(salt, every if split == "left" else one).drop(salts)
        keys.append(salt)
    return left_salted.join(right_salted, keys, how).drop(*[k for k in keys if k not in on])


def _window(group: list[str], order: list) -> Window:
    return Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)


def _sliced(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Range-partition by group and order, and fix the slice of each row by writing it to the checkpoint folder."""
    ranged = df.repartitionByRange(_partitions(df), *group, *order)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def _fits(df: DataFrame, group: list[str], at_most: int | None) -> bool:
    if not group:
        # a whole frame is never one task's
        return False
    limit = hot_rows(df.sparkSession)
    return (at_most is not None and at_most <= limit) or largest_group(df, group) <= limit


def _salt_table(df: DataFrame, on: list[str], out: str, at_most: int | None) -> tuple[DataFrame, str] | None:
    """Salts per hot key and how to join them; None without hot keys."""
    limit = hot_rows(df.sparkSession)
    if at_most is not None and at_most <= limit:
        return None
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.agg(F.count_if(F.col("__n") > limit)).first()[0]
    if not hot:
        return None
    # More salts than there are tasks would not spread a key further.
    salts = F.least(F.ceil(F.col("__n") / limit), F.lit(4 * _partitions(df))).cast("int")
    table = counts.filter(F.col("__n") > limit).select(*on, salts.alias(out))
    # A longer table is joined by a shuffle, whose hot partitions Spark splits, as the join keeps its left side.
    return table, "broadcast" if hot <= MAX_HOT_KEYS else "merge"


def _join_small(df: DataFrame, small: DataFrame, keys: list[str], hint: str = "broadcast") -> DataFrame:
    """Left join with a table of one row per key, broadcast where the caller bounds its rows; null keys match."""
    renamed = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           *[c for c in small.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return df.join(renamed.hint(hint), same, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
