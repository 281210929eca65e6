"""From items that share bucket keys to classes of verified likeness, without pairs of a whole bucket as rows.

1. Keys held by one item only go; of the keys held by the same items, one stays.
2. A bucket is cut into blocks of bounded size. A task compares all items of a block with each other and with the
   bucket's leader, exactly, and returns one link per item at most. Links join classes.
3. In buckets of several blocks whose items still belong to several classes, every item outside the largest class is
   compared with all blocks. Items of one class need no comparison, so no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyframe.session import written

# A comparison gets two tables of items and returns a matrix: is row i of the first like row j of the second?
Compare = Callable[[pa.Table, pa.Table], np.ndarray]
# Are rows i of a table of items like its rows j?
Pairs = Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]
VISITORS = 256
# Items of a bucket whose pairs are told together with those of other buckets.
FEW = 12


def dropped(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for table in tables:
        jvm, sc = table.sparkSession._jvm, table.sparkSession.sparkContext
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            path = jvm.java.net.URI(folder)
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def components(links: DataFrame) -> DataFrame:
    """(node, class) of every node in `links` (a, b): class is the smallest node that links lead to.

    Alternates large-star and small-star steps, which end after about log(n) rounds whatever the shape of the graph. A round
    writes two tables. It ends when every node has one smaller neighbour or none, and none of both kinds: the least
    neighbours are the classes then. The join can be split at a node with many larger neighbours; the smaller ones of a node,
    few where links lead to the smallest node of their block, are sorted in one task.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                    "edges")
    smaller = Window.partitionBy("u")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("up"),
            F.count_if(F.col("v") > F.col("u")).alias("down")).select(
            "u", "m", ((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).alias("open")), "least")
        if least.where("open").isEmpty():
            break
        # an edge goes to the least neighbour of its smaller end; of a node's edges then, all but the least go there
        large = edges.join(least.select(F.col("u").alias("v"), "m").hint("shuffle_hash"), "v").select(
            "u", F.col("m").alias("v")).withColumn("m", F.min("v").over(smaller))
        small = large.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                             F.col("m").alias("v"))
        before, edges = edges, written(small.distinct(), "edges")
        # what a round has replaced is read no more
        dropped(before, least)
    dropped(edges)
    return least.select(F.col("u").alias("node"), F.col("m").alias("class"))


def shared(held: DataFrame) -> DataFrame:
    """The rows of `held` (node long, bucket long) whose bucket stands in other rows too, after one shuffle and sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits for the next batch; `told` is whether its bucket has been seen before
        node, bucket, told = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            if batch.num_rows:
                node = np.concatenate((node, batch.column("node").to_numpy()))
                bucket = np.concatenate((bucket, batch.column("bucket").to_numpy()))
                same, kept = bucket[1:] == bucket[:-1], np.zeros(len(bucket), bool)
                kept[0] = told
                kept[1:] |= same
                told = bool(kept[-1])
                kept[:-1] |= same
                at = np.flatnonzero(kept[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(bucket[at])], ["node", "bucket"])
                node, bucket = node[-1:], bucket[-1:]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(bucket)], ["node", "bucket"])

    rows = held.select("node", "bucket").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "node long, bucket long")


def shared_buckets(held: DataFrame, block_rows: int, block_weight: int) -> DataFrame:
    """Buckets of at least two items: (bucket, n, blocks). `held` has (node, weight, bucket)."""
    return (held.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"),
                 F.sum("weight").alias("total"))
            .where("n > 1")
            .groupBy("n", "members").agg(F.min("bucket").alias("bucket"), F.min("total").alias("total"))
            .select("bucket", "n", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("total") / block_weight),
                                              F.lit(1)).cast("int").alias("blocks")))


def linked_classes(sketches: DataFrame, payload: DataFrame, compare: Compare, block_rows: int = 256,
                   block_weight: int = 200_000, pairs: Pairs | None = None) -> DataFrame:
    """(node, class) of every item with a link; with `pairs`, buckets of few items are compared many at a time.

    `sketches` (node long, weight long, keys array<long>) has one row per item; `payload` has `node` and what `compare`
    needs, one row per node. What is written on the way is deleted when the classes are there.
    """
    held = sketches.select("node", "weight", F.explode("keys").alias("bucket"))
    buckets = written(shared_buckets(held, block_rows, block_weight), "buckets")
    entries = written(held.drop("weight").join(buckets, "bucket"), "entries")
    dropped(buckets)
    # the payload of what shares a bucket is fetched once; by a merge join, as either side may be large
    wanted = entries.select("node").distinct()
    return classes_of(entries, written(payload.join(wanted.hint("merge"), "node", "left_semi"), "payload"), compare, pairs)


def held_classes(held: DataFrame, payload: DataFrame, compare: Compare, block_rows: int = 256,
                 block_weight: int = 200_000, pairs: Pairs | None = None) -> DataFrame:
    """The same of written rows (node, weight, bucket), and the payload of none but the items that share a bucket."""
    buckets = written(shared_buckets(held, block_rows, block_weight), "buckets")
    entries = written(held.drop("weight").join(buckets.hint("shuffle_hash"), "bucket"), "entries")
    dropped(buckets, held)
    return classes_of(entries, written(payload, "payload"), compare, pairs)


def classes_of(entries: DataFrame, payload: DataFrame, compare: Compare, pairs: Pairs | None) -> DataFrame:
    """(node, class) from written `entries` (bucket, node, n, blocks) and `payload`, which are deleted."""
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    met = entries.select("node", "bucket", block.alias("block"), F.lit(0).alias("visit"))
    # a table of its own, so that Spark sees how small it is
    wide = written(entries.where("blocks > 1"), "wide")
    some = not wide.isEmpty()
    if some:
        met = met.unionByName(_everywhere(_leaders(entries, wide)))
    classes, used = components(compared(met, payload, compare, pairs)), [entries, payload, wide]
    if some:
        placed = (wide.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")))
        sizes = placed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("size"))
        open_buckets = written(sizes.groupBy("bucket").agg(F.max_by("class", F.struct("size", "class")).alias("main"),
                                                           F.count(F.lit(1)).alias("classes")).where("classes > 1"), "open")
        left = written(placed.join(open_buckets, "bucket"), "left")
        used += [open_buckets, left]
        if not left.isEmpty():
            again = (left.select("node", "bucket", block.alias("block"), F.lit(0).alias("visit"))
                     .unionByName(_everywhere(left.where(F.col("class") != F.col("main")))))
            used.append(classes)
            # what is linked already is told by the classes
            classes = components(classes.toDF("a", "b").union(compared(again, payload, compare, pairs)))
    dropped(*used)
    return classes


def _leaders(entries: DataFrame, wide: DataFrame) -> DataFrame:
    """Of each bucket of several blocks, the item that meets most others over all its buckets."""
    seen = entries.join(wide.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.sum("n").alias("met"))
    return wide.join(seen, "node").groupBy("bucket", "blocks").agg(
        F.max_by("node", F.struct("met", "node")).alias("node"))


def _everywhere(entries: DataFrame) -> DataFrame:
    return entries.select("node", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                          F.lit(1).alias("visit"))


def compared(entries: DataFrame, payload: DataFrame, compare: Compare, pairs: Pairs | None = None) -> DataFrame:
    """Links (a, b) found by comparing, in each (bucket, block), its own items among themselves and with visitors."""
    rows = (entries.join(payload, "node").repartition("bucket", "block")
            .sortWithinPartitions("bucket", "block", "visit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, done = None, [], False
        for batch in batches:
            if pairs:
                batch, few = _few(batch)
                yield from _paired(few, pairs)
            for part in _runs(batch):
                k = (part["bucket"][0].as_py(), part["block"][0].as_py())
                visit = part["visit"][0].as_py()
                if k != key:
                    if own and not done:
                        yield from _links(own, None, compare)
                    key, own, done = k, [], False
                if not visit:
                    own.append(part)
                elif own:
                    if not done:
                        yield from _links(own, None, compare)
                        done = True
                    for at in range(0, part.num_rows, VISITORS):
                        yield from _links(own, part.slice(at, VISITORS), compare)
        if own and not done:
            yield from _links(own, None, compare)

    return rows.mapInArrow(run, "a long, b long")


def _few(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.Table]:
    """The rows of a batch without, and those of, blocks of few items that lie in it as a whole."""
    keys = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("bucket", "block")]
    new = np.ones(batch.num_rows, bool)
    if batch.num_rows:
        new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    at = np.append(np.flatnonzero(new), batch.num_rows)
    size = np.diff(at)
    whole = (size <= FEW) & (at[:-1] > 0) & (at[1:] < batch.num_rows)
    visits = np.add.reduceat(batch.column("visit").to_numpy(), at[:-1]) if batch.num_rows else np.zeros(0)
    few = np.repeat(whole & (visits == 0), size)
    return batch.filter(pa.array(~few)), pa.Table.from_batches([batch.filter(pa.array(few))])


def _paired(items: pa.Table, pairs: Pairs) -> Iterator[pa.RecordBatch]:
    """Links of all like pairs of items in one bucket and block."""
    items = items.combine_chunks()
    bucket, block, node = (items[c].to_numpy() for c in ("bucket", "block", "node"))
    for step in range(1, FEW):
        i = np.flatnonzero((bucket[step:] == bucket[:-step]) & (block[step:] == block[:-step]))
        if not len(i):
            break
        for at in range(0, len(i), 1 << 14):
            a = i[at:at + (1 << 14)]
            like = pairs(items, a, a + step)
            yield pa.RecordBatch.from_arrays([pa.array(node[a[like]]), pa.array(node[a[like] + step])], ["a", "b"])


def _runs(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    table = pa.Table.from_batches([batch])
    keys = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("bucket", "block", "visit")]
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.append(np.flatnonzero(new), batch.num_rows)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield table.slice(int(a), int(b - a))


def _links(own: list[pa.Table], visitors: pa.Table | None, compare: Compare) -> Iterator[pa.RecordBatch]:
    mine = pa.concat_tables(own).combine_chunks()
    a = mine["node"].to_numpy()
    if visitors is None:
        if len(a) < 2:
            return
        like = compare(mine, mine)
        nodes = a
    else:
        other = visitors.combine_chunks()
        nodes = np.concatenate((a, other["node"].to_numpy()))
        n = len(a)
        like = np.zeros((len(nodes), len(nodes)), bool)
        like[:n, n:] = compare(mine, other)
    like |= like.T
    label = _labels(like)
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    joined = least[label] != nodes
    if joined.any():
        yield pa.RecordBatch.from_arrays([pa.array(nodes[joined]), pa.array(least[label[joined]])], ["a", "b"])


def _labels(like: np.ndarray) -> np.ndarray:
    """For each row the first row of its component."""
    n = len(like)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            front = np.zeros(n, bool)
            front[i] = True
            label[i] = i
            while front.any():
                front = like[front].any(axis=0) & (label < 0)
                label[front] = i
    return label


def overlaps(rows_a: np.ndarray, ids_a: np.ndarray, n_a: int, rows_b: np.ndarray, ids_b: np.ndarray, n_b: int,
             columns: int = 2048) -> np.ndarray:
    """How many ids row i of the first and row j of the second have in common; ids are distinct within a row."""
    distinct, place = np.unique(np.concatenate((ids_a, ids_b)), return_inverse=True)
    pa_, pb = place[:len(ids_a)], place[len(ids_a):]
    both = (np.bincount(pa_, minlength=len(distinct)) > 0) & (np.bincount(pb, minlength=len(distinct)) > 0)
    number = np.cumsum(both) - 1
    total = np.zeros((n_a, n_b), np.float32)
    use_a, use_b = both[pa_], both[pb]
    col_a, row_a, col_b, row_b = number[pa_[use_a]], rows_a[use_a], number[pb[use_b]], rows_b[use_b]
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    col_a, row_a, col_b, row_b = col_a[order_a], row_a[order_a], col_b[order_b], row_b[order_b]
    for at in range(0, int(both.sum()), columns):
        left, right = np.zeros((n_a, columns), np.float32), np.zeros((n_b, columns), np.float32)
        s = slice(*np.searchsorted(col_a, (at, at + columns)))
        left[row_a[s], col_a[s] - at] = 1
        s = slice(*np.searchsorted(col_b, (at, at + columns)))
        right[row_b[s], col_b[s] - at] = 1
        total += left @ right.T
    return total


