"""Connected components of edge tables and dense numbering, without collecting or sorting anything in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrella.sources.scratch import written


#: Edges up to which one task settles all components (16 bytes each), which saves rounds; more go by rounds of stars.
EDGES_IN_ONE_TASK = 2_000_000


def _settled(group: pa.Table) -> pa.Table:
    a, b = group["a"].to_numpy(), group["b"].to_numpy()
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(more := label[label], label):
            label = more
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"node": pa.array(nodes[moved]), "root": pa.array(nodes[label[moved]])})


def components(edges: DataFrame, *, in_one_task: int = EDGES_IN_ONE_TASK) -> DataFrame:
    """node, root (the least node of its component) of every node of `edges` (a, b: long) that is not its own root.

    Alternating large and small stars: each is a minimum by node and a join.
    """
    edges = written(edges.select("a", "b"), "edges")
    if edges.count() <= in_one_task:
        return edges.groupBy(F.lit(0).alias("_all")).applyInArrow(_settled, "node long, root long")
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    mark = _mark(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("root"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("root").alias("b"))
        now = written(small.filter("a <> b").distinct(), "stars")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return r["n"], r["s"]


#: Rows up to which a table is numbered by one sort.
SORTED_IN_ONE_TASK = 1_000_000


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """`df` with `name`: 1, 2, .. in the order of the column `by`, whose values differ. Each range is numbered by itself."""
    if df.limit(SORTED_IN_ONE_TASK + 1).count() <= SORTED_IN_ONE_TASK:
        return df.withColumn(name, F.row_number().over(Window.orderBy(by)).cast("long"))
    ranged = written(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(by)
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.row_number().over(within)).drop("_part", "_before")
