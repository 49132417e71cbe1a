"""Connected components of an edge table by alternating large and small stars, without collecting any group.

In a large star every node sends its larger neighbours to the least node it sees; in a small star its smaller ones. Both
are a minimum by node and a join, so a node with a third of all links is pre-aggregated and split like any other
skewed key. The result is a forest of stars: each node once with the least node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node of `edges` (a, b: long, null-free) that is not its own root."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    mark = _mark(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        large = written(large, "stars")
        dropped(now)
        # Here b < a throughout; the small star of a has its least b as the centre.
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("root"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("root").alias("b")).filter("a <> b").distinct()
        now = written(small, "stars")
        dropped(large)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return r["n"], r["s"]
