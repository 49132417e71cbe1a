"""Exact quantiles of groups of any size, by narrowing ranges of values.

The built-in exact percentile holds all different values of a group in one buffer. Here each wanted rank keeps a range of values that holds it; a
pass counts values by equal parts of the range (partial counts, so a hot group costs its task no more than others), the part with
the rank becomes the next range, and when few values are left they are sorted. Passes follow the logarithm of the values per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrella.sources.scratch import written

#: Parts of a range in one pass, values of a range that are sorted at the end, and passes at most (doubles have no more to tell apart).
PARTS, SORTED, PASSES = 1024, 100_000, 12


def grouped_quantiles(df: DataFrame, key: str, value: str, shares: Sequence[float], *, parts: int = PARTS, sorted_values: int = SORTED) -> DataFrame:
    """key, share and quantile (double, linear between neighbours) of the values that are not NULL or NaN."""
    x = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    facts = x.groupBy("_k").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    asked = facts.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    place = F.col("share") * (F.col("n") - 1)
    asked = asked.withColumn("place", place).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    # below: values under the range; inside: values in it.
    now = written(asked.select("_k", "share", "place", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "quantile-ranges")
    for _ in range(PASSES):
        open_ = now.filter((F.col("inside") > sorted_values) & (F.col("lo") < F.col("hi")))
        if not open_.limit(1).count():
            break
        ranges = open_.select("_k", "rank", "lo", "hi", "below").distinct()
        met = x.join(ranges, "_k").filter((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi")))
        part = F.least(F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(parts))), F.lit(parts - 1))
        counts = met.groupBy("_k", "rank", "below", part.alias("part")).agg(F.count("*").alias("c"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        up = Window.partitionBy("_k", "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.col("below") + F.coalesce(F.sum("c").over(up), F.lit(0)))
        hit = counts.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).select("_k", "rank", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("before").alias("_below"), F.col("c").alias("_c"))
        joined = now.join(hit, ["_k", "rank"], "left")
        now = written(joined.select("_k", "share", "place", "rank", F.coalesce("_lo", "lo").alias("lo"), F.coalesce("_hi", "hi").alias("hi"), F.coalesce("_below", "below").alias("below"), F.coalesce("_c", "inside").alias("inside")), "quantile-ranges")
    settled = now.filter("lo = hi").select("_k", "rank", F.col("lo").alias("v")).distinct()
    ranges = now.filter("lo < hi").select("_k", "rank", "lo", "hi", "below").distinct()
    order = Window.partitionBy("_k", "rank").orderBy("_x")
    last = x.join(ranges, "_k").filter((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi"))).withColumn("_i", F.col("below") + F.row_number().over(order) - 1)
    values = settled.unionAll(last.filter("_i = rank").select("_k", "rank", F.col("_x").alias("v")))
    found = now.select("_k", "share", "place", "rank").join(values, ["_k", "rank"])
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    out = found.groupBy("_k", "share", "place").agg(low.alias("a"), high.alias("b"))
    return out.select(F.col("_k").alias(key), "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("quantile"))
