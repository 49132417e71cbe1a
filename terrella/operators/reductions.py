"""Whole-raster aggregations: one partial and one final aggregate, never a global sort or window."""

from __future__ import annotations

from builtins import range as _count
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.errors import OperationError
from terrella.functions import dtypes as D
from terrella.raster import Raster


def exact(c: Column, d: str) -> Column:
    """A summand: exact integers as decimals, floats as doubles."""
    return c.cast("double") if D.is_float(d) else (c.cast("int") if d == "bool" else c).cast("decimal(20,0)")


def statistics(raster: Raster) -> DataFrame:
    """One row: count, invalid_count, sum, mean, min, max, range, variance and std (population) of the valid cells."""
    v = F.when(F.col("valid"), F.col("value"))
    v = v.cast("int") if raster.dtype == "bool" else v
    x = v.cast("double")
    total = F.sum(exact(v, raster.dtype))
    return raster.cells().agg(
        F.count(v).alias("count"), F.count_if(~F.col("valid")).alias("invalid_count"),
        total.cast("double" if D.is_float(raster.dtype) else "decimal(38,0)").alias("sum"),
        F.try_divide(total.cast("double"), F.count(v).cast("double")).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"), (F.max(x) - F.min(x)).alias("range"),
        F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std"),
    )


def statistics_record(raster: Raster) -> dict:
    r = statistics(raster).first().asDict()
    if not r["count"]:
        raise OperationError("The raster has no valid cell.", code="empty_raster")
    return r


def histogram(raster: Raster, *, bins: int | Sequence[float] = 10, range: tuple[float, float] | None = None) -> DataFrame:
    """bin, low, high and count; the last bin is closed, what lies outside is dropped."""
    spark: SparkSession = raster.root.sparkSession
    v = (raster.v.cast("int") if raster.dtype == "bool" else raster.v).cast("double")
    cells = raster.df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    if isinstance(bins, int):
        if bins < 1:
            raise OperationError("At least one bin is needed.", code="invalid_bins")
        low, high = range if range is not None else tuple(cells.agg(F.min("v"), F.max("v")).first())
        if low is None:
            low, high = 0.0, 1.0
        if low == high:
            low, high = low - 0.5, high + 0.5
        if not low < high:
            raise OperationError("The range must rise.", code="invalid_range")
        edges = [low + (high - low) * i / bins for i in _count(bins + 1)]
        edges[-1] = float(high)
        at = F.least(F.floor((F.col("v") - F.lit(float(low))) * F.lit(bins) / F.lit(float(high) - float(low))), F.lit(bins - 1))
        # As numpy does: the estimate is corrected by comparing with the edges themselves.
        table = F.array(*(F.lit(float(e)) for e in edges))
        at = F.when(F.col("v") < F.get(table, at.cast("int")), at - 1).when((F.col("v") >= F.get(table, (at + 1).cast("int"))) & (at < bins - 1), at + 1).otherwise(at)
    else:
        edges = [float(b) for b in bins]
        if len(edges) < 2 or edges != sorted(edges):
            raise OperationError("Edges must rise.", code="invalid_bins")
        table = F.array(*(F.lit(e) for e in edges))
        at = F.least(F.size(F.filter(table, lambda e: e <= F.col("v"))) - 1, F.lit(len(edges) - 2))
    inside = cells.filter((F.col("v") >= F.lit(float(edges[0]))) & (F.col("v") <= F.lit(float(edges[-1]))))
    counts = inside.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    frame = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in _count(len(edges) - 1)], "bin int, low double, high double")
    return frame.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))




def percentile(raster: Raster, q: float | Sequence[float], *, method: str = "exact") -> DataFrame:
    """q and value. exact: linear interpolation; approximate: the value at the rank nearest, halves to even."""
    qs = [float(x) for x in ([q] if isinstance(q, (int, float)) else q)]
    if any(not 0 <= x <= 100 for x in qs):
        raise OperationError("q lies in 0..100.", code="invalid_percentile")
    v = raster.v.cast("int") if raster.dtype == "bool" else raster.v
    shares = F.array(*(F.lit(x / 100) for x in qs))
    if method == "exact":
        found = raster.df.agg(F.percentile(v, shares).alias("p"))
    elif method == "approximate":
        # Values with counts in order give every rank without numbering single cells.
        counts = raster.df.select(v.cast("double").alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("c"))
        n = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        if not n:
            raise OperationError("The raster has no valid cell.", code="empty_raster")
        ranks = F.array(*(F.lit(_half_even(x / 100 * (n - 1)) / max(n - 1, 1)) for x in qs))
        found = raster.df.agg(F.percentile(v, ranks).alias("p"))
    else:
        raise OperationError("method is exact or approximate.", code="invalid_percentile_method")
    return found.select(F.posexplode("p").alias("i", "value")).select(F.get(F.array(*(F.lit(x) for x in qs)), F.col("i")).alias("q"), "value")


def _half_even(x: float) -> int:
    return round(x)


def unique_counts(raster: Raster, *, max_unique: int | None = None) -> DataFrame:
    """value and count of each distinct valid value, in order; more than max_unique is an error."""
    out = raster.df.select(raster.v.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("count"))
    if max_unique is not None and out.limit(max_unique + 1).count() > max_unique:
        raise OperationError("There are more unique values than allowed.", code="too_many_unique_values", details={"max_unique": max_unique})
    return out.orderBy("value")


