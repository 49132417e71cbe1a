"""Durations of runs of a condition, by gaps and islands.

Samples are (ts, row, col, cond). A run is named by the number of false samples before it; what is left of a run at each
sample is a sum over the rest of it. Both are windows by cell, so work is one shuffle by cell and one sort.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrella.errors import OperationError
from terrella.operators.temporal import _sql, parsed


def _frame(spark: SparkSession, pairs: list[tuple[datetime, datetime]]) -> DataFrame:
    rows = spark.createDataFrame([(i, round((a - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)), round((b - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))) for i, (a, b) in enumerate(pairs)], "iv int, a long, b long")
    return rows.select("iv", F.timestamp_micros("a").alias("start_ts"), F.timestamp_micros("b").alias("stop_ts"))


def fixed_candidate_intervals(spark: SparkSession, start, stop, *, duration: timedelta) -> DataFrame:
    """iv, start_ts, stop_ts of half-open intervals of one width, the last one clipped."""
    a, b = parsed(start), parsed(stop)
    if a >= b or duration <= timedelta(0):
        raise OperationError("Intervals need a positive range and duration.", code="invalid_interval_range")
    pairs = []
    while a < b:
        pairs.append((a, min(b, a + duration)))
        a += duration
    return _frame(spark, pairs)


def weekly_candidate_intervals(spark: SparkSession, start, stop) -> DataFrame:
    return fixed_candidate_intervals(spark, start, stop, duration=timedelta(days=7))


def monthly_candidate_intervals(spark: SparkSession, start, stop) -> DataFrame:
    """Calendar months (UTC) clipped to the range."""
    a, b = parsed(start), parsed(stop)
    if a >= b:
        raise OperationError("Intervals need a positive range.", code="invalid_interval_range")
    pairs, at = [], datetime(a.year, a.month, 1, tzinfo=UTC)
    while at < b:
        after = datetime(at.year + at.month // 12, at.month % 12 + 1, 1, tzinfo=UTC)
        if max(a, at) < min(b, after):
            pairs.append((max(a, at), min(b, after)))
        at = after
    return _frame(spark, pairs)


def sample_hours(axis: DataFrame, stop) -> DataFrame:
    """ts and hours: each sample covers the time to the next one, the last one to the stop."""
    end = _sql(parsed(stop))
    after = F.coalesce(F.lead("ts").over(Window.orderBy("ts")), end)
    return axis.select("ts").withColumn("hours", (F.unix_micros(F.least(after, end)) - F.unix_micros("ts")) / F.lit(3.6e9))


def mission_duration(samples: DataFrame, axis: DataFrame, intervals: DataFrame, *, stop, output_unit: str = "hours") -> DataFrame:
    """row, col, iv and duration: the longest time that the condition holds from a sample of the interval on, past its end if it lasts.

    A run that began before counts from its first sample inside. Cells without such a sample have 0.
    """
    if output_unit not in ("hours", "days"):
        raise OperationError("output_unit is hours or days.", code="invalid_output_unit", details={"output_unit": output_unit})
    hours = sample_hours(axis, stop)
    placed = hours.join(intervals, (F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("stop_ts")), "left").groupBy("ts", "hours").agg(F.collect_list("iv").alias("ivs"))
    by_cell = Window.partitionBy("row", "col").orderBy("ts")
    numbered = samples.join(F.broadcast(placed), "ts").withColumn("_run", F.sum((~F.col("cond")).cast("int")).over(by_cell))
    rest = Window.partitionBy("row", "col", "_run").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    left = numbered.filter("cond").withColumn("_left", F.sum("hours").over(rest))
    found = left.select("row", "col", F.explode("ivs").alias("iv"), "_left").groupBy("row", "col", "iv").agg(F.max("_left").alias("_left"))
    every = samples.select("row", "col").distinct().crossJoin(F.broadcast(intervals.select("iv")))
    unit = 24.0 if output_unit == "days" else 1.0
    return every.join(found, ["row", "col", "iv"], "left").select("row", "col", "iv", (F.coalesce("_left", F.lit(0.0)) / F.lit(unit)).cast("float").alias("duration"))


def safe_haven(samples: DataFrame, *, sunlight_threshold: float = 0.2, earth_threshold: float = 2.0, step_hours: float = 1.0) -> DataFrame:
    """row, col, month and hours, from samples (ts, row, col, fraction, earth).

    The longest run of low Sun (fraction below its threshold) that meets an outage (earth below its threshold) within the month;
    the whole run counts. Months without any outage, or of outage only, have NaN.
    """
    low, out = F.col("fraction") < F.lit(sunlight_threshold), F.col("earth") < F.lit(earth_threshold)
    by_cell = Window.partitionBy("row", "col").orderBy("ts")
    marked = samples.select("row", "col", F.date_trunc("month", "ts").alias("month"), low.alias("low"), out.alias("out"), F.sum((~low).cast("int")).over(by_cell).alias("_run"))
    run = Window.partitionBy("row", "col", "_run")
    sized = marked.withColumn("_n", F.count_if("low").over(run))
    best = sized.groupBy("row", "col", "month").agg(F.max(F.when(F.col("low") & F.col("out"), F.col("_n"))).alias("n"), F.bool_or("out").alias("some"), F.bool_and("out").alias("only"))
    hours = F.coalesce("n", F.lit(0)).cast("float") * F.lit(step_hours).cast("float")
    return best.select("row", "col", "month", F.when(~F.col("some") | F.col("only"), F.lit(float("nan")).cast("float")).otherwise(hours).alias("hours"))


def month_bands(axis: DataFrame) -> DataFrame:
    """month of each calendar month (UTC) that an axis meets."""
    return axis.select(F.date_trunc("month", "ts").alias("month")).distinct()
