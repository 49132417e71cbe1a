"""Body vectors as tables (body, ts, x, y, z) in metres: choosing a body, explicit vectors first, values between samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.errors import OperationError
from terrella.operators.temporal import lookup


def vectors_of(ephemeris: DataFrame, body: str) -> DataFrame:
    """ts, x, y, z of one body."""
    found = ephemeris.filter(F.lower("body") == body.lower()).select(F.col("ts").cast("timestamp").alias("ts"), "x", "y", "z")
    if not found.limit(1).count():
        raise OperationError("The table has no such body.", code="unknown_body", details={"body": body})
    return found


def resolve_vectors(body: str, axis: DataFrame, *, explicit: DataFrame | None = None, ephemeris: DataFrame | None = None) -> DataFrame:
    """Vectors at the times of an axis: explicit ones, which must have all of them, or from an ephemeris, linear between its samples."""
    if explicit is not None:
        own = explicit.select(F.col("ts").cast("timestamp").alias("ts"), "x", "y", "z")
        if axis.select("ts").join(own, "ts", "left_anti").limit(1).count():
            raise OperationError("Explicit vectors lack a time.", code="missing_vectors", details={"body": body})
        return axis.select("ts").join(own, "ts")
    if ephemeris is None:
        raise OperationError("Vectors or an ephemeris are needed.", code="no_vectors", details={"body": body})
    return interpolated(vectors_of(ephemeris, body), axis)


def interpolated(samples: DataFrame, axis: DataFrame) -> DataFrame:
    """ts, x, y, z at the times of an axis that lie within the samples' times."""
    from pyspark.sql import Window

    numbered = samples.withColumn("layer", F.row_number().over(Window.orderBy("ts")).cast("long") - 1)
    low = lookup(axis.select("ts"), numbered.select("ts", "layer"), method="before").withColumnRenamed("layer", "_a")
    both = lookup(low, numbered.select("ts", "layer"), method="after").withColumnRenamed("layer", "_b")
    a = numbered.select(F.col("layer").alias("_a"), F.unix_micros("ts").alias("_ta"), *(F.col(c).alias(f"_{c}a") for c in "xyz"))
    b = numbered.select(F.col("layer").alias("_b"), F.unix_micros("ts").alias("_tb"), *(F.col(c).alias(f"_{c}b") for c in "xyz"))
    joined = both.filter("_a IS NOT NULL AND _b IS NOT NULL").join(a, "_a").join(b, "_b")
    part = F.coalesce(F.try_divide((F.unix_micros("ts") - F.col("_ta")).cast("double"), (F.col("_tb") - F.col("_ta")).cast("double")), F.lit(0.0))
    return joined.select("ts", *((F.col(f"_{c}a") + part * (F.col(f"_{c}b") - F.col(f"_{c}a"))).alias(c) for c in "xyz"))
