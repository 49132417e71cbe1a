"""Rasters carved out of the test tables, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.grid import Grid, Stereographic
from terrella.operators.temporal import TemporalRaster
from terrella.raster import Raster

SIDE = 40
GRID = Grid(SIDE, SIDE, (1000.0, 20.0, 0.0, 2000.0, 0.0, -10.0), Stereographic(), None)
SERIES_GRID = Grid(15, 10, (0.0, 100.0, 0.0, 0.0, 0.0, -100.0), Stereographic(), None)

DEM_SQL = """grid AS (SELECT CAST(i // 40 AS INTEGER) AS row, CAST(i % 40 AS INTEGER) AS col FROM range(1600) AS t(i)),
sums AS (SELECT CAST(l_partkey % 40 AS INTEGER) AS row, CAST(l_suppkey % 40 AS INTEGER) AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2),
dem AS (SELECT g.row, g.col, coalesce(s.value, 0) AS value, coalesce(s.value % 7 <> 0, false) AS valid, coalesce(s.n, 0) AS n, coalesce(s.n % 5 <> 0, false) AS n_valid FROM grid g LEFT JOIN sums s USING (row, col)),
d AS (SELECT row, col, CASE WHEN valid THEN value END AS v, CASE WHEN n_valid THEN n END AS w, valid, n_valid, value AS payload FROM dem)"""
SERIES_SQL = """sgrid AS (SELECT CAST(i // 15 AS INTEGER) AS row, CAST(i % 15 AS INTEGER) AS col FROM range(150) AS t(i)),
axis AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + i * INTERVAL 1 HOUR AS ts, i AS layer FROM range(720) AS t(i)),
hours AS (SELECT date_trunc('hour', ts) AS ts, CAST(user_id // 15 AS INTEGER) AS row, CAST(user_id % 15 AS INTEGER) AS col, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events WHERE user_id BETWEEN 0 AND 149 GROUP BY 1, 2, 3),
series AS (SELECT a.ts, a.layer, g.row, g.col, h.value AS v FROM axis a CROSS JOIN sgrid g LEFT JOIN hours h USING (ts, row, col))"""
#: Threshold of the mask: the mean of all cells, as an integer.
MASK_SQL = DEM_SQL + """,
cut AS (SELECT CAST(floor(avg(value)) AS BIGINT) AS t FROM dem),
mask AS (SELECT row, col, value > t AS m, valid FROM dem, cut)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cells with two bands: value (quantity) and n (lines)."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % SIDE).cast("int").alias("row"), (F.col("l_suppkey") % SIDE).cast("int").alias("col"), F.col("l_quantity").cast("long").alias("q"))
    sums = items.groupBy("row", "col").agg(F.sum("q").alias("value"), F.count("*").alias("n"))
    dense = GRID.cells(spark).join(sums, ["row", "col"], "left")
    return dense.select("row", "col", F.coalesce("value", F.lit(0)).alias("value"), F.coalesce(F.col("value") % 7 != 0, F.lit(False)).alias("valid"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") % 5 != 0, F.lit(False)).alias("n_valid"))


def bands(spark: SparkSession, sf_dir: str) -> tuple[Raster, Raster]:
    """Both bands on one table, so that operators on them never join."""
    base = cells(spark, sf_dir)
    a = Raster.of(base, GRID, value="value", valid="valid", units=None, name="quantity")
    # The second band is added to the first one's table.
    root = base.select("row", "col", F.col("value").alias(a.value), F.col("valid").alias(a.valid), F.col("n").alias("_n"), F.col("n_valid").alias("_nv"))
    a = a._replaced(root=root)
    return a, Raster(root, GRID, "int64", "_n", "_nv", None, "lines")


def dem(spark: SparkSession, sf_dir: str) -> Raster:
    return bands(spark, sf_dir)[0]


def mask(spark: SparkSession, sf_dir: str) -> Raster:
    base = cells(spark, sf_dir)
    cut = base.agg(F.floor(F.avg("value")).cast("long")).first()[0]
    return Raster.of(base.select("row", "col", (F.col("value") > cut).alias("value"), "valid"), GRID, valid="valid")


def zones(r: Raster) -> Raster:
    """25 zones of 8 x 8 cells on the same table."""
    return r.derive(F.expr("(row div 8) * 5 + col div 8"), F.lit(True), "int64")


def axis(spark: SparkSession) -> DataFrame:
    from datetime import UTC, datetime, timedelta

    from terrella.operators import temporal

    return temporal.axis(spark, datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 30, 23, tzinfo=UTC), timedelta(hours=1))


def sparse_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("user_id BETWEEN 0 AND 149")
    return events.select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.expr("cast(user_id div 15 as int)").alias("row"), F.expr("cast(user_id % 15 as int)").alias("col"), F.round(F.col("value") * 100).cast("long").alias("c")).groupBy("ts", "row", "col").agg(F.sum("c").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> TemporalRaster:
    from terrella.operators.temporal import densified

    return TemporalRaster.of(densified(sparse_series(spark, sf_dir), axis(spark), SERIES_GRID), SERIES_GRID, dtype="int64")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as horizons of 64 azimuth bins in whole hundredths of a degree: row, col, elevation, horizon."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id < 100")
    return e.select(F.expr("cast(vec_id div 10 as int)").alias("row"), F.expr("cast(vec_id % 10 as int)").alias("col"), F.lit(0.0).alias("elevation"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 500) / 100).alias("horizon"))


def vectors(spark: SparkSession, n: int = 48, radius: float = 1.5e11, rise: float = 0.03) -> DataFrame:
    """An analytic body that circles low over the south pole: ts, x, y, z."""
    a = F.col("layer") * (2 * math.pi / n)
    return axis(spark).filter(F.col("layer") < n).select("ts", (F.cos(a) * radius).alias("x"), (F.sin(a) * radius).alias("y"), (F.sin(a * 3) * rise * radius - 0.01 * radius).alias("z"))
