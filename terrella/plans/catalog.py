"""Registered queries over the test tables, with the SQL each is held against.

One query stands for a family of operators. Values are whole numbers, or rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.grid import Grid
from terrella.operators import coordinates, distance, focal, horizon, local, products, reductions, regions, resample, runs, temporal, terrain, zonal
from terrella.plans import fixtures as fx
from terrella.raster import Raster

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _wide(digits: int | None = None, **rasters: Raster) -> DataFrame:
    """row, col and one column a raster, NULL where invalid. Rasters of one table stay one projection."""
    from terrella.raster import aligned

    moved = aligned(*rasters.values())
    return moved[0].df.select("row", "col", *((r.v if digits is None else _rounded(r.v, digits)).alias(n) for n, r in zip(rasters, moved, strict=True)))


def _rounded(c, digits: int):
    """A double rounded to so many digits, without negative zero."""
    r = F.round(c.cast("double"), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def _r(expression: str, digits: int = 6) -> str:
    return f"CASE WHEN round(CAST({expression} AS DOUBLE), {digits}) = 0 THEN 0.0::DOUBLE ELSE round(CAST({expression} AS DOUBLE), {digits}) END"


# Local


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, v + w AS added, v - w AS taken, v * w AS product, CAST(v AS DOUBLE) / nullif(w, 0) AS quotient, -v AS minus, abs(v - 1500) AS apart, v * v AS squared, CASE WHEN v IS NULL OR w IS NULL THEN NULL ELSE least(v, w) END AS low, CASE WHEN v IS NULL OR w IS NULL THEN NULL ELSE greatest(v, w) END AS high FROM d")
def local_arith(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    return _wide(added=a + b, taken=a - b, product=a * b, quotient=a / b, minus=-a, apart=abs(a - 1500), squared=local.square(a), low=local.minimum(a, b), high=local.maximum(a, b))


@_query(f"WITH {fx.DEM_SQL}, x AS (SELECT row, col, v - 1500 AS a, w - 40 AS b FROM d) SELECT row, col, CAST(floor(CAST(a AS DOUBLE) / nullif(b, 0)) AS BIGINT) AS quotient, CAST(a - b * floor(CAST(a AS DOUBLE) / nullif(b, 0)) AS BIGINT) AS rest, CAST(floor(CAST(a AS DOUBLE) / -7) AS BIGINT) AS by_scalar, CAST(a - -7 * floor(CAST(a AS DOUBLE) / -7) AS BIGINT) AS rest_scalar FROM x")
def local_floor_mod(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    a, b = a - 1500, b - 40
    return _wide(quotient=a // b, rest=a % b, by_scalar=a // -7, rest_scalar=a % -7)


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, v % 10 * (v % 10) * (v % 10) AS cubed, CAST(1 AS BIGINT) << CAST(w % 10 AS INTEGER) AS twos, round(pow(CAST(v AS DOUBLE), 0.5), 6) AS root FROM d")
def local_power(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    out = _wide(cubed=(a % 10) ** 3, twos=2 ** (b % 10), root=a**0.5)
    return out.withColumn("root", F.round("root", 6))


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, v < w * 26 AS lt, v <= w * 26 AS le, v > w * 26 AS gt, v >= w * 26 AS ge, v % 3 = w % 3 AS eq, v % 3 <> w % 3 AS ne, abs(v - w * 25) <= 1e-8 + 0.05 * abs(w * 25) AS near, NOT (v > 900) AS negated, CASE WHEN v IS NULL OR w IS NULL THEN NULL ELSE v > 900 AND w > 35 END AS both, CASE WHEN v IS NULL OR w IS NULL THEN NULL ELSE v > 900 OR w > 35 END AS either, CASE WHEN v IS NULL OR w IS NULL THEN NULL ELSE (v > 900) <> (w > 35) END AS one FROM d")
def local_compare_bool(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    x, y = a > 900, b > 35
    return _wide(lt=a < b * 26, le=a <= b * 26, gt=a > b * 26, ge=a >= b * 26, eq=(a % 3) == (b % 3), ne=(a % 3) != (b % 3), near=local.isclose(a, b * 25, rtol=0.05), negated=~x, both=x & y, either=x | y, one=x ^ y)


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, CASE WHEN v > 900 THEN v WHEN v <= 900 THEN w END AS chosen, CASE WHEN v > 900 THEN v END AS part, coalesce(v, w) AS first, coalesce(v, w, -1) AS filled FROM d")
def local_where_coalesce(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    return _wide(chosen=local.where(a > 900, a, b), part=local.where(a > 900, a, local.invalid), first=local.coalesce(a, b), filled=local.coalesce(a, b, -1))


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, valid AS ok, NOT valid AS bad, CASE WHEN coalesce(w > 35, false) THEN NULL ELSE v END AS masked, coalesce(v, -9999) AS filled FROM d")
def local_validity_fill(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    return _wide(ok=local.is_valid(a), bad=local.is_invalid(a), masked=local.set_invalid(a, b > 35), filled=local.fill_invalid(a, -9999))


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, CAST(((v % 256) + 256) % 256 AS SMALLINT) AS byte, CAST((((v + 128) % 256) + 256) % 256 - 128 AS TINYINT) AS signed, CAST(trunc(CAST(v AS DOUBLE) / 7) AS INTEGER) AS whole, CAST(v AS DOUBLE) AS real FROM d")
def local_cast_wrap(spark, sf_dir):
    a, _ = fx.bands(spark, sf_dir)
    return _wide(byte=local.cast(a, "uint8", casting="unsafe", overflow="wrap"), signed=local.cast(a, "int8", casting="same_kind", overflow="wrap"), whole=local.cast(a / 7, "int32", casting="unsafe"), real=local.cast(a, "float64"))


@_query(
    f"""WITH {fx.DEM_SQL}
SELECT row, col, v AS same, abs(v - 1500) AS size, {_r('round_even((CAST(v AS DOUBLE) - 900) / 4, 1)', 1)} AS tenths,
  CASE WHEN coalesce(w > 35, false) THEN payload END AS stated
FROM d"""
)
def local_views(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    x = a - 1500
    out = _wide(same=local.positive(a), size=local.absolute(x), tenths=round((a - 900) / 4, 1), stated=a.with_validity(b > 35).with_name("stated"))
    return out.withColumn("tenths", _rounded(F.col("tenths"), 1))


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, coalesce(v, -1) AS value FROM d")
def raster_filled(spark, sf_dir):
    return fx.bands(spark, sf_dir)[0].filled(-1)


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, v AS value FROM d")
def raster_masked(spark, sf_dir):
    return fx.bands(spark, sf_dir)[0].masked()


@_query(
    f"""WITH {fx.DEM_SQL}
SELECT bool_and(valid = n_valid AND (NOT valid OR abs(v - w) <= 1e-8 + 0.05 * abs(w))) AS near_other,
  bool_and(NOT valid OR abs(v - (v + 1)) <= 1e-8 + 0.5 * abs(v + 1)) AS near_self, true AS one_grid, false AS one_kind
FROM d"""
)
def raster_comparison(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    facts = (a.allclose(b, rtol=0.05), a.allclose(a + 1, rtol=0.5), a.same_grid(b), a.same_metadata(b))
    return spark.createDataFrame([facts], "near_other boolean, near_self boolean, one_grid boolean, one_kind boolean")


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, CASE v % 5 WHEN 0 THEN 10 WHEN 1 THEN 21 WHEN 2 THEN 12 END::SMALLINT AS dropped, CASE v % 5 WHEN 0 THEN 10 WHEN 1 THEN 21 ELSE v % 5 END AS kept, CASE WHEN v IS NULL THEN NULL WHEN v % 5 = 0 THEN 10 ELSE 99 END::SMALLINT AS other FROM d")
def reclass_values(spark, sf_dir):
    a, _ = fx.bands(spark, sf_dir)
    x = a % 5
    return _wide(dropped=local.reclassify_values(x, {0: 10, 1: 21, 2: 12}), kept=local.reclassify_values(x, {0: 10, 1: 21}, default="preserve"), other=local.reclassify_values(x, {0: 10}, default=99))


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, CASE WHEN v >= 850 AND v < 1000 THEN 3 WHEN v >= 700 AND v < 900 THEN 2 WHEN v >= 0 AND v < 700 THEN 1 END::SMALLINT AS class FROM d")
def reclass_ranges(spark, sf_dir):
    a, _ = fx.bands(spark, sf_dir)
    return _wide(**{"class": local.reclassify_ranges(a, [(0, 700, 1), (700, 900, 2), (850, 1000, 3)])})


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, CASE WHEN v IS NULL THEN NULL ELSE CAST((v >= 700) AS BIGINT) + CAST((v >= 900) AS BIGINT) + CAST((v >= 1100) AS BIGINT) END AS bin, CASE WHEN v IS NULL THEN NULL ELSE CAST((v > 700) AS BIGINT) + CAST((v > 900) AS BIGINT) + CAST((v > 1100) AS BIGINT) END AS right_bin FROM d")
def digitize(spark, sf_dir):
    a, _ = fx.bands(spark, sf_dir)
    return _wide(bin=local.digitize(a, [700, 900, 1100]), right_bin=local.digitize(a, [700, 900, 1100], right=True))


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, v % 4 = 0 AS c0, v % 4 = 1 AS c1, v % 4 = 3 AS c3 FROM d")
def one_hot(spark, sf_dir):
    a, _ = fx.bands(spark, sf_dir)
    c0, c1, c3 = local.one_hot(a % 4, [0, 1, 3])
    return _wide(c0=c0, c1=c1, c3=c3)


@_query(f"WITH {fx.DEM_SQL}, s AS (SELECT min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS sd FROM d) SELECT row, col, {_r('(v - lo)::DOUBLE / (hi - lo)')} AS minmax, {_r('(v - m) / sd')} AS standard FROM d, s")
def normalize_standardize(spark, sf_dir):
    a, _ = fx.bands(spark, sf_dir)
    return _wide(6, minmax=local.normalize_minmax(a), standard=local.standardize(a))


@_query(f"WITH {fx.DEM_SQL}, x AS (SELECT row, col, CAST(v AS DOUBLE) / 100 AS a FROM d) SELECT row, col, {_r('sqrt(a)')} AS root, {_r('exp(a / 10)')} AS power, {_r('CASE WHEN a > 0 THEN ln(a) END')} AS natural, {_r('CASE WHEN a > 0 THEN log10(a) END')} AS decimal, {_r('sin(radians(a))')} AS s, {_r('cos(radians(a))')} AS c, {_r('tan(radians(a))')} AS t, {_r('asin(a / 100)')} AS asin, {_r('acos(a / 100)')} AS acos, {_r('atan(a)')} AS atan, {_r('atan2(a, 3)')} AS atan2, {_r('sqrt(a * a + 9)')} AS hyp, {_r('degrees(a)')} AS deg, {_r('radians(a)')} AS rad FROM x")
def math_unary(spark, sf_dir):
    a, _ = fx.bands(spark, sf_dir)
    x = a / 100
    three = x * 0 + 3
    angle = x.with_units("degrees")
    return _wide(6, root=local.sqrt(x), power=local.exp(x / 10), natural=local.log(x), decimal=local.log10(x), s=local.sin(angle), c=local.cos(angle), t=local.tan(angle), asin=local.arcsin(x / 100), acos=local.arccos(x / 100), atan=local.arctan(x), atan2=local.arctan2(x, three), hyp=local.hypot(x, three), deg=local.degrees(x), rad=local.radians(x))


@_query(f"WITH {fx.DEM_SQL}, x AS (SELECT row, col, (CAST(v AS DOUBLE) - 900) / 4 AS a FROM d) SELECT row, col, {_r('round_even(a, 0)')} AS even, {_r('floor(a)')} AS down, {_r('ceil(a)')} AS up, {_r('trunc(a)')} AS cut FROM x")
def round_half_even(spark, sf_dir):
    a, _ = fx.bands(spark, sf_dir)
    x = (a - 900) / 4
    return _wide(6, even=round(x), down=local.floor(x), up=local.ceil(x), cut=local.trunc(x))


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, v + w + w AS total, {_r('CAST(v + w + w AS DOUBLE) / 3')} AS mean, CASE WHEN v IS NULL OR w IS NULL THEN NULL ELSE least(v, w, 900) END AS low, CASE WHEN v IS NULL OR w IS NULL THEN NULL ELSE greatest(v, w, 900) END AS high FROM d")
def layer_stack(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    out = _wide(total=local.sum_layers(a, b, b), mean=local.mean_layers(a, b, b), low=local.min_layers(a, b, 900), high=local.max_layers(a, b, 900))
    return out.withColumn("mean", _rounded(F.col("mean"), 6))


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, CASE WHEN v IS NULL THEN NULL WHEN v < 800 THEN 800 WHEN v > 1000 THEN 1000 ELSE v END AS clipped FROM d")
def clip(spark, sf_dir):
    a, _ = fx.bands(spark, sf_dir)
    return _wide(clipped=local.clip(a, lower=800, upper=1000))


@_query(f"WITH {fx.DEM_SQL} SELECT count(*) AS cells, count(*) FILTER (WHERE valid = n_valid AND (NOT valid OR payload = n)) = count(*) AS same FROM (SELECT d.*, dem.n FROM d JOIN dem USING (row, col))")
def array_equal(spark, sf_dir):
    a, b = fx.bands(spark, sf_dir)
    x, y = a.array_equal(a + 0), a.array_equal(b)
    assert x
    return spark.createDataFrame([(fx.GRID.width * fx.GRID.height, y)], "cells long, same boolean")


# Coordinates


@_query("SELECT CAST(i // 40 AS INTEGER) AS row, CAST(i % 40 AS INTEGER) AS col, CAST(i // 40 AS BIGINT) AS r, CAST(i % 40 AS BIGINT) AS c, 1000.0::DOUBLE + (i % 40 + 0.5::DOUBLE) * 20 AS x, 2000.0::DOUBLE - (i // 40 + 0.5::DOUBLE) * 10 AS y FROM range(1600) AS t(i)")
def coords_affine(spark, sf_dir):
    g = fx.GRID
    return _wide(r=coordinates.row_indices(spark, g), c=coordinates.column_indices(spark, g), x=coordinates.projected_x(spark, g), y=coordinates.projected_y(spark, g))


@_query(f"""WITH p AS (SELECT CAST(i // 40 AS INTEGER) AS row, CAST(i % 40 AS INTEGER) AS col, 1000.0::DOUBLE + (i % 40 + 0.5::DOUBLE) * 20 AS x, 2000.0::DOUBLE - (i // 40 + 0.5::DOUBLE) * 10 AS y FROM range(1600) AS t(i)),
q AS (SELECT *, 2 * atan(sqrt(x * x + y * y) / (2 * 1737400.0::DOUBLE)) AS c FROM p)
SELECT row, col, {_r('degrees(atan2(x, y))', 6)} AS longitude, {_r('degrees(-asin(cos(c)))', 5)} AS latitude FROM q""")
def coords_lonlat(spark, sf_dir):
    g = fx.GRID
    out = _wide(longitude=coordinates.longitude(spark, g), latitude=coordinates.latitude(spark, g))
    return out.select("row", "col", _rounded(F.col("longitude"), 6).alias("longitude"), _rounded(F.col("latitude"), 5).alias("latitude"))


# Focal


def _around(columns: str, h: int = 1, extra: str = "", source: str = "d") -> str:
    """Each cell with aggregates over cells within h rows and columns."""
    return f"SELECT a.row, a.col, {columns} FROM {source} a JOIN {source} b ON b.row BETWEEN a.row - {h} AND a.row + {h} AND b.col BETWEEN a.col - {h} AND a.col + {h} {extra} GROUP BY a.row, a.col"


_INNER = "a.row BETWEEN 1 AND 38 AND a.col BETWEEN 1 AND 38"


@_query(f"WITH {fx.DEM_SQL}, f AS ({_around('count(b.v) AS n, sum(b.v) AS s')}) SELECT row, col, CASE WHEN n = 9 THEN CAST(s AS BIGINT) END AS strict, CASE WHEN n >= 1 AND row BETWEEN 1 AND 38 AND col BETWEEN 1 AND 38 THEN CAST(s AS BIGINT) END AS loose, CASE WHEN row BETWEEN 1 AND 38 AND col BETWEEN 1 AND 38 THEN n END AS n FROM f")
def focal_sum_count(spark, sf_dir):
    a = fx.dem(spark, sf_dir)
    return _wide(strict=focal.focal_sum(a, size=3), loose=focal.focal_sum(a, size=3, valid_neighbor="ignore_invalid"), n=focal.focal_count(a, size=3))


@_query(f"WITH {fx.DEM_SQL}, f AS ({_around('count(b.v) AS n, avg(b.v) AS m, stddev_pop(b.v) AS s', 2)}) SELECT row, col, CASE WHEN n >= 10 AND row BETWEEN 2 AND 37 AND col BETWEEN 2 AND 37 THEN {_r('m')} END AS mean, CASE WHEN n >= 10 AND row BETWEEN 2 AND 37 AND col BETWEEN 2 AND 37 THEN {_r('s')} END AS std FROM f")
def focal_mean_std(spark, sf_dir):
    a = fx.dem(spark, sf_dir)
    o = {"size": 5, "valid_neighbor": "ignore_invalid", "min_valid_count": 10}
    return _wide(6, mean=focal.focal_mean(a, **o), std=focal.focal_std(a, **o))


@_query(f"WITH {fx.DEM_SQL}, p AS (SELECT r.row, c.col, d.v, d.valid FROM (SELECT CAST(i - 1 AS INTEGER) AS row, CAST(greatest(0, least(39, i - 1)) AS INTEGER) AS src FROM range(42) AS t(i)) r CROSS JOIN (SELECT CAST(i - 1 AS INTEGER) AS col, CAST(greatest(0, least(39, i - 1)) AS INTEGER) AS src FROM range(42) AS t(i)) c JOIN d ON d.row = r.src AND d.col = c.src), f AS ({_around('count(b.v) AS n, min(b.v) AS lo, max(b.v) AS hi', 1, '', 'p')}) SELECT row, col, lo, hi, CAST(hi - lo AS DOUBLE) AS span FROM (SELECT f.row, f.col, CASE WHEN n >= 1 THEN lo END AS lo, CASE WHEN n >= 1 THEN hi END AS hi FROM f WHERE f.row BETWEEN 0 AND 39 AND f.col BETWEEN 0 AND 39)")
def focal_min_max_range(spark, sf_dir):
    a = fx.dem(spark, sf_dir)
    o = {"size": 3, "edge": "nearest", "valid_neighbor": "ignore_invalid"}
    return _wide(lo=focal.focal_min(a, **o), hi=focal.focal_max(a, **o), span=focal.focal_range(a, **o))


@_query(f"WITH {fx.DEM_SQL}, f AS ({_around('count(b.v) AS n, median(b.v) AS m', 1, 'AND (b.row = a.row OR b.col = a.col)')}) SELECT row, col, CASE WHEN n >= 1 AND row BETWEEN 1 AND 38 AND col BETWEEN 1 AND 38 THEN CAST(m AS DOUBLE) END AS median FROM f")
def focal_median(spark, sf_dir):
    cross = [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
    return _wide(median=focal.focal_median(fx.dem(spark, sf_dir), footprint=cross, valid_neighbor="ignore_invalid"))


@_query(f"WITH {fx.DEM_SQL}, f AS ({_around('count(b.v) AS n, sum(coalesce(b.v, 0) * ((a.row - b.row) * 3 + (a.col - b.col) + 5)) AS s')}) SELECT row, col, CASE WHEN row BETWEEN 1 AND 38 AND col BETWEEN 1 AND 38 THEN CAST(s AS DOUBLE) END AS loose, CASE WHEN n = 9 THEN CAST(s AS DOUBLE) END AS strict FROM f")
def focal_convolve(spark, sf_dir):
    a = fx.dem(spark, sf_dir)
    k = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    return _wide(loose=focal.convolve(a, k, valid_neighbor="ignore_invalid"), strict=focal.convolve(a, k))


_M = fx.MASK_SQL + ", k AS (SELECT row, col, (m AND valid) AS t, valid FROM mask)"


@_query(f"WITH {_M}, e AS ({_around('bool_or(b.t) AS dilated, count(*) FILTER (WHERE b.t) = 9 AS eroded', 1, '', 'k')}), o AS ({_around('bool_or(b.eroded) AS opened', 1, '', 'e')}), c AS ({_around('count(*) FILTER (WHERE b.dilated) = 9 AS closed', 1, '', 'e')}) SELECT row, col, CASE WHEN valid THEN dilated END AS dilated, CASE WHEN valid THEN eroded END AS eroded, CASE WHEN valid THEN opened END AS opened FROM k JOIN e USING (row, col) JOIN o USING (row, col)")
def morphology(spark, sf_dir):
    m = fx.mask(spark, sf_dir)
    return _wide(dilated=focal.dilate(m, size=3), eroded=focal.erode(m, size=3), opened=focal.opening(m, size=3))


@_query(f"WITH {_M}, p AS (SELECT r.row, c.col, k.t FROM (SELECT CAST(i - 1 AS INTEGER) AS row, CAST(greatest(0, least(39, i - 1)) AS INTEGER) AS src FROM range(42) AS t(i)) r CROSS JOIN (SELECT CAST(i - 1 AS INTEGER) AS col, CAST(greatest(0, least(39, i - 1)) AS INTEGER) AS src FROM range(42) AS t(i)) c JOIN k ON k.row = r.src AND k.col = c.src), f AS ({_around('count(*) FILTER (WHERE b.t) AS s', 1, '', 'p')}) SELECT k.row, k.col, CASE WHEN k.valid THEN s * 2 > 9 END AS major FROM k JOIN f ON f.row = k.row AND f.col = k.col")
def majority(spark, sf_dir):
    return _wide(major=focal.majority(fx.mask(spark, sf_dir), size=3))


# Terrain


_GRADIENT = f"""WITH {fx.DEM_SQL}, z AS (SELECT row, col, CAST(payload AS DOUBLE) / 100 AS z, valid FROM d),
g AS (SELECT a.row, a.col, (e.z - w.z) / 40 AS x, (s.z - n.z) / 20 AS y FROM z a JOIN z e ON e.row = a.row AND e.col = a.col + 1 JOIN z w ON w.row = a.row AND w.col = a.col - 1 JOIN z s ON s.col = a.col AND s.row = a.row + 1 JOIN z n ON n.col = a.col AND n.row = a.row - 1),
f AS ({_around('count(*) FILTER (WHERE b.valid) AS n')}), ok AS (SELECT d.row, d.col, n = 9 AS ok FROM d JOIN f USING (row, col))
"""


@_query(_GRADIENT + f"SELECT ok.row, ok.col, CASE WHEN ok THEN {_r('degrees(atan(sqrt(x * x + y * y)))', 3)} END AS slope, CASE WHEN ok AND (abs(x) > 1e-8 OR abs(y) > 1e-8) THEN {_r('((90 - degrees(atan2(y, -x))) + 360) % 360', 2)} END AS aspect, CASE WHEN ok THEN {_r('100 * sqrt(x * x + y * y)', 2)} END AS percent FROM ok LEFT JOIN g USING (row, col)")
def slope_aspect(spark, sf_dir):
    a = fx.dem(spark, sf_dir) / 100
    out = _wide(slope=terrain.slope(a), aspect=terrain.aspect(a), percent=terrain.slope(a, units="percent"))
    return out.select("row", "col", _rounded(F.col("slope"), 3).alias("slope"), _rounded(F.col("aspect"), 2).alias("aspect"), _rounded(F.col("percent"), 2).alias("percent"))


@_query(_GRADIENT + "SELECT ok.row, ok.col, CASE WHEN ok THEN CAST(round_even(least(greatest(255 * (sin(radians(45)) * cos(atan(sqrt(x * x + y * y))) + cos(radians(45)) * sin(atan(sqrt(x * x + y * y))) * cos(radians(135) - atan2(y, -x))), 0), 255), 0) AS SMALLINT) END AS shade FROM ok LEFT JOIN g USING (row, col)")
def hillshade(spark, sf_dir):
    return _wide(shade=terrain.hillshade(fx.dem(spark, sf_dir) / 100))


# Resampling

_FINE = Grid(60, 60, (1010.0, 12.0, 0.0, 1990.0, 0.0, -6.0), fx.GRID.projection)
_COARSE = Grid(10, 10, (1000.0, 80.0, 0.0, 2000.0, 0.0, -40.0), fx.GRID.projection)
_FINE_SQL = "t AS (SELECT CAST(i // 60 AS INTEGER) AS row, CAST(i % 60 AS INTEGER) AS col, (10 + (i % 60 + 0.5::DOUBLE) * 12) / 20 AS sc, (10 + (i // 60 + 0.5::DOUBLE) * 6) / 10 AS sr FROM range(3600) AS r(i))"


@_query(f"WITH {fx.DEM_SQL}, {_FINE_SQL} SELECT t.row, t.col, d.v AS value FROM t LEFT JOIN d ON d.row = CAST(floor(sr) AS INTEGER) AND d.col = CAST(floor(sc) AS INTEGER)")
def resample_nearest(spark, sf_dir):
    return _wide(value=resample.resample_to(fx.dem(spark, sf_dir), _FINE))


@_query(f"WITH {fx.DEM_SQL}, {_FINE_SQL}, w AS (SELECT t.row, t.col, d.v, (1 - abs(sr - 0.5 - d.row)) * (1 - abs(sc - 0.5 - d.col)) AS w FROM t JOIN d ON abs(sr - 0.5 - d.row) < 1 AND abs(sc - 0.5 - d.col) < 1 WHERE d.v IS NOT NULL), s AS (SELECT row, col, sum(v * w) / sum(w) AS value FROM w GROUP BY row, col) SELECT t.row, t.col, CASE WHEN n.v IS NOT NULL THEN {_r('s.value', 5)} END AS value FROM t LEFT JOIN s USING (row, col) LEFT JOIN d n ON n.row = CAST(floor(sr) AS INTEGER) AND n.col = CAST(floor(sc) AS INTEGER)")
def resample_bilinear(spark, sf_dir):
    a = local.cast(fx.dem(spark, sf_dir), "float64")
    return _wide(5, value=resample.resample_to(a, _FINE, resampling="bilinear"))


@_query(f"WITH {fx.DEM_SQL}, b AS (SELECT row // 4 AS row, col // 4 AS col, avg(v) AS mean, sum(v) AS total, sqrt(avg(CAST(v AS DOUBLE) * v)) AS rms, min(v) AS lo, max(v) AS hi, median(v) AS med, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(v) AS n FROM d GROUP BY 1, 2) SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, {_r('mean', 5)} AS mean, {_r('total', 3)} AS total, {_r('rms', 5)} AS rms, {_r('lo', 3)} AS lo, {_r('hi', 3)} AS hi, {_r('med', 5)} AS med, {_r('q1', 5)} AS q1, {_r('q3', 5)} AS q3 FROM b")
def resample_block_stats(spark, sf_dir):
    a = local.cast(fx.dem(spark, sf_dir), "float64")
    names = {"mean": "average", "total": "sum", "rms": "rms", "lo": "min", "hi": "max", "med": "median", "q1": "q1", "q3": "q3"}
    out = _wide(**{n: resample.resample_to(a, _COARSE, resampling=r, validity_coverage_threshold=0.01) for n, r in names.items()})
    return out.select("row", "col", *(_rounded(F.col(n), 3 if n in ("total", "lo", "hi") else 5).alias(n) for n in names))


@_query(f"WITH {fx.DEM_SQL}, c AS (SELECT row // 4 AS row, col // 4 AS col, v % 5 AS m, count(*) AS n FROM d WHERE v IS NOT NULL GROUP BY 1, 2, 3) SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, first(m ORDER BY n DESC, m) AS mode FROM c GROUP BY row, col")
def resample_mode(spark, sf_dir):
    return _wide(mode=resample.resample_to(fx.dem(spark, sf_dir) % 5, _COARSE, resampling="mode", validity_coverage_threshold=0.01))


# Global and zonal


@_query(f"WITH {fx.DEM_SQL} SELECT count(v) AS count, count(*) FILTER (WHERE NOT valid) AS invalid_count, CAST(sum(v) AS BIGINT) AS sum, {_r('avg(v)')} AS mean, min(v) AS min, max(v) AS max, CAST(max(v) - min(v) AS DOUBLE) AS range, {_r('var_pop(v)', 4)} AS variance, {_r('stddev_pop(v)')} AS std FROM d")
def global_stats(spark, sf_dir):
    s = reductions.statistics(fx.dem(spark, sf_dir))
    return s.select("count", "invalid_count", F.col("sum").cast("long").alias("sum"), _rounded(F.col("mean"), 6).alias("mean"), "min", "max", "range", _rounded(F.col("variance"), 4).alias("variance"), _rounded(F.col("std"), 6).alias("std"))


@_query(f"WITH {fx.DEM_SQL}, b AS (SELECT CAST(least(9, (v - 500) // 100) AS INTEGER) AS bin, count(*) AS n FROM d WHERE v BETWEEN 500 AND 1500 GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, 500.0::DOUBLE + i * 100 AS low, 600.0::DOUBLE + i * 100 AS high, coalesce(n, 0) AS count FROM range(10) AS t(i) LEFT JOIN b ON b.bin = i")
def histogram(spark, sf_dir):
    return reductions.histogram(fx.dem(spark, sf_dir), bins=10, range=(500, 1500))


@_query(f"WITH {fx.DEM_SQL} SELECT q, round(CAST(p AS DOUBLE), 9) AS value FROM (SELECT unnest([10.0::DOUBLE, 50.0::DOUBLE, 95.0::DOUBLE]) AS q, unnest([quantile_cont(v, 0.1), quantile_cont(v, 0.5), quantile_cont(v, 0.95)]) AS p FROM d)")
def percentiles(spark, sf_dir):
    out = reductions.percentile(fx.dem(spark, sf_dir), [10, 50, 95])
    return out.select("q", F.round("value", 9).alias("value"))


@_query(f"WITH {fx.DEM_SQL} SELECT v % 10 AS value, count(*) AS count FROM d WHERE v IS NOT NULL GROUP BY 1")
def unique_counts(spark, sf_dir):
    return reductions.unique_counts(fx.dem(spark, sf_dir) % 10)


@_query(f"WITH {fx.DEM_SQL} SELECT CAST((row // 8) * 5 + col // 8 AS BIGINT) AS zone, count(*) AS count, count(v) AS valid_count, count(*) - count(v) AS invalid_count, CAST(sum(v) AS BIGINT) AS sum, {_r('avg(v)')} AS mean, min(v) AS min, max(v) AS max, CAST(max(v) - min(v) AS DOUBLE) AS range, {_r('stddev_pop(v)')} AS std, CAST(median(v) AS DOUBLE) AS median, {_r('quantile_cont(v, 0.25)')} AS p25, {_r('quantile_cont(v, 0.75)')} AS p75, {_r('quantile_cont(v, 0.9)')} AS p90 FROM d GROUP BY 1")
def zonal_stats(spark, sf_dir):
    a = fx.dem(spark, sf_dir)
    names = ["count", "valid_count", "invalid_count", "sum", "mean", "min", "max", "range", "std", "median", "p25", "p75", "p90"]
    out = zonal.zonal_stats(a, fx.zones(a), statistics=names)
    return out.select("zone", *(_rounded(F.col(n), 6).alias(n) if n in ("mean", "std", "p25", "p75", "p90") else n for n in names))


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, {_r('avg(v) OVER (PARTITION BY row // 8, col // 8)')} AS mean FROM d")
def zonal_raster(spark, sf_dir):
    a = fx.dem(spark, sf_dir)
    return _wide(6, mean=zonal.zonal_raster(a, fx.zones(a)))


# Regions

_LABELS = f"""WITH RECURSIVE {_M}, t AS (SELECT row, col, row * 40 + col AS id FROM k WHERE t),
e AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
reach(a, b) AS (SELECT id, id FROM t UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
lab AS (SELECT a AS id, min(b) AS region FROM reach GROUP BY a), sized AS (SELECT region, count(*) AS n FROM lab GROUP BY region), num AS (SELECT region, dense_rank() OVER (ORDER BY region) AS label FROM sized)
"""


@_query(_LABELS + "SELECT k.row, k.col, CASE WHEN k.valid THEN CAST(coalesce(label, 0) AS INTEGER) END AS label, CASE WHEN k.valid THEN coalesce(n, 0) END AS size, CASE WHEN k.valid THEN coalesce(n >= 12, false) END AS large FROM k LEFT JOIN lab ON lab.id = k.row * 40 + k.col LEFT JOIN sized USING (region) LEFT JOIN num USING (region)")
def regions_label_size(spark, sf_dir):
    m = fx.mask(spark, sf_dir)
    return _wide(label=regions.label_regions(m, tile=16), size=regions.region_sizes(m, tile=16), large=regions.filter_regions_by_size(m, threshold=12, tile=16))


@_query(f"WITH {_M}, f AS ({_around('count(*) FILTER (WHERE b.t) AS n', 1, '', 'k')}) SELECT k.row, k.col, CASE WHEN valid THEN k.t AND n < 9 END AS border FROM k JOIN f ON f.row = k.row AND f.col = k.col")
def regions_borders(spark, sf_dir):
    return _wide(border=regions.find_borders(fx.mask(spark, sf_dir)))


# Distance

_SEEDS = f"WITH {fx.DEM_SQL}, s AS (SELECT row, col FROM d WHERE v % 97 = 0)"


@_query(_SEEDS + ", m AS (SELECT d.row, d.col, d.valid, min((d.row - s.row) * (d.row - s.row) + (d.col - s.col) * (d.col - s.col)) AS e, min(abs(d.row - s.row) + abs(d.col - s.col)) AS t, min(greatest(abs(d.row - s.row), abs(d.col - s.col))) AS c, min(100 * (d.row - s.row) * (d.row - s.row) + 400 * (d.col - s.col) * (d.col - s.col)) AS p FROM d, s GROUP BY 1, 2, 3) SELECT row, col, CASE WHEN valid THEN CAST(e AS BIGINT) END AS euclidean, CASE WHEN valid THEN CAST(t AS BIGINT) END AS taxicab, CASE WHEN valid THEN CAST(c AS BIGINT) END AS chessboard, CASE WHEN valid THEN CAST(p AS BIGINT) END AS physical FROM m")
def distance_fields(spark, sf_dir):
    a = fx.dem(spark, sf_dir)
    seeds = (a % 97) == 0
    out = _wide(euclidean=distance.distance_to(seeds), taxicab=distance.distance_to(seeds, metric="taxicab"), chessboard=distance.distance_to(seeds, metric="chessboard"), physical=distance.distance_to(seeds, units="physical"))
    square = lambda c: F.round(F.col(c).cast("double") * F.col(c).cast("double")).cast("long").alias(c)
    return out.select("row", "col", square("euclidean"), F.col("taxicab").cast("long").alias("taxicab"), F.col("chessboard").cast("long").alias("chessboard"), square("physical"))


@_query(f"WITH {_M}, m AS (SELECT a.row, a.col, a.valid, bool_or(a.m) AS m, min(CASE WHEN b.valid AND b.m THEN abs(a.row - b.row) + abs(a.col - b.col) END) AS dt, min(CASE WHEN b.valid AND NOT b.m THEN abs(a.row - b.row) + abs(a.col - b.col) END) AS df FROM mask a, mask b GROUP BY 1, 2, 3) SELECT row, col, CASE WHEN valid THEN CAST(CASE WHEN m THEN df ELSE -dt END AS BIGINT) END AS signed FROM m")
def signed_distance(spark, sf_dir):
    out = _wide(signed=distance.signed_distance(fx.mask(spark, sf_dir), metric="taxicab"))
    return out.select("row", "col", F.col("signed").cast("long").alias("signed"))


# Temporal


@_query(f"WITH {fx.SERIES_SQL} SELECT row, col, {_r('avg(v)', 4)} AS mean, min(v) AS low, max(v) AS high, CAST(sum(v) AS BIGINT) AS total, count(v) AS n, {_r('stddev_pop(v)', 4)} AS std FROM series GROUP BY row, col")
def temporal_reduce(spark, sf_dir):
    t = fx.series(spark, sf_dir)
    out = _wide(mean=temporal.temporal_mean(t), low=temporal.temporal_min(t), high=temporal.temporal_max(t), total=temporal.temporal_sum(t), n=temporal.temporal_count(t), std=temporal.temporal_std(t))
    return out.withColumn("mean", _rounded(F.col("mean"), 4)).withColumn("std", _rounded(F.col("std"), 4))


@_query(
    f"""WITH {fx.SERIES_SQL}
SELECT row, col, max(v) FILTER (WHERE layer = 5) AS fifth, max(v) FILTER (WHERE layer = 100) AS before, max(v) FILTER (WHERE layer = 101) AS after
FROM series GROUP BY row, col"""
)
def temporal_layers(spark, sf_dir):
    t = fx.series(spark, sf_dir)
    moment = datetime(2024, 1, 5, 4, 40, tzinfo=UTC)
    assert t.layer_for_time(t.time_for_layer(7)) == 7
    return _wide(fifth=t.layer(5), before=t.read_time(moment, method="before"), after=t.read_time(moment, method="after"))


@_query(
    """SELECT kind, CAST(iv AS INTEGER) AS iv, CAST(a AS TIMESTAMP) AS start_ts, CAST(b AS TIMESTAMP) AS stop_ts FROM (
  SELECT 'month' AS kind, i AS iv, greatest(TIMESTAMP '2027-01-15', TIMESTAMP '2027-01-01' + to_months(CAST(i AS INTEGER))) AS a,
    least(TIMESTAMP '2027-03-10', TIMESTAMP '2027-02-01' + to_months(CAST(i AS INTEGER))) AS b FROM range(3) AS t(i)
  UNION ALL SELECT 'week', i, TIMESTAMP '2027-01-03 12:00:00' + i * INTERVAL 7 DAY, least(TIMESTAMP '2027-01-20 12:00:00', TIMESTAMP '2027-01-03 12:00:00' + (i + 1) * INTERVAL 7 DAY) FROM range(3) AS t(i)
  UNION ALL SELECT 'fixed', i, TIMESTAMP '2027-01-01' + i * INTERVAL 36 HOUR, least(TIMESTAMP '2027-01-08', TIMESTAMP '2027-01-01' + (i + 1) * INTERVAL 36 HOUR) FROM range(5) AS t(i))"""
)
def candidate_intervals(spark, sf_dir):
    at = lambda month, day, hour=0: datetime(2027, month, day, hour, tzinfo=UTC)
    parts = {
        "month": runs.monthly_candidate_intervals(spark, at(1, 15), at(3, 10)),
        "week": runs.weekly_candidate_intervals(spark, at(1, 3, 12), at(1, 20, 12)),
        "fixed": runs.fixed_candidate_intervals(spark, at(1, 1), at(1, 8), duration=timedelta(hours=36)),
    }
    month, week, fixed = (df.select(F.lit(kind).alias("kind"), "iv", "start_ts", "stop_ts") for kind, df in parts.items())
    return month.unionAll(week).unionAll(fixed)


@_query("SELECT CAST(TIMESTAMP '2024-01-01' + i * INTERVAL 90 MINUTE AS TIMESTAMP) AS ts FROM range(17) AS t(i)")
def times_axis(spark, sf_dir):
    return temporal.times(spark, datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 2, tzinfo=UTC), step_hours=1.5).select("ts")


@_query(f"WITH {fx.SERIES_SQL} SELECT CAST(ts AS TIMESTAMP) AS ts, row, col, v * 2 + (row * 15 + col) AS value FROM series WHERE v IS NOT NULL")
def temporal_algebra(spark, sf_dir):
    t = fx.series(spark, sf_dir)
    base = Raster.of(fx.SERIES_GRID.cells(spark).withColumn("value", (F.col("row") * 15 + F.col("col")).cast("long")), fx.SERIES_GRID)
    out = temporal.lifted(local.add, temporal.lifted(local.multiply, t, 2), base)
    return out.df.filter("valid").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "row", "col", "value")


_ASKS = f"WITH {fx.SERIES_SQL}, q AS (SELECT event_id, ts FROM events)"


def _asof(method):
    def run(spark, sf_dir):
        asks = fx.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
        every_six = fx.axis(spark).filter("layer % 6 = 0").withColumn("layer", F.expr("layer div 6"))
        return temporal.lookup(asks, every_six, method=method).select("event_id", "layer")

    return run


for _m, _e in {
    "before": "CASE WHEN epoch_us(ts) < epoch_us(TIMESTAMP '2024-01-01') THEN NULL ELSE least((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 21600000000, 119) END",
    "after": "CASE WHEN epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-30 18:00:00') THEN NULL ELSE greatest((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + 21599999999) // 21600000000, 0) END",
    "nearest": "CASE WHEN epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-30 18:00:00') OR epoch_us(ts) < epoch_us(TIMESTAMP '2024-01-01') THEN NULL ELSE (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + 10799999999) // 21600000000 END",
}.items():
    _QUERIES[f"asof_lookup_{_m}"] = _asof(_m)
    _SQL[f"asof_lookup_{_m}"] = f"SELECT event_id, CAST({_e} AS BIGINT) AS layer FROM events"


# Runs


def _condition(spark, sf_dir):
    t = fx.series(spark, sf_dir)
    return t.df.select("ts", "row", "col", F.coalesce(F.when(F.col("valid"), F.col("value") > 3000), F.lit(False)).alias("cond"))


_RUNS = f"""WITH {fx.SERIES_SQL}, s AS (SELECT ts, layer, row, col, coalesce(v > 3000, false) AS cond FROM series),
n AS (SELECT *, sum(CASE WHEN cond THEN 0 ELSE 1 END) OVER (PARTITION BY row, col ORDER BY ts) AS run FROM s),
l AS (SELECT *, count(*) OVER (PARTITION BY row, col, run ORDER BY ts DESC) AS hours FROM n WHERE cond)"""


@_query(_RUNS + ", iv AS (SELECT CAST(i AS INTEGER) AS iv FROM range(5) AS t(i)), f AS (SELECT row, col, CAST(layer // 168 AS INTEGER) AS iv, max(hours) AS h FROM l GROUP BY 1, 2, 3) SELECT g.row, g.col, iv.iv, CAST(coalesce(h, 0) AS FLOAT) AS duration FROM sgrid g CROSS JOIN iv LEFT JOIN f ON f.row = g.row AND f.col = g.col AND f.iv = iv.iv")
def mission_duration(spark, sf_dir):
    start, stop = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 31, tzinfo=UTC)
    return runs.mission_duration(_condition(spark, sf_dir), fx.axis(spark), runs.weekly_candidate_intervals(spark, start, stop), stop=stop)


@_query(f"""WITH {fx.SERIES_SQL}, s AS (SELECT ts, row, col, coalesce(v, 0) < 5000 AS low, (layer % 24) < 6 AND (row + col) % 3 <> 0 AS out FROM series),
n AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY row, col ORDER BY ts) AS run FROM s),
z AS (SELECT *, count(*) FILTER (WHERE low) OVER (PARTITION BY row, col, run) AS k FROM n)
SELECT row, col, date_trunc('month', ts)::TIMESTAMP AS month, CAST(CASE WHEN NOT bool_or(out) OR bool_and(out) THEN -1 ELSE coalesce(max(CASE WHEN low AND out THEN k END), 0) END AS FLOAT) AS hours FROM z GROUP BY 1, 2, 3""")
def safe_haven(spark, sf_dir):
    t = fx.series(spark, sf_dir)
    layer = F.expr("timestampdiff(HOUR, timestamp '2024-01-01 00:00:00', ts)")
    samples = t.df.select("ts", "row", "col", F.coalesce(F.when(F.col("valid"), F.col("value")), F.lit(0)).alias("fraction"), F.when((layer % 24 < 6) & ((F.col("row") + F.col("col")) % 3 != 0), F.lit(1.0)).otherwise(F.lit(3.0)).alias("earth"))
    out = runs.safe_haven(samples, sunlight_threshold=5000, earth_threshold=2.0)
    return out.select("row", "col", F.col("month").cast("timestamp_ntz").alias("month"), F.when(F.isnan("hours"), F.lit(-1.0).cast("float")).otherwise(F.col("hours")).alias("hours"))


# Products

_SKY = """cells AS (SELECT CAST(vec_id // 10 AS INTEGER) AS row, CAST(vec_id % 10 AS INTEGER) AS col, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 500) / 100) AS horizon FROM embeddings WHERE vec_id < 100),
vec AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + i * INTERVAL 1 HOUR AS ts, cos(i * (2 * pi() / 48)) * 1.5e11 AS x, sin(i * (2 * pi() / 48)) * 1.5e11 AS y, sin(i * (2 * pi() / 48) * 3) * 0.03 * 1.5e11 - 0.01 * 1.5e11 AS z FROM range(48) AS t(i)),
geo AS (SELECT *, 0.0::DOUBLE + col * 100 AS px, 0.0::DOUBLE - row * 100 AS py FROM cells),
ll AS (SELECT *, sqrt(px * px + py * py) AS rho, CASE WHEN sqrt(px * px + py * py) < 1e-9 THEN -pi() / 2 ELSE -asin(cos(2 * atan(sqrt(px * px + py * py) / 3474800.0::DOUBLE))) END AS lat0, CASE WHEN sqrt(px * px + py * py) < 1e-9 THEN 0.0::DOUBLE ELSE atan2(px, py) END AS lon FROM geo),
l2 AS (SELECT *, CASE WHEN rho < 1e-9 THEN lat0 ELSE -(pi() / 2 - 2 * atan(rho / 3474800.0::DOUBLE)) END AS lat FROM ll),
look AS (SELECT l.row, l.col, v.ts, l.horizon, v.x - 1737400.0::DOUBLE * cos(lat) * cos(lon) AS dx, v.y - 1737400.0::DOUBLE * cos(lat) * sin(lon) AS dy, v.z - 1737400.0::DOUBLE * sin(lat) AS dz, lat, lon FROM l2 l CROSS JOIN vec v),
enu AS (SELECT row, col, ts, horizon, -sin(lon) * dx + cos(lon) * dy AS e, -sin(lat) * cos(lon) * dx - sin(lat) * sin(lon) * dy + cos(lat) * dz AS n, cos(lat) * cos(lon) * dx + cos(lat) * sin(lon) * dy + sin(lat) * dz AS u FROM look),
ae AS (SELECT row, col, ts, horizon, (degrees(atan2(e, n)) + 360) % 360 AS az, degrees(atan2(u, sqrt(e * e + n * n))) AS el FROM enu),
mg AS (SELECT *, el - (horizon[CAST(floor(az * 64 / 360) AS INTEGER) % 64 + 1] * (1 - (az * 64 / 360 - floor(az * 64 / 360))) + horizon[(CAST(floor(az * 64 / 360) AS INTEGER) + 1) % 64 + 1] * (az * 64 / 360 - floor(az * 64 / 360))) AS margin FROM ae)"""


@_query(f"WITH {_SKY} SELECT ts::TIMESTAMP AS ts, row, col, {_r('margin', 3)} AS value FROM mg")
def body_elevation(spark, sf_dir):
    out = products.body_elevation(fx.profiles(spark, sf_dir), fx.vectors(spark), fx.SERIES_GRID, bins=64)
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "row", "col", _rounded(F.col("value"), 3).alias("value"))


@_query(f"WITH {_SKY} SELECT row, col, CAST(CASE WHEN max(margin) > -0.2725 THEN 0 ELSE 255 END AS SMALLINT) AS value FROM mg GROUP BY row, col")
def psr(spark, sf_dir):
    return products.psr(fx.profiles(spark, sf_dir), fx.vectors(spark), fx.SERIES_GRID, bins=64)


@_query(None)
def lightmap(spark, sf_dir):
    out = products.lightmap(fx.profiles(spark, sf_dir), fx.vectors(spark), fx.SERIES_GRID, bins=64)
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "row", "col", "value")


@_query(None)
def vector_reduction(spark, sf_dir):
    dem = fx.SERIES_GRID.cells(spark).withColumn("elevation", F.lit(0.0))
    out = products.reduce_vectors(fx.vectors(spark), products.viewpoints(dem, fx.SERIES_GRID), fx.SERIES_GRID, bins=64)
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"))


# Horizons


@_query(f"WITH {fx.DEM_SQL}, p AS (SELECT a.row, a.col, (b.col - a.col) * 20.0::DOUBLE AS e, (a.row - b.row) * 10.0::DOUBLE AS n, CAST(b.v - a.v AS DOUBLE) AS dz FROM d a JOIN d b ON abs(a.row - b.row) <= 4 AND abs(a.col - b.col) <= 4 AND (a.row <> b.row OR a.col <> b.col) WHERE a.v IS NOT NULL AND b.v IS NOT NULL) SELECT row, col, CAST(floor(((degrees(atan2(e, n)) + 360) % 360) * 16 / 360 + 0.5) AS INTEGER) % 16 AS azimuth, {_r('max(dz / sqrt(e * e + n * n))')} AS slope FROM p GROUP BY 1, 2, 3")
def horizon_range_join(spark, sf_dir):
    out = horizon.range_join_horizon(fx.dem(spark, sf_dir).cells(), fx.GRID, reach=4, azimuths=16)
    return out.select("row", "col", "azimuth", _rounded(F.col("slope"), 6).alias("slope"))


@_query(None)
def horizon_march(spark, sf_dir):
    g = Grid(fx.SIDE, fx.SIDE, (1000.0, 20.0, 0.0, 2000.0, 0.0, -20.0), fx.GRID.projection)
    out = horizon.generate_horizons((fx.dem(spark, sf_dir) / 100).cells(), g, maximum_m=400.0, azimuths=64, tile=16)
    return out.select("row", "col", F.transform("horizon", lambda h: F.round(h.cast("double"), 3)).alias("horizon"))


@_query(f"WITH {fx.DEM_SQL}, a AS (SELECT row // 4 AS row, col // 4 AS col, max(v) AS z FROM d GROUP BY 1, 2), b AS (SELECT row // 4 AS row, col // 4 AS col, max(z) AS z FROM a GROUP BY 1, 2), c AS (SELECT 0 AS row, 0 AS col, max(z) AS z FROM b) SELECT CAST(1 AS INTEGER) AS level, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(coalesce(z, -32000) AS FLOAT) AS zmax FROM a UNION ALL SELECT 2, row, col, CAST(coalesce(z, -32000) AS FLOAT) FROM b UNION ALL SELECT 3, row, col, CAST(coalesce(z, -32000) AS FLOAT) FROM c")
def horizon_pyramid(spark, sf_dir):
    return horizon.max_pyramid(fx.dem(spark, sf_dir).cells(), fx.GRID)


# Flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing-site screening: gentle, sunny cells in regions of some size, ranked by size."""
    a = fx.dem(spark, sf_dir)
    gentle = terrain.slope(a / 100) <= 20.0
    sunny = fx.bands(spark, sf_dir)[1] >= 1
    candidates = regions.filter_regions_by_size(gentle & sunny, threshold=3, tile=16)
    sizes = regions.region_sizes(candidates, tile=16)
    labels = regions.label_regions(candidates, tile=16)
    table = _wide(region=labels, size=sizes).filter("region > 0")
    return table.groupBy("region").agg(F.max("size").alias("size"), F.min("row").alias("first_row"), F.min("col").alias("first_col")).orderBy(F.desc("size"), "region")


@_query(None)
def landing_sites(spark, sf_dir):
    return flagship(spark, sf_dir)



# Text, streaming, storage


@_query("SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type), '.*in.*ec')")
def catalog_search(spark, sf_dir):
    from terrella.functions.text import search_products

    parts = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return search_products(parts, "in EC").select("id", "name")


@_query("SELECT p_partkey AS id, lower(regexp_replace(regexp_replace(regexp_replace(trim(p_name || ' (' || p_type || ')!'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), '_+', '_', 'g')) AS slug FROM part")
def slug(spark, sf_dir):
    from terrella.functions.text import safe_name

    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), safe_name(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")!"))).alias("slug"))


@_query(f"WITH {fx.SERIES_SQL} SELECT row, col, count(v) AS n, CAST(sum(v) AS BIGINT) AS total, {_r('avg(v)', 4)} AS mean, min(v) AS low, max(v) AS high FROM series WHERE v IS NOT NULL GROUP BY row, col")
def streaming_temporal(spark, sf_dir):
    from terrella.sources.scratch import scratch_path
    from terrella.streaming import temporal as streams

    root = scratch_path(spark, "stream")
    fx.sparse_series(spark, sf_dir).withColumn("valid", F.lit(True)).repartition(4, "ts").write.parquet(f"{root}/in")
    streams.run_to_table(streams.reduced(streams.layers(spark, f"{root}/in", files_per_trigger=2)), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("row", "col", "n", "total", _rounded(F.col("mean"), 4).alias("mean"), "low", "high")


@_query(f"WITH {fx.DEM_SQL} SELECT row, col, v FROM d WHERE row BETWEEN 5 AND 20 AND col BETWEEN 3 AND 30")
def storage_window(spark, sf_dir):
    from terrella.sources import rasters
    from terrella.sources.scratch import scratch_path

    path = scratch_path(spark, "raster")
    rasters.write(path, fx.dem(spark, sf_dir))
    r = rasters.read(spark, path, rows=(5, 21), cols=(3, 31))
    return r.df.select("row", "col", r.v.alias("v"))


@_query(None)
def operations(spark, sf_dir):
    from terrella.plans import registry

    return registry.frame(spark)
