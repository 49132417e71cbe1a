"""Illumination products of stored horizons and body vectors.

cells: row, col, elevation, horizon (array of degrees by azimuth, sample 0 north). vectors: ts, x, y, z in metres, one row a
time, broadcast behind a size check (a time axis has at most a million samples). Azimuth and elevation are column
expressions; nothing but the product's own rows is ever written.
"""

from __future__ import annotations

from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrella.errors import OperationError
from terrella.functions import sky
from terrella.grid import Grid
from terrella.operators import disk, runs

#: Rows of body vectors that are broadcast; more are joined by a plain nested loop that streams them.
VECTORS_BROADCAST = 1_000_000


def _small(vectors: DataFrame) -> DataFrame:
    return F.broadcast(vectors) if bounded(vectors) else vectors


def looks(cells: DataFrame, vectors: DataFrame, grid: Grid) -> DataFrame:
    """Every cell at every time with azimuth and elevation of the body. The frame of a cell is computed once."""
    f = sky.frame(grid, F.col("row"), F.col("col"), F.col("elevation"))
    framed = cells.select("row", "col", "horizon", *(c.alias(f"_{n}") for n, c in f.items()))
    both = framed.crossJoin(_small(vectors.select("ts", "x", "y", "z")))
    az, el = sky.azimuth_elevation(*sky.enu({n: F.col(f"_{n}") for n in f}, F.col("x"), F.col("y"), F.col("z")))
    return both.select("row", "col", "ts", "horizon", az.alias("azimuth"), el.alias("body_elevation"))


def body_elevation(cells: DataFrame, vectors: DataFrame, grid: Grid, *, bins: int = 1440) -> DataFrame:
    """ts, row, col and value: elevation of the body's centre over the local horizon in degrees (float)."""
    margin = F.col("body_elevation") - sky.horizon_at(F.col("horizon"), F.col("azimuth"), bins)
    return looks(cells, vectors, grid).select("ts", "row", "col", margin.cast("float").alias("value"))


sun_elevation = earth_elevation = body_elevation


def sunlight(cells: DataFrame, vectors: DataFrame, grid: Grid, *, bins: int = 1440) -> DataFrame:
    """ts, row, col and value: visible part of the Sun's disk (float)."""
    if bounded(vectors):
        return disk.visible(cells, vectors, grid)
    part = sky.visible_fraction(F.col("horizon"), F.col("azimuth"), F.col("body_elevation"), bins)
    return looks(cells, vectors, grid).select("ts", "row", "col", part.cast("float").alias("value"))


def lightmap(cells: DataFrame, vectors: DataFrame, grid: Grid, *, bins: int = 1440) -> DataFrame:
    """ts, row, col and value: the visible part as a byte, cut off below."""
    return sunlight(cells, vectors, grid, bins=bins).withColumn("value", sky.disk_byte(F.col("value").cast("double")).cast("short"))


def bounded(vectors: DataFrame) -> bool:
    return vectors.limit(VECTORS_BROADCAST + 1).count() <= VECTORS_BROADCAST


def lightmap_bands(cells: DataFrame, vectors: DataFrame, grid: Grid) -> DataFrame:
    """row, col and bands: the lightmap's bytes of one cell, in the order of times. A thirtieth of the size of one row a value."""

    def bands(row, col, horizon, sun):
        return [(row, col, np.floor(disk.fractions(horizon, *sun).astype(np.float32) * 255.0 + 1e-9).astype(np.uint8).tobytes())]

    return disk.per_cell(cells, [vectors], grid, bands, "row int, col int, bands binary")


def psr(cells: DataFrame, vectors: DataFrame, grid: Grid, *, bins: int = 1440) -> DataFrame:
    """row, col and value: 255 where the Sun's upper limb never rises over the horizon, else 0."""
    if bounded(vectors):
        def dark(row, col, horizon, sun):
            return [(row, col, 0 if (disk.margins(horizon, *sun) > -sky.SUN_DIAMETER / 2).any() else 255)]

        return disk.per_cell(cells, [vectors], grid, dark, "row int, col int, value smallint")
    margin = F.col("body_elevation") - sky.horizon_at(F.col("horizon"), F.col("azimuth"), bins)
    best = looks(cells, vectors, grid).select("row", "col", margin.alias("m")).groupBy("row", "col").agg(F.max("m").alias("m"))
    return best.select("row", "col", F.when(F.col("m") > F.lit(-sky.SUN_DIAMETER / 2), F.lit(0)).otherwise(F.lit(255)).cast("short").alias("value"))


def reduce_vectors(vectors: DataFrame, viewpoints: DataFrame, grid: Grid, *, bins: int = 1440) -> DataFrame:
    """The vectors that stand highest in an azimuth bin seen from any viewpoint (row, col, elevation, view); a heuristic for `psr`, so never applied by itself."""
    f = sky.frame(grid, F.col("row"), F.col("col"), F.col("elevation"))
    indexed = vectors.select("ts", "x", "y", "z")
    az, el = sky.azimuth_elevation(*sky.enu(f, F.col("x"), F.col("y"), F.col("z")))
    seen = indexed.crossJoin(F.broadcast(viewpoints)).select("view", "ts", "x", "y", "z", (F.floor(az * F.lit(bins / 360.0)) % bins).alias("bin"), el.alias("el"))
    first = seen.withColumn("_r", F.row_number().over(Window.partitionBy("view", "bin").orderBy(F.desc("el"), "ts"))).filter("_r = 1")
    return first.groupBy("ts", "x", "y", "z").agg(F.min(F.struct("view", "bin")).alias("first"))


def viewpoints(dem: DataFrame, grid: Grid) -> DataFrame:
    """view, row, col, elevation of the four corners and the centre."""
    h, w = grid.height, grid.width
    places = [(0, 0, 0), (1, 0, w - 1), (2, h - 1, 0), (3, h - 1, w - 1), (4, h // 2, w // 2)]
    p = dem.sparkSession.createDataFrame(places, "view int, row int, col int")
    return p.join(dem.select("row", "col", "elevation"), ["row", "col"])


def _mission_in_place(cells, grid, axis, intervals, stop, bodies, has_sun, fraction, sun_degrees, earth_degrees, output_unit) -> DataFrame:
    if output_unit not in ("hours", "days"):
        raise OperationError("output_unit is hours or days.", code="invalid_output_unit", details={"output_unit": output_unit})
    table = runs.sample_hours(axis, stop).select(F.unix_micros("ts").alias("us"), "hours").orderBy("us").toArrow()
    us, hours = table["us"].to_numpy(), table["hours"].to_numpy()
    spans = [(r["iv"], int(np.searchsorted(us, r["a"])), int(np.searchsorted(us, r["b"]))) for r in intervals.select("iv", F.unix_micros("start_ts").alias("a"), F.unix_micros("stop_ts").alias("b")).orderBy("iv").collect()]
    unit = 24.0 if output_unit == "days" else 1.0

    def durations(row, col, horizon, *looked):
        ok = np.ones(len(us), bool)
        sun, earth = (looked[0] if has_sun else None), looked[-1]
        if fraction is not None:
            ok &= disk.fractions(horizon, *sun).astype(np.float32) >= np.float32(fraction)
        if sun_degrees is not None:
            ok &= disk.margins(horizon, *sun).astype(np.float32) >= np.float32(sun_degrees)
        if earth_degrees is not None:
            ok &= disk.margins(horizon, *earth).astype(np.float32) >= np.float32(earth_degrees)
        left = disk.time_left(ok, hours)
        return [(row, col, iv, float(left[a:b].max(initial=0.0)) / unit) for iv, a, b in spans]

    return disk.per_cell(cells, bodies, grid, durations, "row int, col int, iv int, duration float")


def mission_duration_from(cells: DataFrame, grid: Grid, axis: DataFrame, intervals: DataFrame, *, stop, sun_vectors: DataFrame | None = None, earth_vectors: DataFrame | None = None, sunlight_fraction_threshold: float | None = None, sun_elevation_threshold_deg: float | None = None, earth_elevation_threshold_deg: float | None = None, output_unit: str = "hours", bins: int = 1440) -> DataFrame:
    """Mission durations of any conjunction of: enough sunlight, Sun high enough, Earth high enough (thresholds included).

    With bounded vectors a cell's series is made, judged and reduced in one place; only durations leave it.
    """
    bodies = [v for v in (sun_vectors, earth_vectors) if v is not None]
    if all(bounded(v) for v in bodies):
        return _mission_in_place(cells, grid, axis, intervals, stop, bodies, sun_vectors is not None, sunlight_fraction_threshold, sun_elevation_threshold_deg, earth_elevation_threshold_deg, output_unit)
    parts: list[tuple[DataFrame, float]] = []
    if sunlight_fraction_threshold is not None:
        parts.append((sunlight(cells, sun_vectors, grid, bins=bins), sunlight_fraction_threshold))
    if sun_elevation_threshold_deg is not None:
        parts.append((body_elevation(cells, sun_vectors, grid, bins=bins), sun_elevation_threshold_deg))
    if earth_elevation_threshold_deg is not None:
        parts.append((body_elevation(cells, earth_vectors, grid, bins=bins), earth_elevation_threshold_deg))
    samples: DataFrame | None = None
    for signal, threshold in parts:
        one = signal.select("ts", "row", "col", (F.col("value") >= F.lit(threshold).cast("float")).alias("cond"))
        samples = one if samples is None else samples.withColumnRenamed("cond", "_c").join(one, ["ts", "row", "col"]).select("ts", "row", "col", (F.col("_c") & F.col("cond")).alias("cond"))
    return runs.mission_duration(samples, axis, intervals, stop=stop, output_unit=output_unit)


def _havens_in_place(cells, sun_vectors, earth_vectors, grid, hours, earth_degrees, fraction) -> DataFrame:
    bodies = [sun_vectors.join(earth_vectors.select("ts"), "ts", "left_semi"), earth_vectors.join(sun_vectors.select("ts"), "ts", "left_semi")]
    table = bodies[0].select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.unix_micros(F.date_trunc("month", "ts")).alias("month")).orderBy("us").toArrow()
    months, first = np.unique(table["month"].to_numpy(), return_index=True)

    def havens(row, col, horizon, sun, earth):
        low = disk.fractions(horizon, *sun).astype(np.float32).astype(np.float64) < fraction
        out = disk.margins(horizon, *earth).astype(np.float32).astype(np.float64) < earth_degrees
        longest = np.maximum.reduceat(np.where(out, disk.run_lengths(low), 0), first)
        some, only = np.logical_or.reduceat(out, first), np.logical_and.reduceat(out, first)
        found = np.where(~some | only, np.float32("nan"), longest.astype(np.float32) * np.float32(hours))
        return [(row, col, int(m), float(h)) for m, h in zip(months, found, strict=True)]

    made = disk.per_cell(cells, bodies, grid, havens if len(months) else lambda *_: [], "row int, col int, month bigint, hours float")
    return made.withColumn("month", F.timestamp_micros("month"))


def safe_havens(cells: DataFrame, sun_vectors: DataFrame, earth_vectors: DataFrame, grid: Grid, *, step: timedelta, earth_elevation_threshold_deg: float = 2.0, sunlight_fraction_threshold: float = 0.2, bins: int = 1440) -> DataFrame:
    """row, col, month and hours of `runs.safe_haven`, at the times that both bodies have.

    With bounded vectors a cell's two series are made and judged in one place and only its months leave it: no shuffle.
    """
    hours = step / timedelta(hours=1)
    if bounded(sun_vectors) and bounded(earth_vectors):
        return _havens_in_place(cells, sun_vectors, earth_vectors, grid, hours, earth_elevation_threshold_deg, sunlight_fraction_threshold)
    light = sunlight(cells, sun_vectors, grid, bins=bins).withColumnRenamed("value", "fraction")
    earth = body_elevation(cells, earth_vectors, grid, bins=bins).withColumnRenamed("value", "earth")
    return runs.safe_haven(light.join(earth, ["ts", "row", "col"]), sunlight_threshold=sunlight_fraction_threshold, earth_threshold=earth_elevation_threshold_deg, step_hours=hours)


# Point functions


def point_azimuth_elevation(vectors: DataFrame, longitude: float, latitude: float, radius: float, height: float = 0.0) -> DataFrame:
    """ts, north, east, down, azimuth and elevation of a body from one place."""
    lat, lon = F.radians(F.lit(latitude)), F.radians(F.lit(longitude))
    sa, ca, so, co = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    r = F.lit(radius + height)
    f = {"ex": -so, "ey": co, "ez": F.lit(0.0), "nx": -sa * co, "ny": -sa * so, "nz": ca, "ux": ca * co, "uy": ca * so, "uz": sa, "px": r * ca * co, "py": r * ca * so, "pz": r * sa}
    e, n, u = sky.enu(f, F.col("x"), F.col("y"), F.col("z"))
    az, el = sky.azimuth_elevation(e, n, u)
    return vectors.select("ts", n.alias("north"), e.alias("east"), (-u).alias("down"), az.alias("azimuth"), el.alias("elevation"))


def point_over_horizon(vectors: DataFrame, horizon: list[float], longitude: float, latitude: float, radius: float, height: float = 0.0) -> DataFrame:
    """ts, azimuth and elevation over a local horizon."""
    table = F.array(*(F.lit(float(h)) for h in horizon))
    return point_azimuth_elevation(vectors, longitude, latitude, radius, height).select("ts", "azimuth", (F.col("elevation") - sky.horizon_at(table, F.col("azimuth"), len(horizon))).alias("elevation"))


def point_sunlight(vectors: DataFrame, horizon: list[float], longitude: float, latitude: float, radius: float, height: float = 0.0) -> DataFrame:
    """ts and the visible part of the Sun's disk."""
    table = F.array(*(F.lit(float(h)) for h in horizon))
    return point_azimuth_elevation(vectors, longitude, latitude, radius, height).select("ts", sky.visible_fraction(table, F.col("azimuth"), F.col("elevation"), len(horizon)).alias("fraction"))


def transformed(product: DataFrame, output_transform, schema: str) -> DataFrame:
    """A caller's vectorised function over Arrow batches of a product, with a declared schema."""

    def run(batches):
        for batch in batches:
            yield output_transform(batch)

    return product.mapInArrow(run, schema)


def horizon_cells(horizons: DataFrame, dem: DataFrame, *, value: Column | None = None) -> DataFrame:
    """row, col, elevation, horizon from stored horizons and terrain."""
    return horizons.join(dem.select("row", "col", (F.col("value") if value is None else value).alias("elevation")), ["row", "col"])
