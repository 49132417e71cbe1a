"""Terrain horizons: the highest elevation angle of the terrain in each azimuth, seen from each cell.

Observers are grouped in tiles. Every terrain cell is sent to the tiles that it may be seen from (those within the maximum
distance), so a tile's task holds a bounded patch and no whole elevation model is ever broadcast. In a task rays are marched for all
azimuths of a block of observers at once along great circles, in steps of a cell at first that grow with the distance; stretches
whose highest ground could not raise the horizon found so far are left out, by block maxima.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.errors import OperationError
from terrella.grid import Grid

AZIMUTHS, TILE = 1440, 128
#: Elevation that stands for missing ground. Fixed value.
INVALID_ELEVATION = -32000.0


def max_pyramid(dem: DataFrame, grid: Grid, *, factor: int = 4) -> DataFrame:
    """level, row, col, zmax: maxima of blocks of factor x factor cells, level by level up to one cell."""
    ok = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & (F.col("value") > -20000)
    valid = ok & F.col("valid") if "valid" in dem.columns else ok
    level, out, h, w = 0, None, grid.height, grid.width
    now = dem.select("row", "col", F.when(valid, F.col("value").cast("float")).alias("zmax"))
    while h > 1 or w > 1:
        level, h, w = level + 1, -(-h // factor), -(-w // factor)
        now = now.groupBy(F.expr(f"row div {factor}").cast("int").alias("row"), F.expr(f"col div {factor}").cast("int").alias("col")).agg(F.max("zmax").alias("zmax"))
        part = now.select(F.lit(level).alias("level"), "row", "col", F.coalesce("zmax", F.lit(INVALID_ELEVATION).cast("float")).alias("zmax"))
        out = part if out is None else out.unionAll(part)
    return out


def bilinear(z: np.ndarray, col: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Values between cell places; NaN outside or where a corner is missing."""
    c0, r0 = np.floor(col).astype(np.int64), np.floor(row).astype(np.int64)
    inside = (c0 >= 0) & (r0 >= 0) & (c0 < z.shape[1] - 1) & (r0 < z.shape[0] - 1)
    c, r = np.where(inside, c0, 0), np.where(inside, r0, 0)
    if z.shape[0] < 2 or z.shape[1] < 2:
        return np.full(col.shape, np.nan)
    fc, fr = col - c0, row - r0
    top = z[r, c] * (1 - fc) + z[r, c + 1] * fc
    low = z[r + 1, c] * (1 - fc) + z[r + 1, c + 1] * fc
    return np.where(inside, top * (1 - fr) + low * fr, np.nan)


def _stereographic(grid: Grid, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = grid.projection
    s0, c0 = math.sin(p.latitude_0), math.cos(p.latitude_0)
    k = 2 * p.radius * p.scale / np.maximum(1 + s0 * np.sin(lat) + c0 * np.cos(lat) * np.cos(lon - p.longitude_0), 1e-12)
    x = k * np.cos(lat) * np.sin(lon - p.longitude_0) + p.false_easting
    y = k * (c0 * np.sin(lat) - s0 * np.cos(lat) * np.cos(lon - p.longitude_0)) + p.false_northing
    g0, a, b, g3, d, e = grid.affine
    det = a * e - b * d
    return ((x - g0) * e - (y - g3) * b) / det, ((y - g3) * a - (x - g0) * d) / det


def _geodetic(grid: Grid, col: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, (g0, a, b, g3, d, e) = grid.projection, grid.affine
    x, y = g0 + col * a + row * b - p.false_easting, g3 + col * d + row * e - p.false_northing
    rho = np.hypot(x, y)
    c = 2 * np.arctan(rho / (2 * p.radius * p.scale))
    s0, c0 = math.sin(p.latitude_0), math.cos(p.latitude_0)
    safe = np.maximum(rho, 1e-9)
    lat = np.arcsin(np.clip(np.cos(c) * s0 + y * np.sin(c) * c0 / safe, -1, 1))
    lon = p.longitude_0 + np.arctan2(x * np.sin(c), safe * c0 * np.cos(c) - y * s0 * np.sin(c))
    return np.where(rho < 1e-9, p.latitude_0, lat), np.where(rho < 1e-9, p.longitude_0, lon)


def distances(maximum_m: float, step_m: float, growth: float = 0.002) -> np.ndarray:
    """Where rays are sampled: steps of step_m at first, then of a share of the distance."""
    out, at, step = [], step_m, step_m
    while at <= maximum_m:
        out.append(at)
        at += step
        step = max(step_m, at * growth)
    return np.array(out)


def block_maxima(z: np.ndarray, size: int) -> np.ndarray:
    """Greatest value of each block of size x size cells and its neighbours; -inf where there is no ground."""
    h, w = -(-z.shape[0] // size), -(-z.shape[1] // size)
    full = np.full((h * size, w * size), -np.inf)
    full[: z.shape[0], : z.shape[1]] = np.where(np.isnan(z), -np.inf, z)
    top = np.pad(full.reshape(h, size, w, size).max((1, 3)), 1, constant_values=-np.inf)
    return np.max([top[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)


def _bound(radius: float, at: np.ndarray, top: np.ndarray, near: float, far: float) -> np.ndarray:
    """The greatest slope that ground of at most this height can have between two central angles."""
    k = (radius + at) / (radius + top)
    ends = np.maximum((math.cos(near) - k) / math.sin(near), (math.cos(far) - k) / math.sin(far))
    turn = np.arccos(np.minimum(1 / np.maximum(k, 1.0), 1.0))
    return np.where((k > 1) & (turn > near) & (turn < far), np.maximum(ends, -np.sqrt(np.maximum(k * k - 1, 0))), ends)


def march(grid: Grid, z: np.ndarray, row0: int, col0: int, rows: np.ndarray, cols: np.ndarray, *, azimuths: int, maximum_m: float, step_m: float, observer_height: float = 0.0, chunk: int = 16) -> np.ndarray:
    """Horizon degrees (observer, azimuth) over a patch z whose first cell is (row0, col0); -90 where no ground is met.

    Samples are taken in chunks. A ray leaves a chunk out where the highest ground of the blocks around it could not raise the horizon
    found so far; chunk = 0 takes every sample.
    """
    radius = grid.projection.radius
    lat, lon = (x[:, None] for x in _geodetic(grid, cols.astype(float), rows.astype(float)))
    at = z[rows - row0, cols - col0][:, None] + observer_height
    az = np.radians(np.arange(azimuths) * 360.0 / azimuths)[None, :]
    shape = (len(rows), azimuths)
    lat, lon, at, az = (np.broadcast_to(x, shape).ravel() for x in (lat, lon, at, az))
    sin_lat, cos_lat, sin_az, cos_az = np.sin(lat), np.cos(lat), np.sin(az), np.cos(az)
    best = np.full(lat.shape, -np.inf)
    samples = distances(maximum_m, step_m)
    cell = min(grid.pixel_size)
    levels: dict[int, np.ndarray] = {}

    def places(rays: np.ndarray | slice, angle: float) -> tuple[np.ndarray, np.ndarray]:
        lat1 = np.arcsin(np.clip(sin_lat[rays] * math.cos(angle) + cos_lat[rays] * math.sin(angle) * cos_az[rays], -1, 1))
        lon1 = lon[rays] + np.arctan2(sin_az[rays] * math.sin(angle) * cos_lat[rays], math.cos(angle) - sin_lat[rays] * np.sin(lat1))
        c, r = _stereographic(grid, lat1, lon1)
        return c - col0, r - row0

    for first in range(0, len(samples), chunk or len(samples) or 1):
        part = samples[first : first + (chunk or len(samples))] / radius
        rays: np.ndarray | slice = slice(None)
        if chunk:
            size = 4
            while size * cell < (part[-1] - part[0]) * radius * 0.75 + 2 * cell:
                size *= 4
            if size not in levels:
                levels[size] = block_maxima(z, size)
            c, r = places(slice(None), float(part[0] + part[-1]) / 2)
            i, j = np.floor(r / size).astype(np.int64), np.floor(c / size).astype(np.int64)
            inside = (i >= -1) & (j >= -1) & (i <= levels[size].shape[0]) & (j <= levels[size].shape[1])
            top = levels[size][np.clip(i, 0, levels[size].shape[0] - 1), np.clip(j, 0, levels[size].shape[1] - 1)]
            known = inside & np.isfinite(top)
            rays = np.flatnonzero(known & (_bound(radius, at, np.where(known, top, 0.0), float(part[0]), float(part[-1])) > best))
            if not len(rays):
                continue
        for angle in part.tolist():
            height = bilinear(z, *places(rays, angle))
            slope = ((radius + height) * math.cos(angle) - (radius + at[rays])) / ((radius + height) * math.sin(angle))
            best[rays] = np.fmax(best[rays], slope)
    best = best.reshape(shape)
    return np.where(np.isfinite(best), np.degrees(np.arctan(best)), -90.0).astype(np.float32)


def generate_horizons(dem: DataFrame, grid: Grid, *, maximum_m: float, azimuths: int = AZIMUTHS, tile: int = TILE, step_m: float | None = None, observer_height: float = 0.0) -> DataFrame:
    """row, col and horizon of every valid cell of one elevation model (row, col, value, valid)."""
    if grid.projection is None:
        raise OperationError("Horizons need a projection.", code="missing_projection")
    size = min(grid.pixel_size)
    halo = math.ceil(maximum_m / size) + 2
    reach = -(-halo // tile)
    ok = F.coalesce(F.col("valid"), F.lit(False)) & F.col("value").isNotNull()
    cells = dem.select("row", "col", F.when(ok, F.col("value").cast("double")).alias("z"))
    shifts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    tiles_r, tiles_c = -(-grid.height // tile), -(-grid.width // tile)
    sent = cells.withColumn("_o", F.explode(shifts)).select((F.expr(f"row div {tile}") + F.col("_o.i")).cast("int").alias("tr"), (F.expr(f"col div {tile}") + F.col("_o.j")).cast("int").alias("tc"), "row", "col", "z")
    near = F.col("row").between(F.col("tr") * tile - halo, F.col("tr") * tile + tile + halo) & F.col("col").between(F.col("tc") * tile - halo, F.col("tc") * tile + tile + halo)
    sent = sent.filter((F.col("tr") >= 0) & (F.col("tr") < tiles_r) & (F.col("tc") >= 0) & (F.col("tc") < tiles_c) & near)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        tr, tc = (k.as_py() for k in key)
        row, col = group["row"].to_numpy().astype(np.int64), group["col"].to_numpy().astype(np.int64)
        r0, c0 = int(row.min()), int(col.min())
        z = np.full((int(row.max()) - r0 + 1, int(col.max()) - c0 + 1), np.nan)
        z[row - r0, col - c0] = group["z"].to_numpy(zero_copy_only=False)
        mine = (row // tile == tr) & (col // tile == tc) & ~np.isnan(z[row - r0, col - c0])
        rows, cols = row[mine], col[mine]
        parts = [march(grid, z, r0, c0, rows[i : i + 128], cols[i : i + 128], azimuths=azimuths, maximum_m=maximum_m, step_m=step_m or size, observer_height=observer_height) for i in range(0, len(rows), 128)]
        flat = np.concatenate(parts).ravel() if parts else np.array([], np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, azimuths, dtype=np.int32)), pa.array(flat))
        return pa.table({"row": pa.array(rows.astype(np.int32)), "col": pa.array(cols.astype(np.int32)), "horizon": lists})

    return sent.groupBy("tr", "tc").applyInArrow(run, "row int, col int, horizon array<float>")


def merge_passes(passes: list[DataFrame]) -> DataFrame:
    """The highest of several horizons at each azimuth (elevation rises with slope, so maxima agree)."""
    out = passes[0]
    for p in passes[1:]:
        out = out.unionAll(p)
    return out.groupBy("row", "col").agg(F.collect_list("horizon").alias("h")).select("row", "col", F.aggregate("h", F.get("h", F.lit(0)), lambda a, b: F.zip_with(a, b, F.greatest)).alias("horizon"))


def range_join_horizon(dem: DataFrame, grid: Grid, *, reach: int, azimuths: int = 64) -> DataFrame:
    """A simple exact form over a planar grid: row, col, azimuth bin and the greatest slope to the centre of any cell of the bin within reach cells.

    Cells are bucketed by blocks of `reach`, so each meets nine blocks only.
    """
    w, h = grid.pixel_size
    ok = F.coalesce(F.col("valid"), F.lit(False)) & F.col("value").isNotNull()
    z = dem.filter(ok).select("row", "col", F.col("value").cast("double").alias("z"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    seen = z.withColumn("_o", F.explode(steps)).select((F.expr(f"row div {reach}") + F.col("_o.i")).alias("br"), (F.expr(f"col div {reach}") + F.col("_o.j")).alias("bc"), F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("z").alias("z2"))
    here = z.select(F.expr(f"row div {reach}").cast("long").alias("br"), F.expr(f"col div {reach}").cast("long").alias("bc"), "row", "col", "z")
    pairs = here.join(seen, ["br", "bc"]).filter((F.abs(F.col("r2") - F.col("row")) <= reach) & (F.abs(F.col("c2") - F.col("col")) <= reach) & ((F.col("r2") != F.col("row")) | (F.col("c2") != F.col("col"))))
    east, north = (F.col("c2") - F.col("col")) * F.lit(w), (F.col("row") - F.col("r2")) * F.lit(h)
    az = F.pmod(F.degrees(F.atan2(east.cast("double"), north.cast("double"))), F.lit(360.0))
    bin_ = (F.floor(az * F.lit(azimuths / 360.0) + F.lit(0.5)) % azimuths).cast("int")
    slope = (F.col("z2") - F.col("z")) / F.sqrt(east * east + north * north)
    return pairs.groupBy("row", "col", bin_.alias("azimuth")).agg(F.max(slope).alias("slope"))


