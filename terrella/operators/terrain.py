"""Slope, aspect and hillshade from central differences, one-sided at the rim; the gradient is shared between them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrella.errors import OperationError
from terrella.functions import dtypes as D
from terrella.operators.focal import rim
from terrella.raster import Raster


def gradient(raster: Raster, factor: float = 1.0) -> DataFrame:
    """row, col, dzdx, dzdy and ok (no invalid cell within one step) of each cell; z is multiplied by factor."""
    g = raster.grid
    if g.width < 2 or g.height < 2:
        raise OperationError("Terrain operators need two rows and columns.", code="terrain_grid_too_small")
    xres, yres = abs(g.affine[1]), abs(g.affine[5])
    if not xres or not yres:
        raise OperationError("Terrain operators need non-zero pixel sizes.", code="terrain_invalid_georeference")
    z = (F.col("value").cast("int") if raster.dtype == "bool" else F.col("value")).cast("double") * F.lit(factor)
    ok = F.col("valid") & (~F.isnan(z) & (F.abs(z) != math.inf) if D.is_float(raster.dtype) else F.lit(True))
    cells = raster.cells().select("row", "col", F.when(ok, z).alias("z"), (~ok).cast("int").alias("bad"))
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    near, far = across.rangeBetween(-1, 1), down.rangeBetween(-1, 1)

    def slope(w, at: str, n: int, step: float) -> Column:
        before, after = F.lag("z").over(w), F.lead("z").over(w)
        return F.when(F.col(at) == 0, (after - F.col("z")) / F.lit(step)).when(F.col(at) == n - 1, (F.col("z") - before) / F.lit(step)).otherwise((after - before) / F.lit(2 * step))

    # The frames along rows share one shuffle, those along columns another.
    rows = cells.select("*", slope(across, "col", g.width, xres).alias("dzdx"), F.sum("bad").over(near).alias("bad_across"))
    return rows.select("row", "col", "dzdx", slope(down, "row", g.height, yres).alias("dzdy"), (F.sum("bad_across").over(far) == 0).alias("ok"))


def _result(raster: Raster, table: DataFrame, value: Column, dtype: str, compute_edges: bool, units: str | None, extra: Column | None = None) -> Raster:
    ok = F.col("ok") if extra is None else F.col("ok") & extra
    ok = ok if compute_edges else ok & ~rim(raster.grid, 1, 1)
    return raster.with_table(table.select("row", "col", F.when(ok, value).alias("value"), ok.alias("valid")), dtype, units=units)


def _positive(x: float, name: str) -> float:
    if not (math.isfinite(x) and x > 0):
        raise OperationError(f"{name} must be positive and finite.", code="terrain_invalid_argument", details={name: x})
    return x


def slope(raster: Raster, *, units: str = "degrees", compute_edges: bool = False, scale: float = 1.0) -> Raster:
    if units not in ("degrees", "percent"):
        raise OperationError("Slope units are degrees or percent.", code="terrain_invalid_argument", details={"units": units})
    rise = F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy"))
    value = F.degrees(F.atan(rise)) if units == "degrees" else rise * 100.0
    return _result(raster, gradient(raster, 1 / _positive(scale, "scale")), value, "float32", compute_edges, units)


def aspect(raster: Raster, *, compute_edges: bool = False) -> Raster:
    """Compass direction of descent; flat cells are invalid."""
    x, y = F.col("dzdx"), F.col("dzdy")
    value = F.pmod(90.0 - F.degrees(F.atan2(y, -x)), F.lit(360.0))
    return _result(raster, gradient(raster), value, "float32", compute_edges, "degrees", (F.abs(x) > 1e-8) | (F.abs(y) > 1e-8))


def hillshade(raster: Raster, *, azimuth: float = 315.0, altitude: float = 45.0, compute_edges: bool = False, scale: float = 1.0, z_factor: float = 1.0) -> Raster:
    if not 0 <= azimuth <= 360 or not 0 <= altitude <= 90:
        raise OperationError("azimuth lies in 0..360 and altitude in 0..90.", code="terrain_invalid_argument")
    x, y = F.col("dzdx"), F.col("dzdy")
    steep, facing = F.atan(F.sqrt(x * x + y * y)), F.atan2(y, -x)
    sun, high = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    shade = F.lit(math.sin(high)) * F.cos(steep) + F.lit(math.cos(high)) * F.sin(steep) * F.cos(F.lit(sun) - facing)
    value = F.rint(F.least(F.greatest(255.0 * shade, F.lit(0.0)), F.lit(255.0)))
    return _result(raster, gradient(raster, _positive(z_factor, "z_factor") / _positive(scale, "scale")), value, "uint8", compute_edges, None)
