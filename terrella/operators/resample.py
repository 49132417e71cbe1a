"""Cross-grid resampling, always explicit.

Every target cell computes which source cells it looks at; values come by an equi-join on source (row, col), never by a range
scan. Interpolating kernels weigh a fixed support and divide by the weight of valid cells; block statistics weigh source
cells by the part of them that lies in the target cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.errors import DTypeError, GridError, OperationError
from terrella.functions import dtypes as D
from terrella.grid import Grid
from terrella.raster import Raster

#: Names of the resampling algorithms. Fixed values.
ALGORITHMS = ("nearest", "bilinear", "cubic", "cubicspline", "lanczos", "average", "mode", "max", "min", "median", "q1", "q3", "sum", "rms")
_SUPPORT = {"bilinear": 1, "cubic": 2, "cubicspline": 2, "lanczos": 3}


def available_resampling_algorithms() -> tuple[str, ...]:
    return ALGORITHMS


def same_grid(left: Grid, right: Grid, *, affine_tolerance: float = 0.0) -> bool:
    return left.same_as(right, affine_tolerance=affine_tolerance)


def require_same_grid(left: Grid, right: Grid, *, affine_tolerance: float = 0.0) -> None:
    left.require_same(right, affine_tolerance=affine_tolerance)


def check_safety(resampling: str, source: str, output: str, *, categorical: bool | None, allow_unsafe: bool) -> None:
    """Categories take only nearest or mode, and interpolated values no integer type, unless allowed."""
    if resampling not in ALGORITHMS:
        raise OperationError("Unknown resampling algorithm.", code="unknown_resampling", details={"resampling": resampling})
    if allow_unsafe or resampling in ("nearest", "mode"):
        return
    if categorical if categorical is not None else not D.is_float(source):
        raise DTypeError("Categories are resampled by nearest or mode.", code="unsafe_categorical_resampling", details={"resampling": resampling, "dtype": source})
    if not D.is_float(output) and resampling not in ("min", "max"):
        raise DTypeError("Interpolated values need a float type.", code="unsafe_resampling_dtype", details={"resampling": resampling, "dtype": output})


def _source_place(spark: SparkSession, source: Grid, target: Grid) -> DataFrame:
    """row, col and the source column and row (in corner coordinates) of each target cell's centre."""
    cells = target.cells(spark)
    x, y = target.to_projected(F.col("col"), F.col("row"))
    if target.projection != source.projection:
        if target.projection is None or source.projection is None:
            raise GridError("Both grids need a projection.", code="missing_projection")
        x, y = source.from_lonlat(*target.to_lonlat(x, y))
    c, r = source.to_pixel(x, y, anchor="corner")
    return cells.select("row", "col", c.alias("sc"), r.alias("sr"))


def _cubic(t: Column) -> Column:
    a = F.abs(t)
    return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(F.lit(0.0))


def _spline(t: Column) -> Column:
    a = F.abs(t)
    return F.when(a <= 1, 2 / 3 + a * a * (0.5 * a - 1)).when(a < 2, F.pow(2 - a, F.lit(3.0)) / 6).otherwise(F.lit(0.0))


def _lanczos(t: Column) -> Column:
    x = t * math.pi
    safe = F.when(F.abs(t) < 1e-12, F.lit(1.0)).otherwise(x)
    return F.when(F.abs(t) < 1e-12, F.lit(1.0)).when(F.abs(t) >= 3, F.lit(0.0)).otherwise(F.sin(safe) / safe * F.sin(safe / 3) / (safe / 3))


_KERNELS = {"bilinear": lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t)), "cubic": _cubic, "cubicspline": _spline, "lanczos": _lanczos}


def window_of(source: Grid, target: Grid, *, x0: int, y0: int, width: int, height: int, resampling: str) -> tuple[int, int, int, int]:
    """Source columns and rows (first, stop) that a target window may look at: same projection, conservative."""
    if source.projection != target.projection:
        return 0, source.width, 0, source.height
    g, h = target.affine, source.affine
    det = h[1] * h[5] - h[2] * h[4]
    cs, rs = [], []
    for c in (x0, x0 + width):
        for r in (y0, y0 + height):
            x, y = g[0] + c * g[1] + r * g[2] - h[0], g[3] + c * g[4] + r * g[5] - h[3]
            cs.append((x * h[5] - y * h[2]) / det)
            rs.append((y * h[1] - x * h[4]) / det)
    more = _SUPPORT.get(resampling, 1) + 1
    return max(0, math.floor(min(cs)) - more), min(source.width, math.ceil(max(cs)) + more), max(0, math.floor(min(rs)) - more), min(source.height, math.ceil(max(rs)) + more)


def _nearest(raster: Raster, grid: Grid) -> DataFrame:
    places = _source_place(raster.root.sparkSession, raster.grid, grid)
    looked = places.select("row", "col", F.floor("sr").cast("int").alias("_r"), F.floor("sc").cast("int").alias("_c"))
    cells = raster.cells().select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value", "valid")
    return looked.join(cells, ["_r", "_c"], "left").select("row", "col", "value", F.coalesce("valid", F.lit(False)).alias("valid"))


def _interpolated(raster: Raster, grid: Grid, name: str) -> DataFrame:
    n, kernel = _SUPPORT[name], _KERNELS[name]
    places = _source_place(raster.root.sparkSession, raster.grid, grid)
    first_r, first_c = F.floor(F.col("sr") - 0.5), F.floor(F.col("sc") - 0.5)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(1 - n, n + 1) for j in range(1 - n, n + 1)))
    wide = places.withColumn("_o", F.explode(steps)).select("row", "col", "sr", "sc", (first_r + F.col("_o.i")).cast("int").alias("_r"), (first_c + F.col("_o.j")).cast("int").alias("_c"))
    inside = (F.col("sc") >= 0) & (F.col("sc") < raster.grid.width) & (F.col("sr") >= 0) & (F.col("sr") < raster.grid.height)
    wide = wide.filter(inside).withColumn("_w", kernel(F.col("sr") - 0.5 - F.col("_r")) * kernel(F.col("sc") - 0.5 - F.col("_c")))
    cells = raster.masked().select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").cast("int" if raster.dtype == "bool" else "double").cast("double").alias("v"))
    sums = wide.join(cells, ["_r", "_c"]).filter("v IS NOT NULL").groupBy("row", "col").agg(F.sum(F.col("_w") * F.col("v")).alias("s"), F.sum("_w").alias("w"))
    return sums.select("row", "col", F.when(F.abs("w") > 1e-9, F.col("s") / F.col("w")).alias("value"))


def _spread(raster: Raster, grid: Grid) -> DataFrame:
    """row, col (target), v, ok and w (the part of the source cell inside) of each overlapping pair; same axes."""
    s, t = raster.grid, grid
    if s.projection != t.projection or any(abs(g.affine[i]) > 1e-12 for g in (s, t) for i in (2, 4)):
        raise GridError("Block statistics need grids of one projection without rotation.", code="unsupported_block_grid")

    def span(at: str, o_s: float, step_s: float, o_t: float, step_t: float, n: int) -> tuple[Column, Column, Column]:
        a = (F.lit(o_s) + F.col(at) * F.lit(step_s) - F.lit(o_t)) / F.lit(step_t)
        b = (F.lit(o_s) + (F.col(at) + 1) * F.lit(step_s) - F.lit(o_t)) / F.lit(step_t)
        low, high = F.least(a, b), F.greatest(a, b)
        first = F.greatest(F.floor(low + 1e-9), F.lit(0))
        last = F.least(F.ceil(high - 1e-9) - 1, F.lit(n - 1))
        return low, high, F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    rl, rh, rows = span("_r", s.affine[3], s.affine[5], t.affine[3], t.affine[5], t.height)
    cl, ch, cols = span("_c", s.affine[0], s.affine[1], t.affine[0], t.affine[1], t.width)
    cells = raster.cells().select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value", "valid")
    cells = cells.select("value", "valid", rl.alias("rl"), rh.alias("rh"), cl.alias("cl"), ch.alias("ch"), rows.alias("rows"), cols.alias("cols"))
    wide = cells.withColumn("row", F.explode("rows")).withColumn("col", F.explode("cols"))
    part = (F.least(F.col("rh"), F.col("row") + 1) - F.greatest(F.col("rl"), F.col("row"))) * (F.least(F.col("ch"), F.col("col") + 1) - F.greatest(F.col("cl"), F.col("col")))
    area = (F.col("rh") - F.col("rl")) * (F.col("ch") - F.col("cl"))
    return wide.select("row", "col", F.when(F.col("valid"), F.col("value")).alias("v"), part.alias("w"), (part / area).alias("share"))


def _block(raster: Raster, grid: Grid, name: str) -> DataFrame:
    x = (F.col("v").cast("int") if raster.dtype == "bool" else F.col("v")).cast("double")
    w = F.when(F.col("v").isNotNull(), F.col("w"))
    spread = _spread(raster, grid)
    if name == "mode":
        weights = spread.filter("v IS NOT NULL").groupBy("row", "col", "v").agg(F.sum("w").alias("w"))
        return weights.groupBy("row", "col").agg(F.max_by("v", F.struct(F.round("w", 9), -F.col("v").cast("int" if raster.dtype == "bool" else "double"))).alias("value"))
    stat = {
        "average": F.sum(x * w) / F.sum(w), "sum": F.sum(x * F.when(F.col("v").isNotNull(), F.col("share"))), "rms": F.sqrt(F.sum(x * x * w) / F.sum(w)),
        "min": F.min("v"), "max": F.max("v"), "median": F.median(x), "q1": F.percentile(x, F.lit(0.25)), "q3": F.percentile(x, F.lit(0.75)),
    }[name]
    return spread.filter("v IS NOT NULL").groupBy("row", "col").agg(stat.alias("value"))


def resample_to(raster: Raster, grid: Grid, *, resampling: str = "nearest", output_dtype: str | None = None, validity_coverage_threshold: float | None = None, categorical: bool | None = None, allow_unsafe: bool = False) -> Raster:
    """The raster on another grid. Validity: that of the nearest source cell, or enough of the target covered by valid ones."""
    d = D.logical(output_dtype) if output_dtype else raster.dtype
    check_safety(resampling, raster.dtype, d, categorical=categorical, allow_unsafe=allow_unsafe)
    near = _nearest(raster, grid)
    if resampling == "nearest":
        out = near
    else:
        values = _interpolated(raster, grid, resampling) if resampling in _SUPPORT else _block(raster, grid, resampling)
        out = near.drop("value").join(values, ["row", "col"], "left").select("row", "col", "value", (F.col("valid") & F.col("value").isNotNull()).alias("valid"))
    if validity_coverage_threshold is not None:
        covered = _spread(raster, grid).groupBy("row", "col").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("cover"))
        enough = F.coalesce(F.col("cover"), F.lit(0.0))
        out = out.drop("valid").join(covered, ["row", "col"], "left").select("row", "col", "value", ((enough > 0) & (enough + 1e-9 >= float(validity_coverage_threshold)) & F.col("value").isNotNull()).alias("valid"))
    value = F.col("value")
    if D.is_int(d) and out.schema["value"].dataType.simpleString() == "double":
        value = F.rint(value)
    return raster.with_table(out.select("row", "col", value.alias("value"), "valid"), d, grid=grid).with_name(raster.name)


def align(raster: Raster, *, to: Grid, resampling: str = "nearest", output_nodata="auto", output_dtype: str | None = None, validity_coverage_threshold: float | None = None, categorical: bool | None = None, allow_unsafe: bool = False) -> Raster:
    """`resample_to` that also decides the nodata of the result's grid."""
    nodata = raster.grid.nodata if isinstance(output_nodata, str) and output_nodata == "auto" else output_nodata
    return resample_to(raster, to.with_nodata(nodata), resampling=resampling, output_dtype=output_dtype, validity_coverage_threshold=validity_coverage_threshold, categorical=categorical, allow_unsafe=allow_unsafe)
