"""Neighbourhood operators over dense rasters.

Full rectangles use two one-dimensional window frames, first along rows, then along columns: two shuffles of the cells, no
blow-up. Other footprints, and statistics that do not split that way, send each cell to the cells that see it and
aggregate. Edges other than invalid ones are first written out as extra cells around the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrella.errors import DTypeError, OperationError
from terrella.functions import dtypes as D
from terrella.raster import Raster

EDGES = ("invalid", "constant", "nearest", "reflect", "wrap")


def footprint_of(size, footprint) -> np.ndarray:
    if footprint is not None:
        f = np.asarray(footprint, bool)
    elif size is not None:
        h, w = (size, size) if isinstance(size, int) else size
        if h < 1 or w < 1:
            raise OperationError("A window needs positive odd sides.", code="invalid_footprint")
        f = np.ones((h, w), bool)
    else:
        raise OperationError("size or footprint is needed.", code="invalid_footprint")
    if f.ndim != 2 or f.shape[0] % 2 != 1 or f.shape[1] % 2 != 1 or not f.any():
        raise OperationError("A footprint is two-dimensional, odd on both sides and not empty.", code="invalid_footprint")
    return f


def _checked(edge: str, valid_neighbor: str, minimum: int | None, cells: int) -> None:
    if edge not in EDGES:
        raise OperationError("Unknown edge mode.", code="invalid_edge_mode", details={"edge": edge})
    if valid_neighbor not in ("require_all", "ignore_invalid", "propagate_center"):
        raise OperationError("Unknown neighbour policy.", code="invalid_valid_neighbor", details={"valid_neighbor": valid_neighbor})
    if minimum is not None and (valid_neighbor != "ignore_invalid" or not 1 <= minimum <= cells):
        raise OperationError("min_valid_count goes with ignore_invalid and lies within the footprint.", code="invalid_min_valid_count")


def _source(p: int, n: int, edge: str) -> int:
    """The cell that a padded place shows."""
    if edge in ("nearest",):
        return min(max(p, 0), n - 1)
    if edge == "wrap":
        return p % n
    if edge == "symmetric":
        p %= 2 * n
        return p if p < n else 2 * n - 1 - p
    if n == 1:
        return 0
    p %= 2 * (n - 1)
    return p if p < n else 2 * (n - 1) - p


def padded(cells: DataFrame, height: int, width: int, hh: int, hw: int, edge: str) -> DataFrame:
    """Cells with the extra rows and columns that an edge mode shows."""
    if edge in ("invalid", "constant"):
        return cells
    for name, n, halo in (("row", height, hh), ("col", width, hw)):
        if halo:
            shown: dict[int, list[int]] = {}
            for p in [*range(-halo, 0), *range(n, n + halo)]:
                shown.setdefault(_source(p, n, edge), []).append(p)
            extra = F.lit(None).cast("array<int>")
            for s, places in shown.items():
                extra = F.when(F.col(name) == s, F.array(*(F.lit(p) for p in places))).otherwise(extra)
            everywhere = F.concat(F.array(F.col(name)), F.coalesce(extra, F.array().cast("array<int>")))
            cells = cells.withColumn(name, F.explode(everywhere))
    return cells


def _frames(hh: int, hw: int):
    return (Window.partitionBy("row").orderBy("col").rangeBetween(-hw, hw), Window.partitionBy("col").orderBy("row").rangeBetween(-hh, hh))


def separable(cells: DataFrame, hh: int, hw: int, **stats: tuple) -> DataFrame:
    """Add windowed columns to row, col, ..: name=(function, column) over the rectangle of halo hh x hw."""
    across, down = _frames(hh, hw)
    cells = cells.select("*", *(f(c).over(across).alias(f"_{n}") for n, (f, c) in stats.items()))
    merge = {n: F.sum if f in (F.sum, F.count) else f for n, (f, c) in stats.items()}
    return cells.select(*(c for c in cells.columns if c[1:] not in stats or c[0] != "_"), *(merge[n](f"_{n}").over(down).alias(n) for n in stats))


def seen(cells: DataFrame, offsets: Sequence[tuple], height: int, width: int) -> DataFrame:
    """Each cell once for every cell that sees it; offsets: (dr, dc, ..) from the seeing cell to the seen one."""
    o = F.array(*(F.struct(F.lit(int(x[0])).alias("dr"), F.lit(int(x[1])).alias("dc"), *(F.lit(float(w)).alias("w") for w in x[2:3])) for x in offsets))
    out = cells.withColumn("_o", F.explode(o))
    out = out.withColumn("row", F.col("row") - F.col("_o.dr")).withColumn("col", F.col("col") - F.col("_o.dc"))
    return out.filter((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width))


def _offsets(f: np.ndarray) -> list[tuple[int, int]]:
    return [(int(i) - f.shape[0] // 2, int(j) - f.shape[1] // 2) for i, j in np.argwhere(f)]


def _wide(c: Column, d: str, power: int = 1) -> Column:
    """An exact or double accumulator of a value or its square."""
    if D.is_float(d):
        c = c.cast("double")
    elif d == "bool":
        c = c.cast("int").cast("long")
    else:
        c = c.cast("decimal(20,0)") if np.dtype(d).itemsize == 8 else c.cast("long")
    return c if power == 1 else c * c


def _statistics(raster: Raster, f: np.ndarray, edge: str, what: dict[str, tuple], split: bool) -> DataFrame:
    """row, col, valid, value of each cell with aggregates over its neighbourhood."""
    g = raster.grid
    hh, hw = f.shape[0] // 2, f.shape[1] // 2
    cells = raster.cells().withColumn("v", F.when(F.col("valid"), F.col("value")))
    around = padded(cells, g.height, g.width, hh, hw, edge)
    inside = F.col("row").between(0, g.height - 1) & F.col("col").between(0, g.width - 1)
    if split and f.all():
        return separable(around, hh, hw, **what).filter(inside)
    spread = seen(around.select("row", "col", "v"), _offsets(f), g.height, g.width)
    return cells.drop("v").join(spread.groupBy("row", "col").agg(*(fn(c).alias(n) for n, (fn, c) in what.items())), ["row", "col"], "left")


def rim(grid, hh: int, hw: int) -> Column:
    return (F.col("row") < hh) | (F.col("row") >= grid.height - hh) | (F.col("col") < hw) | (F.col("col") >= grid.width - hw)


def _validity(raster: Raster, f: np.ndarray, edge: str, valid_neighbor: str, minimum: int | None, ddof: int | None = None) -> Column:
    n = F.coalesce(F.col("n"), F.lit(0))
    if valid_neighbor == "ignore_invalid":
        ok = n >= (1 if minimum is None else minimum)
    elif valid_neighbor == "propagate_center":
        ok = F.col("valid")
    else:
        ok = n == int(f.sum())
    if ddof is not None:
        ok = ok & (n > ddof)
    return ok & ~rim(raster.grid, f.shape[0] // 2, f.shape[1] // 2) if edge == "invalid" else ok


def _focal(raster: Raster, name: str, what: dict, value, *, size, footprint, edge, valid_neighbor, minimum, split=True, ddof=None, units="same", dtype=None) -> Raster:
    f = footprint_of(size, footprint)
    _checked(edge, valid_neighbor, minimum, int(f.sum()))
    table = _statistics(raster, f, edge, {"n": (F.count, F.col("v"))} | what, split)
    d = dtype or D.accumulator(raster.dtype, name)
    ok = _validity(raster, f, edge, valid_neighbor, minimum, ddof)
    # A neighbourhood without valid cells has nothing to give, whatever the policy.
    value = value(F) if callable(value) else value
    return raster.with_table(table.select("row", "col", F.when(ok, value).alias("value"), (ok & value.isNotNull()).alias("valid")), d, units=units)


def focal_sum(raster: Raster, *, size=None, footprint=None, edge: str = "invalid", valid_neighbor: str = "require_all", min_valid_count: int | None = None, cval: float = 0.0) -> Raster:
    d = D.accumulator(raster.dtype, "sum")
    total = F.coalesce(F.col("s"), F.lit(0))
    value = D.fitted(total, d, "wrap") if D.is_int(d) else total
    return _focal(raster, "sum", {"s": (F.sum, _wide(F.col("v"), raster.dtype))}, value, size=size, footprint=footprint, edge=edge, valid_neighbor=valid_neighbor, minimum=min_valid_count)


def focal_mean(raster: Raster, *, size=None, footprint=None, edge: str = "invalid", valid_neighbor: str = "require_all", min_valid_count: int | None = None, cval: float = 0.0) -> Raster:
    return _focal(raster, "mean", {"s": (F.sum, _wide(F.col("v"), raster.dtype))}, F.try_divide(F.col("s").cast("double"), F.col("n").cast("double")), size=size, footprint=footprint, edge=edge, valid_neighbor=valid_neighbor, minimum=min_valid_count)


def focal_min(raster: Raster, *, size=None, footprint=None, edge: str = "invalid", valid_neighbor: str = "require_all", min_valid_count: int | None = None, cval: float = 0.0) -> Raster:
    return _focal(raster, "min", {"s": (F.min, F.col("v"))}, F.col("s"), size=size, footprint=footprint, edge=edge, valid_neighbor=valid_neighbor, minimum=min_valid_count)


def focal_max(raster: Raster, *, size=None, footprint=None, edge: str = "invalid", valid_neighbor: str = "require_all", min_valid_count: int | None = None, cval: float = 0.0) -> Raster:
    return _focal(raster, "max", {"s": (F.max, F.col("v"))}, F.col("s"), size=size, footprint=footprint, edge=edge, valid_neighbor=valid_neighbor, minimum=min_valid_count)


def focal_range(raster: Raster, *, size=None, footprint=None, edge: str = "invalid", valid_neighbor: str = "require_all", min_valid_count: int | None = None, cval: float = 0.0) -> Raster:
    v = _wide(F.col("v"), raster.dtype)
    return _focal(raster, "range", {"lo": (F.min, v), "hi": (F.max, v)}, F.col("hi") - F.col("lo"), size=size, footprint=footprint, edge=edge, valid_neighbor=valid_neighbor, minimum=min_valid_count)


def focal_std(raster: Raster, *, size=None, footprint=None, edge: str = "invalid", valid_neighbor: str = "require_all", min_valid_count: int | None = None, cval: float = 0.0, ddof: int = 0) -> Raster:
    """Integers from exact sums of squares; floats from a stable variance."""
    if ddof < 0 or int(ddof) != ddof:
        raise OperationError("ddof is a non-negative integer.", code="invalid_ddof")
    n = F.col("n").cast("double")
    common = {"size": size, "footprint": footprint, "edge": edge, "valid_neighbor": valid_neighbor, "minimum": min_valid_count, "ddof": int(ddof)}
    if D.is_float(raster.dtype):
        return _focal(raster, "std", {"p": (F.var_pop, F.col("v").cast("double"))}, F.sqrt(F.try_divide(F.col("p") * n, n - F.lit(float(ddof)))), split=False, **common)
    v = _wide(F.col("v"), raster.dtype).cast("decimal(18,0)")
    exact = F.col("n").cast("decimal(10,0)") * F.col("q") - F.col("s") * F.col("s")
    return _focal(raster, "std", {"s": (F.sum, v), "q": (F.sum, v * v)}, F.sqrt(F.try_divide(exact.cast("double"), n * (n - F.lit(float(ddof))))), **common)


def focal_count(raster: Raster, *, size=None, footprint=None, edge: str = "invalid", valid_neighbor: str = "ignore_invalid", min_valid_count: int | None = None, cval: float = 0.0) -> Raster:
    """Valid neighbours; by default every cell is valid, but for the rim of invalid edges."""
    f = footprint_of(size, footprint)
    _checked(edge, valid_neighbor, min_valid_count, int(f.sum()))
    table = _statistics(raster, f, edge, {"n": (F.count, F.col("v"))}, True)
    if valid_neighbor == "ignore_invalid" and min_valid_count is None:
        ok = ~rim(raster.grid, f.shape[0] // 2, f.shape[1] // 2) if edge == "invalid" else F.lit(True)
    else:
        ok = _validity(raster, f, edge, valid_neighbor, min_valid_count)
    return raster.with_table(table.select("row", "col", F.coalesce("n", F.lit(0)).alias("value"), ok.alias("valid")), "int64", units=None)


def focal_median(raster: Raster, *, size=None, footprint=None, edge: str = "invalid", valid_neighbor: str = "require_all", min_valid_count: int | None = None, cval: float = 0.0) -> Raster:
    v = F.col("v").cast("int") if raster.dtype == "bool" else F.col("v")
    return _focal(raster, "median", {"s": (F.median, v)}, F.col("s"), size=size, footprint=footprint, edge=edge, valid_neighbor=valid_neighbor, minimum=min_valid_count, split=False)


def convolve(raster: Raster, kernel, *, normalize: bool = False, edge: str = "invalid", valid_neighbor: str = "require_all", min_valid_count: int | None = None, cval: float = 0.0) -> Raster:
    """True convolution (the kernel is turned by 180 degrees); invalid cells add nothing and weights are not rescaled."""
    k = np.asarray(kernel, np.float64)
    if k.ndim != 2 or k.shape[0] % 2 != 1 or k.shape[1] % 2 != 1 or not np.isfinite(k).all():
        raise OperationError("A kernel is two-dimensional, odd on both sides and finite.", code="invalid_kernel")
    f = np.ones(k.shape, bool)
    _checked(edge, valid_neighbor, min_valid_count, f.size)
    if normalize:
        total = np.abs(k).sum()
        if total == 0:
            raise OperationError("The kernel has no weight.", code="invalid_kernel")
        k = k / total
    g, (hh, hw) = raster.grid, (k.shape[0] // 2, k.shape[1] // 2)
    cells = raster.cells().withColumn("v", F.when(F.col("valid"), F.col("value")))
    around = padded(cells, g.height, g.width, hh, hw, edge).select("row", "col", "v")
    offsets = [(hh - i, hw - j, k[i, j]) for i in range(k.shape[0]) for j in range(k.shape[1])]
    v = F.coalesce((F.col("v").cast("int") if raster.dtype == "bool" else F.col("v")).cast("double"), F.lit(0.0))
    sums = seen(around, offsets, g.height, g.width).groupBy("row", "col").agg(F.sum(v * F.col("_o.w")).alias("s"), F.count("v").alias("n"))
    table = cells.drop("v").join(sums, ["row", "col"], "left")
    if valid_neighbor == "ignore_invalid" and min_valid_count is None:
        ok = ~rim(g, hh, hw) if edge == "invalid" else F.lit(True)
    else:
        ok = _validity(raster, f, edge, valid_neighbor, min_valid_count)
    return raster.with_table(table.select("row", "col", F.coalesce("s", F.lit(0.0)).alias("value"), ok.alias("valid")), "float32" if raster.dtype == "float32" else "float64")


# Morphology


def _mask(raster: Raster) -> DataFrame:
    if raster.dtype != "bool":
        raise DTypeError("A Boolean raster is needed.", code="requires_boolean", details={"dtype": raster.dtype})
    return raster.cells().withColumn("v", (F.col("valid") & F.col("value")).cast("int"))


def _morph(raster: Raster, f: np.ndarray, erode_: bool) -> Raster:
    g, cells = raster.grid, _mask(raster)
    n = int(f.sum())
    if f.all():
        table = separable(cells, f.shape[0] // 2, f.shape[1] // 2, s=(F.sum, F.col("v")))
    else:
        offsets = _offsets(f) if erode_ else [(-r, -c) for r, c in _offsets(f)]
        table = cells.join(seen(cells.select("row", "col", "v"), offsets, g.height, g.width).groupBy("row", "col").agg(F.sum("v").alias("s")), ["row", "col"], "left")
    value = F.coalesce(F.col("s"), F.lit(0)) == n if erode_ else F.coalesce(F.col("s"), F.lit(0)) > 0
    return raster.with_table(table.select("row", "col", value.alias("value"), "valid"), "bool")


def _structure(size, footprint, structure) -> np.ndarray:
    return footprint_of(size, footprint) if structure is None else footprint_of(None, structure)


def dilate(raster: Raster, *, size=None, footprint=None, structure=None) -> Raster:
    return _morph(raster, _structure(size, footprint, structure), False)


def erode(raster: Raster, *, size=None, footprint=None, structure=None) -> Raster:
    """What lies outside the grid counts as false, so rims erode."""
    return _morph(raster, _structure(size, footprint, structure), True)


def opening(raster: Raster, *, size=None, footprint=None, structure=None) -> Raster:
    f = _structure(size, footprint, structure)
    return _morph(_morph(raster, f, True), f, False)


def closing(raster: Raster, *, size=None, footprint=None, structure=None) -> Raster:
    f = _structure(size, footprint, structure)
    return _morph(_morph(raster, f, False), f, True)


def majority(raster: Raster, *, size=None, footprint=None) -> Raster:
    """True where more than half of the neighbourhood is, rims mirrored with the edge repeated."""
    f = footprint_of(size, footprint)
    g, cells = raster.grid, _mask(raster)
    around = padded(cells, g.height, g.width, f.shape[0] // 2, f.shape[1] // 2, "symmetric")
    sums = seen(around.select("row", "col", "v"), _offsets(f), g.height, g.width).groupBy("row", "col").agg(F.sum("v").alias("s"))
    return raster.with_table(cells.join(sums, ["row", "col"], "left").select("row", "col", (F.col("s") * 2 > int(f.sum())).alias("value"), "valid"), "bool")
