"""Connected regions of Boolean rasters.

Cells are grouped into square tiles and labelled inside a tile in Arrow batches; labels that meet at a seam are joined by
connected components over seam pairs only. Iterations follow the chain of tiles that a region crosses, not its cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.errors import DTypeError, OperationError
from terrella.operators.focal import dilate, erode
from terrella.operators.graph import components, numbered
from terrella.raster import Raster
from terrella.sources.scratch import written

TILE = 256


def structure_of(connectivity: int) -> np.ndarray:
    if connectivity not in (4, 8):
        raise OperationError("connectivity is 4 or 8.", code="invalid_connectivity", details={"connectivity": connectivity})
    return np.ones((3, 3), bool) if connectivity == 8 else np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)


def clean(mask: Raster, cleanup: str, iterations: int, connectivity: int) -> Raster:
    """none, erosion or opening, so many times (opening: that many erosions, then as many dilations)."""
    if cleanup not in ("none", "erosion", "opening") or iterations < 0:
        raise OperationError("Unknown cleanup.", code="invalid_cleanup", details={"cleanup": cleanup, "iterations": iterations})
    s = structure_of(connectivity)
    if cleanup == "none":
        return mask
    for _ in range(iterations):
        mask = erode(mask, structure=s)
    if cleanup == "opening":
        for _ in range(iterations):
            mask = dilate(mask, structure=s)
    return mask


def _true_cells(mask: Raster) -> DataFrame:
    if mask.dtype != "bool":
        raise DTypeError("A Boolean raster is needed.", code="requires_boolean", details={"dtype": mask.dtype})
    return mask.cells().filter(F.col("valid") & F.col("value")).select("row", "col")


def local_labels(row: np.ndarray, col: np.ndarray, eight: bool) -> np.ndarray:
    """For each of the cells, the place of the first cell (in raster order of the input) of its region."""
    n = len(row)
    order = np.lexsort((col, row))
    row, col = row[order].astype(np.int64), col[order].astype(np.int64)
    wide = int(col.max() - col.min()) + 3 if n else 3
    key = row * wide + (col - (col.min() if n else 0) + 1)
    label = np.arange(n)
    pairs = []
    for step in (1, wide, *((wide - 1, wide + 1) if eight else ())):
        at = np.minimum(np.searchsorted(key, key + step), max(n - 1, 0))
        hit = key[at] == key + step if n else np.array([], bool)
        pairs.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(more := label[label], label):
            label = more
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def region_ids(mask: Raster, connectivity: int = 8, *, tile: int = TILE) -> DataFrame:
    """row, col and region (the least row * width + col of it) of every true cell."""
    structure_of(connectivity)
    width, eight = mask.grid.width, connectivity == 8

    def label(group: pa.Table) -> pa.Table:
        row, col = group["row"].to_numpy(), group["col"].to_numpy()
        first = local_labels(row, col, eight)
        return pa.table({"row": group["row"], "col": group["col"], "part": pa.array(row[first].astype(np.int64) * width + col[first])})

    tiled = _true_cells(mask).groupBy(F.expr(f"row div {tile}").alias("_tr"), F.expr(f"col div {tile}").alias("_tc"))
    parts = written(tiled.applyInArrow(label, "row int, col int, part long"), "region-parts")
    rim = parts.filter(f"row % {tile} IN (0, {tile - 1}) OR col % {tile} IN (0, {tile - 1})")
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    there = rim.select("row", "col", F.col("part").alias("a")).withColumn("_s", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps))))
    there = there.select((F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), "a")
    seams = there.join(rim.select("row", "col", F.col("part").alias("b")), ["row", "col"]).filter("a <> b").select("a", "b").distinct()
    roots = components(seams)
    return parts.join(roots, parts.part == roots.node, "left").select("row", "col", F.coalesce("root", "part").alias("region"))


def _over_grid(mask: Raster, found: DataFrame, column: str, dtype: str, units: str | None = None) -> Raster:
    cells = mask.cells().select("row", "col", "valid").join(found, ["row", "col"], "left")
    zero = F.lit(False) if dtype == "bool" else F.lit(0)
    return mask.with_table(cells.select("row", "col", F.coalesce(column, zero).alias("value"), "valid"), dtype, units=units)


def label_regions(mask: Raster, *, cleanup: str = "none", iterations: int = 0, connectivity: int = 8, tile: int = TILE) -> Raster:
    """Labels 1, 2, .. in raster order of first cells; 0 elsewhere."""
    cells = written(region_ids(clean(mask, cleanup, iterations, connectivity), connectivity, tile=tile), "regions")
    labels = numbered(cells.select("region").distinct(), "region", "label")
    return _over_grid(mask, cells.join(labels, "region").select("row", "col", F.col("label").cast("int").alias("label")), "label", "int32")


def region_sizes(mask: Raster, *, cleanup: str = "none", iterations: int = 0, connectivity: int = 8, tile: int = TILE) -> Raster:
    cells = written(region_ids(clean(mask, cleanup, iterations, connectivity), connectivity, tile=tile), "regions")
    sizes = cells.groupBy("region").agg(F.count("*").alias("size"))
    return _over_grid(mask, cells.join(sizes, "region").select("row", "col", "size"), "size", "int64", "pixels")


def filter_regions_by_size(mask: Raster, *, threshold: int, comparator: str = ">=", cleanup: str = "none", iterations: int = 0, connectivity: int = 8, tile: int = TILE) -> Raster:
    """Regions that hold a seed (a region of the cleaned mask) whose size passes; shapes are the original ones."""
    if comparator not in (">=", "<="):
        raise OperationError("comparator is '>=' or '<='.", code="invalid_comparator")
    original = written(region_ids(mask, connectivity, tile=tile), "regions")
    seeds = original if cleanup == "none" or not iterations else written(region_ids(clean(mask, cleanup, iterations, connectivity), connectivity, tile=tile), "seeds")
    passing = seeds.groupBy("region").agg(F.count("*").alias("n")).filter(f"n {comparator} {int(threshold)}").select("region")
    kept = seeds.join(passing, "region", "left_semi").select("row", "col").join(original, ["row", "col"]).select("region").distinct()
    return _over_grid(mask, original.join(kept, "region", "left_semi").select("row", "col", F.lit(True).alias("kept")), "kept", "bool")


def find_borders(mask: Raster, *, connectivity: int = 8) -> Raster:
    """True cells that erosion takes away; outside the grid counts as false."""
    inner = erode(mask, structure=structure_of(connectivity))
    cells = mask.cells().join(inner.cells().select("row", "col", F.col("value").alias("inner")), ["row", "col"])
    return mask.with_table(cells.select("row", "col", (F.col("valid") & F.col("value") & ~F.col("inner")).alias("value"), "valid"), "bool", units=None)
