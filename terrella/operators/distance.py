"""Distance fields, exact in two passes.

First each column finds the nearest seed above and below by window functions. Then each row takes the least over its
columns: taxicab by two more window functions, squared Euclidean distances by a lower envelope of parabolas and
chessboard distances by an outward search, a row at a time in Arrow. Work is linear in the cells, whatever the number of seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrella.errors import DTypeError, OperationError
from terrella.raster import Raster

#: Seeds up to which a sheared grid is measured against all of them; such grids have no separable form.
SHEARED_SEEDS = 200_000


def _column_pass(seeds: DataFrame) -> DataFrame:
    """row, col and gap: rows to the nearest seed of the column, NULL where it has none. seeds: row, col, seed."""
    at = F.when(F.col("seed"), F.col("row"))
    w = Window.partitionBy("col").orderBy("row")
    up = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return seeds.select("row", "col", F.least(F.col("row") - up, down - F.col("row")).alias("gap"))


def envelope(gap2: np.ndarray, x: np.ndarray, step2: float = 1.0) -> np.ndarray:
    """min over j of step2 * (x_i - x_j)**2 + gap2_j, with inf where there is no seed."""
    have = np.flatnonzero(np.isfinite(gap2))
    if not len(have):
        return np.full(len(x), np.inf)
    f, at = gap2[have].tolist(), x[have].astype(float).tolist()
    hull, starts = [0], [-np.inf]
    for j in range(1, len(at)):
        while True:
            i = hull[-1]
            s = ((f[j] + step2 * at[j] ** 2) - (f[i] + step2 * at[i] ** 2)) / (2 * step2 * (at[j] - at[i]))
            if s > starts[-1] or len(hull) == 1:
                break
            hull.pop()
            starts.pop()
        if s > starts[-1]:
            hull.append(j)
            starts.append(s)
        else:
            hull[-1] = j
    k = np.array(hull)[np.maximum(np.searchsorted(np.array(starts), x.astype(float), side="right") - 1, 0)]
    return step2 * (x - np.array(at)[k]) ** 2 + np.array(f)[k]


def chessboard(gap: np.ndarray, x: np.ndarray) -> np.ndarray:
    """min over j of max(|x_i - x_j|, gap_j); the search widens only while it can still gain."""
    best = gap.copy()
    n, step = len(x), 1
    while step < n and (best > step).any():
        best[step:] = np.minimum(best[step:], np.maximum(gap[:-step], step))
        best[:-step] = np.minimum(best[:-step], np.maximum(gap[step:], step))
        step += 1
    return best


def _rows(gaps: DataFrame, f) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["col"].to_numpy())
        group = group.take(pa.array(order))
        gap = group["gap"].to_numpy(zero_copy_only=False).astype(float)
        return pa.table({"row": group["row"], "col": group["col"], "d": pa.array(f(np.where(np.isnan(gap), np.inf, gap), group["col"].to_numpy()))})

    return gaps.groupBy("row").applyInArrow(run, "row int, col int, d double")


def distances(seeds: DataFrame, grid, metric: str, units: str) -> DataFrame:
    """row, col and d (infinite where there is no seed) for a table row, col, seed."""
    if metric not in ("euclidean", "taxicab", "chessboard") or units not in ("pixels", "physical"):
        raise OperationError("Unknown metric or units.", code="invalid_metric", details={"metric": metric, "units": units})
    if units == "physical":
        if metric != "euclidean":
            raise OperationError("Physical units go with the Euclidean metric.", code="physical_requires_euclidean")
        _, a, b, _, d, e = grid.affine
        if abs(a * b + d * e) > 1e-12 * max(abs(a * e), abs(b * d)):
            return _sheared(seeds, grid)
        across, down = grid.pixel_size
        return _rows(_column_pass(seeds), lambda g, x: np.sqrt(envelope((g * down) ** 2, x, across**2)))
    gaps = _column_pass(seeds)
    if metric == "euclidean":
        return _rows(gaps, lambda g, x: np.sqrt(envelope(g**2, x)))
    if metric == "chessboard":
        return _rows(gaps, chessboard)
    w = Window.partitionBy("row").orderBy("col")
    left = F.min(F.col("gap") - F.col("col")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("col")
    right = F.min(F.col("gap") + F.col("col")).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("col")
    return gaps.select("row", "col", F.coalesce(F.least(left, right).cast("double"), F.lit(float("inf"))).alias("d"))


def _sheared(seeds: DataFrame, grid) -> DataFrame:
    points = seeds.filter("seed").select("row", "col").limit(SHEARED_SEEDS + 1).toArrow()
    if points.num_rows > SHEARED_SEEDS:
        raise OperationError("A sheared grid is measured against a bounded number of seeds.", code="too_many_seeds", details={"limit": SHEARED_SEEDS})
    _, a, b, _, d, e = grid.affine
    r, c = points["row"].to_numpy().astype(float), points["col"].to_numpy().astype(float)
    sx, sy = c * a + r * b, c * d + r * e

    def run(batches):
        for batch in batches:
            row, col = (batch.column(i).to_numpy().astype(float) for i in (0, 1))
            x, y = col * a + row * b, col * d + row * e
            best = np.full(len(x), np.inf)
            for at in range(0, len(sx), 512):
                best = np.minimum(best, ((x[:, None] - sx[None, at : at + 512]) ** 2 + (y[:, None] - sy[None, at : at + 512]) ** 2).min(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(best))], ["row", "col", "d"])

    return seeds.select("row", "col").mapInArrow(run, "row int, col int, d double")


def _options(invalid_output: str, max_distance: float | None) -> None:
    if invalid_output not in ("preserve", "compute"):
        raise OperationError("invalid_output is preserve or compute.", code="invalid_invalid_output")
    if max_distance is not None and not max_distance > 0:
        raise OperationError("max_distance must be positive.", code="invalid_max_distance")


def _boolean(raster: Raster) -> DataFrame:
    if raster.dtype != "bool":
        raise DTypeError("A Boolean raster is needed.", code="requires_boolean", details={"dtype": raster.dtype})
    return raster.cells()


def distance_to(seeds: Raster, *, metric: str = "euclidean", units: str = "pixels", max_distance: float | None = None, invalid_output: str = "preserve") -> Raster:
    """Distance to the nearest valid true cell; invalid cells are neither seeds nor barriers."""
    _options(invalid_output, max_distance)
    cells = _boolean(seeds)
    if not cells.filter(F.col("valid") & F.col("value")).limit(1).count():
        raise OperationError("There is no valid true cell.", code="no_seeds")
    d = distances(cells.select("row", "col", (F.col("valid") & F.col("value")).alias("seed")), seeds.grid, metric, units)
    value = F.col("d") if max_distance is None else F.least(F.col("d"), F.lit(float(max_distance)))
    valid = F.col("valid") if invalid_output == "preserve" else F.lit(True)
    out = cells.join(d, ["row", "col"]).select("row", "col", value.alias("value"), valid.alias("valid"))
    return seeds.with_table(out, "float64" if units == "physical" else "float32", units="pixels" if units == "pixels" else "metres")


def signed_distance(mask: Raster, *, metric: str = "euclidean", units: str = "pixels", max_distance: float | None = None, invalid_output: str = "preserve") -> Raster:
    """True cells: distance to the nearest false one; false cells: minus the distance to the nearest true one."""
    _options(invalid_output, max_distance)
    cells = _boolean(mask)
    there = cells.agg(F.coalesce(F.bool_or(F.col("valid") & F.col("value")), F.lit(False)).alias("t"), F.coalesce(F.bool_or(F.col("valid") & ~F.col("value")), F.lit(False)).alias("f")).first()
    if not there["t"] or not there["f"]:
        raise OperationError("Both classes need a valid cell.", code="no_valid_true" if not there["t"] else "no_valid_false")
    sides = []
    for name, test in (("dt", F.col("value")), ("df", ~F.col("value"))):
        d = distances(cells.select("row", "col", (F.col("valid") & test).alias("seed")), mask.grid, metric, units)
        value = F.col("d") if max_distance is None else F.least(F.col("d"), F.lit(float(max_distance)))
        sides.append(d.select("row", "col", value.alias(name)))
    both = cells.join(sides[0], ["row", "col"]).join(sides[1], ["row", "col"])
    valid = F.col("valid") if invalid_output == "preserve" else F.lit(True)
    out = both.select("row", "col", F.when(F.col("value"), F.col("df")).otherwise(-F.col("dt")).alias("value"), valid.alias("valid"))
    return mask.with_table(out, "float64" if units == "physical" else "float32", units="pixels" if units == "pixels" else "metres")
