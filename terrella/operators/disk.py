"""The visible part of the Sun's disk for many cells and times, in Arrow batches.

The slices of the disk are only summed where the horizon cuts through it: where even the highest (lowest) horizon near the Sun leaves
the whole disk visible (hidden), the answer is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.functions import sky
from terrella.grid import Grid

HEIGHTS = np.sqrt(64 - (7.5 - np.arange(sky.SLICES)) ** 2) / 8 * sky.SUN_HALF_ANGLE


def fractions(horizon: np.ndarray, azimuth: np.ndarray, elevation: np.ndarray) -> np.ndarray:
    """Visible parts for the times of one cell; horizon: degrees by azimuth bin."""
    bins = len(horizon)
    ring = np.concatenate([horizon, horizon[:6]]).astype(np.float64)
    start = (azimuth - (sky.SUN_HALF_ANGLE + sky.BUCKET_HALF_WIDTH)) * (bins / 360.0)
    first = np.trunc(start)
    rest = start - first
    base = first.astype(np.int64)
    base[base < 0] += bins
    step = 2 * sky.SUN_HALF_ANGLE / sky.SLICES * bins / 360.0
    out = np.zeros(len(azimuth))
    width = int(np.ceil(1 + step * sky.SLICES)) + 1
    if width <= 6:
        high, low = ring[:bins].copy(), ring[:bins].copy()
        for k in range(1, width):
            np.maximum(high, ring[k : bins + k], out=high)
            np.minimum(low, ring[k : bins + k], out=low)
        whole = (elevation - high[base] >= sky.SUN_HALF_ANGLE) & (rest >= 0)
        out[whole] = 1.0
        cut = np.flatnonzero(~whole & ((elevation - low[base] > -sky.SUN_HALF_ANGLE) | (rest < 0)))
    else:
        cut = np.arange(len(azimuth))
        ring = np.concatenate([horizon] * (2 + width // bins)).astype(np.float64)
    for at in range(0, len(cut), 8_192):
        some = cut[at : at + 8_192]
        # Slices by times: few, larger array operations.
        q = rest[some][None, :] + np.arange(sky.SLICES)[:, None] * step
        k = np.maximum(np.floor(q), 0).astype(np.int64)
        i = base[some][None, :] + k
        left = ring[i]
        shown = elevation[some][None, :] + HEIGHTS[:, None] - (left + (q - k) * (ring[i + 1] - left))
        out[some] = np.minimum(np.maximum(shown, 0.0), 2 * HEIGHTS[:, None]).sum(0) / (2 * HEIGHTS.sum())
    return out


def per_cell(cells: DataFrame, bodies: list[DataFrame], grid: Grid, function, schema: str, *, rows: int = 256) -> DataFrame:
    """Rows that a function makes of each cell's whole time series, without the series ever leaving its task.

    bodies: bounded tables of vectors (ts, x, y, z) with one time axis. The function takes row, col, the horizon and, for each body, arrays of
    azimuth and elevation, and gives a tuple of the schema's values; results of `rows` cells make one Arrow batch.
    """
    ways = []
    for body in bodies:
        t = body.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "x", "y", "z").orderBy("us").toArrow()
        ways.append(np.stack([t[c].to_numpy() for c in "xyz"]))
    frame = sky.frame(grid, F.col("row"), F.col("col"), F.col("elevation"))
    framed = cells.select("row", "col", "horizon", *(frame[a + b].alias(f"_{a}{b}") for a in "enup" for b in "xyz"))
    types = [(f.name, _arrow(f.dataType.simpleString())) for f in _parsed(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            numbers = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(12)])
            row, col = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, rows):
                out = []
                for i in range(at, min(batch.num_rows, at + rows)):
                    m = numbers[:, i].reshape(4, 3)
                    out += function(row[i], col[i], flat[offsets[i] : offsets[i + 1]], *(look(m, w) for w in ways))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, (_, kind) in enumerate(types)], [n for n, _ in types])

    return framed.mapInArrow(run, schema)


def _parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary()}[kind]


def look(m: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Azimuth and elevation in degrees of vectors seen in a frame (rows east, north, up, place)."""
    east, north, up = m[:3] @ way - (m[:3] @ m[3])[:, None]
    azimuth = np.degrees(np.arctan2(east, north))
    azimuth[azimuth < 0] += 360.0
    return azimuth, np.degrees(np.arctan2(up, np.sqrt(east * east + north * north)))


def margins(horizon: np.ndarray, azimuth: np.ndarray, elevation: np.ndarray) -> np.ndarray:
    """Elevations over the horizon, interpolated around the circle."""
    bins = len(horizon)
    place = azimuth * (bins / 360.0)
    low = np.floor(place)
    ring = np.append(horizon, horizon[:2]).astype(np.float64)
    i = low.astype(np.int64) % bins
    return elevation - (ring[i] + (place - low) * (ring[i + 1] - ring[i]))


def time_left(condition: np.ndarray, hours: np.ndarray) -> np.ndarray:
    """Hours that the condition holds from each sample on; 0 where it does not."""
    n = len(condition)
    until = np.minimum.accumulate(np.where(condition, n, np.arange(n))[::-1])[::-1]
    total = np.concatenate([[0.0], np.cumsum(hours)])
    return np.where(condition, total[until] - total[:-1], 0.0)


def run_lengths(condition: np.ndarray) -> np.ndarray:
    """For each sample the length of the run of the condition that it lies in; 0 where it does not hold."""
    run = np.cumsum(~condition)
    return np.where(condition, np.bincount(run, weights=condition, minlength=len(run) + 1)[run], 0).astype(np.int64)


def visible(cells: DataFrame, vectors: DataFrame, grid: Grid) -> DataFrame:
    """ts, row, col and value (float) for cells (row, col, elevation, horizon) and a bounded table of vectors (ts, x, y, z)."""
    t = vectors.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "x", "y", "z").orderBy("us").toArrow()
    us, way = t["us"].to_numpy(), np.stack([t[c].to_numpy() for c in "xyz"])
    frame = sky.frame(grid, F.col("row"), F.col("col"), F.col("elevation"))
    axes = [a + b for a in "enup" for b in "xyz"]
    framed = cells.select("row", "col", "horizon", *(frame[a].alias(f"_{a}") for a in axes))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = pa.array(us, pa.timestamp("us", "UTC"))
        for batch in rows:
            lists = batch.column(2)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            numbers = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(12)])
            row, col = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            many = max(1, 200_000 // max(1, len(us)))
            for at in range(0, batch.num_rows, many):
                values, stop = [], min(batch.num_rows, at + many)
                for i in range(at, stop):
                    m = numbers[:, i].reshape(4, 3)
                    values.append(fractions(flat[offsets[i] : offsets[i + 1]], *look(m, way)).astype(np.float32))
                n = stop - at
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([times] * n), pa.array(np.repeat(row[at:stop], len(us))), pa.array(np.repeat(col[at:stop], len(us))), pa.array(np.concatenate(values))], ["ts", "row", "col", "value"])

    return framed.mapInArrow(run, "ts timestamp, row int, col int, value float")
