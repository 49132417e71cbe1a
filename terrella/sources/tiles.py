"""Horizon tiles: 128 x 128 cells of 1,440 elevations, raw floats or blocks of coded differences.

A coded block is a 16-bit start (high byte first) and differences of one or two bytes; each block is preceded by its length
(low byte first). Encoding and decoding work on all cells of a tile side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.errors import StorageError

#: Fixed values of the tile format.
PATCH, AZIMUTHS, LIMIT_DEGREES, LIMIT = 128, 1440, 50.0, 32767
DELTA_LOW, DELTA_HIGH, SHORT_LOW, SHORT_HIGH = -16384, 16383, -64, 62
RAW_BYTES, RAW_TRAILER = PATCH * PATCH * AZIMUTHS * 4, 28


def quantise(degrees: np.ndarray) -> np.ndarray:
    """Whole steps of 50 / 32767 degrees, halves away from zero."""
    scaled = (np.clip(degrees.astype(np.float32), -LIMIT_DEGREES, LIMIT_DEGREES) * (np.float32(LIMIT) / np.float32(LIMIT_DEGREES))).astype(np.float64)
    return np.clip(np.sign(scaled) * np.floor(np.abs(scaled) + 0.5), -LIMIT, LIMIT).astype(np.int64)


def _differences(q: np.ndarray) -> np.ndarray:
    """What is added at each sample; a step too large for two bytes is cut, and made up for by the next ones."""
    d = np.diff(q, axis=1)
    for i in np.flatnonzero(((d < DELTA_LOW) | (d > DELTA_HIGH)).any(1)):
        at = int(q[i, 0])
        for j, goal in enumerate(q[i, 1:].tolist()):
            d[i, j] = min(DELTA_HIGH, max(DELTA_LOW, goal - at))
            at += int(d[i, j])
    return d


def encode(degrees: np.ndarray) -> list[bytes]:
    """One block for each row of horizons, without its length."""
    q = quantise(degrees)
    d = _differences(q)
    short = (d >= SHORT_LOW) & (d <= SHORT_HIGH)
    sizes = np.where(short, 1, 2)
    ends = np.cumsum(sizes, axis=1) + 2
    out = np.zeros((len(q), int(ends[:, -1].max()) if len(q) else 0), np.uint8)
    out[:, 0], out[:, 1] = (q[:, 0] >> 8) & 255, q[:, 0] & 255
    rows = np.broadcast_to(np.arange(len(q))[:, None], d.shape)
    place = ends - sizes
    out[rows[short], place[short]] = d[short] & 127
    out[rows[~short], place[~short]] = ((d[~short] >> 8) & 255) | 128
    out[rows[~short], place[~short] + 1] = d[~short] & 255
    return [out[i, : ends[i, -1]].tobytes() for i in range(len(q))]


def _wrapped(x: np.ndarray) -> np.ndarray:
    return (x + 32768) % 65536 - 32768


def decode(blocks: list[bytes], azimuths: int = AZIMUTHS) -> np.ndarray:
    """Degrees of each block; anything but exactly one horizon a block is an error."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    if (sizes < 2).any() or (sizes > 2 * azimuths).any():
        raise StorageError("A block length is invalid.", code="invalid_horizon_block")
    data = np.zeros((len(blocks), int(sizes.max(initial=2)) + 2), np.int64)
    for i, b in enumerate(blocks):
        data[i, : len(b)] = np.frombuffer(b, np.uint8)
    rows = np.arange(len(blocks))
    steps = np.zeros((len(blocks), azimuths), np.int64)
    steps[:, 0] = _wrapped(data[:, 0] << 8 | data[:, 1])
    at = np.full(len(blocks), 2)
    for j in range(1, azimuths):
        first = data[rows, np.minimum(at, data.shape[1] - 2)]
        long = first >= 128
        two = _wrapped(((((first << 1) & 128) | (first & 127)) << 8) | data[rows, np.minimum(at + 1, data.shape[1] - 1)])
        one = np.where(first & 64, first - 128, first)
        steps[:, j] = np.where(long, two, one)
        at = at + 1 + long
    if (at != sizes).any():
        raise StorageError("A block does not hold one horizon.", code="invalid_horizon_block")
    return (_wrapped(np.cumsum(steps, axis=1)).astype(np.float32) * (np.float32(LIMIT_DEGREES) / np.float32(LIMIT))).astype(np.float32)


def decode_tile(data: bytes, compressed: bool) -> np.ndarray:
    """(cells, azimuths) of a whole tile."""
    if not compressed:
        if len(data) not in (RAW_BYTES, RAW_BYTES + RAW_TRAILER):
            raise StorageError("The size of a raw tile is wrong.", code="invalid_horizon_tile")
        return np.frombuffer(data, "<f4", PATCH * PATCH * AZIMUTHS).reshape(-1, AZIMUTHS)
    blocks, at = [], 0
    for _ in range(PATCH * PATCH):
        if at + 2 > len(data):
            raise StorageError("The tile ends early.", code="invalid_horizon_tile")
        n = data[at] | data[at + 1] << 8
        blocks.append(data[at + 2 : at + 2 + n])
        at += 2 + n
    if at != len(data):
        raise StorageError("Bytes are left over.", code="invalid_horizon_tile")
    return decode(blocks)


def encode_tile(degrees: np.ndarray) -> bytes:
    return b"".join(len(b).to_bytes(2, "little") + b for b in encode(degrees))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """row, col and horizon of every tile file under a folder named <tile_y>_<tile_x>[..].bin or .cbin (in cells)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*bin").load(path)
    named = files.select(F.regexp_extract("path", r"(\d+)_(\d+)[^/]*$", 1).cast("int").alias("y"), F.regexp_extract("path", r"(\d+)_(\d+)[^/]*$", 2).cast("int").alias("x"), F.col("path").endswith(".cbin").alias("packed"), "content")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for y, x, packed, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                degrees = decode_tile(content, packed)
                for r in range(0, PATCH, 8):
                    part = degrees[r * PATCH : (r + 8) * PATCH]
                    i = np.arange(len(part), dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, AZIMUTHS, dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(y + r + i // PATCH), pa.array(x + i % PATCH), lists], ["row", "col", "horizon"])

    return named.mapInArrow(run, "row int, col int, horizon array<float>")


def write_store(horizons: DataFrame, path: str, *, observer_decimeters: int = 0, mode: str = "append") -> None:
    """Horizons as Parquet, one partition a tile and observer height."""
    tiled = horizons.withColumn("observer_dm", F.lit(observer_decimeters)).withColumn("tile_y", F.expr(f"row div {PATCH}")).withColumn("tile_x", F.expr(f"col div {PATCH}"))
    tiled.repartition("tile_y", "tile_x").write.mode(mode).partitionBy("observer_dm", "tile_y", "tile_x").parquet(path)


def read_store(spark: SparkSession, path: str, *, observer_decimeters: int = 0) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("observer_dm") == observer_decimeters).select("row", "col", "horizon")


def horizon_for_pixel(spark: SparkSession, path: str, x: int, y: int, observer_decimeters: int = 0) -> list[float]:
    """One cell's horizon: filters that prune to its tile."""
    found = spark.read.parquet(path).filter((F.col("observer_dm") == observer_decimeters) & (F.col("tile_y") == y // PATCH) & (F.col("tile_x") == x // PATCH) & (F.col("row") == y) & (F.col("col") == x)).first()
    if found is None:
        raise StorageError("There is no horizon for the pixel.", code="missing_horizon", details={"x": x, "y": y})
    return found["horizon"]
