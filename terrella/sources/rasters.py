"""Stored rasters and series: Parquet cells with a metadata file beside them, and minimal TIFF files.

A raster's folder holds `cells` (tiled Parquet) and `meta` (one JSON row: grid, dtype, units, name, and the digest of the plan it came from).
Metadata is written last, so a folder without it is incomplete and never read. An interrupted write resumes: tiles that were committed are kept.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.errors import StorageError
from terrella.functions import dtypes as D
from terrella.grid import Grid
from terrella.operators.temporal import TemporalRaster, _sql, parsed
from terrella.raster import Raster, aligned

TILE = 256


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    text = json.dumps(meta, sort_keys=True)
    spark.createDataFrame([(text, hashlib.sha256(text.encode()).hexdigest())], "meta string, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/meta/_SUCCESS"):
        raise StorageError("The folder is not a complete raster.", code="incomplete_output", details={"path": path})
    r = spark.read.schema("meta string, digest string").json(f"{path}/meta").first()
    if hashlib.sha256(r["meta"].encode()).hexdigest() != r["digest"]:
        raise StorageError("The metadata does not match its digest.", code="digest_mismatch", details={"path": path})
    return json.loads(r["meta"])


def _tiled(cells: DataFrame) -> DataFrame:
    return cells.withColumn("tile_row", F.expr(f"row div {TILE}")).withColumn("tile_col", F.expr(f"col div {TILE}"))


def write(path: str, raster: Raster, *, dtype: str | None = None, overwrite: bool = False, resume: bool = False, identity: str | None = None) -> None:
    """Write a raster by tiles. resume: go on with an earlier write of the same identity, leaving out the tiles it committed."""
    from terrella.operators import local

    spark = raster.root.sparkSession
    identity = identity or hashlib.sha256(raster.df._jdf.queryExecution().analyzed().canonicalized().toString().encode()).hexdigest()
    if exists(spark, f"{path}/meta/_SUCCESS") and not overwrite:
        raise StorageError("The output exists.", code="output_exists", details={"path": path})
    if overwrite and not resume:
        remove(spark, path)
    raster = local.cast(raster, dtype, casting="same_kind") if dtype else raster
    cells = _tiled(raster.cells())
    if resume and exists(spark, f"{path}/cells"):
        done = spark.read.parquet(f"{path}/cells").select("tile_row", "tile_col").distinct()
        cells = cells.join(F.broadcast(done), ["tile_row", "tile_col"], "left_anti")
    cells.repartition("tile_row", "tile_col").sortWithinPartitions("row", "col").write.mode("append").partitionBy("tile_row", "tile_col").parquet(f"{path}/cells")
    _write_meta(spark, path, {"kind": "raster", "grid": raster.grid.to_dict(), "dtype": raster.dtype, "units": raster.units, "name": raster.name, "identity": identity})


def read(spark: SparkSession, path: str, *, units: str | None = None, name: str | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> Raster:
    """A stored raster; rows and cols (first, stop) prune tiles at the scan."""
    meta = read_meta(spark, path)
    df = spark.read.parquet(f"{path}/cells")
    for column, tile, window in (("row", "tile_row", rows), ("col", "tile_col", cols)):
        if window is not None:
            df = df.filter(F.col(tile).between(window[0] // TILE, (window[1] - 1) // TILE) & (F.col(column) >= window[0]) & (F.col(column) < window[1]))
    return Raster.of(df, Grid.from_dict(meta["grid"]), valid="valid", dtype=meta["dtype"], units=units or meta["units"], name=name or meta["name"], provenance="stored")


source = read


def identity_of(spark: SparkSession, path: str, *, mode: str = "stat") -> str:
    """Digest of what is stored: of names, sizes and times, or of contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/cells")
    if mode == "stat":
        rows = files.select("path", "length", "modificationTime").select(F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256).alias("h"))
    elif mode == "sha256":
        rows = files.select(F.sha2("content", 256).alias("h"))
    else:
        raise StorageError("identity is stat or sha256.", code="invalid_identity", details={"mode": mode})
    return rows.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("h"))), 256)).first()[0]


# Time series


class SeriesWriter:
    """Layers in strictly rising order, then `finalize`; `abort` drops what was staged. One Parquet partition a time."""

    def __init__(self, spark: SparkSession, path: str, grid: Grid, dtype: str, *, units: str | None = None, signal_name: str | None = None, overwrite: bool = False, progress=None):
        if exists(spark, f"{path}/meta/_SUCCESS") and not overwrite:
            raise StorageError("The output exists.", code="output_exists", details={"path": path})
        self.spark, self.path, self.staging = spark, path, f"{path.rstrip('/')}.staging"
        self.grid, self.dtype, self.units, self.name = grid, D.logical(dtype), units, signal_name
        self.last, self.layers, self.open, self.progress = None, 0, True, progress
        remove(spark, self.staging)

    def write_layer(self, time, layer) -> None:
        """layer: a raster on the grid, or an array."""
        if not self.open:
            raise StorageError("The writer is closed.", code="writer_closed")
        try:
            t = parsed(time)
            if self.last is not None and t <= self.last:
                raise StorageError("Times must rise strictly.", code="time_not_increasing", details={"time": str(time)})
            r = layer if isinstance(layer, Raster) else Raster.from_array(self.spark, layer, self.grid, dtype=self.dtype)
            self.grid.require_same(r.grid)
            if r.dtype != self.dtype:
                raise StorageError("The layer has another dtype.", code="layer_dtype_mismatch", details={"dtype": r.dtype})
            r.cells().withColumn("ts", _sql(t)).write.mode("append").partitionBy("ts").parquet(f"{self.staging}/cells")
        except Exception:
            self.abort()
            raise
        self.last, self.layers = t, self.layers + 1
        if self.progress is not None:
            self.progress({"phase": "write", "completed": self.layers})

    def finalize(self) -> None:
        if not self.open or not self.layers:
            raise StorageError("There is nothing to finish.", code="no_layers")
        _write_meta(self.spark, self.staging, {"kind": "series", "grid": self.grid.to_dict(), "dtype": self.dtype, "units": self.units, "name": self.name, "layers": self.layers})
        remove(self.spark, self.path)
        fs, old = _fs(self.spark, self.staging)
        fs.rename(old, _fs(self.spark, self.path)[1])
        self.open = False

    def abort(self) -> None:
        remove(self.spark, self.staging)
        self.open = False

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if self.open:
            self.abort() if kind else self.finalize()


def write_temporal_cube(path: str, series: TemporalRaster, *, overwrite: bool = False) -> None:
    """A whole series at once, partitioned by time."""
    spark = series.df.sparkSession
    if exists(spark, f"{path}/meta/_SUCCESS") and not overwrite:
        raise StorageError("The output exists.", code="output_exists", details={"path": path})
    remove(spark, path)
    series.df.repartition("ts").write.partitionBy("ts").parquet(f"{path}/cells")
    _write_meta(spark, path, {"kind": "series", "grid": series.grid.to_dict(), "dtype": series.dtype, "units": series.units, "name": series.name, "layers": series.axis().count()})


def open_temporal_cube(spark: SparkSession, path: str, *, validate_layers: bool = True) -> TemporalRaster:
    meta = read_meta(spark, path)
    df = spark.read.parquet(f"{path}/cells")
    if validate_layers and df.select("ts").distinct().count() != meta["layers"]:
        raise StorageError("Layers are missing.", code="missing_layers", details={"path": path})
    return TemporalRaster.of(df, Grid.from_dict(meta["grid"]), dtype=meta["dtype"], units=meta["units"], name=meta["name"])


# TIFF

#: Sample formats and bits of each dtype in a TIFF. Fixed values of the file format.
_FORMAT = {"uint8": (1, 8), "uint16": (1, 16), "uint32": (1, 32), "uint64": (1, 64), "int8": (2, 8), "int16": (2, 16), "int32": (2, 32), "int64": (2, 64), "float32": (3, 32), "float64": (3, 64)}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}


def encode_tiff(values: np.ndarray, grid: Grid) -> bytes:
    """One band, strips of 64 rows, deflated, with the georeferencing tags of axis-aligned or general grids."""
    kind, bits = _FORMAT[values.dtype.name]
    strips = [zlib.compress(np.ascontiguousarray(values[i : i + 64]).astype(values.dtype.newbyteorder("<")).tobytes()) for i in range(0, values.shape[0], 64)]
    g = grid.affine
    tags = [(256, 4, [values.shape[1]]), (257, 4, [values.shape[0]]), (258, 3, [bits]), (259, 3, [8]), (262, 3, [1]), (273, 4, None), (277, 3, [1]), (278, 4, [64]), (279, 4, [len(s) for s in strips]), (339, 3, [kind]), (34264, 12, [g[1], g[2], 0.0, g[0], g[4], g[5], 0.0, g[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    if grid.nodata is not None:
        tags.append((42113, 2, list(f"{grid.nodata}\0".encode())))
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    entries, extra, base = [], b"", at + 2 + 12 * len(tags) + 4
    for tag, kind_, v in sorted(tags):
        v = offsets if v is None else v
        data = struct.pack("<" + {2: "B", 3: "H", 4: "I", 12: "d"}[kind_] * len(v), *v)
        if len(data) <= 4:
            entries.append(struct.pack("<HHI", tag, kind_, len(v)) + data.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, kind_, len(v), base + len(extra)))
            extra += data
    return b"II*\0" + struct.pack("<I", at) + b"".join(strips) + struct.pack("<H", len(tags)) + b"".join(entries) + bytes(4) + extra


def decode_tiff(data: bytes, band: int = 1) -> tuple[np.ndarray, Grid | None]:
    """Strips or tiles, raw or deflated, one or more bands stored pixel by pixel; georeferencing where there is any."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, list] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        place = at + 10 + 12 * i
        if _SIZES.get(kind, 1) * n > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        letter = {1: "B", 2: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}.get(kind)
        if letter:
            tags[tag] = list(struct.unpack_from(order + letter * n, data, place))
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    kind, bits = tags.get(339, [1])[0], tags[258][0]
    name = next((n for n, f in _FORMAT.items() if f == (kind, bits)), None)
    if name is None or tags.get(259, [1])[0] not in (1, 8, 32946) or tags.get(284, [1])[0] != 1 or not 1 <= band <= bands or tags.get(317, [1])[0] != 1:
        raise StorageError("This kind of TIFF is not supported.", code="unsupported_tiff")
    dtype = np.dtype(name).newbyteorder(order)
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, [height])[0])
    across = -(-width // tw)
    out = np.zeros((height, width), name)
    for i, (o, n) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        raw = data[o : o + n]
        raw = zlib.decompress(raw) if tags.get(259, [1])[0] != 1 else raw
        r, c = i // across * th, i % across * tw
        part = np.frombuffer(raw, dtype).reshape(-1, tw, bands)[: min(th, height - r), : min(tw, width - c), band - 1]
        out[r : r + part.shape[0], c : c + part.shape[1]] = part
    grid = None
    nodata = bytes(tags[42113]).split(b"\0")[0].decode() if 42113 in tags else None
    missing = None if nodata is None else float(nodata) if kind == 3 else int(float(nodata))
    if 34264 in tags:
        m = tags[34264]
        grid = Grid(width, height, (m[3], m[0], m[1], m[7], m[4], m[5]), None, missing)
    elif 33550 in tags and 33922 in tags:
        s, p = tags[33550], tags[33922]
        grid = Grid(width, height, (p[3] - p[0] * s[0], s[0], 0.0, p[4] + p[1] * s[1], 0.0, -s[1]), None, missing)
    return out, grid


def read_geotiff(spark: SparkSession, filename: str, band: int = 1) -> tuple[DataFrame, Grid | None]:
    """row, col, value of one band, decoded by an executor; and the grid, or None where the file has none."""
    files = spark.read.format("binaryFile").load(filename).select("content")
    header = files.first()
    if header is None:
        raise StorageError("There is no such file.", code="missing_file", details={"path": filename})
    values, grid = decode_tiff(bytes(header["content"]), band)
    d = values.dtype.name

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for content in batch.column(0).to_pylist():
                v, _ = decode_tiff(content, band)
                for at in range(0, v.shape[0], 256):
                    r, c = np.indices(v[at : at + 256].shape, dtype=np.int32)
                    flat = v[at : at + 256].ravel()
                    column = pa.array([int(x) for x in flat], pa.decimal128(20, 0)) if d == "uint64" else pa.array(flat.astype({"uint8": "i2", "uint16": "i4", "uint32": "i8"}.get(d, d)))
                    yield pa.RecordBatch.from_arrays([pa.array(r.ravel() + np.int32(at)), pa.array(c.ravel()), column], ["row", "col", "value"])

    return files.mapInArrow(run, f"row int, col int, value {D.STORAGE[d]}"), grid


def write_geotiff(filename: str, raster: Raster, *, overwrite: bool = False) -> None:
    """One small raster as a TIFF file, invalid cells as the grid's nodata. For rasters that fit the driver."""
    spark = raster.root.sparkSession
    if exists(spark, filename) and not overwrite:
        raise StorageError("The output exists.", code="output_exists", details={"path": filename})
    values, valid = raster.collect()
    if not valid.all():
        if raster.grid.nodata is None:
            raise StorageError("Invalid cells need a nodata value.", code="missing_nodata")
        values[~valid] = raster.grid.nodata
    data = encode_tiff(values.astype(np.uint8) if raster.dtype == "bool" else values, raster.grid)
    fs, p = _fs(spark, filename)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{filename}.part")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


# Products written patch by patch


def _claimed(spark: SparkSession, path: str, identity: str | None, resume: bool) -> None:
    """A product's folder belongs to the identity that it was begun with; another one may not add patches to it."""
    note = f"{path}/_identity"
    if exists(spark, path):
        if not resume:
            raise StorageError("The output exists.", code="output_exists", details={"path": path})
        held = spark.read.text(note).first() if exists(spark, f"{note}/_SUCCESS") else None
        if (held["value"] if held else None) != identity:
            raise StorageError("The output was made of something else.", code="foreign_output", details={"path": path})
    elif identity is not None:
        spark.createDataFrame([(identity,)], "value string").coalesce(1).write.text(note)


def write_product(product: DataFrame, path: str, *, patch: int = 128, resume: bool = True, identity: str | None = None) -> int:
    """Write a product (row, col, ..) one partition a patch; patches that an earlier run committed are left out. Returns how many were.

    identity: a digest of what the product is made of. A folder begun with one is not resumed with another, or with none.
    """
    spark = product.sparkSession
    patched = product.withColumn("patch_row", F.expr(f"row div {patch}")).withColumn("patch_col", F.expr(f"col div {patch}"))
    done = 0
    _claimed(spark, path, identity, resume)
    fs, p = _fs(spark, path)
    if exists(spark, path) and any(f.getPath().getName().startswith("patch_row=") for f in fs.listStatus(p)):
        committed = spark.read.parquet(path).select("patch_row", "patch_col").distinct()
        done = committed.count()
        patched = patched.join(F.broadcast(committed), ["patch_row", "patch_col"], "left_anti")
    patched.repartition("patch_row", "patch_col").write.mode("append").partitionBy("patch_row", "patch_col").parquet(path)
    return done


# Stored pyramids


def write_pyramid(path: str, pyramid: DataFrame, grid: Grid, *, factor: int = 4, overwrite: bool = False) -> None:
    """Store the levels of `horizon.max_pyramid`, one partition a level. Metadata goes last, so an unfinished one is never read."""
    spark = pyramid.sparkSession
    if exists(spark, path):
        if not overwrite:
            raise StorageError("The output exists.", code="output_exists", details={"path": path})
        remove(spark, path)
    pyramid.repartition("level").write.partitionBy("level").parquet(f"{path}/cells")
    _write_meta(spark, path, {"height": grid.height, "width": grid.width, "factor": factor})


def read_pyramid(spark: SparkSession, path: str, grid: Grid, *, factor: int = 4) -> DataFrame:
    """level, row, col and zmax of a stored pyramid of a grid of this shape, by this factor."""
    if read_meta(spark, path) != {"height": grid.height, "width": grid.width, "factor": factor}:
        raise StorageError("The pyramid belongs to another grid or factor.", code="pyramid_mismatch", details={"path": path})
    return spark.read.schema("row int, col int, zmax float, level int").parquet(f"{path}/cells").select("level", "row", "col", "zmax")


def with_missing_patches(product: DataFrame, grid: Grid) -> DataFrame:
    """Every cell of the grid; those without a product row have NULL and valid = false."""
    value = [c for c in product.columns if c not in ("row", "col")]
    return grid.cells(product.sparkSession).join(product.withColumn("_there", F.lit(True)), ["row", "col"], "left").select("row", "col", *value, F.coalesce("_there", F.lit(False)).alias("valid"))


def stacked(*rasters: Raster) -> DataFrame:
    """row, col and one column a named raster, NULL where invalid."""
    moved = aligned(*rasters)
    return moved[0].df.select("row", "col", *(r.v.alias(r.name or f"band{i}") for i, r in enumerate(moved, 1)))
