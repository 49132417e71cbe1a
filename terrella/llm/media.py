"""Media columns: images in Netpbm and BMP form decoded to numpy arrays, resized, hashed and stored as NPY tiles.

`decode` reads binary Netpbm (P4, P5, P6; samples of 8 or 16 bits) and uncompressed BMP (1, 4, 8, 16, 24 and 32 bits,
either row order, bit fields, old core headers). `area_resize` averages source areas exactly by an integral image, fractional edges included; the
integral image is made strip by strip, and only the rows that target cells end at are kept, so memory follows a strip.
`difference_hash` compares neighbours of a 9 x 8 reduction: 64 bits. `to_tiles` cuts an array into NPY streams laid
end to end, `from_tiles` reads them back.

`store_text` shows the path on a table of texts: each text's bytes, filled up with bytes 255 to whole rows, become a
grey image, are decoded from its PGM form, stored as tiles and read back.

Cases: an image without rows or columns has a difference hash of zeros and one empty tile; a null text counts as empty and gives one unit of padding; equal texts give equal values; texts of any length
are stored whole, tile by tile; repeated rows each give a row; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrella.llm.common import batches, text_of

#: Bytes that a payload's length is a multiple of, and the image's width: a unit is six rows.
UNIT, WIDTH = 576, 96
#: Rows of a tile, and of a strip of an integral image.
TILE_ROWS, STRIP_ROWS = 576, 4_096


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def decode(data: bytes) -> np.ndarray:
    """An array (rows, columns) or (rows, columns, channels) of a Netpbm or BMP file."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if data[:2] in (b"P4", b"P5", b"P6"):
        return _decode_netpbm(data)
    raise ValueError("neither binary Netpbm nor BMP")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1:2], 2, []
    while len(numbers) < (2 if kind == b"4" else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        start = at
        while data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("a number is missing in the header")
        numbers.append(int(data[start:at]))
    at += 1
    width, height = numbers[:2]
    if kind == b"4":
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride), axis=1)
        return (1 - bits[:, :width]) * np.uint8(255)
    channels = 3 if kind == b"6" else 1
    sample = np.dtype(">u2") if numbers[2] > 255 else np.dtype(np.uint8)
    flat = np.frombuffer(data, sample, width * height * channels, at)
    return flat.reshape((height, width, 3) if channels == 3 else (height, width)).astype(sample.newbyteorder("="), copy=False)


def _decode_bmp(data: bytes) -> np.ndarray:
    start, header = struct.unpack_from("<II", data, 10)
    if header == 12:
        (width, height, planes, depth), compression, used, entry = struct.unpack_from("<HHHH", data, 18), 0, 0, 3
    else:
        width, height, planes, depth, compression = struct.unpack_from("<iiHHI", data, 18)
        used, entry = struct.unpack_from("<I", data, 46)[0], 4
    if planes != 1 or width < 0 or (depth, compression) not in ((1, 0), (4, 0), (8, 0), (16, 0), (24, 0), (32, 0), (16, 3), (32, 3)):
        raise ValueError("this kind of BMP is not supported")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    if depth == 16 or compression == 3:
        masks = struct.unpack_from("<III", data, 54) if compression == 3 else (0x7C00, 0x03E0, 0x001F)
        pixels = np.ascontiguousarray(raw).view("<u2" if depth == 16 else "<u4")[:, :width]
        return np.stack([_field(pixels, m) for m in masks], axis=2).astype(np.uint8)
    if depth >= 24:
        return raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    used = used or 1 << depth
    palette = np.frombuffer(data, np.uint8, used * entry, 14 + header).reshape(used, entry)[:, 2::-1]
    if depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(rows, -1, depth)
        index = bits.dot(1 << np.arange(depth - 1, -1, -1))[:, :width]
    else:
        index = raw[:, :width]
    return palette[index]


def _field(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits under a mask, brought to 0 .. 255."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    return ((pixels & mask).astype(np.uint64) >> low) * 255 // (mask >> low)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the source area under each target cell, by an integral image."""
    height, width = image.shape
    low, part = _ends(height, rows)
    wanted = np.unique(np.concatenate([low, low + 1]))
    kept, carry = np.zeros((len(wanted), width + 1)), np.zeros(width + 1)
    for at in range(0, height, STRIP_ROWS):
        strip = np.zeros((min(STRIP_ROWS, height - at) + 1, width + 1))
        np.cumsum(np.cumsum(image[at : at + STRIP_ROWS], axis=0, dtype=np.float64), axis=1, out=strip[1:, 1:])
        here = np.flatnonzero((wanted >= at) & (wanted < at + len(strip)))
        kept[here] = carry + strip[wanted[here] - at]
        carry = carry + strip[-1]
    place = np.searchsorted(wanted, low)
    total = kept[place] * (1 - part[:, None]) + kept[place + 1] * part[:, None]
    low, part = _ends(width, columns)
    total = total.take(low, 1) * (1 - part) + total.take(low + 1, 1) * part
    return np.diff(np.diff(total, axis=0), axis=1) * (rows * columns / (height * width))


def _ends(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n equal parts of `size` cells end: the cells before and the share of the next cell."""
    at = np.arange(n + 1) * size / n
    low = np.minimum(at.astype(np.int64), size - 1)
    return low, at - low


def difference_hash(image: np.ndarray) -> str:
    """64 bits in 16 hex digits: is a cell of the 8 x 9 reduction brighter than the one to its left?"""
    if not image.shape[0] or not image.shape[1]:
        return "0" * 16
    small = area_resize(grey(image), 8, 9)
    return np.packbits(np.diff(small, axis=1) > 1e-9).tobytes().hex()


def to_tiles(image: np.ndarray, tile_rows: int = TILE_ROWS) -> bytes:
    out = io.BytesIO()
    for at in range(0, max(1, image.shape[0]), tile_rows):
        np.save(out, np.ascontiguousarray(image[at : at + tile_rows]), allow_pickle=False)
    return out.getvalue()


def from_tiles(data: bytes) -> np.ndarray:
    source, tiles = io.BytesIO(data), []
    while source.tell() < len(data):
        tiles.append(np.load(source, allow_pickle=False))
    return tiles[0] if len(tiles) == 1 else np.concatenate(tiles)


def store_text(docs: DataFrame, *, with_media: bool = True) -> DataFrame:
    """Each text as a stored grey image, with checks and features of what is read back; media holds the NPY tiles."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4_000_000, "text"):
            out, kept = [], []
            for text in text_of(batch.column(1)):
                data = text.encode()
                n = max(1, -(-len(data) // UNIT)) * UNIT
                image = decode(encode_pgm(np.frombuffer(data + b"\xff" * (n - len(data)), np.uint8).reshape(-1, WIDTH)))
                media = to_tiles(image)
                back = from_tiles(media)
                payload = back.tobytes()
                out.append((len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha256(media).hexdigest(), difference_hash(back)))
                if with_media:
                    kept.append(media)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [batch.column(0).cast(pa.int64()), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))]
            columns += [pa.array(kept, pa.binary())] * with_media
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def image_features(images: DataFrame, column: str = "content") -> DataFrame:
    """Height, width, channels, difference hash and NPY tiles of a table of image files; what cannot be decoded gets nulls and the reason."""
    names = ["height", "width", "channels", "feature", "tiles", "error"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 16_000_000, column):
            out = []
            for data in batch.column(batch.schema.get_field_index(column)).to_pylist():
                try:
                    image = decode(data or b"")
                    out.append((image.shape[0], image.shape[1], image.shape[2] if image.ndim == 3 else 1, difference_hash(image), to_tiles(image), None))
                except (ValueError, struct.error, IndexError) as e:
                    out.append((None, None, None, None, None, str(e) or type(e).__name__))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            others = [i for i, f in enumerate(batch.schema) if f.name != column and f.name not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], [*(batch.schema.names[i] for i in others), *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name != column and f.name not in names)
    return images.mapInArrow(run, f"{kept}{', ' * bool(kept)}height int, width int, channels int, feature string, tiles binary, error string")


def op5_media_columns(spark, sf_dir):
    from terrella.llm.common import table

    return store_text(table(spark, sf_dir, "documents"), with_media=False)
