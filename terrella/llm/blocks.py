"""Blocks of texts that ask hash buckets about their keys.

Texts are grouped into blocks of bounded size. A block sends each of its distinct keys once, however often it holds it, to
the bucket of the key's highest bits; keys and numbers travel packed, one row a block and bucket. A bucket so gets one entry a block of
the most common key, and answers each block in the order it was asked. Nothing is collected or broadcast.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text a block holds on average, and bytes of text whose keys a bucket gets.
BLOCK_BYTES, BUCKET_BYTES = 8_000_000, 8_000_000

ASKED = "block long, part long, keys binary, found binary"


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, so that the leading zeros of small numbers lie together, and compressed."""
    data = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def numbers_of(data: bytes, kind: type = np.int64) -> np.ndarray:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


class Dealt:
    """Keys in ascending order, cut into buckets by their highest bits."""

    def __init__(self, keys: np.ndarray, buckets: int):
        self.buckets, self.order = buckets, np.argsort(keys)
        self.keys = keys[self.order]
        bucket = (self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.array([], np.int64)
        #: Bucket, start and stop of each run of keys of one bucket.
        self.runs = list(zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=False))

    def asked(self, block: int, round_: int, *values: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
        """Rows of block, part, keys and values."""
        v = np.stack([x.view(np.int64) for x in values])[:, self.order]
        return [(block, round_ * self.buckets + i, planes(np.diff(self.keys[a:b], prepend=np.uint64(0))), planes(v[:, a:b].ravel())) for i, a, b in self.runs]

    def answered(self, answers: dict[int, bytes], round_: int, width: int) -> np.ndarray:
        """The values sent back, one row each, in the order of the keys as they were given."""
        out = np.zeros((width, len(self.keys)), np.int64)
        for i, a, b in self.runs:
            out[:, self.order[a:b]] = numbers_of(answers[round_ * self.buckets + i]).reshape(width, -1)
        return out


def asked_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "part", "keys", "found"])


def asked_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Keys and values (a column each) of all rows that a bucket gets, and how many keys each row has."""
    keys = [np.cumsum(numbers_of(k.as_py(), np.uint64)) for k in group["keys"]]
    size = [len(k) for k in keys]
    return np.concatenate(keys), np.concatenate([numbers_of(v.as_py()).reshape(-1, n) for v, n in zip(group["found"], size, strict=True)], axis=1), size


def shared_out(values: np.ndarray, size: list[int]) -> pa.Array:
    """`values` (a row for each number sent back) packed for the rows they answer."""
    ends = np.cumsum(size)
    return pa.array([planes(values[:, e - n : e].ravel()) for e, n in zip(ends, size, strict=True)], pa.binary())


def block_of(doc_id: str, text: str, blocks: int) -> Column:
    """The block of a row by its id and text."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))), F.lit(blocks))


def bytes_of(docs: DataFrame, text: str) -> int:
    """Bytes of all texts, and some for each row."""
    return docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 40), F.lit(0)).alias("b")).first()["b"]


def released() -> None:
    """Let Spark delete the shuffle files of steps that are done: it does so when the driver's garbage is collected."""
    from pyspark import SparkContext

    gc.collect()
    for _ in range(2):  # what the first leaves unreachable, such as plans still in the listeners' queue, the second finds
        SparkContext._active_spark_context._jvm.System.gc()
        time.sleep(0.5)
