"""What the operators of this subpackage share: reading tables, the shared scratch folder, checked writes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder and runs in one process, as in tests.
FALLBACK_SCRATCH = "file:///tmp/terrella-scratch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root or FALLBACK_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/terrella/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: computed once, lineage cut, any executor may go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/terrella/" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bits_for(rows: int, each: int) -> int:
    """The least b such that 2**b buckets hold `each` rows on average or fewer."""
    return max(0, (max(rows, 1) - 1) // each).bit_length()


def top_bits(key: str, bits: int):
    """Bucket number, in the (signed) order of the 64-bit column `key`; 0 where bits is 0."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftright(F.col(key), 64 - bits) + F.lit(1 << (bits - 1))


def text_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def batches(rows: Iterator[pa.RecordBatch], each: int, of: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices whose column `of` holds about `each` bytes, so that memory follows texts and not row counts."""
    for batch in rows:
        at, n = 0, batch.num_rows
        while at < n:
            step = n - at
            column = batch.column(batch.schema.get_field_index(of))
            while step > 1 and column.slice(at, step).get_total_buffer_size() > 0 and _bytes(column, at, step) > each:
                step = (step + 1) // 2
            yield batch.slice(at, step)
            at += step


def _bytes(column: pa.Array, at: int, step: int) -> int:
    return column.slice(at, step).nbytes


def text_key() -> Column:
    """What tells the texts of rows of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their group (doc_id, text_key, root) by doc_id and text. Rows without doc_id stay."""
    first = groups.filter("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("m"))
    first = written(first.select("m.doc_id", "m.text_key"), "groups-first")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(first, (docs["doc_id"].cast("long") == first["doc_id"]) & (key == first["text_key"]), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").limit(1).count():
        name = "_text_key"
        while name in docs.columns:
            name += "_"
        kept = kept.withColumn(name, text_key()).dropDuplicates(["doc_id", name]).drop(name)
    return kept.unionAll(docs.filter("doc_id IS NULL"))
