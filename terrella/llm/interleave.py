"""Proportional stratified interleaving: shards that all match the corpus's mixture of sources.

Rows are shuffled within each source by a seeded hash and ranked; rank r of n becomes the fraction (r + u) / n, where u
is a seeded hash of the source between 0 and 1, so that many sources of few rows spread too; all rows are ordered by fraction and
cut into runs of equal length. Every run then holds each source in proportion, to within a row or so.

No source is ever ranked in one task: the hash's leading bits deal each source into buckets of bounded size, bucket
counts are summed up in two levels to offsets, and only buckets are sorted. The global order is cut the same way by fraction.

Cases: a null source is a stratum of its own; a null or empty text has size 1; repeated rows are placed
independently, ties fall to doc_id, then checksum, then size (rows equal in these are interchangeable); fewer rows
than shards leave some shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrella.llm.common import bits_for, top_bits, written

#: Rows a bucket holds on average; bounds the largest sort of a task.
ROWS_PER_BUCKET = 512
#: Buckets whose counts are summed up in one task.
BUCKETS_SUMMED = 4_096


def interleave(docs: DataFrame, *, stratum: str = "source", shards: int = 16, seed: int = 42, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, stratum, shard, slot of every row of `docs` under the law of equal row counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("_stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    base = written(base, "interleave")
    rows = base.count()
    bits = bits_for(rows, rows_per_bucket)
    base = base.withColumn("_bucket", top_bits("_key", bits))

    offsets = _before(base.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_n")), ["_stratum"], "_bucket")
    offsets = offsets.join(base.groupBy("_stratum").agg(F.count("*").alias("_all")), "_stratum")
    inner = Window.partitionBy("_stratum", "_bucket").orderBy("_key", "doc_id", "text_crc32", "size")
    ranked = base.join(offsets, ["_stratum", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(inner) - 1)
    ranked = ranked.withColumn("_fraction", (F.col("_rank") + _share(F.xxhash64(F.lit(seed + 1), "_stratum"))) / F.col("_all"))
    ranked = written(ranked.select("doc_id", "size", "text_crc32", "_stratum", "_rank", "_fraction"), "interleave-ranks")

    ranked = ranked.withColumn("_slice", F.floor(F.col("_fraction") * F.lit(float(1 << bits))))
    slices = _before(ranked.groupBy("_slice").agg(F.count("*").alias("_n")), [], "_slice")
    within = Window.partitionBy("_slice").orderBy("_fraction", "_stratum", "_rank")
    at = F.col("_before") + F.row_number().over(within) - 1
    placed = ranked.join(slices, "_slice").withColumn("_at", at)
    shard = _div(F.col("_at") * shards, rows)
    return placed.withColumn("_shard", shard).select(
        "doc_id", "size", "text_crc32", F.col("_stratum").alias("stratum"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_at") - _div(F.col("_shard") * rows + (shards - 1), shards)).alias("slot"),
    )


def _share(h: Column) -> Column:
    """A hash as a number from 0 to less than 1."""
    return F.shiftrightunsigned(h, 33) / F.lit(float(1 << 31))


def _before(counts: DataFrame, by: list[str], place: str) -> DataFrame:
    """`counts` (by, place, _n) with _before in place of _n: the sum of what lies at smaller places, in two levels."""
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_part", F.floor(F.col(place) / BUCKETS_SUMMED))
    parts = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_n")).withColumn("_ahead", ahead(Window.partitionBy(*by).orderBy("_part"))).drop("_n")
    within = counts.withColumn("_within", ahead(Window.partitionBy(*by, "_part").orderBy(place)))
    return within.join(parts, [*by, "_part"]).select(*by, place, (F.col("_ahead") + F.col("_within")).alias("_before"))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(max(b, 1)).cast("long"))


def op10_stratified_interleave(spark, sf_dir):
    from terrella.llm.common import table

    return interleave(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "stratum"
    )
