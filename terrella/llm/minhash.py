"""Near copies by similarity of word shingles: MinHash bands find candidates, an exact check of the sets decides.

A text stands for the set of its shingles of five words. Two texts are near copies if their sets' Jaccard similarity is 0.8 or
more. Of each set 160 minima in 32 bands of 5 are taken; texts that share a band are candidates (at similarity 0.8 all bands differ
in 3 of a million cases). Links among them are found in two steps, and every link is an exact comparison of two sets.

1. In each band's bucket every text is held against the one that meets most others over all its bands, which in a group of copies is
   the text they were made of. A bucket of n texts gives n pairs, so a group of any size is joined by about as many links as it has texts.
2. Whatever that leaves apart is found by the prefix filter, which misses nothing: with shingles in order of how rare they are, sets of
   similarity s share one among their first n - ceil(s * n) + 1. Texts that do so meet if they are not in one group yet, their sizes fit
   and enough shingles can follow at both places. Shingles that only one group holds are left out first, so a group's own texts do not meet.

Components of all links are the groups.

Cases: a null text counts as empty; texts of no words are copies of each other; one of fewer words than a shingle is one shingle; rows
of equal sets are one node; rows without doc_id stay and speak for nobody; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrella.llm.blocks import released
from terrella.llm.common import batches, first_of_groups, text_key, text_of, written
from terrella.llm.components import components
from terrella.llm.wordhash import mixed, text_words

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 5
_MULTIPLY, _ADD = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles in order, all texts in a row, and where each text's begin and end."""
    words, owner = text_words([t.encode().lower() for t in texts])
    n = np.bincount(owner, minlength=len(texts))
    at = np.flatnonzero(owner[: 1 - SHINGLE] == owner[SHINGLE - 1 :]) if len(words) >= SHINGLE else np.array([], np.int64)
    whole = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        whole = mixed(whole * _PRIME + words[at + k])
    # Texts of fewer words, side by side.
    short = np.flatnonzero(n < SHINGLE)
    start, single = (np.cumsum(n) - n)[short], np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        has = n[short] > k
        single[has] = mixed(single[has] * _PRIME + words[start[has] + k])
    hashes, of = np.concatenate([whole, single]), np.concatenate([owner[at], short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.array([], bool)
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(len(texts) + 1))


def band_keys(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A key for each text (a row) and band."""
    out = np.zeros((len(cuts) - 1, BANDS), np.uint64)
    for i, (a, b) in enumerate(zip(_MULTIPLY, _ADD, strict=True)):
        band = i // ROWS
        out[:, band] = mixed((out[:, band] + np.uint64(band)) * _PRIME + np.minimum.reduceat(hashes * a + b, cuts[:-1]))
    return out


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (a hash of the shingle set) and keys of every row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 2_000_000, "text"):
            if not batch.num_rows:
                continue
            hashes, cuts = shingle_sets(text_of(batch.column(2)))
            keys = band_keys(hashes, cuts)
            index = np.arange(len(hashes)) - np.repeat(cuts[:-1], np.diff(cuts))
            node = mixed(np.add.reduceat(mixed(hashes + index.astype(np.uint64) * _PRIME), cuts[:-1])).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), lists], ["doc_id", "text_key", "node", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, node long, keys array<long>")


def similar(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs a, b whose sets (x, y) are similar enough."""
    for batch in rows:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True)) if SIMILAR * max(len(x), len(y)) <= min(len(x), len(y)) else 0
            good.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and hashes (its set) of the nodes `wanted` (node, doc_id, text_key of a row that has it)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 2_000_000, "text"):
            hashes, cuts = shingle_sets(text_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["node", "hashes"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    asked = wanted.withColumnRenamed("doc_id", "row").withColumnRenamed("text_key", "its_key")
    found = own.join(asked, (own.text_key == asked.its_key) & own.doc_id.eqNullSafe(asked.row)).select("node", "text")
    return found.groupBy("node").agg(F.min("text").alias("text")).mapInArrow(run, "node long, hashes binary")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (node, other) that are similar, as a and b."""
    both = pairs.join(sets.withColumnRenamed("hashes", "x"), "node").join(sets.select(F.col("node").alias("other"), F.col("hashes").alias("y")), "other")
    return written(both.select("node", "other", "x", "y").mapInArrow(similar, "a long, b long"), "minhash-links")


def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size of its set and shingle, a row for each."""
    for batch in batches(rows, 2_000_000, "hashes"):
        sets = [np.frombuffer(h.as_buffer(), np.int64) for h in batch.column(1)]
        if sets:
            size = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets))], ["node", "size", "shingle"])


def apart(sets: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs (node, other) of different groups of `stars` that can be similar; all that are similar are among them."""
    shingles = sets.select("node", "hashes").mapInArrow(spread, "node long, size long, shingle long")
    often = shingles.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    # What no other set holds comes first in the order and needs no more than a count: what is left of the size.
    own = Window.partitionBy("node")
    prefix = shingles.join(often, "shingle").withColumn("at", F.row_number().over(own.orderBy("n", "shingle")) + F.col("size") - F.count("*").over(own))
    prefix = prefix.filter(F.col("at") <= F.col("size") - F.ceil(SIMILAR * F.col("size") - 1e-9) + 1)
    return meeting(written(prefix.join(stars, "node", "left").select("shingle", "node", "size", "at", F.coalesce("root", "node").alias("root")), "minhash-prefixes"))


def meeting(prefix: DataFrame) -> DataFrame:
    """The pairs (node, other) of different groups that share a shingle of `prefix` (shingle, node, size, at, root), and whose sizes and places fit."""
    shared = prefix.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
    # Sizes of one class differ by less than a factor of SIMILAR, so a set's larger partners are in its own class or the next.
    scale = F.log(F.col("size").cast("double")) / -math.log(SIMILAR)
    prefix = written(prefix.join(shared, "shingle", "left_semi").withColumn("class", F.floor(scale)), "minhash-shared")
    asking = prefix.withColumn("class", F.explode(F.sequence(F.floor(scale - 1e-9), F.floor(scale + 1 + 1e-9))))
    x, y = asking.alias("x"), prefix.alias("y")
    left = F.least(F.expr("x.size - x.at"), F.expr("y.size - y.at")) + 1
    fits = F.expr("x.shingle = y.shingle AND x.class = y.class AND x.root <> y.root AND (x.size < y.size OR x.size = y.size AND x.node < y.node)")
    fits = fits & (F.col("x.size") >= SIMILAR * F.col("y.size") - 1e-9) & (left >= SIMILAR / (1 + SIMILAR) * F.expr("x.size + y.size") - 1e-9)
    return x.join(y, fits).select(F.col("x.node").alias("node"), F.col("y.node").alias("other")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and root (equal within a group) of every row."""
    rows = written(marked(docs), "minhash")
    nodes = written(rows.groupBy("node").agg(F.first("keys").alias("keys"), F.min(F.struct("doc_id", "text_key")).alias("row")), "minhash-nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    meets = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(keyed.join(meets, "key"), "minhash-met")
    most = members.groupBy("node").agg(F.sum("n").alias("met"))
    members = written(members.select("key", "node").join(most, "node").select("key", "node", "met"), "minhash-members")
    released()
    sets = written(sets_of(docs, members.select("node").distinct().join(nodes, "node").select("node", "row.*")), "minhash-sets")
    released()
    chosen = members.groupBy("key").agg(F.max(F.struct("met", "node")).alias("m")).select("key", F.col("m.node").alias("other"))
    linked = compared(members.join(chosen, "key").filter("node <> other").select("node", "other").distinct(), sets)
    released()
    stars = written(components(linked), "minhash-stars")
    linked = compared(apart(sets, stars), sets)
    released()
    groups = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(linked))
    return rows.select("doc_id", "text_key", "node").join(groups, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their group by doc_id and text. Rows without doc_id stay."""
    return first_of_groups(docs, near_copies(docs))
