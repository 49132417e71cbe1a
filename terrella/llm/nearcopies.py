"""Near copies by SimHash, held to an exact Jaccard similarity of word shingles.

A text stands for the set of its shingles of five words. Two texts are near copies if their sets' Jaccard similarity is 0.8 or
more, and every link is an exact comparison of two sets.

1. SimHash: fingerprints of five-word shingles meet in the vantage-point trees of `simhash`. The texts of a component of its links are a bucket.
2. At similarity 0.8 fingerprints of 64 bits differ in ten bits or so, beyond any radius that prunes. What they leave apart is found by
   the prefix filter, which misses nothing: in one order of all shingles, sets of similarity s share one among their first
   n - ceil(s * n) + 1. Those that hold such a shingle are a bucket too. In each bucket every text is first held against the few that meet most
   others, so a group of any size is joined by a few comparisons a text; then all that are still apart, share a shingle and fit in size meet.
3. A pair that meets is compared by the sets' beginnings first: these already differ in more shingles than similar sets can in all if most of
   them do. Whole sets are fetched only for the rest.

Shingles go by how many rows hold them, rare ones first; any order gives the same links. Blocks of texts ask hash buckets for these counts, so
none is collected or broadcast. Components of all links are the groups.

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

from terrella.llm import simhash
from terrella.llm.blocks import ASKED, BLOCK_BYTES, BUCKET_BYTES, Dealt, asked_of, asked_table, block_of, bytes_of, numbers_of, planes, released, shared_out
from terrella.llm.common import batches, first_of_groups, text_key, text_of, written
from terrella.llm.components import components
from terrella.llm.minhash import SHINGLE, SIMILAR, compared, meeting, sets_of, shingle_sets
from terrella.llm.wordhash import mixed

#: Texts of a shingle's bucket and class of sizes that all others in it are held against, before all that are still apart meet.
CENTRES = 8
#: Entries of prefixes that a bucket of shingles gets on average.
BUCKET = 400_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingled(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, all texts in a row, and where each text's begin and end."""
    held, sizes = [], []
    for chunk in batches(iter(pa.table({"text": texts}).to_batches()), 2_000_000, "text"):
        hashes, cuts = shingle_sets(text_of(chunk.column(0)))
        held.append(hashes)
        sizes.append(np.diff(cuts))
    return np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def ordered(hashes: np.ndarray, cuts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Numbers of each text's shingles in ascending order: by how many texts hold a shingle, then by its hash. Two of one number only make more texts meet."""
    keys = np.minimum(count, (1 << 20) - 1).astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20)
    return keys[np.lexsort((keys, np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))))]


def add_up(group: pa.Table) -> pa.Table:
    """Answer each block with the sums over all blocks."""
    keys, values, size = asked_of(group)
    _, at = np.unique(keys, return_inverse=True)
    return pa.table({"block": group["block"], "part": group["part"], "found": shared_out(np.bincount(at, values[0]).astype(np.int64)[at][None], size)})


def prefix_sizes(size: np.ndarray) -> np.ndarray:
    """n - ceil(0.8 * n) + 1."""
    return size - -(-size * round(SIMILAR * 10) // 10) + 1


def marked(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text_key, node (a hash of the shingle set), fp (the fingerprint), size of the set and its prefix of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    size = bytes_of(own, "text")
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    blocked = own.withColumn("block", block_of("doc_id", "text", blocks)).repartition("block")

    def ask(group: pa.Table) -> pa.Table:
        keys, count = np.unique(shingled(group["text"])[0], return_counts=True)
        return asked_table(Dealt(keys, buckets).asked(group["block"][0].as_py(), 0, count.astype(np.int64)))

    def mark(group: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, cuts = shingled(group["text"])
        distinct, at = np.unique(hashes, return_inverse=True)
        found = dict(zip(answers["part"].to_pylist(), answers["found"].to_pylist(), strict=True))
        keys = ordered(hashes, cuts, Dealt(distinct, buckets).answered(found, 0, 1)[0][at])
        size = np.diff(cuts)
        index = np.arange(len(hashes)) - np.repeat(cuts[:-1], size)
        node = mixed(np.add.reduceat(mixed(hashes + index.astype(np.uint64) * _PRIME), cuts[:-1])).view(np.int64)
        fp = np.frombuffer(b"".join([simhash.fingerprint(t.as_py(), SHINGLE) for t in group["text"]]), ">i8").astype(np.int64)
        prefix = pa.array([keys[a : a + n].tobytes() for a, n in zip(cuts[:-1], prefix_sizes(size), strict=True)], pa.binary())
        return pa.table({"doc_id": group["doc_id"], "text_key": group["text_key"], "node": pa.array(node), "fp": pa.array(fp), "size": pa.array(size.astype(np.int64)), "prefix": prefix})

    counts = written(blocked.groupBy("block").applyInArrow(ask, ASKED).groupBy("part").applyInArrow(add_up, "block long, part long, found binary"), "near-counts")
    released()
    return blocked.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(mark, "doc_id long, text_key long, node long, fp long, size long, prefix binary")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """The pairs (node, other) to compare that SimHash finds: texts of one fingerprint, and trees of those within the radius."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("other")), "near-fingerprints")
    forest = written(simhash.links(first.select("fp"), first.count()), "near-forest")
    same = nodes.select("fp", "node").join(first, "fp").filter("node <> other").select("node", "other")
    close = forest.join(first.select(F.col("fp").alias("a"), F.col("other").alias("node")), "a").join(first.withColumnRenamed("fp", "b"), "b")
    return same.unionAll(close.select("node", "other"))


def shared_prefixes(nodes: DataFrame, entries: int, each: int = BUCKET) -> DataFrame:
    """shingle, node, size, at (its place in the node's order) and n (how many hold it there) of the prefixes' shingles that two nodes or more hold."""
    buckets = max(1, -(-entries // each))

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4_000_000, "prefix"):
            held = [np.frombuffer(p.as_buffer(), np.uint64) for p in batch.column(2)]
            if not held:
                continue
            count = np.array([len(h) for h in held])
            shingle = np.concatenate(held)
            facts = [shingle, np.repeat(batch.column(0).to_numpy(), count), np.repeat(batch.column(1).to_numpy(), count), np.arange(len(shingle)) - np.repeat(np.cumsum(count) - count, count) + 1]
            to = (mixed(shingle * _PRIME) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.lexsort((shingle, to))
            ends = np.cumsum(np.bincount(to.astype(np.int64), minlength=buckets))
            filled = np.flatnonzero(np.diff(ends, prepend=0))
            facts = [f[order] for f in facts]
            packed = [[planes(f[(ends[i - 1] if i else 0) : ends[i]]) for i in filled] for f in facts]
            yield pa.RecordBatch.from_arrays([pa.array(filled), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", "shingle", "node", "size", "at"])

    def shared(group: pa.Table) -> pa.Table:
        names = ["shingle", "node", "size", "at"]
        facts = [np.concatenate([numbers_of(x.as_py()) for x in group[n]]) for n in names]
        order = np.argsort(facts[0], kind="stable")
        facts = [f[order] for f in facts]
        _, run, n = np.unique(facts[0], return_inverse=True, return_counts=True)
        n = n[run]
        return pa.table({name: pa.array(f[n > 1]) for name, f in zip([*names, "n"], [*facts, n], strict=True)})

    dealt = nodes.select("node", "size", "prefix").mapInArrow(deal, "bucket long, shingle binary, node binary, size binary, at binary")
    return dealt.groupBy("bucket").applyInArrow(shared, "shingle long, node long, size long, at long, n long")


def hopeful(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs node, other whose sizes (sx, sy) and beginnings (x, y) do not rule out that they are similar."""
    for batch in rows:
        good = []
        for x, y, sx, sy in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            fits = SIMILAR * max(sx, sy) <= min(sx, sy) + 1e-9
            if fits:
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                last = min(x[-1], y[-1])
                x, y = x[: np.searchsorted(x, last, side="right")], y[: np.searchsorted(y, last, side="right")]
                # Similar sets differ in at most (1 - s) / (1 + s) of both sizes together.
                fits = len(np.setxor1d(x, y)) <= (1 - SIMILAR) / (1 + SIMILAR) * (sx + sy) + 1e-9
            good.append(fits)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["node", "other"]).filter(pa.array(good, pa.bool_()))


def linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, step: str) -> DataFrame:
    """a, b: the pairs (node, other) that are similar."""
    x = nodes.select("node", F.col("prefix").alias("x"), F.col("size").alias("sx"))
    y = nodes.select(F.col("node").alias("other"), F.col("prefix").alias("y"), F.col("size").alias("sy"))
    both = pairs.join(x, "node").join(y, "other").select("node", "other", "x", "y", "sx", "sy")
    left = written(both.mapInArrow(hopeful, "node long, other long"), f"near-{step}-pairs")
    released()
    wanted = left.select("node").unionAll(left.select(F.col("other").alias("node"))).distinct()
    sets = written(sets_of(docs, wanted.join(nodes, "node").select("node", "row.*")), f"near-{step}-sets")
    released()
    return compared(left, sets)


def near_copies(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_key and root (equal within a group) of every row."""
    rows = written(marked(docs, block_bytes=block_bytes, bucket_bytes=bucket_bytes), "near")
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.min(F.struct("doc_id", "text_key")).alias("row"))
    nodes = written(nodes, "near-nodes")
    released()
    close = written(fingerprint_links(nodes).distinct(), "near-close")
    guess = written(components(close.select(F.col("node").alias("a"), F.col("other").alias("b"))), "near-guess")
    entries = nodes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)).alias("b")).first()["b"] // 8
    members = written(shared_prefixes(nodes, entries, bucket), "near-members")
    released()
    # A component of SimHash's links is one more bucket: its ends may be too far apart, but those in it are candidates.
    roots = guess.unionAll(guess.select(F.col("root").alias("node"), "root").distinct())
    buckets = members.select("shingle", "node", "size").unionAll(roots.join(nodes, "node").select(F.col("root").alias("shingle"), "node", "size"))
    facts = members.groupBy("node").agg(F.sum("n").alias("met"))
    # Classes of sizes as in `meeting`: a text meets the centres of its own class and of the next.
    scale = F.log(F.col("size").cast("double")) / -math.log(SIMILAR)
    met = written(buckets.join(facts, "node", "left").select("shingle", "node", "size", F.coalesce("met", F.lit(0)).alias("met")).withColumn("class", F.floor(scale)), "near-met")
    most = Window.partitionBy("shingle", "class").orderBy(F.desc("met"), "node")
    chosen = met.withColumn("place", F.row_number().over(most)).filter(F.col("place") <= CENTRES).select("shingle", "class", F.col("node").alias("other"), F.col("size").alias("its_size"))
    asking = met.withColumn("class", F.explode(F.sequence(F.floor(scale - 1e-9), F.floor(scale + 1 + 1e-9))))
    fits = (F.least("size", "its_size") >= SIMILAR * F.greatest("size", "its_size") - 1e-9) & F.expr("node <> other")
    held = asking.join(chosen, ["shingle", "class"]).filter(fits).select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct()
    first = linked(docs, nodes, close.unionAll(held).distinct(), "first")
    released()
    stars = written(components(first), "near-stars")
    prefix = written(members.join(stars, "node", "left").select("shingle", "node", "size", "at", F.coalesce("root", "node").alias("root")), "near-prefixes")
    rest = linked(docs, nodes, meeting(prefix), "rest")
    released()
    groups = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(rest))
    return rows.select("doc_id", "text_key", "node").join(groups, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their group by doc_id and text. Rows without doc_id stay."""
    return first_of_groups(docs, near_copies(docs))
