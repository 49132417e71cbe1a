"""SimHash near-duplicates by vantage-point trees.

A document's fingerprint takes the majority of the bits of its word shingles' hashes. Distinct fingerprints are
partitioned by a vantage-point tree over Hamming distance, built from a bounded sample: its leaves are shards. By
the triangle inequality a fingerprint can have partners only in shards whose boundaries come within the radius of it,
so it is sent there as a query; of each two shards one asks the other. In a shard a local tree prunes in the same way
and its leaves are compared exactly, so no link is lost. A shard answers with a spanning forest of its links (never all
pairs of a group), and components follow from the forests.

Cases: a null text counts as empty; a text of no words has fingerprint zero, which links like any other; one of fewer words
than a shingle is one shingle; repeated rows share a fingerprint and a component; rows of null doc_id keep null
there, and a component of null ids alone has a null id; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.llm.common import batches, bits_for, first_of_groups, text_key, text_of, written
from terrella.llm.components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, RADIUS, SEED = 4, 4, 42
#: Distinct fingerprints a shard holds on average, and of the sample that the shards' tree is built from.
SHARD, SAMPLE = 32_768, 16_384
#: Fingerprints that are compared with each other without another split, and cells of one comparison.
LEAF, CELLS = 64, 1 << 21


def fingerprint(text: str, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, the highest bit first."""
    words = WORDS.findall(text.encode().lower())
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    digest, seed = xxhash.xxh64_digest, SEED
    starts = [0, *ends[:-shingle].tolist()]
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(bits), 65_536):
        votes += np.unpackbits(bits[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(bits)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number) of every row, and its text_key if asked for."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4_000_000, "text"):
            fp = np.frombuffer(b"".join([fingerprint(t, shingle) for t in text_of(batch.column(1))]), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    key = [text_key().alias("text_key")] if keyed else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *key).mapInArrow(run, "doc_id long, fp long" + ", text_key long" * keyed)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class ShardTree:
    """A vantage-point tree of a given depth over a sample: node i has children 2i + 1 (within its radius) and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.vantage, self.within = np.zeros((1 << depth) - 1, np.uint64), np.zeros((1 << depth) - 1, np.int64)
        parts = {0: sample}
        for node in range((1 << depth) - 1):
            own = parts.pop(node)
            self.vantage[node] = own[0] if len(own) else np.uint64((node + 1) * 0x9E3779B97F4A7C15 % 2**64)
            d = distance(own, self.vantage[node])
            self.within[node] = int(np.median(d)) if len(own) else 31
            parts[2 * node + 1], parts[2 * node + 2] = own[1:][d[1:] <= self.within[node]], own[d > self.within[node]]

    def homes(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (distance(x, self.vantage[node]) > self.within[node])
        return node - ((1 << self.depth) - 1)

    def visits(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in x and shards that may hold partners of them."""
        at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            d = distance(x[at], self.vantage[node]).astype(np.int64)
            near, far = d - radius <= self.within[node], d + radius > self.within[node]
            at, node = np.concatenate([at[near], at[far]]), np.concatenate([2 * node[near] + 1, 2 * node[far] + 2])
        return at, node - ((1 << self.depth) - 1)


class Forest:
    """Links between numbered places, kept as a spanning forest."""

    def __init__(self, n: int):
        self.label, self.a, self.b, self.held = np.arange(n), [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            a, b = self.label[a], self.label[b]
            apart = a != b
            if apart.any():
                self.a.append(a[apart])
                self.b.append(b[apart])
                self.held += int(apart.sum())
                if self.held > CELLS:
                    self.settle()

    def settle(self) -> np.ndarray:
        """The least place of each place's component."""
        label = self.label
        if self.held:
            a, b = np.concatenate(self.a), np.concatenate(self.b)
            while True:
                x, y = label[a], label[b]
                apart = x != y
                if not apart.any():
                    break
                np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
                while not np.array_equal(further := label[label], label):
                    label = further
            self.label, self.a, self.b, self.held = label, [], [], 0
        return label


def link(points: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int, forest: Forest) -> None:
    """Link each of `queries` with each of `members` (places in points) within the radius, by a local tree."""
    stack = [(members, queries, 0)]
    while stack:
        m, q, level = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > LEAF and level < 48:
            v = points[m[len(m) // 2]]
            dm, dq = distance(points[m], v).astype(np.int64), distance(points[q], v).astype(np.int64)
            mu = int(np.median(dm))
            if dm.max() > mu:
                stack.append((m[dm <= mu], q[dq - radius <= mu], level + 1))
                stack.append((m[dm > mu], q[dq + radius > mu], level + 1))
                continue
        step = max(1, CELLS // len(m))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, j = np.nonzero(distance(points[part][:, None], points[m][None, :]) <= radius)
            forest.add(part[i], m[j])


def links(fps: DataFrame, rows: int, *, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """a, b: a spanning forest, by shard, of the links among the distinct fingerprints `fps` (fp; rows of them)."""
    depth = bits_for(rows, shard)
    share = min(1.0, SAMPLE / max(rows, 1))
    sample = fps.filter(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()["fp"].to_numpy() if depth else np.array([], np.int64)
    tree = ShardTree(np.sort(sample).view(np.uint64)[np.random.default_rng(SEED).permutation(len(sample))], depth)
    shards = 1 << depth
    #: Queries from elsewhere grow with the depth; they are dealt to so many tasks that each has a few times its members.
    salts = max(1, round(1.68**depth / 8))

    def route(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            home = tree.homes(x)
            at, to = tree.visits(x, radius)
            turn = (to - home[at]) % shards
            ask = (turn > 0) & ((turn * 2 < shards) | ((turn * 2 == shards) & (home[at] < to)))
            at, to = at[ask], to[ask]
            own = np.repeat(np.arange(len(x)), salts)
            fp = np.concatenate([x[own], x[at]]).view(np.int64)
            key = np.concatenate([home[own] * salts + np.tile(np.arange(salts), len(x)), to * salts + (x[at] % np.uint64(salts)).astype(np.int64)])
            member = np.concatenate([np.ones(len(own), bool), np.zeros(len(at), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(member)], ["shard", "fp", "member"])

    def within(group: pa.Table) -> pa.Table:
        points = group["fp"].to_numpy().astype(np.int64).view(np.uint64)
        member = group["member"].to_numpy(zero_copy_only=False)
        order = np.argsort(points, kind="stable")
        points, member = points[order], member[order]
        forest = Forest(len(points))
        members, queries = np.flatnonzero(member), np.flatnonzero(~member)
        link(points, members, queries, radius, forest)
        key = group["shard"][0].as_py()
        mine = members[points[members] % np.uint64(salts) == np.uint64(key % salts)] if salts > 1 else members
        link(points, members, mine, radius, forest)
        root = forest.settle()
        apart = np.flatnonzero(root != np.arange(len(root)))
        signed = points.view(np.int64)
        return pa.table({"a": pa.array(signed[apart]), "b": pa.array(signed[root[apart]])})

    routed = fps.select("fp").mapInArrow(route, "shard long, fp long, member boolean")
    return routed.groupBy("shard").applyInArrow(within, "a long, b long")


def grouped(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD, keyed: bool = False) -> DataFrame:
    """doc_id, fp, root (equal within a component), component_id (the smallest doc_id reachable) of every row, and its text_key if asked for."""
    marked = written(fingerprints(docs, shingle, keyed), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    forest = written(links(distinct, distinct.count(), radius=radius, shard=shard), "simhash-links")
    roots = components(forest)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    return grouped(docs, shingle=shingle, radius=radius, shard=shard).select("doc_id", "fp", "component_id")


def hex_of(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their component by doc_id and text. Rows without doc_id stay."""
    return first_of_groups(docs, grouped(docs, keyed=True, **options))


def op4_simhash(spark, sf_dir):
    from terrella.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
