"""Exact top-k search by inner product: ball-tree branch and bound per shard.

Vectors are dealt to the nearest of a bounded number of coarse balls, whose centres are the leaves of a ball tree over a
bounded sample; a ball of many vectors is cut into shards of bounded size, so a hot ball is never one task. Every shard
has a tree of its own whose nodes are balls (centre, radius); for a query q no vector in a ball scores above
q.centre + |q| * radius. A query first searches the coarse ball with the largest bound. The kth score found there goes
with it to the other coarse balls, but only to those whose bound reaches it. Within a shard, children with the larger
bound are visited first and a ball is left out for every query whose bound stays below its current kth score. Queries
of a shard are dealt to tasks in groups of bounded size; the shard's vectors are repeated for each group, and vectors of
shards that no query reaches are not moved.

Cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
score over their common length; equal scores rank by id; rows that share the query's id are not its candidates; equal query rows count once;
fewer than k candidates give all; an empty table gives no rows; other columns are dropped. Scores are
exact while they stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrella.llm.common import bits_for, written

#: Vectors a shard holds on average, vectors of a leaf, queries that one task answers for a shard.
SHARD, LEAF, QUERIES = 16_384, 96, 8_192
#: Coarse balls at most (a power of two), and vectors of the sample that their centres come from. Both bound what the driver holds.
COARSE, SAMPLE = 1_024, 16_384
#: Vectors that are held against all coarse balls at once, and rows of one batch of routed queries.
HELD, ROUTED = 256, 4_096


def reach(queries: np.ndarray, length: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that each query can score in each ball, with room for rounding."""
    most = queries @ centres.T + length[:, None] * radii
    return most + 1e-9 * length[:, None] * (radii + np.sqrt((centres * centres).sum(1))) + 1e-6


class BallTree:
    """Nodes in preorder: start and stop of its run of rows, centre, radius, right child (0: a leaf)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, np.ndarray, float, int]] = []
        self._build(vectors, order, 0, len(ids), leaf)
        self.ids, self.vectors = ids[order], vectors[order]

    def _build(self, x: np.ndarray, order: np.ndarray, start: int, stop: int, leaf: int) -> int:
        rows = x[order[start:stop]]
        centre = rows.mean(0)
        away = rows - centre
        node = len(self.nodes)
        self.nodes.append((start, stop, centre, float(np.sqrt((away * away).sum(1).max())), 0))
        if stop - start > leaf:
            pole = away[int((away * away).sum(1).argmax())]
            side = away @ pole
            middle = (stop - start) // 2
            part = np.argpartition(side, middle)
            if side.min() < side.max():
                order[start:stop] = order[start:stop][part]
                self._build(x, order, start, start + middle, leaf)
                right = self._build(x, order, start + middle, stop, leaf)
                self.nodes[node] = (*self.nodes[node][:4], right)
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores: for each query its k best by score, then id, among those of at least its floor."""
        best = np.full((len(queries), k), -np.inf)
        kth = floor.copy()
        length = np.sqrt((queries * queries).sum(1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            _, _, centre, radius, _ = self.nodes[node]
            return reach(queries[who], length[who], centre[None, :], np.array([radius]))[:, 0]

        everyone = np.arange(len(queries))
        stack = [(0, everyone, bound(0, everyone))] if self.nodes else []
        while stack:
            node, who, most = stack.pop()
            who = who[most >= kth[who]]
            if not len(who):
                continue
            start, stop, _, _, right = self.nodes[node]
            if right:
                parts = [(child, who, bound(child, who)) for child in (node + 1, right)]
                stack += sorted(parts, key=lambda p: float(p[2].sum()))
                continue
            for at in range(start, stop, 4_096):
                ids = self.ids[at : min(stop, at + 4_096)]
                scores = queries[who] @ self.vectors[at : at + len(ids)].T
                scores[own[who][:, None] == ids[None, :]] = -np.inf
                i, j = np.nonzero((scores >= kth[who][:, None]) & (scores > -np.inf))
                if len(i):
                    found.append((who[i], ids[j], scores[i, j]))
                    hit = np.unique(i)
                    both = np.concatenate([best[who[hit]], scores[hit]], axis=1)
                    both.partition(both.shape[1] - k, axis=1)
                    best[who[hit]] = both[:, -k:]
                    kth[who[hit]] = np.maximum(kth[who[hit]], both[:, -k])
        if not found:
            empty = np.array([], np.int64)
            return empty, empty, empty.astype(float)
        q, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        good = scores >= kth[q]
        q, ids, scores = q[good], ids[good], scores[good]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], ids[rank < k], scores[rank < k]


def whole(embedding: Column, scale: float) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    out = np.zeros((len(rows), width))
    sizes = np.asarray(rows.value_lengths())
    flat = rows.flatten().to_numpy().astype(np.float64)
    out[np.repeat(np.arange(len(rows)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _search_group(k: int):
    def run(group: pa.Table) -> pa.Table:
        member = group["member"].to_numpy(zero_copy_only=False)
        width = max(1, max((len(v) for v in group["v"]), default=1))
        x, ids = _matrix(group["v"], width), group["vec_id"].to_numpy()
        floor = group["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
        q = np.flatnonzero(~member)
        tree = BallTree(ids[member], x[member]) if member.any() and len(q) else None
        if tree is None:
            return pa.table({"query_id": pa.array([], pa.int64()), "qkey": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        at, found, scores = tree.search(x[q], ids[q], k, np.where(np.isnan(floor[q]), -np.inf, floor[q]))
        return pa.table({"query_id": pa.array(ids[q][at]), "qkey": pa.array(group["qkey"].to_numpy()[q][at]), "vec_id": pa.array(found), "score": pa.array(scores.astype(np.int64))})

    return run


class CoarseBalls:
    """Centres from a sample's ball tree. Once every vector is dealt to its nearest centre, their radii and shards."""

    def __init__(self, sample: np.ndarray, balls: int):
        tree = BallTree(np.arange(len(sample)), sample, max(1, -(-len(sample) // balls))) if len(sample) else None
        leaves = [node[2] for node in tree.nodes if not node[4]] if tree else [np.zeros(sample.shape[1])]
        self.centres = np.array(leaves)
        self.radii, self.first, self.shards = np.zeros(len(leaves)), np.zeros(len(leaves), np.int64), np.zeros(len(leaves), np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ball = ((self.centres * self.centres).sum(1) - 2 * (x @ self.centres.T)).argmin(1)
        away = x - self.centres[ball]
        return ball, np.sqrt((away * away).sum(1))

    def settle(self, ball: np.ndarray, radius: np.ndarray, rows: np.ndarray, shard: int) -> None:
        self.radii[ball] = radius
        self.shards[ball] = -(-rows // shard)
        self.first = np.cumsum(self.shards) - self.shards

    def visits(self, x: np.ndarray, floor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and shards they visit: those of the ball with the largest bound, or, with a floor, of all others that reach it."""
        most = reach(x, np.sqrt((x * x).sum(1)), self.centres, self.radii)
        most[:, self.shards == 0] = -np.inf
        best = most.argmax(1)
        if floor is None:
            at, ball = np.arange(len(x)), best
        else:
            most[np.arange(len(x)), best] = -np.inf
            at, ball = np.nonzero((most >= floor[:, None]) & (most > -np.inf))
        times = self.shards[ball]
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at, times), np.repeat(self.first[ball], times) + part


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, HELD) for batch in batches for at in range(0, batch.num_rows, HELD))


def _dealt(rows: DataFrame, balls: CoarseBalls, width: int) -> DataFrame:
    """`rows` with their ball and their distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            ball, away = balls.nearest(_matrix(pa.chunked_array([batch.column("v")]), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball.astype(np.int64)), pa.array(away)], [*batch.schema.names, "ball", "away"])

    return rows.mapInArrow(run, "vec_id long, qkey long, spread long, asked boolean, v array<long>, ball long, away double")


def _routed(asked: DataFrame, balls: CoarseBalls, width: int, first: bool) -> DataFrame:
    """A row of `asked` (vec_id, qkey, v, floor) for each shard that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            floor = np.nan_to_num(batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            at, shard = balls.visits(_matrix(pa.chunked_array([batch.column("v")]), width), None if first else floor)
            for a in range(0, len(at), ROUTED):
                yield pa.RecordBatch.from_arrays([pa.array(shard[a : a + ROUTED]), *(c.take(pa.array(at[a : a + ROUTED])) for c in batch.columns)], ["shard", *batch.schema.names])

    return asked.mapInArrow(run, "shard long, vec_id long, qkey long, v array<long>, floor double")


def top_k(vectors: DataFrame, queries: Column, *, k: int = 20, scale: float = 64.0, shard: int = SHARD, per_task: int = QUERIES, coarse: int = COARSE) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products of each row that `queries` holds of with all other rows."""
    spread = F.floor(F.rand(11) * (1 << 31)).alias("spread")
    rows = vectors.filter(usable(F.col("embedding"))).filter(F.col("vec_id").cast("long").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), spread, F.coalesce(queries, F.lit(False)).alias("asked"), whole(F.col("embedding"), scale).alias("v"))
    rows = rows.select("vec_id", F.xxhash64("vec_id", "v").alias("qkey"), "spread", "asked", "v")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).first()
    n, width = size["n"], max(1, size["width"])
    sample = rows.filter(F.rand(13) < min(1.0, SAMPLE / max(n, 1))).select("v").toArrow()["v"]
    balls = CoarseBalls(_matrix(sample, width), min(coarse, 1 << bits_for(n, shard)))
    rows = written(_dealt(rows, balls, width), "vectors")
    extent = rows.groupBy("ball").agg(F.max("away").alias("radius"), F.count("*").alias("n")).toArrow()
    balls.settle(extent["ball"].to_numpy(), extent["radius"].to_numpy(), extent["n"].to_numpy(), shard)

    spark = rows.sparkSession
    plan = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(balls.first, balls.shards, strict=True))], "ball long, first long, shards long")
    members = rows.join(F.broadcast(plan), "ball").select((F.col("first") + F.col("spread") % F.col("shards")).alias("shard"), "vec_id", "qkey", "v")
    asked = written(rows.filter("asked").dropDuplicates(["vec_id", "qkey"]).select("vec_id", "qkey", "v", F.lit(None).cast("double").alias("floor")), "vectors-asked")
    out = "query_id long, qkey long, vec_id long, score long"
    search = _search_group(k)

    def searched(asking: DataFrame, first: bool) -> DataFrame:
        routed = _routed(asking, balls, width, first)
        tasks = written(routed.groupBy("shard").agg((F.floor((F.count("*") - 1) / F.lit(per_task)) + 1).alias("tasks")), "vectors-tasks")
        query = routed.join(tasks, "shard").select("shard", F.pmod(F.xxhash64(F.lit(5), "qkey"), F.col("tasks")).alias("task"), "vec_id", "qkey", "v", "floor", F.lit(False).alias("member"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task")
        member = members.join(tasks, "shard").select("shard", each, "vec_id", "qkey", "v", F.lit(None).cast("double").alias("floor"), F.lit(True).alias("member"))
        found = member.unionAll(query).groupBy("shard", "task").applyInArrow(search, out)
        best = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    near = written(searched(asked, True), "vectors-near")
    kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "qkey", F.col("score").cast("double").alias("floor"))
    floored = written(asked.drop("floor").join(kth, ["vec_id", "qkey"], "left").select("vec_id", "qkey", "v", "floor"), "vectors-floors")
    found = near.drop("rank").unionAll(searched(floored, False).drop("rank")) if (balls.shards > 0).sum() > 1 else near.drop("rank")
    best = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_ball_tree(spark, sf_dir):
    from terrella.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


OP2_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
