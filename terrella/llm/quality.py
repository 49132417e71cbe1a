"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled 1; unlabelled text is a sample of training documents whose labels are
not looked at; rows labelled 0 are never used. The class prior is estimated from these two alone: a classifier tells positives from unlabelled
text on one half of the sample, and on the other half the prior is the least share of unlabelled over share of positive texts above any of
its thresholds, the threshold being chosen with allowance for chance, as almost only positives stand above a high one. Then a linear model over
text features minimises the non-negative unbiased risk

    prior * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_positive[loss(-)])

with the logistic loss; where the second part falls below zero, the step goes against it instead. Features are shares of bytes
and a few statistics of words and lines; none comes from labels, language, source or id. Only features of the
bounded sample reach the driver, each different row once; scoring is one pass over the texts without a shuffle.

Cases: a null text counts as empty and is scored by features that are all zero; texts of any length are read whole; repeated rows each give a row; an empty table gives no
rows; without any labelled positive or without training texts every score is 0.5; other columns are dropped.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.llm.common import batches, text_of

#: Documents that the model is fitted on, at most about: positives, unlabelled.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 12_000, 24_000
THRESHOLD = 0.3
BYTES = 128
STATISTICS = 14
WIDTH = BYTES + STATISTICS


def features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        data = text.encode()
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
        row[:BYTES] = np.sqrt(counts[:BYTES])
        words, lines = text.split(), text.split("\n")
        n = len(words)
        common = Counter(words).most_common(3) if n else [("", 0)]
        lower, upper, digits = counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum()
        letters = lower + upper + counts[128:].sum()
        row[BYTES:] = (
            lower, upper, digits, letters, counts[128:].sum(), 1 - letters - digits - counts[32] - counts[9:14].sum(),
            upper / (lower + upper + 1e-3),
            sum(map(operator.eq, words, words[1:])) / max(1, n - 1),
            common[0][1] / max(1, n) * (n >= 8),
            sum(c for _, c in common) / max(1, n) * (n >= 8),
            len(data) / max(1, n) / 20,
            np.log1p(n) / 10,
            1 - len(set(lines)) / len(lines),
            np.log1p(len(data) / len(lines)) / 10,
        )
    return out


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the last one is the bias) of least non-negative risk."""

    def slope(p: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        return prior * (p.T @ (sp - 1)) / len(p) + grad_negative if negative >= 0 else -grad_negative

    return _minimised(slope, positive, unlabelled, float(np.log(prior / (1 - prior))), steps, rate, decay)


def apart(positive: np.ndarray, unlabelled: np.ndarray, *, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of a classifier that tells positives from unlabelled texts, both counting the same."""

    def slope(p: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (u.T @ (1 / (1 + np.exp(-(u @ w)))) / len(u) - p.T @ (1 / (1 + np.exp(p @ w))) / len(p)) / 2

    return _minimised(slope, positive, unlabelled, 0.0, steps, rate, decay)


def _minimised(slope, positive: np.ndarray, unlabelled: np.ndarray, bias: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Descent with averaged moments and a falling rate over standardised features."""
    centre, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.hstack([np.clip((x - centre) / scale, -8, 8), np.ones((len(x), 1))]).astype(np.float64) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = bias
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = slope(p, u, w) + decay * np.append(w[:-1], 0)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        w = w - rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return centre, scale, w


def margins(x: np.ndarray, model: tuple) -> np.ndarray:
    centre, scale, w = model
    return (np.clip((x - centre) / scale, -8, 8) * w[:-1]).sum(1) + w[-1]  # row by row, so that equal texts score the same in any batch


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, *, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows. Even rows fit a classifier, odd rows are measured; doubt: chance of a bound that fails."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    model = apart(positive[::2], unlabelled[::2])
    p, u = np.sort(margins(positive[1::2], model)), np.sort(margins(unlabelled[1::2], model))
    above_p = 1 - np.arange(len(p)) / len(p)
    above_u = 1 - np.searchsorted(u, p, side="left") / len(u)
    chance = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(((above_u + chance) / above_p).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def sampled(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most so many positive and unlabelled training rows, in an order that follows their content."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality = 1 and doc_id is not null").filter(~held_out("doc_id"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null").filter(~held_out("doc_id"))
    marked, rows = labels.count(), docs.count()

    def run(batch_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows, 8_000_000, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in features(text_of(batch.column(1)))], pa.binary())], ["mark", "x"])

    def chosen(of: DataFrame, most: int, among: float, salt: int) -> np.ndarray:
        """A share of the rows by a hash of id and text, equal rows once; where ids or texts repeat so much that it is more than asked for, the first by that hash."""
        mark = F.xxhash64(F.lit(salt), "doc_id", "text")
        share = int(min(1.0, most / max(among, 1.0)) * (1 << 30))
        part = of.filter(F.pmod(mark, F.lit(1 << 30)) < share).select(mark.alias("mark"), "text").dropDuplicates(["mark"])
        found = part.mapInArrow(run, "mark long, x binary").orderBy("mark").limit(2 * most).toArrow()
        return np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, WIDTH)

    positive = own.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    return chosen(positive, positives, marked, 1), chosen(own, unlabelled, 0.8 * rows, 2)


def train(docs: DataFrame, labels: DataFrame, *, positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED) -> tuple:
    """A model from training rows only; returns what `score` takes."""
    p, u = sampled(docs, labels, positives, unlabelled)
    if not len(p) or not len(u):
        return None, 0.5
    prior = class_prior(p, u)
    return fit(p, u, prior), prior


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    weights, prior = model

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4_000_000, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(text_of(batch.column(2)), weights, prior), pa.float64())], ["doc_id", "held_out", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def scores(texts: list[str], weights: tuple | None, prior: float) -> np.ndarray:
    if weights is None:
        return np.full(len(texts), prior)
    return 1 / (1 + np.exp(-margins(features(texts), weights)))


def keep(docs: DataFrame, model: tuple) -> DataFrame:
    """The rows of `docs`, all columns, that the model does not reject."""
    weights, prior = model
    names = docs.columns
    at = names.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4_000_000, "text"):
            yield batch.filter(pa.array(scores(text_of(batch.column(at)), weights, prior) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op9_pu_quality(spark, sf_dir):
    from terrella.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
