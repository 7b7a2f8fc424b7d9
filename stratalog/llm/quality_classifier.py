"""Operator 13, quality classifier by positive-unlabelled learning.

Trusted positives are the documents that labels call good; all training documents together are the unlabelled text, good
and bad, and no label says which is bad. With the share p of good text among it (the class prior) the risk of a scorer g is

    p * E_good[l(g)] + max(0, E_all[l(-g)] - p * E_good[l(-g)]),   l(z) = log(1 + exp(-z)),

whose second term stands for the bad documents and must not fall below 0 (non-negative unbiased risk). g is linear in the
text's figures (``text_features``), set to mean 0 and spread 1 over all training documents. Newton steps take the risk down;
of the step's lengths that keep the second term from falling below 0 the best is taken, and where none is better, the fit
ends. Each round of steps is one Spark job over all training rows, whose sums have a size that the figures alone decide.

The prior comes from the scores themselves (best bin estimation): above a cut that good documents pass with share a, and all
documents with share b, at most b / a of all are good; the cut with the least upper confidence bound is taken, over all
rows. Fit and estimate take turns until the prior settles.

Defined cases: an empty or null text is scored by its figures, which say that it is empty; a null doc_id is a training row
without a label; a label counts for each row of its id, and an id with labels of both kinds isn't trusted; without a
trusted document every score is 0.5; repeated rows count one by one; an empty table gives no row; other columns are not
carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .encode import chunks
from .text_features import NAMES, figures

FOLDS, HELD_OUT = 3, 1
#: Ridge: its own weight, and one that fades with the number of trusted documents.
RIDGE, RIDGE_FEW = 0.03, 20.0
#: Lengths of a step that one job tries.
LENGTHS = (1.0, 0.5, 0.25, 0.0625)
#: A fit ends when a step lowers the risk by less than this share; the prior has settled when it moves by less than this.
SETTLED, PRIOR_SETTLED, MOST_STEPS, MOST_PRIORS = 1e-4, 0.005, 25, 8
FIRST_PRIOR = 0.5
#: Bins of a score's histogram, chance of a wrong bound, and how far a figure may lie from the mean, in spreads.
BINS, DELTA, FAR = 1024, 0.1, 6.0
#: Rows handled at once.
ROWS = 1 << 14


def trains(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) != HELD_OUT, F.lit(True))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        kept = [batch.column(c) for c in ("doc_id", "train")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([figures(x).tobytes() for x in texts], pa.binary())], names=["doc_id", "train", "x"])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, train, x: the figures of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), trains().alias("train"), "text")
    return stored(rows.mapInArrow(_figures, "doc_id long, train boolean, x binary"), "figures")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Training ids whose every label is 1; no label of a held-out row is read."""
    return labels.where(trains() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def _raw(column: pa.Array) -> Iterator[np.ndarray]:
    rows = column.to_pylist()
    for lo in range(0, len(rows), ROWS):
        part = rows[lo : lo + ROWS]
        yield np.frombuffer(b"".join(part), np.float32).reshape(len(part), -1).astype(np.float64)


def _summed(rows: DataFrame) -> np.ndarray:
    """Sums by place over all tasks, of rows (i, v)."""
    got = rows.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(max(got.column("i").to_pylist(), default=-1) + 1)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def _row(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)), pa.int32()), pa.array(v, pa.float64())], names=["i", "v"])


class Scale:
    """Figures to mean 0 and spread 1, and a constant in front."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, np.inf)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.spread, -FAR, FAR)], axis=1)


def scale_of(train: DataFrame) -> Scale:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * len(NAMES))
        for batch in batches:
            for x in _raw(batch.column(0)):
                total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield _row(total)

    n, *sums = _summed(train.select("x").mapInArrow(run, "i int, v double"))
    first, second = np.array(sums[: len(NAMES)]) / max(n, 1), np.array(sums[len(NAMES) :]) / max(n, 1)
    return Scale(first, np.sqrt(np.maximum(second - first * first, 0)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Sums:
    """What one pass gives for one weight vector: over all rows their number, l(-g), its gradient and curvature; over good
    rows their number, l(g), l(-g) and the mean direction."""

    @staticmethod
    def of(z: np.ndarray, good: np.ndarray, w: np.ndarray) -> np.ndarray:
        g = z @ w
        p = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
        u, t = ~good, good
        curve = (z[u] * (p[u] * (1 - p[u]))[:, None]).T @ z[u]
        return np.concatenate([[u.sum(), softplus(g[u]).sum(), t.sum(), softplus(-g[t]).sum(), softplus(g[t]).sum()], z[u].T @ p[u], z[t].sum(0), curve.reshape(-1)])

    def __init__(self, flat: np.ndarray, prior: float, w: np.ndarray):
        k = len(w)
        n_all, over, n_good, loss, against = flat[:5]
        self.n_good, self.ridge = n_good, RIDGE + RIDGE_FEW / max(n_good, 1)
        self.bad_risk = over / n_all - prior * against / n_good
        weights = np.concatenate([[0], w[1:]])
        self.risk = prior * loss / n_good + max(0.0, self.bad_risk) + self.ridge / 2 * weights @ weights
        gradient = flat[5 : 5 + k] / n_all - prior * flat[5 + k : 5 + 2 * k] / n_good + self.ridge * weights
        curve = flat[5 + 2 * k :].reshape(k, k) / n_all + np.diag([1e-6, *[self.ridge] * (k - 1)])
        self.step = -np.linalg.solve(curve, gradient)


def passed(rows: DataFrame, scale: Scale, candidates: list[np.ndarray]) -> list[np.ndarray]:
    """One job over rows (x, good): the sums of every candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), bool)
            for k, x in enumerate(_raw(batch.column(0))):
                z, own = scale.of(x), good[k * ROWS : (k + 1) * ROWS]
                total = total + np.concatenate([Sums.of(z, own, w) for w in candidates])
        if np.ndim(total):
            yield _row(total)

    return np.split(_summed(rows.mapInArrow(run, "i int, v double")), len(candidates))


def fit(rows: DataFrame, scale: Scale, prior: float) -> np.ndarray:
    """Weights of least non-negative unbiased risk under a prior."""
    w = np.zeros(1 + len(NAMES))
    now = Sums(passed(rows, scale, [w])[0], prior, w)
    for _ in range(MOST_STEPS):
        tried = [w + t * now.step for t in LENGTHS]
        found = [Sums(flat, prior, v) for flat, v in zip(passed(rows, scale, tried), tried, strict=True)]
        allowed = [(s.risk, k) for k, s in enumerate(found) if s.bad_risk >= 0]
        if not allowed or not min(allowed)[0] < now.risk - SETTLED * abs(now.risk):
            return w
        best = min(allowed)[1]
        w, now = tried[best], found[best]
    return w


def best_bin(good: np.ndarray, every: np.ndarray) -> float:
    """The class prior from two histograms over the same score bins, low scores first."""
    above_good, above_all = (np.cumsum(x[::-1]) for x in (good, every))
    a, b = above_good / above_good[-1], above_all / above_all[-1]
    wide = sum(np.sqrt(np.log(4 / DELTA) / (2 * n)) for n in (above_good[-1], above_all[-1]))
    held = a > 0
    a, b = a[held], b[held]
    k = ((b + wide) / a).argmin()
    return float(min(1.0, max(b[k] / a[k], 1 / BINS)))


def prior_of(rows: DataFrame, scale: Scale, w: np.ndarray) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BINS)
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), bool)
            for k, x in enumerate(_raw(batch.column(0))):
                at = np.minimum((scored(scale.of(x), w) * BINS).astype(np.int64), BINS - 1)
                total += np.bincount(at + BINS * good[k * ROWS : (k + 1) * ROWS], minlength=2 * BINS)
        yield _row(total)

    counts = _summed(rows.mapInArrow(run, "i int, v double"))
    return best_bin(counts[BINS:], counts[:BINS])


def scored(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))


class Model:
    def __init__(self, scale: Scale, weights: np.ndarray, prior: float):
        self.scale, self.weights, self.prior = scale, weights, prior


def train(features: DataFrame, labels: DataFrame) -> Model | None:
    """None where no trusted document is there."""
    own = features.where("train")
    good = stored(own.join(trusted_ids(labels), "doc_id", "left_semi").select("x", F.lit(True).alias("good")), "trusted")
    if good.isEmpty():
        return None
    scale = scale_of(own)
    rows = own.select("x", F.lit(False).alias("good")).unionByName(good)
    prior = FIRST_PRIOR
    for _ in range(MOST_PRIORS):
        weights = fit(rows, scale, prior)
        last, prior = prior, prior_of(rows, scale, weights)
        if abs(prior - last) < PRIOR_SETTLED:
            break
    return Model(scale, weights, prior)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document row."""
    features = featured(docs)
    model = train(features, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([scored(model.scale.of(x), model.weights) for x in _raw(batch.column(2))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "train", "score"])

    out = features.withColumn("score", F.lit(0.5)) if model is None else features.mapInArrow(run, "doc_id long, train boolean, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
