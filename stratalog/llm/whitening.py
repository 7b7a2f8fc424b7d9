"""Operator 12, embedding whitening by an exact characteristic polynomial.

Entries become integers, so that counts, sums and the scatter matrix are exact whatever the order in which tasks add them
up. The scatter matrix n * sum(y y') - T T' of the vectors y, taken from a centre near the mean, is n * n times their
covariance. Spark tasks work out its characteristic polynomial modulo primes, one row a prime, by Hessenberg reduction;
Chinese remaindering gives the integer coefficients, sign changes isolate the largest roots, and inverse iteration in long
fixed point gives the components (``exact_spectrum``). What reaches the driver depends on the dimension alone. Rows are
read four times, one column each: sums, scatter, the covariance of what comes out, and the output.

Defined cases: a null vector, or one with a null or non-finite entry, is dropped. Where lengths differ, the length that
most rows have is kept (the longer of two equally frequent ones), other rows are dropped. Components without variance are
not numbered, so equal rows, a single row, empty vectors and an empty table give no rows. Repeated rows and null or
repeated ids count one by one. Components of equal variance are some orthonormal basis of their space. A deviation beyond
a long is null. 1024 * c beyond 2**52 in size counts as 2**52. Other columns are not carried, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_spectrum import Roots, combined, eigenvectors, primes_for, residues

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LIMIT = 1 << 52
#: Sums of products below this are exact in doubles; rows handled at once; two halves of a long integer.
EXACT, ROWS, HALF = 1 << 53, 1 << 14, 1 << 60


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the rows, integers as rows) of the vectors without null or non-finite entries."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.array(lists.value_lengths().fill_null(-1), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    odd = np.zeros(len(lengths), bool)
    odd[row[~np.isfinite(flat)]] = True
    for size in np.unique(lengths[~odd & (lengths > 0)]).tolist():
        at = np.flatnonzero(~odd & (lengths == size))
        picked = flat[np.isin(row, at)].reshape(-1, size)
        yield size, at, np.clip(np.floor(picked * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _halves(value: int) -> tuple[int, int]:
    return value // HALF, value % HALF


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, int] = defaultdict(int)
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, at, x in _vectors(batch.column(0)):
            count[size] += len(at)
            total[size] = total.get(size, 0) + x.astype(object).sum(0) if abs(x).max() > 1 << 40 else total.get(size, 0) + x.sum(0).astype(object)
    rows = [(s, i, count[s], *_halves(int(v))) for s, of in total.items() for i, v in enumerate(of)]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["size", "i", "n", "hi", "lo"])


def _wide(column: str):
    return F.sum(F.col(column).cast("decimal(20,0)")).alias(column)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors the fit list has and their sum in each dimension."""
    parts = vectors.mapInArrow(_sums, "size int, i int, n long, hi long, lo long").groupBy("size", "i").agg(F.sum("n").alias("n"), _wide("hi"), _wide("lo"))
    by_size = parts.groupBy("size").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "hi", "lo"))).alias("sums"))
    best = by_size.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()  # one row, as long as a vector
    if not best:
        return 0, []
    return best[0]["n"], [int(s["hi"]) * HALF + int(s["lo"]) for s in best[0]["sums"]]


def _products(y: np.ndarray) -> np.ndarray:
    """y' y as exact integers: by doubles in runs short enough for their sums to be exact, else by long integers."""
    most = int(abs(y).max()) if y.size else 0
    step = EXACT // max(1, most * most)
    if step < 1:
        wide = y.astype(object)
        return wide.T @ wide
    total: np.ndarray | int = 0
    for lo in range(0, len(y), min(step, ROWS)):
        part = y[lo : lo + min(step, ROWS)].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _scatter(centre: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, total = len(centre), None
        for batch in batches:
            for size, _, x in _vectors(batch.column(0)):
                if size == d:
                    found = _products(x - np.array(centre, np.int64))
                    total = found if total is None else total + found
        rows = [] if total is None else [(i, j, *_halves(int(total[i, j]))) for i in range(d) for j in range(i, d)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["i", "j", "hi", "lo"])

    return run


def scatter(vectors: DataFrame, n: int, total: list[int]) -> tuple[np.ndarray, list[int], list[int]]:
    """n * n times the covariance, exact; the centre, and the sums of what is left beside it."""
    d = len(total)
    centre = [(2 * s + n) // (2 * n) for s in total]
    left = [s - n * c for s, c in zip(total, centre, strict=True)]
    rows = vectors.mapInArrow(_scatter(centre), "i int, j int, hi long, lo long").groupBy("i", "j").agg(_wide("hi"), _wide("lo")).collect()  # a row for each pair of dimensions
    matrix = np.zeros((d, d), object)
    for r in rows:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = n * (int(r["hi"]) * HALF + int(r["lo"])) - left[r["i"]] * left[r["j"]]
    return matrix, centre, left


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, highest first; each prime is a row of its own, and rows are dealt over tasks."""
    primes = primes_for(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for lo in range(0, len(own), 16):
                found = residues(matrix, own[lo : lo + 16])
                yield pa.RecordBatch.from_arrays([pa.array(own[lo : lo + 16]), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["prime", "rest"])

    tasks = max(1, min(len(primes) // 4, 2 * spark.sparkContext.defaultParallelism))
    dealt = spark.range(len(primes), numPartitions=tasks).select(F.element_at(F.array(*map(F.lit, primes)), F.col("id").cast("int") + 1).cast("long").alias("prime"))
    rows = dealt.mapInArrow(run, "prime long, rest array<long>").collect()
    return combined([r["prime"] for r in rows], [r["rest"] for r in rows])


class Whitening:
    """What every row needs: the centre, the components' axes and variances. Its size follows the dimension."""

    def __init__(self, n: int, centre: list[int], left: list[int], matrix: np.ndarray, roots: list, axes: np.ndarray):
        self.n, self.centre, self.left = n, np.array(centre, np.int64), left
        self.axes = axes
        self.deviations = np.array([float(r) ** 0.5 / n for r in roots])
        trace = int(matrix.trace())
        self.explained = [float(r / trace) for r in roots]

    def of(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.centre) - np.array([t / self.n for t in self.left])
        return y @ self.axes.T / self.deviations

    def deviation(self, x: np.ndarray) -> list[int | None]:
        y, most = x - self.centre, max(map(abs, self.left), default=0)
        if len(self.centre) * (self.n * int(abs(y).max()) + most) ** 2 < 1 << 63:
            return ((self.n * y - np.array(self.left, np.int64)) ** 2).sum(1).tolist()
        z = self.n * y.astype(object) - np.array(self.left, object)
        return [v if v < 1 << 63 else None for v in (z * z).sum(1).tolist()]


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """From a DataFrame of one column; None where nothing varies."""
    n, total = sums(vectors)
    if not n:
        return None
    matrix, centre, left = scatter(vectors, n, total)
    roots = Roots(characteristic_polynomial(vectors.sparkSession, matrix)).largest(components) if matrix.any() else []
    return Whitening(n, centre, left, matrix, roots, eigenvectors(matrix, roots)) if roots else None


def _gram(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.axes)
        total = np.zeros((k, k))
        for batch in batches:
            for size, _, x in _vectors(batch.column(0)):
                if size == len(model.centre):
                    w = model.of(x)
                    total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; their mean is 0 by the centring."""
    sums_ = vectors.mapInArrow(_gram(model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return sums_.agg(F.max(F.abs(F.col("v") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each kept row and component."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = rows.select(vector)
    model = fit(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(vectors, model), len(model.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _vectors(batch.column(1)):
                if size == len(model.centre):
                    m = len(at)
                    columns = [
                        batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.of(x).reshape(-1)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, vector).mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
