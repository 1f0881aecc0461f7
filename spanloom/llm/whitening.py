"""Whitening of embeddings by a covariance in double-double (native long sums, Arrow batches, one eigen-solve).

An entry c becomes the whole number x = floor(64 c) + 1000000 (beyond 2**62 it stays there). Four map-only
readings of the table, of which only sums of d x d numbers a task leave:

1. n and the exact sums S of each dimension, as decimals.
2. Outer products of x - S/n, centred in double-double. A block of rows is cut into slices of 21 bits; sums of
   products of two slices over a block are exact in doubles, so the matrix product is an error-free transformation
   (Ozaki, Ogita, Oishi, Rump 2012); the exact parts are added up as pairs (high, low) by error-free sums. Tasks emit
   both parts a row of the matrix, and rows are merged by index in the order of tasks.
3. The covariance of the whitened values themselves, for `identity_error`.
4. The whitened rows.

The eigen-solve is LAPACK's symmetric divide and conquer (reduction to tridiagonal form, Cuppen's splitting with
deflation), as numpy.linalg.eigh calls it, over one d x d matrix on the driver. d is bounded by DIMENSIONS, not by rows.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry go; vectors of another length
than the commonest (of equals: the longest) go as well; a null or repeated vec_id is carried; repeated rows count each;
other columns are never read; an empty table, or one without a vector left, gives no row. A component whose eigenvalue is
zero to working precision has null whitened values; where all are, identity_error is null as well, and explained is null
where the trace is zero. Of either sign of a component, its largest entry is positive."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1000000
#: Largest dimension: one task and the driver hold d x d numbers twice.
DIMENSIONS = 4096
#: Rows of a block, bits of a slice: 2 * BITS + log2(BLOCK) must not exceed 53.
BLOCK, BITS, SLICES = 2048, 21, 5
WIDEST = 2.0**62


def whole_numbers(vectors: pa.Array):
    """(places of the rows kept, their x as a matrix) for each length in the array."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is no number
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    good = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    for d in np.unique(lengths[good]):
        at = np.flatnonzero(good & (lengths == d))
        c = entries[((ends - lengths)[at][:, None] + np.arange(d)).ravel()].reshape(-1, d)
        yield at, np.clip(np.floor(SCALE * c), -WIDEST, WIDEST).astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python numbers."""
    return (x if np.abs(x).max() < 1 << 40 else x.astype(object)).sum(0).astype(object)


def totals(rows: DataFrame) -> DataFrame:
    """length, place, n, total: how many vectors have a length, and exact sums by place."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for at, x in whole_numbers(batch.column(1)):
                n, sums = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = [n + len(at), sums + exact_sums(x)]
            if sum(found) > 1 << 20:
                yield from emit(found)
                found = {}
        yield from emit(found)
        common.release()

    def emit(found):
        for d, (n, sums) in found.items():
            values = pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), values], ["length", "place", "n", "total"])

    parts = rows.mapInArrow(run, "length bigint, place bigint, n bigint, total decimal(38, 0)")
    return parts.groupBy("length", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38, 0)").alias("total"))


def two_sum(a, b):
    """a + b as a rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - S/n as high and low parts."""
    means = [Fraction(s, n) for s in sums]
    high = np.array([float(m) for m in means])
    low = np.array([float(m - Fraction(h)) for m, h in zip(means, high.tolist(), strict=True)])
    whole = x.astype(np.float64)
    rest = (x - whole.astype(np.int64)).astype(np.float64) if np.abs(x).max(initial=0) >= 1 << 53 else 0.0
    s, e = two_sum(whole, -high)
    return two_sum(s, e + (rest - low))


class Products:
    """A sum of outer products of rows (high, low), kept as high and low parts."""

    def __init__(self, d: int):
        self.high, self.low = np.zeros((d, d)), np.zeros((d, d))

    def include(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        self.high, e = two_sum(self.high, high)
        self.low += e + low

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        for i in range(0, len(high), BLOCK):
            parts = self.slices(high[i : i + BLOCK], low[i : i + BLOCK])
            for p in range(SLICES):
                for q in range(p, SLICES - p):
                    g = parts[p].T @ parts[q]  # exact
                    self.include(g)
                    if p != q:
                        self.include(g.T)
        self.high, self.low = two_sum(self.high, self.low)

    @staticmethod
    def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        """Parts whose sum is the rows to 105 bits of each column's largest entry; a part has BITS bits."""
        top = np.frexp(np.abs(high).max(0))[1]
        out = []
        for k in range(1, SLICES + 1):
            grain = np.ldexp(1.5, top - k * BITS + 52)  # adding it rounds to whole multiples of 2**(top - k*BITS)
            part = (high + grain) - grain
            out.append(part)
            high, low = two_sum(high - part, low)
        return out


def merged(parts: DataFrame) -> DataFrame:
    """i, high, low: rows of the matrix, added up over tasks in their order; a task holds one row at a time."""

    def run(batches):
        at, sums = None, None
        for batch in batches:
            index = batch.column(0).to_numpy()
            for k in range(batch.num_rows):
                if index[k] != at:
                    if at is not None:
                        yield row(at, sums)
                    at, sums = index[k], Products(0)
                    sums.high = sums.low = 0.0
                sums.include(batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy())
                sums.high, sums.low = two_sum(sums.high, sums.low)
        if at is not None:
            yield row(at, sums)

    def row(at, sums):
        lists = [pa.array([s], pa.list_(pa.float64())) for s in (sums.high, sums.low)]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists], ["i", "high", "low"])

    dealt = parts.repartition("i").sortWithinPartitions("i", "task")
    return dealt.mapInArrow(run, "i bigint, high array<double>, low array<double>")


def products(rows: DataFrame, d: int, of) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sum of outer products of of(x), a pair of parts, over all rows of length d."""

    def run(batches):
        sums = None
        for batch in batches:
            for _, x in whole_numbers(batch.column(1)):
                if x.shape[1] == d:
                    high, low = of(x)
                    sums = sums or Products(high.shape[1])
                    sums.add(high, low)
        if sums is not None:
            r = len(sums.high)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(r + 1) * r, pa.int32()), pa.array(m.ravel())) for m in (sums.high, sums.low)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(r)), pa.array(np.full(r, TaskContext.get().partitionId())), *lists], ["i", "task", "high", "low"])
        common.release()

    parts = rows.mapInArrow(run, "i bigint, task bigint, high array<double>, low array<double>")
    found = merged(parts).orderBy("i").collect()  # d rows
    return np.array([r["high"] for r in found]), np.array([r["low"] for r in found])


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; null ones are 0."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return np.where(values > len(covariance) * np.finfo(float).eps * max(values[0], 0), values, 0.0), vectors


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x - S)**2 a row; null beyond 38 digits."""
    small = np.abs(x).max() * n < 1 << 62 and max(map(abs, sums)) < 1 << 62
    q = (x if small else x.astype(object)) * n - np.array(sums, np.int64 if small else object)
    widest = int(np.abs(q).max())
    if x.shape[1] * widest * widest < 1 << 63:
        return pa.array((q.astype(np.int64) ** 2).sum(1)).cast(pa.decimal128(38, 0))
    values = (q.astype(object) ** 2).sum(1)
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in values], pa.decimal128(38, 0))


SCHEMA = "n bigint, deviation decimal(38, 0), whitened array<double>, explained array<double>, identity_error double"


def whiten(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = 32) -> DataFrame:
    """id, n, deviation, whitened and explained (one entry a component, falling), identity_error, for each vector kept."""
    rows = embeddings.select(F.col(id_column), F.col(column).cast("array<double>"))
    spark, kind = rows.sparkSession, rows.schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {SCHEMA}"
    sums = common.staged(totals(rows), "totals")
    best = sums.filter("place = 0").orderBy(F.desc("n"), F.desc("length")).select("length", "n").limit(1).collect()
    if not best:
        return spark.createDataFrame([], schema)
    d, n = best[0]
    if d > DIMENSIONS:
        raise ValueError(f"{d} dimensions; {DIMENSIONS} at most")
    s = [int(r["total"]) for r in sums.filter(F.col("length") == d).orderBy("place").collect()]
    high, low = products(rows, d, lambda x: centred(x, n, s))
    covariance = (high + low) / n
    values, vectors = eigen(covariance, most)
    trace = float(np.trace(covariance))
    explained = [float(v) / trace if trace > 0 else None for v in values]
    live = values > 0
    project = vectors[:, live] / np.sqrt(values[live])

    def whitened(x):
        h, lo = centred(x, n, s)
        return (h + lo) @ project

    error = None
    if live.any():
        def pair(x):
            y = whitened(x)
            return y, np.zeros_like(y)

        high, low = products(rows, d, pair)
        error = float(np.abs((high + low) / n - np.eye(len(high))).max())
    spread = np.flatnonzero(live)

    def run(batches):
        for batch in batches:
            for at, x in whole_numbers(batch.column(1)):
                if x.shape[1] != d:
                    continue
                y = np.full((len(x), len(values)), np.nan)
                y[:, spread] = whitened(x)
                r = len(values)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * r, pa.int32()), v) for v in (pa.array(y.ravel(), mask=np.isnan(y.ravel())), pa.array(explained * len(x), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(x), n)), deviations(x, n, s), *lists, pa.array([error] * len(x), pa.float64())], [id_column, "n", "deviation", "whitened", "explained", "identity_error"])
        common.release()

    return rows.mapInArrow(run, schema)


def components(embeddings: DataFrame, most: int = 32) -> DataFrame:
    """A row for each vector kept and component; a deviation beyond 64 bits is null."""
    found = whiten(embeddings, most=most)
    each = found.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "v"))
    return each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("v.whitened").alias("whitened"), F.col("v.explained").alias("explained"), "identity_error")
