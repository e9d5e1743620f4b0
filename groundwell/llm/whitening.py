"""Whitening of embeddings by a compensated covariance.

Vectors are put on a grid of whole numbers, ``floor(scale * c)``; each distinct one counts once (the fit list). Its number and sums are exact. Means are
kept as unevaluated sums of two doubles, entries are centred by error-free differences, and centred outer products are accumulated in double-double: each
block of centred rows is split into slices of so few bits that every product of two slices is exact, which leaves the work to ordinary matrix
products, and the products are added with their rounding errors kept. High and low parts of all tasks are merged the same way, a row of the matrix at a time. The
driver gets one matrix and solves it by LAPACK's ``syevd``: reduction to tridiagonal form, then divide and conquer.

What tasks and the driver hold is bounded by the square of the dimension, whatever the number of vectors.

Defined results: rows are left out if their vector is null or empty, holds null or non-finite entries, or is not of the most frequent length (of equally frequent
ones the largest); grid values saturate at 64 bits; repeated vectors and rows give equal results, and a null id is a value like any other; a component
without variance (as when all vectors are alike) has a null ``whitened`` and is left out of ``identity_error``, which is null if no component is left; ``explained``
is null if there is no variance at all; ``deviation`` is null beyond 38 digits; there are as many components as dimensions if that is fewer; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.shared import bound_batches, quoted, schema_with_id, stored

#: Rows of a block, and bits of a slice: a sum of that many products of two slices has 53 bits at most.
_ROWS, _BITS = 1024, 21
_SLICES = 5
_OUT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(hi: np.ndarray, lo: np.ndarray, more_hi: np.ndarray, more_lo: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(hi, more_hi)
    t, f = two_sum(lo, more_lo)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def as_double_double(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of 64 bits without an error; doubles as they are."""
    if x.dtype.kind == "f":
        return x, np.zeros_like(x)
    return two_sum(((x >> 32) << 32).astype(np.float64), (x & 0xFFFFFFFF).astype(np.float64))


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return dd_add(*as_double_double(x), -mean[0], -mean[1])


def outer_products(hi: np.ndarray, lo: np.ndarray) -> Iterator[np.ndarray]:
    """Exact matrices whose sum is the sum of outer products of the rows ``hi + lo``, but for what lies 105 bits below the largest entries."""
    unit = np.ldexp(1.0, np.frexp(np.abs(hi).max(axis=0))[1] - _BITS)
    pieces = []
    for _ in range(_SLICES):
        s = np.rint(hi / unit) * unit
        pieces.append(s)
        hi, lo = two_sum(hi - s, lo)
        unit = unit * 2.0**-_BITS
    for i in range(_SLICES):
        for j in range(i, _SLICES - i):
            p = pieces[i].T @ pieces[j]
            yield p if i == j else p + p.T


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            yield _matrix(batch.column(0).slice(a, _ROWS))


def covariance(vectors: DataFrame, n: int, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the covariance (divisor ``n``) of the only column of ``vectors``, arrays of one length."""
    d = len(mean[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi = lo = np.zeros((d, d))
        for x in _blocks(batches):
            for p in outer_products(*centred(x, mean)):
                hi, lo = dd_add(hi, lo, p)
        yield _rows(dict(enumerate(zip(hi, lo, strict=True))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, hi, lo in zip(batch.column("i").to_pylist(), *(_matrix(batch.column(k)) for k in ("hi", "lo")), strict=True) if batch.num_rows else ():
                sums[i] = dd_add(*sums[i], hi, lo) if i in sums else (hi, lo)
        yield _rows(sums)

    kind = "i int, hi array<double>, lo array<double>"
    found = vectors.mapInArrow(run, kind).repartition("i").mapInArrow(merge, kind).toArrow().sort_by("i")
    hi, lo = (_matrix(found.column(k).combine_chunks()) for k in ("hi", "lo"))
    q = hi / n
    return q, ((hi - q * n) + lo) / n


def _rows(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    arrays = [pa.array([x[k] for x in sums.values()], pa.list_(pa.float64())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *arrays], ["i", "hi", "lo"])


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of arrays of whole numbers in the only column, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for x in _blocks(batches):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array([n] * len(high)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    parts = vectors.mapInArrow(run, "i int, n bigint, high bigint, low bigint")
    wide = [F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in ("n", "high", "low")]
    found = parts.groupBy("i").agg(*wide).toArrow().sort_by("i").to_pylist()
    return int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def grid(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``x`` of the rows that stay."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vec_col)).cast("array<double>").alias("v"))
    rows = rows.where(F.coalesce(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1)
    d = next((r.d for r in length.collect()), -1)
    return rows.where(F.size("v") == d).select("id", F.transform("v", lambda c: F.floor(c * scale).cast("bigint")).alias("x"))


class Model:
    """Components fitted on the distinct vectors of a grid: count, exact sums, mean, vectors, eigenvalues, shares of the variance and the error of the identity."""

    def __init__(self, fit: DataFrame, components: int):
        self.n, self.sums = exact_sums(fit)
        high = [float(Fraction(s, self.n)) for s in self.sums]
        self.mean = np.array(high), np.array([float(Fraction(s, self.n) - Fraction(h)) for s, h in zip(self.sums, high, strict=True)])
        hi, lo = covariance(fit, self.n, self.mean)
        values, vectors = np.linalg.eigh(hi + lo)
        order = np.argsort(values)[::-1][:components]
        vectors = vectors[:, order]
        self.vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))])
        trace = math.fsum([*np.diag(hi), *np.diag(lo)])
        self.values = np.where(values[order] > len(hi) * np.finfo(float).eps * max(trace, 0.0), values[order], 0.0)
        self.explained = [float(v) / trace if trace > 0 else None for v in self.values]
        self.identity_error = self._identity_error(fit)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections on the components that have variance; zero on the others."""
        d, e = centred(x, self.mean)
        return np.divide(d @ self.vectors + e @ self.vectors, np.sqrt(self.values), out=np.zeros((len(x), len(self.values))), where=self.values > 0)

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum of (n * x - sum) ** 2 over the dimensions, exact."""
        largest = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums))
        if len(self.sums) * largest**2 < 1 << 63:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1)
        off = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 10**38 else None for v in (off * off).sum(axis=1)]

    def _identity_error(self, fit: DataFrame) -> float | None:
        real = np.flatnonzero(self.values > 0)
        if not len(real):
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(list(self.whitened(x)[:, real]), pa.list_(pa.float64()))], ["y"])

        y = stored(fit.mapInArrow(run, "y array<double>"), "whitened")
        mean = np.array(y.agg(*(F.avg(F.col("y")[k]).alias(str(k)) for k in range(len(real)))).first())
        hi, lo = covariance(y, self.n, (mean, np.zeros(len(real))))
        return float(np.abs(hi - np.eye(len(real)) + lo).max())


def whiten(df: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each remaining row of ``df`` and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = grid(df, scale, id_col, vec_col)
    schema = schema_with_id(rows, _OUT)
    fit = stored(rows.select("x").distinct(), "fit-list")
    if not fit.limit(1).count():
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return rows.mapInArrow(_projection(Model(fit, components), schema.names), schema).withColumnRenamed("id", id_col)


def _projection(model: Model, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    r = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                own = batch.slice(a, _ROWS)
                x = _matrix(own.column("x"))
                each, which = pa.array(np.repeat(np.arange(len(x)), r)), np.tile(np.arange(r), len(x))
                whitened = pa.array(model.whitened(x).ravel(), mask=model.values[which] == 0)
                columns = [own.column("id").take(each), pa.array(which + 1, pa.int32()), pa.array(np.full(len(which), model.n))]
                columns += [_decimals(model.deviations(x)).take(each), whitened, pa.array(model.explained, pa.float64()).take(pa.array(which))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([model.identity_error] * len(which), pa.float64())], names)

    return run


def _decimals(values: list[int] | np.ndarray) -> pa.Array:
    kind = pa.decimal128(38, 0)
    return pa.array(values, kind) if isinstance(values, list) else pa.array(values).cast(kind)
