"""Embedding whitening: digit-slice GEMM.

Entries become integers, and the covariance of the integers is exact. A vector is centred as n * x - S, with S the sums
by dimension, which is an integer too. The centred integers are split into digits of 20 bits; products of the digits'
matrices are float64 BLAS products that lose nothing (4,096 rows of products of 38 bits stay below 2**53). A task
recombines the digits' products as big integers; the tasks' integers are summed by Spark, in digits again, for each pair
of dimensions; only the finished matrix, which has the square of the dimensions, goes to the driver, where its
eigenvectors are found and sharpened by Jacobi rotations in extended precision, so that small eigenvalues are as
accurate as large ones.

Rows whose vector is null, or holds null or non-finite entries or entries beyond 2**62 / 64, are left out. The fit list
has one length of vectors: the one that most rows have (the longer of two as frequent); rows of other lengths are left
out, as are vectors without entries. Repeated rows count each time and give rows each time; a null id stays null.
Components whose eigenvalue is below 1e-16 of the trace cannot be told from none: their whitened value is null, and
with a single vector, or equal ones, all are (explained is null as well). deviation is null beyond 38 digits. Without
rows to fit on the result is empty. Other columns of the table are not read.

What grows: nothing but the rows. The model has a vector for each component, and each task gives one row for each pair
of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of a digit in matrix products, rows of one product, and bits of the digits that Spark sums.
BITS, BLOCK, SUM_BITS = 20, 4096, 40
#: Entries are multiplied by SCALE, rounded down, and shifted.
SCALE, SHIFT = 64.0, 1_000_000
#: An eigenvalue below this part of the trace counts as none.
LEAST = 1e-16


@dataclass(frozen=True)
class Model:
    """n vectors with sums by dimension; a column of components for each eigenvalue, falling; bound of |n * x - S|."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    bound: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as int64 where these fit and else as Python's integers."""
        if self.bound < 1 << 62 and self.n * (abs(x).max(initial=0) + 1) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Centred integers projected on the components, with unit variance; NaN where a component has none."""
        far = (y / self.n).astype(np.float64)
        some = self.eigenvalues > max(LEAST * self.trace, 0.0)
        return np.where(some, far @ self.components / np.sqrt(np.where(some, self.eigenvalues, 1.0)), np.nan)


def integers(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, the rows that are whole and their integers (row by dimension)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        with np.errstate(over="ignore"):
            scaled = flat[starts[rows][:, None] + np.arange(d)] * SCALE
        whole = (np.isfinite(scaled) & (np.abs(scaled) < 2.0**62)).all(axis=1)
        if whole.any():
            yield rows[whole], np.floor(scaled[whole]).astype(np.int64) + SHIFT


def digits(y: np.ndarray, count: int) -> list[np.ndarray]:
    """Balanced digits of BITS bits, the least first, as doubles."""
    half, out = 1 << (BITS - 1), []
    for _ in range(count):
        low = ((y + half) & ((1 << BITS) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> BITS
    return out


class Products:
    """The exact matrix of products, summed over rows of integers below a bound."""

    def __init__(self, d: int, bound: int):
        self.d, self.count = d, bound.bit_length() // BITS + 1
        self.total = np.zeros((d, d), object)
        self.open = np.zeros((2 * self.count - 1, d, d), np.int64)
        self.blocks = 0

    def add(self, y: np.ndarray) -> None:
        for i in range(0, len(y), BLOCK):
            limbs = np.concatenate(digits(y[i : i + BLOCK], self.count), axis=1)
            product = (limbs.T @ limbs).astype(np.int64).reshape(self.count, self.d, self.count, self.d)
            for p in range(self.count):
                for q in range(self.count):
                    self.open[p + q] += product[p, :, q, :]
            self.blocks += 1
            if self.blocks * self.count >= 1 << 10:  # 2**50 each, so sums stay below 2**60
                self.recombine()

    def recombine(self) -> np.ndarray:
        for place, part in enumerate(self.open):
            self.total += part.astype(object) << (BITS * place)
        self.open[:], self.blocks = 0, 0
        return self.total


def in_digits(values: np.ndarray, count: int) -> np.ndarray:
    """Big integers as `count` digits of SUM_BITS bits, the least first; the last one has the sign."""
    out = np.empty((len(values), count), np.int64)
    for k in range(count - 1):
        out[:, k] = values & ((1 << SUM_BITS) - 1)
        values = values >> SUM_BITS
    out[:, count - 1] = values
    return out


def moments(rows: DataFrame) -> DataFrame:
    """d, dim, n, s, low and high: for each length of vectors, count, sum, least and largest integer by dimension."""
    whole = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for batch in batches:
            for _, x in integers(batch.column("embedding")):
                n, s, low, high = known.get(x.shape[1], (0, 0, x[0], x[0]))
                # Sums of halves of 32 bits cannot overflow within a batch.
                own = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                known[x.shape[1]] = n + len(x), s + own, np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        for d, (n, s, low, high) in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], whole), pa.array(low), pa.array(high)], ["d", "dim", "n", "s", "low", "high"])

    parts = rows.select("embedding").mapInArrow(run, "d int, dim int, n long, s decimal(38,0), low long, high long")
    return parts.groupBy("d", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))


def products(rows: DataFrame, model: Model) -> np.ndarray:
    """The exact sums of products of centred integers, dimension by dimension, as Python's integers."""
    d = len(model.sums)
    i, j = np.triu_indices(d)
    count = (2 * model.bound.bit_length() + model.n.bit_length() + 1) // SUM_BITS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for _, x in integers(batch.column("embedding")):
                if x.shape[1] == d:
                    own = own or Products(d, model.bound)
                    own.add(model.centred(x))
        if own:
            parts = in_digits(own.recombine()[i, j], count)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i))), *map(pa.array, parts.T)], ["pair", *[f"digit_{k}" for k in range(count)]])

    names = [f"digit_{k}" for k in range(count)]
    parts = rows.select("embedding").mapInArrow(run, ", ".join(f"{c} long" for c in ["pair", *names]))
    out = np.zeros((d, d), object)
    for r in parts.groupBy("pair").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[i[r["pair"]], j[r["pair"]]] = sum(r[c] << (SUM_BITS * k) for k, c in enumerate(names))
    return np.where(np.arange(d)[:, None] <= np.arange(d), out, out.T)


def eigen(exact: np.ndarray, divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of exact / divisor.

    LAPACK's eigenvectors turn the matrix almost diagonal; rotations in extended precision do away with each coupling
    above 1e-15 of its two eigenvalues. The largest entry of an eigenvector is positive.
    """
    high = np.array([[a / divisor for a in row] for row in exact], np.float64)
    low = np.array([[float(Fraction(int(a), divisor) - Fraction(h)) for a, h in zip(row, near)] for row, near in zip(exact, high)], np.float64)
    u = np.linalg.eigh(high)[1].astype(np.longdouble)
    b = u.T @ (high.astype(np.longdouble) + low) @ u
    tiny = np.trace(b) * LEAST
    for _ in range(30):
        e = np.diag(b)
        scale = np.sqrt(np.where(e > tiny, e, np.inf))
        pairs = np.argwhere(np.triu(np.abs(b / scale[:, None] / scale) > 1e-15, 1))
        if not len(pairs):
            break
        for i, j in pairs:
            half = (b[j, j] - b[i, i]) / (2 * b[i, j]) if b[i, j] else np.longdouble(np.inf)
            t = (1 if half >= 0 else -1) / (abs(half) + np.sqrt(half * half + 1))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            b[:, [i, j]] = np.stack([c * b[:, i] - s * b[:, j], s * b[:, i] + c * b[:, j]], axis=1)
            b[[i, j]] = np.stack([c * b[i] - s * b[j], s * b[i] + c * b[j]])
            u[:, [i, j]] = np.stack([c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]], axis=1)
    order = np.argsort(-np.diag(b), kind="stable")
    u = u[:, order] / np.sqrt((u[:, order] ** 2).sum(axis=0))
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return np.diag(b)[order].astype(np.float64), u.astype(np.float64)


def fit(rows: DataFrame, most: int = 32) -> Model | None:
    """The whitening of the rows' vectors with `most` components at most; None without any whole vector."""
    scratch = Scratch(rows.sparkSession, "whitening")
    found = scratch.save(moments(rows), "moments")
    first = found.filter("dim = 0").orderBy(F.desc("n"), F.desc("d")).first()
    own = found.filter(F.col("d") == first["d"]).orderBy("dim").collect() if first else []
    scratch.drop("moments")
    if not own:
        return None
    n, sums = first["n"], [int(r["s"]) for r in own]
    bound = max(max(abs(n * r["low"] - s), abs(n * r["high"] - s)) for r, s in zip(own, sums))
    model = Model(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0, bound)
    exact = products(rows, model)
    values, vectors = eigen(exact, n**3)
    return Model(n, sums, vectors[:, :most], values[:most], int(np.trace(exact)) / n**3, bound)


def transform(rows: DataFrame, model: Model, id_col: str = "vec_id") -> DataFrame:
    """vec_id, deviation (exact, decimal) and whitened (an array, one value for each component) of every whole row."""
    small = len(model.sums) * model.bound**2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch.column("embedding")):
                if x.shape[1] == len(model.sums):
                    y = model.centred(x)
                    if small:
                        far = pc.cast(pa.array((y * y).sum(axis=1)), pa.decimal128(38, 0))
                    else:
                        far = pa.array([Decimal(v) if v < 10**38 else None for v in (y.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))
                    own = model.whitened(y)
                    values = pa.array(own.ravel(), pa.float64(), mask=np.isnan(own.ravel()))
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), far, listed], ["vec_id", "deviation", "whitened"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("vec_id"), "embedding").mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, model: Model) -> float | None:
    """The largest entry of the whitened values' covariance minus the identity; None if no component has variance.

    Each task centres by its own means before it multiplies; the tasks' sums are merged by Spark for each pair.
    """
    some = np.flatnonzero(model.eigenvalues > max(LEAST * model.trace, 0.0))
    i, j = np.triu_indices(len(some))
    if not len(some):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, around = 0, np.zeros(len(some)), np.zeros((len(some), len(some)))
        for batch in batches:
            for _, x in integers(batch.column("embedding")):
                if x.shape[1] == len(model.sums):
                    w = model.whitened(model.centred(x))[:, some]
                    own = w.mean(axis=0)
                    off, both = own - mean, n + len(w)
                    around += (w - own).T @ (w - own) + np.outer(off, off) * (n * len(w) / both)
                    mean, n = mean + off * (len(w) / both), both
        if n:
            columns = [pa.array(np.arange(len(i))), pa.array(np.full(len(i), n)), pa.array(mean[i]), pa.array(mean[j]), pa.array(around[i, j])]
            yield pa.RecordBatch.from_arrays(columns, ["pair", "n", "a", "b", "around"])

    parts = rows.select("embedding").mapInArrow(run, "pair long, n long, a double, b double, around double")
    n, a, b = F.sum("n"), F.sum(F.col("n") * F.col("a")), F.sum(F.col("n") * F.col("b"))
    found = parts.groupBy("pair").agg(((F.sum("around") + F.sum(F.col("n") * F.col("a") * F.col("b")) - a * b / n) / n).alias("covariance"))
    same = F.col("pair").isin([int(k) for k in np.flatnonzero(i == j)])
    return found.agg(F.max(F.abs(F.col("covariance") - F.when(same, 1.0).otherwise(0.0)))).first()[0]


def whiten(rows: DataFrame, id_col: str = "vec_id", most: int = 32) -> DataFrame:
    """A row for each whole vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(rows, most)
    if model is None:
        kind = rows.schema[id_col].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(rows, model)
    shares = [float(e) / model.trace if model.trace > 0 else None for e in np.maximum(model.eigenvalues, 0.0)]
    each = transform(rows, model, id_col).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("place") + 1)
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
