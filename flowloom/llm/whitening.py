"""Whitening of embeddings with eigenvectors refined in mixed precision.

The covariance is summed over the executors in whole numbers, so it is exact and does
not depend on the order of rows. Its eigenvectors are found in 32-bit floats and
corrected by Ogita-Aishima iterations, which are matrix products in a higher precision
and double the right digits each time. Where eigenvalues lie closer together than the
error of the moment, the iteration can't tell the vectors of the cluster apart: their
common space is refined, and within it a small eigenproblem, shifted by the cluster's
mean, is solved. Only d x d matrices come to the driver, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm import common

STEP, OFFSET = 64, 1_000_000
#: Entries are held to this size, so that whole numbers fit 64 bits.
LARGEST = 1 << 61
#: The precision of the refinement: extended where the machine has it, else double.
HIGH = np.longdouble
ROUNDS = 30
#: Components whose eigenvalue is this part of the largest or less have no variance.
FLAT = 1e-15
#: Rows that tasks multiply at a time; digits of 20 bits, so that 2^12 products of two add up exactly in a double.
ROWS, DIGIT = 1 << 12, 20


def quantised(column: str) -> Column:
    """floor(64 * c) + 1000000 of each entry as double; null unless all entries are finite numbers."""
    c = F.col(column).cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    whole = F.transform(c, lambda x: F.floor(F.greatest(F.least(x * STEP, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("long") + OFFSET)
    return F.when(finite & ~F.exists(c, F.isnan), whole)


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """``y`` in signed digits of DIGIT bits, the lowest first, as doubles."""
    found = []
    while True:
        low = (y + (1 << (DIGIT - 1)) & ((1 << DIGIT) - 1)) - (1 << (DIGIT - 1))
        found.append(low.astype(np.float64))
        y = y - low >> DIGIT
        if not y.any():
            return found


def exact_products(y: np.ndarray) -> list[list[int]]:
    """Sums over rows of the products of every two columns, as integers of any size."""
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), ROWS):
        digits = _digits(y[at : at + ROWS])
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total = total + ((a.T @ b).astype(np.int64).astype(object) << DIGIT * (i + j))
    return total.tolist()


def _cells(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Whole numbers of any size as two decimals, value = high * 2^64 + low; each adds up by itself."""
    i, j, v = zip(*rows)
    kind = pa.decimal128(38, 0)
    parts = [pa.array([Decimal(x) for x in c], kind) for c in ([x >> 64 for x in v], [x & (1 << 64) - 1 for x in v])]
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *parts], ["i", "j", "high", "low"])


CELLS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def summed(cells: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of all tasks' cells by place: at most d * d numbers."""
    return {(r["i"], r["j"]): int(r["high"]) * (1 << 64) + int(r["low"]) for r in cells.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n += len(x)
            # High and low halves, as 64 bits may not hold a sum.
            sums = sums + ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        if n:
            yield _cells([(-1, -1, n), *((i, -1, int(s)) for i, s in enumerate(sums))])

    found = summed(fit.mapInArrow(run, CELLS))
    return found.get((-1, -1), 0), [found.get((i, -1), 0) for i in range(d)]


def centred_products(fit: DataFrame, centre: list[int], d: int) -> list[list[int]]:
    """Sums of (x_i - centre_i) * (x_j - centre_j) over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shift = None, np.array(centre, np.int64)
        for batch in batches:
            found = np.array(exact_products(_matrix(batch.column("x"), d) - shift), object)
            total = found if total is None else total + found
        if total is not None:
            yield _cells([(i, j, total[i, j]) for i in range(d) for j in range(i, d)])

    found = summed(fit.mapInArrow(run, CELLS))
    return [[found.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)]


def _high(value: Fraction) -> np.longdouble:
    """A fraction in the higher precision: its double and the double of what that leaves."""
    first = float(value)
    return HIGH(first) + HIGH(float(value - Fraction(first)))


def refined(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of the symmetric ``a`` in its own precision."""
    d, scale = len(a), np.abs(a).max()
    if not d or not scale:
        return np.zeros(d, a.dtype), np.eye(d, dtype=a.dtype)
    a = a / scale
    size = np.sqrt((a * a).sum())
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(a.dtype)
    unit, floor = np.eye(d, dtype=a.dtype), 16 * d * np.finfo(a.dtype).eps
    for _ in range(ROUNDS):
        r = unit - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        if max(np.abs(off).max(), np.abs(r).max()) <= floor:
            break
        error = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= error
        x = x + x @ np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        order = np.argsort(values)
        for run in np.split(order, np.flatnonzero(np.diff(values[order]) > error) + 1):
            if len(run) > 1:
                x[:, run] = _solved_within(a, x[:, run], floor)
    x = _orthonormal(x)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """The orthonormal vectors next to the nearly orthonormal ``x``."""
    for _ in range(2):
        x = x @ (np.eye(x.shape[1], dtype=x.dtype) * 3 - x.T @ x) / 2
    return x


def _solved_within(a: np.ndarray, x: np.ndarray, floor: float) -> np.ndarray:
    """The eigenvectors within the space that the columns of ``x`` span.

    The small matrix is shifted by the cluster's mean and scaled by its width, so its
    vectors in double precision are good to a part of that width, however narrow it is.
    """
    q = _orthonormal(x)
    t = q.T @ (a @ q)
    t = t - np.trace(t) / len(t) * np.eye(len(t), dtype=a.dtype)
    width = np.abs(t).max()
    if width <= floor:
        return q
    turn = np.linalg.eigh(((t + t.T) / (2 * width)).astype(np.float64))[1].astype(a.dtype)
    return q @ _orthonormal(turn)


@dataclass
class Whitening:
    """n vectors with sums ``sums``; the components' unit vectors as columns, eigenvalues and their parts of the trace."""

    n: int
    d: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def centre(self) -> list[int]:
        """The whole numbers next to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times what the means are beyond the centre."""
        return [s - self.n * c for s, c in zip(self.sums, self.centre)]

    @property
    def scales(self) -> np.ndarray:
        """Components divided by the root of their eigenvalue; without variance nan."""
        roots = np.where(self.values > FLAT * self.values[:1], self.values, np.nan)
        return (self.vectors / np.sqrt(roots)).astype(np.float64)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors of the rows of ``x``."""
        mean = np.array([r / self.n for r in self.rest])
        return (x - np.array(self.centre, np.int64) - mean) @ self.scales

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over the entries of (n * x - sum)^2, exact."""
        y, r = x - np.array(self.centre, np.int64), np.array(self.rest, object)
        largest, most = int(np.abs(y).max(initial=0)), max(map(abs, self.rest), default=0)
        if largest * max(largest, most) * self.d >= 1 << 62:
            y = y.astype(object)
        squares, products = (y * y).sum(1), y @ (r if y.dtype == object else r.astype(np.int64))
        n, rest = self.n, int((r * r).sum()) if len(r) else 0
        return [n * n * int(s) - 2 * n * int(p) + rest for s, p in zip(squares, products)]


def fit(embeddings: DataFrame, vector_col: str = "embedding", components: int = 16) -> Whitening | None:
    """Fit on each distinct vector once; None if there is none.

    The dimension is that of most distinct vectors (on ties the larger). Distinct vectors
    are found by one shuffle after dropping copies within tasks and stored.
    """
    x = quantised(vector_col).alias("x")
    distinct = common.stored(embeddings.select(x).filter("x IS NOT NULL AND size(x) > 0").distinct(), "whitening-fit")
    sizes = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return None
    d = sizes[0]["d"]
    rows = distinct.filter(F.size("x") == d)
    n, sums = column_sums(rows, d)
    model = Whitening(n, d, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    products, rest = centred_products(rows, model.centre, d), model.rest
    # V = products / n - (rest / n)^2, over one denominator.
    cells = [[Fraction(n * products[i][j] - rest[i] * rest[j], n * n) for j in range(d)] for i in range(d)]
    values, vectors = refined(np.array([[_high(c) for c in row] for row in cells], HIGH))
    k, trace = min(components, d), _high(sum(cells[i][i] for i in range(d)))
    values, vectors = values[:k], vectors[:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    explained = np.maximum(values, 0) / trace if trace else np.zeros(k)
    model.values, model.vectors, model.explained = values, vectors * signs, explained.astype(np.float64)
    model.identity_error = identity_error(rows, model)
    return model


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over components with variance."""
    alive = np.flatnonzero(~np.isnan(model.scales).any(0))
    n, d = model.n, model.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(alive) + 1, len(alive)))
        for batch in batches:
            z = model.project(_matrix(batch.column("x"), d))[:, alive]
            total[0] += z.sum(0)
            total[1:] += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    if not len(alive):
        return 0.0
    found = np.zeros((len(alive) + 1, len(alive)))
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        found[r["i"], r["j"]] = r["v"]
    means = found[0] / n
    return float(np.abs(found[1:] / n - np.outer(means, means) - np.eye(len(alive))).max())


def whiten(embeddings: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows with whole vectors: id, deviation decimal(38,0), whitened array<double>.

    Left out are rows whose vector is null, empty or has null, nan or infinite entries.
    A vector of another dimension than the model's has no deviation and no whitened
    entries (nulls); so has a component without variance, and a deviation beyond 38
    digits. Null and repeated ids keep their rows; other columns are left out.
    """
    source = embeddings.select(F.col(id_col).alias("id"), quantised(vector_col).alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    kind = embeddings.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            lists = batch.column("x")
            fits = np.asarray(lists.value_lengths()) == model.d
            x = _matrix(lists.filter(pa.array(fits)), model.d)
            z, found = np.full((len(fits), k), np.nan), np.full(len(fits), None, object)
            z[fits] = model.project(x)
            found[fits] = [Decimal(v) if v < 10**38 else None for v in model.deviations(x)]
            white = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel(), from_pandas=True), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.decimal128(38, 0)), white], ["id", "deviation", "whitened"])

    schema = f"id {kind}, deviation decimal(38,0), whitened array<double>"
    found = source.select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")) if model is None else source.mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_col)


def components_of(whitened: DataFrame, model: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """A row per vector and component: id, component, n, deviation (null beyond 64 bits), whitened, explained, identity_error."""
    parts = F.array(*(F.lit(float(e)) for e in model.explained)) if model is not None and len(model.explained) else F.array().cast("array<double>")
    rows = whitened.select(F.col(id_col), F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        id_col,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model is not None else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(parts, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model is not None else 0.0).alias("identity_error"),
    )
