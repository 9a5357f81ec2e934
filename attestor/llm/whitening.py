"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries become integers (`SCALE` times the entry, rounded down), so that sums and distances are exact. The fit list has each
distinct vector once. One pass gives n and the sums S; a second compresses the centred rows (n * x - S, divided by n) to an
upper triangular R: a task takes QR of its blocks of rows, each with the R before it, and Rs of several tasks are compressed in
turn until one is left (TSQR). R has as many rows as a vector has entries, so it goes to the driver, where plane
rotations make its columns orthogonal. The accumulated rotations are the components; the columns' lengths over sqrt(n) are the
standard deviations, accurate also when they are small, as the covariance is never formed. A last pass over the fit list
measures how far the covariance of what is whitened is from the identity.

Vectors that are null or hold nulls, NaN or infinite entries are dropped. Empty vectors have no component and so no rows.
Vectors shorter than the longest are filled with 0. Repeated vectors count once for the fit, but each row is returned, also rows with null or
repeated ids. Components without variance (a single distinct vector, constant entries) have null in `whitened` and aren't in
`identity_error`, which is null if there is none; `explained` is null if no entry varies. Equal eigenvalues may come in any order, the same
for all rows; the largest entry of a component is positive. `deviation` is null if it doesn't fit a long. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship, written

SCALE, COMPONENTS = 256, 4
#: Rows of a block, and partial results that one task combines.
BLOCK, FAN = 4096, 32
#: Rotations stop when the cosine of every two columns is below this.
ORTHOGONAL, SWEEPS = 1e-15, 60
LONG = 2**63


def integers(vector: Column) -> Column:
    """The integer vector, null where an entry is null or not finite."""
    entries = vector.cast("array<double>")
    whole = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(whole, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """Rows of a list column, filled with 0 up to `size` entries."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if size and len(lengths) and (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


@dataclass(frozen=True)
class Centre:
    """n, the sums, and the greatest absolute entry."""

    n: int
    sums: tuple[int, ...]
    most: int

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: long, or Python's integers where a long might not hold it."""
        exact = self.n * self.most + max(map(abs, self.sums), default=0) < LONG
        kind = np.int64 if exact else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S) squared of each row."""
        d = self.scaled(x)
        if (self.n * self.most + max(map(abs, self.sums), default=0)) ** 2 * max(1, len(self.sums)) < LONG:
            return (d * d).sum(1).tolist()
        return [v if v < LONG else None for v in (sum(int(e) ** 2 for e in row) for row in d)]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles; only the quotient is rounded."""
        return self.scaled(x).astype(np.float64) / self.n


@dataclass(frozen=True)
class Whitening:
    """What a fit found. `axes` has one component a column, `deviations` are their standard deviations (falling)."""

    centre: Centre
    axes: np.ndarray
    deviations: np.ndarray

    @property
    def explained(self) -> list[float | None]:
        total = float((self.deviations**2).sum())
        return [float(s * s) / total if total else None for s in self.deviations]

    def apply(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        k = min(components, len(self.deviations))
        s = self.deviations[:k]
        least = np.finfo(float).eps * max(1, len(self.deviations)) * (self.deviations[0] if k else 0.0)
        return self.centre.rows(x) @ self.axes[:, :k] / np.where(s > least, s, np.nan)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components, singular values) of a matrix: columns are rotated in pairs until all are orthogonal.

    A round rotates pairs that share no column at once; after size - 1 rounds every two columns have met."""
    a, size = np.array(r, np.float64), r.shape[1]
    v = np.eye(size)
    seats = np.arange(size + size % 2)  # an odd one out sits opposite a column that doesn't exist
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(1, len(seats) - 1)):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            both = (p < size) & (q < size)
            p, q = p[both], q[both]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(alpha) * np.sqrt(beta)
            cosine = np.divide(np.abs(gamma), scale, out=np.zeros_like(gamma), where=scale > 0)
            turn = cosine > ORTHOGONAL
            worst = max(worst, float(cosine.max(initial=0)))
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - c * t * y, c * t * x + c * y
            seats[1:] = np.roll(seats[1:], 1)
        if worst <= ORTHOGONAL:
            break
    s = np.sqrt((a * a).sum(0))
    order = np.argsort(-s, kind="stable")
    v = v[:, order]
    if size:
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(size)] < 0, -1.0, 1.0)
    return v, s[order]


def _folded(parts: DataFrame, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """One state of many rows (part, state). A task joins the states of about `FAN` parts; this is done again until so few
    are left, and the driver joins those. Which parts meet follows from their numbers, so reruns agree."""

    def of(table: pa.Table) -> pa.Table:
        table, state = table.sort_by("part"), None
        for s in table.column("state").to_pylist():
            state = np.array(s) if state is None else join(state, np.array(s))
        return pa.table({"part": table.column("part")[:1], "state": pa.array([state.tolist()], pa.list_(pa.float64()))})

    parts = written(parts, "folded")
    while (n := parts.count()) > FAN:
        dealt = parts.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(math.ceil(n / FAN))))
        parts = written(dealt.groupBy("group").applyInArrow(lambda t: of(t.drop_columns("group")), "part long, state array<double>"), "folded")
    state = None
    for r in parts.orderBy("part").collect():
        state = np.array(r["state"]) if state is None else join(state, np.array(r["state"]))
    return state


def _states(vectors: DataFrame, of_block: Callable[[np.ndarray, np.ndarray | None], np.ndarray], size: int) -> DataFrame:
    """(part, state): one state for each task with rows, built block by block."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                state = of_block(_matrix(b.column(0).slice(at, BLOCK), size), state)
        if state is not None:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state.tolist()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "state"])

    return vectors.select("x").mapInArrow(of, "part long, state array<double>")


def centre(vectors: DataFrame) -> Centre:
    """n and the exact sums of the vectors `x`: each task sums its rows by entry, Spark sums the tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[int] = []
        most: list[int] = []
        for b in batches:
            x = _matrix(b.column(0), max(b.column(0).value_lengths().to_pylist(), default=0))
            size, peak = x.shape[1], max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            own = x.sum(0, dtype=np.int64 if peak * max(1, len(x)) < LONG else object).tolist()
            sums += [0] * (size - len(sums))
            most += [0] * (size - len(most))
            for j, s in enumerate(own):
                sums[j] += s
                most[j] = max(most[j], peak)
        columns = [pa.array(range(len(sums)), pa.int32()), pa.array(map(str, sums), pa.string()), pa.array(map(str, most), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["entry", "sum", "most"])

    parts = vectors.select("x").mapInArrow(of, "entry int, sum string, most string")
    number = lambda c: F.col(c).cast("decimal(38,0)")
    rows = parts.groupBy("entry").agg(F.sum(number("sum")).alias("sum"), F.max(number("most")).alias("most")).orderBy("entry").collect()
    return Centre(vectors.count(), tuple(int(r["sum"]) for r in rows), max((int(r["most"]) for r in rows), default=0))


def fit(vectors: DataFrame) -> Whitening:
    """The components of the rows of column `x`; every row counts, so give each vector once."""
    mid = centre(vectors)
    size = len(mid.sums)
    if not size:
        return Whitening(mid, np.zeros((0, 0)), np.zeros(0))
    triangle = lambda rows: np.linalg.qr(rows, mode="r")
    r = _folded(
        _states(vectors, lambda x, s: triangle(mid.rows(x) if s is None else np.vstack((s.reshape(-1, size), mid.rows(x)))).ravel(), size),
        lambda a, b: triangle(np.vstack((a.reshape(-1, size), b.reshape(-1, size)))).ravel(),
    )
    axes, values = jacobi(r.reshape(-1, size))
    return Whitening(mid, axes, values / math.sqrt(mid.n))


def identity_error(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows minus the identity. States are (rows, means, sums of
    products of centred entries), which are joined without forming products of entries that aren't centred."""
    k = min(components, len(model.deviations))
    seen = [j for j in range(k) if not np.isnan(model.apply(np.zeros((1, len(model.centre.sums)), np.int64), k)[0, j])]
    if not seen:
        return None
    k = len(seen)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (n, x, xx), (m, y, yy) = ((s[0], s[1 : k + 1], s[k + 1 :].reshape(k, k)) for s in (a, b))
        apart = y - x
        products = xx + yy + np.outer(apart, apart) * (n * m / (n + m))
        return np.concatenate(([n + m], x + apart * (m / (n + m)), products.ravel()))

    def of_block(x: np.ndarray, state: np.ndarray | None) -> np.ndarray:
        w = model.apply(x, components)[:, seen]
        mean = w.mean(0)
        own = np.concatenate(([len(w)], mean, ((w - mean).T @ (w - mean)).ravel()))
        return own if state is None else joined(state, own)

    state = _folded(_states(vectors, of_block, len(model.centre.sums)), joined)
    return float(np.abs(state[k + 1 :].reshape(k, k) / state[0] - np.eye(k)).max())


def report(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each kept vector and component."""
    spark = embeddings.sparkSession
    bound_batches(spark, BLOCK)
    ship(spark)
    rows = embeddings.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")
    vectors = written(rows.select("x").distinct(), "fit-list")
    model = fit(vectors)
    error, size, k = identity_error(vectors, model, components), len(model.centre.sums), min(components, len(model.deviations))
    kind = embeddings.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if k else ():
            x, m = _matrix(b.column(1), size), b.num_rows
            deviations = pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [
                b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.centre.n)), deviations,
                pa.array(model.apply(x, k).ravel(), from_pandas=True), pa.array(model.explained[:k] * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(of, schema)
