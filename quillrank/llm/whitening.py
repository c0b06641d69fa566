"""Whitening of vectors from an eigendecomposition that grows by one vector at a time.

Every task keeps the mean and the spectrum of the vectors it has seen. A new vector is a rank-one update of the scatter
matrix: the secular equation gives the new eigenvalues, after deflation of directions that do not change. Spectra of
tasks are combined in a tree, the eigenpairs of one going into the other as rank-one updates. A last pass over all
vectors (Rayleigh-Ritz) takes the covariance in the basis found and turns the basis so that it is diagonal.

The decomposition is of the different integer vectors floor(64 * c) + 1000000, each once; copies do not count twice.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out, as are entries of
2**40 and more in size, which have no exact integer form, and vectors of another length than the most frequent one
(ties: the longer). Components without variance are left out, so equal vectors alone, one vector or an empty table give
no rows. Repeated rows and ids each get rows of their own. Other columns do not matter, whatever they are called.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.session import settled

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
FAN_IN = 16
LARGEST = float(1 << 40)
RANK = 1e-12
_EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(poles) + rho z z', and the matrix poles[j] - root[i] at [i, j], without cancellation.

    `poles` rise strictly, no z is zero, rho > 0. Every root lies between two poles, the last one beyond them all. Each is
    found as its distance from the nearer pole: the sums over the poles on either side are replaced by a pole with the
    same value and slope, and a step that leaves the bracket is a bisection.
    """
    m = len(poles)
    weight = rho * z * z
    upper = np.append(poles[1:], poles[-1] + weight.sum())
    gap = upper - poles
    # The sign at the middle of each interval tells the nearer end; the last root is measured from the last pole.
    middle = 1 + (weight / (poles - (poles + gap / 2)[:, None])).sum(1)
    right = middle < 0
    right[-1] = False
    origin = np.where(right, upper, poles)
    delta = poles[None, :] - origin[:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, gap / 2)
    if middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    left_side = np.tri(m, dtype=bool)
    at = (low + high) / 2
    near = np.diagonal(delta).copy()
    far = np.append(np.diagonal(delta, 1), np.inf)
    for _ in range(100):
        distance = delta - at[:, None]
        part = weight / distance
        value = 1 + part.sum(1)
        low, high = np.where(value < 0, at, low), np.where(value > 0, at, high)
        slopes = part / distance
        below, above = (part * left_side).sum(1), (part * ~left_side).sum(1)
        slope_below, slope_above = (slopes * left_side).sum(1), (slopes * ~left_side).sum(1)
        to_near, to_far = near - at, far - at
        s = to_near * to_near * slope_below
        end = np.isinf(to_far)
        to_far_ = np.where(end, 1.0, to_far)
        big = np.where(end, 0.0, to_far_ * to_far_ * slope_above)
        c = 1 + below - to_near * slope_below + np.where(end, 0.0, above - to_far_ * slope_above)
        # c + s / (near - t) + big / (far - t) = 0 in the step from here.
        with np.errstate(all="ignore"):
            a = c * (to_near + to_far_) + s + big
            b = to_near * to_far_ * (c + s / to_near + big / to_far_)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(end, to_near + s / c, step)
            next_ = at + step
        bad = ~np.isfinite(next_) | (next_ <= low) | (next_ >= high)
        next_ = np.where(bad, (low + high) / 2, next_)
        # A value within its own rounding error tells nothing more.
        exact = np.abs(value) <= 8 * _EPS * (1 + np.abs(below) + np.abs(above))
        done = exact | (np.abs(next_ - at) <= 2 * _EPS * np.abs(next_))
        at = np.where(exact, at, next_)
        if done.all():
            break
    return origin + at, delta - at[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of basis diag(values) basis' + rho vector vector', rho > 0; values rise.

    Deflation: directions that the vector does not reach stay as they are; of directions with one eigenvalue a
    reflection leaves a single one that it reaches.
    """
    z = basis.T @ vector
    size = max(abs(values[-1]), rho * float(z @ z))
    if not size:
        return values, basis
    tolerance = 8 * _EPS * size
    close = np.append(np.diff(values) <= tolerance, False)
    if close.any():
        basis, start = basis.copy(), 0
        for stop in (np.flatnonzero(~close) + 1).tolist():
            if stop - start > 1 and (length := np.linalg.norm(z[start:stop])):
                w = z[start:stop].copy()
                w[-1] += np.copysign(length, w[-1])
                basis[:, start:stop] -= np.outer(basis[:, start:stop] @ w, w * (2 / (w @ w)))
                z[stop - 1] = -np.copysign(length, z[stop - 1])
                z[start : stop - 1] = 0
            start = stop
    moved = np.flatnonzero(np.abs(z) * np.sqrt(rho) > _EPS * np.sqrt(size))
    # Poles that stay too close after all would not be told apart.
    moved = moved[np.append(np.diff(values[moved]) > tolerance / 4, True)] if len(moved) else moved
    if not len(moved):
        return values, basis
    poles, part = values[moved], z[moved]
    roots, difference = secular_roots(poles, part, rho)
    # The vector for which these roots are exact keeps the new basis orthogonal.
    m = len(moved)
    spread = poles[:, None] - poles[None, :]
    ratio = -difference.T.copy()
    np.fill_diagonal(spread, 1.0)
    ratio[:, :] = ratio / np.where(np.eye(m, dtype=bool), 1.0, -spread)
    exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1))), part)
    turn = (exact / difference).T
    turn /= np.linalg.norm(turn, axis=0)
    values, out = values.copy(), basis.copy()
    values[moved] = roots
    out[:, moved] = basis[:, moved] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], out[:, order]


@dataclass
class Spectrum:
    """Number, exact sums, and spectrum of the scatter matrix of the vectors seen."""

    size: int
    n: int = 0
    sums: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    basis: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.sums is None:
            self.sums, self.values, self.basis = np.zeros(self.size, np.int64), np.zeros(self.size), np.eye(self.size)

    def add(self, x: np.ndarray) -> None:
        if self.n:
            away = x - OFFSET - (self.sums - self.n * OFFSET) / self.n
            self.values, self.basis = rank_one(self.values, self.basis, away, self.n / (self.n + 1))
        self.n, self.sums = self.n + 1, self.sums + x

    def join(self, other: Spectrum) -> None:
        """The other's eigenpairs and the distance of the means, one rank-one update each."""
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.values, self.basis = other.n, other.sums, other.values, other.basis
            return
        mean = lambda s: (s.sums - s.n * OFFSET) / s.n
        away = mean(other) - mean(self)
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector, value)
        self.values, self.basis = rank_one(self.values, self.basis, away, self.n * other.n / (self.n + other.n))
        self.n, self.sums = self.n + other.n, self.sums + other.sums


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(state: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(state)))


def _join_spectra(states: list[bytes]) -> bytes:
    parts = [_unpack(s) for s in states]
    total = Spectrum(len(parts[0]["sums"]))
    for p in parts:
        total.join(Spectrum(total.size, int(p["n"]), p["sums"], p["values"], p["basis"]))
    return _pack(n=total.n, sums=total.sums, values=total.values, basis=total.basis)


def _add_matrices(states: list[bytes]) -> bytes:
    return _pack(m=sum(_unpack(s)["m"] for s in states))


def _matrix(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    """The vectors of a column of lists, one row each."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


def folded(rows: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], bytes | None], join: Callable[[list[bytes]], bytes]):
    """One state per task, joined in a tree with at most FAN_IN of them in a task; the last one, or None without rows."""

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = step(iter(batches))
        if state is not None:
            node = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state], pa.binary())], ["node", "state"])

    def combine(table: pa.Table) -> pa.Table:
        states = [s for _, s in sorted(zip(table.column("node").to_pylist(), table.column("state").to_pylist()))]
        up = table.column("up")[0].as_py()
        return pa.table({"node": pa.array([up], pa.int64()), "state": pa.array([join(states)], pa.binary())})

    schema = "node long, state binary"
    states = settled(rows.mapInArrow(start, schema), "states")
    last = states.agg(F.max("node")).first()[0]
    if last is None:
        return None
    while last > 0:
        up = states.withColumn("up", F.floor(F.col("node") / FAN_IN))
        states, last = settled(up.groupBy("up").applyInArrow(combine, schema), "states"), last // FAN_IN
    return states.first()["state"]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x, the integer form of the vectors that take part."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    form = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & whole).select(F.col(id_col).alias("id"), form.alias("x"))
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (size["size"] if size else 0))


@dataclass
class Whitening:
    """The fitted turn: column i of `basis` is component i + 1; `error` is how far the covariance is from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    explained: np.ndarray
    error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.basis / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the different vectors x; None where nothing varies."""
    listed = settled(rows.select("x").distinct(), "fit")

    def spectrum(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        seen = None
        for batch in batches:
            if batch.num_rows:
                size = len(batch.column(0)[0])
                seen = seen or Spectrum(size)
                for x in _matrix(batch, 0, size):
                    seen.add(x)
        return seen and _pack(n=seen.n, sums=seen.sums, values=seen.values, basis=seen.basis)

    state = folded(listed, spectrum, _join_spectra)
    if state is None:
        return None
    found = _unpack(state)
    n, sums, basis = int(found["n"]), found["sums"], found["basis"]

    def products(turn: Callable[[np.ndarray], np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> bytes | None:
            total = None
            for batch in batches:
                if batch.num_rows:
                    y = turn(_matrix(batch, 0, len(sums)))
                    total = y.T @ y + (0 if total is None else total)
            return None if total is None else _pack(m=total)

        return run

    ritz = _unpack(folded(listed, products(lambda x: (n * x - sums) / n @ basis), _add_matrices))["m"] / n
    # The basis is orthogonal up to rounding; what is missing is taken out before the last turn.
    gram = np.linalg.cholesky(basis.T @ basis)
    inner = np.linalg.solve(gram, np.linalg.solve(gram, ritz).T)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    full = basis @ np.linalg.solve(gram.T, turn)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(inner))
    order = order[values[order] > RANK * trace] if trace > 0 else order[:0]
    if not len(order):
        return None
    basis, values = full[:, order], values[order]
    basis = basis / np.linalg.norm(basis, axis=0)
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(len(order))])
    found = Whitening(n, sums, values, basis, values / trace, 0.0)
    covariance = _unpack(folded(listed, products(found.whiten), _add_matrices))["m"] / n
    found.error = float(np.abs(covariance - np.eye(len(order))).max())
    return found


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = integer_vectors(vectors, id_col, vector_col)
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    turn = fit(rows, components)
    if turn is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(turn.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, 1, len(turn.sums))
            away = turn.n * x - turn.sums
            if float(np.abs(away).max()) ** 2 * x.shape[1] < 2**62:
                deviation = pa.array((away * away).sum(1)).cast(pa.decimal128(38, 0))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in away]
                deviation = pa.array(exact, pa.decimal128(38, 0))
            again = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, turn.n)),
                    deviation.take(again),
                    pa.array((away / turn.n @ turn.basis / np.sqrt(turn.values)).ravel()),
                    pa.array(np.tile(turn.explained, len(x))),
                    pa.array(np.full(len(x) * k, turn.error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
