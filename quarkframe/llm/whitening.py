"""Whitening of embeddings along the leading eigenvectors of their covariance.

Entries become whole numbers (256ths, ``grid``), so that counts, sums and
second moments of the fit list -- every distinct vector once -- are exact
whatever the order of the rows: each vector is centred by the whole number next
to its mean before it is multiplied, the products are summed as DECIMAL, and
the rest of the mean is taken off in exact arithmetic. Only the d x d
covariance (d: dimensions) reaches the driver.

Eigenvalues come from spectrum slicing (``leading``). By Sylvester's law the
signs of the pivots of an LDL' factorisation of V - s*I count the eigenvalues
above s. Bisection on these counts isolates the k-th eigenvalue in an interval
of its own; Rayleigh quotient iteration, started from inverse iteration at the
interval's middle, then converges cubically; counts just below and above the
value certify that it is the k-th. A quotient that leaves its interval is
dropped and the interval halved again. Equal eigenvalues share an interval that
halving cannot part; their vectors are kept orthogonal to those found before.

Edge cases: null vectors and vectors with null or non-finite entries go; a
vector shorter than the longest counts as 0 in the missing entries; an entry
beyond 2^63 / 256 is held at that bound; repeated rows and rows without vec_id
each get their own results; a component whose variance is not positive
(fewer distinct vectors or dimensions than components) is left out, so that a
table of equal vectors and an empty table give no rows; a deviation beyond a
long, or second moments beyond DECIMAL(38), fail the query rather than wrap
around; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

SCALE = 256
COMPONENTS = 4
EPS = float(np.finfo(float).eps)
ALPHA = (1 + 17 ** 0.5) / 8      # bound of growth between pivots of size 1 and 2
SAFE = 1 << 62


def grid(vector: Column) -> Column:
    """floor(256 * entry) of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite entry."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


# ------------------------------------------------------------ eigenvalues

def inertia_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` exceed ``shift``: positive
    pivots of an LDL' factorisation of v - shift*I with symmetric pivoting (1x1,
    or 2x2 of one positive and one negative eigenvalue)."""
    a = v - shift * np.eye(len(v))
    floor = EPS * EPS * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny)
    above = 0
    while len(a):
        m, diagonal = len(a), np.abs(np.diag(a))
        i = int(diagonal.argmax())
        off = np.abs(a) - np.diag(diagonal)
        r, c = divmod(int(off.argmax()), m)
        if diagonal[i] >= ALPHA * off[r, c]:
            pivot = a[i, i]
            if abs(pivot) <= floor:          # what is left is 0: eigenvalues at the shift
                return above
            above += pivot > 0
            keep = np.arange(m) != i
            col = a[keep, i]
            a = a[np.ix_(keep, keep)] - np.outer(col, col / pivot)
        else:
            above += 1
            pair = [r, c]
            keep = np.ones(m, bool)
            keep[pair] = False
            cols = a[np.ix_(keep, pair)]
            a = a[np.ix_(keep, keep)] - cols @ np.linalg.solve(a[np.ix_(pair, pair)], cols.T)
    return above


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:            # the shift is an eigenvalue
        return np.linalg.solve(a + EPS * max(np.abs(a).max(), np.finfo(float).tiny) * np.eye(len(a)), b)


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest positive eigenvalues of the covariance ``v``, falling,
    and their unit eigenvectors as columns."""
    d = len(v)
    scale = float(np.trace(v)) if d else 0.0
    if scale <= 0:
        return np.zeros(0), np.zeros((d, 0))
    v = v / scale
    radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
    top = float((np.diag(v) + radius).max()) * (1 + 4 * EPS) + EPS
    tiny = 8 * d * EPS
    counts = {top: 0}
    values, vectors = [], []

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia_above(v, shift)
        return counts[shift]

    def orthogonal(q: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in vectors:
                q = q - (u @ q) * u
        size = np.linalg.norm(q)
        return q / size if size else q

    for number in range(1, min(k, d) + 1):
        if above(tiny) < number:             # the rest is 0 but for rounding
            break
        # known shifts around the eigenvalue of this number
        lo = max(s for s, n in counts.items() if n >= number)
        hi = min(s for s, n in counts.items() if n < number)
        q, value = None, None
        while value is None:
            alone = above(lo) == number and above(hi) == number - 1
            close = hi - lo <= tiny
            if alone or close:
                q = orthogonal(np.random.default_rng(number).standard_normal(d))
                middle = (lo + hi) / 2
                for _ in range(3):           # inverse iteration
                    q = orthogonal(_solve(v - middle * np.eye(d), q))
                rho = float(q @ v @ q)
                for _ in range(30):          # Rayleigh quotient iteration
                    before = float(np.linalg.norm(v @ q - rho * q))
                    if before <= EPS / 4:
                        break
                    z = orthogonal(_solve(v - rho * np.eye(d), q))
                    moved = float(z @ v @ z)
                    after = float(np.linalg.norm(v @ z - moved * z))
                    if after < before:
                        q, rho = z, moved
                    if after >= before / 2:
                        break
                slack = tiny
                inside = lo - slack <= rho <= hi + slack
                certified = above(rho - slack) >= number and above(rho + slack) <= number - 1
                if close or (inside and certified):
                    value = rho
                    break
            middle = (lo + hi) / 2
            if above(middle) >= number:
                lo = middle
            else:
                hi = middle
        values.append(value * scale)
        vectors.append(q)
    return np.array(values), np.array(vectors).T.reshape(d, len(vectors))


# ------------------------------------------------------------ moments in Spark

def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of long lists as a matrix of d columns, missing entries 0."""
    flat = np.asarray(column.flatten(), np.int64)
    lengths = np.asarray(column.value_lengths(), np.int64) if len(column) else np.zeros(0, np.int64)
    if d and (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(column), d), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _products(centre: np.ndarray, d: int):  # noqa: ANN202
    """Per task the sums of products of whole-number entries about ``centre``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d), object), False
        for batch in batches:
            x = _matrix(batch.column(0), d)
            far = int(np.abs(x.astype(float) - centre.astype(float)).max(initial=0.0)) + 1
            if far * far * max(len(x), 1) < SAFE:
                y = x - centre
                # doubles hold the products exactly as long as their sums stay below 2^53
                z = y.astype(float) if far * far * len(x) < 1 << 52 else y
                total = total + (z.T @ z).astype(np.int64).astype(object)
            else:
                y = x.astype(object) - centre.astype(object)
                total = total + y.T @ y
            some = True
        if some:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array([str(t) for t in total[i, j]], pa.string())], names=["i", "j", "s"])

    return run


@dataclass
class Whitener:
    """n vectors of the fit list, sums of their entries, mean, eigenvalues,
    eigenvectors (columns), trace of the covariance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - self.mean) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitener, DataFrame]:
    """The whitening of the distinct rows ``x`` (array of longs) of ``vectors``,
    and those distinct rows as a written table."""
    shape = F.count(F.lit(1)), F.max(F.size("x")), F.min(F.size("x"))
    distinct = store(vectors.select("x").distinct(), "whitening-fit")
    n, d, least = distinct.agg(*shape).collect()[0]
    d = d or 0
    if n and least < d:          # vectors that differ only by missing zeros are one
        padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
        distinct = store(distinct.select(padded.alias("x")).distinct(), "whitening-fit")
        n = distinct.count()
    # per dimension: sums over the partial sums of each task
    got = {r["i"]: int(r["s"]) for r in distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
        F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).collect()}
    sums = [got.get(i, 0) for i in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64) if n else np.zeros(d, np.int64)
    rows = (distinct.mapInArrow(_products(centre, d), "i int, j int, s string").groupBy("i", "j")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()) if d else []
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    v = np.zeros((d, d))
    for r in rows:
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = float(Fraction(n * int(r["s"]) - rest[i] * rest[j], n * n))
    values, basis = leading(v, components)
    mean = np.array([float(Fraction(s, n)) for s in sums]) if n else np.zeros(d)
    return Whitener(n, sums, mean, values, basis, float(np.trace(v))), distinct


def identity_error(w: Whitener, distinct: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus
    the identity, measured: a pass for the means, one for centred products."""
    k, d = len(w.values), len(w.mean)
    if not k:
        return 0.0

    def partial(centre: np.ndarray, squares: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k if squares else 1))
            for batch in batches:
                y = w.project(_matrix(batch.column(0), d)) - centre
                total += y.T @ y if squares else y.sum(axis=0)[:, None]
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel(), pa.float64())],
                names=["i", "j", "s"])

        got = distinct.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        out = np.zeros((k, k if squares else 1))
        for r in got:
            out[r["i"], r["j"]] = r["s"]
        return out / w.n

    centre = partial(np.zeros(k), False)[:, 0]
    return float(np.abs(partial(centre, True) - np.eye(k)).max())


def whiten(rows: DataFrame, w: Whitener, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of
    each row (vec_id, x) and component."""
    d, k = len(w.mean), len(w.values)
    sums, share = np.array(w.sums, object), w.values / w.trace if k else w.values

    def deviations(x: np.ndarray) -> list[int]:
        most = w.n * (int(np.abs(x.astype(float)).max(initial=0.0)) + 1) + max((abs(s) for s in w.sums), default=0)
        if most * most * max(d, 1) < SAFE:
            z = w.n * x - sums.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        z = w.n * x.astype(object) - sums
        return [int(t) for t in (z * z).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, w.n), pa.int64()),
                pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(w.project(x).ravel(), pa.float64()), pa.array(np.tile(share, m), pa.float64()),
                pa.array(np.full(m * k, error), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = dict(rows.dtypes)["vec_id"]
    return rows.select("vec_id", "x").mapInArrow(
        run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
             "identity_error double")


def whitened(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fits the usable vectors of ``embeddings`` (vec_id, ``vector``) and whitens each of them."""
    rows = embeddings.where(usable(F.col(vector))).select("vec_id", grid(F.col(vector)).alias("x"))
    w, distinct = fit(rows, components)
    return whiten(rows, w, identity_error(w, distinct))
