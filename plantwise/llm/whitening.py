"""Embedding whitening: leading principal components of integer vectors, and rows of unit covariance.

Components become integers floor(1024 c) + 100000, so counts and sums are exact whatever order
tasks end in. Two passes fit the model: exact sums, then the covariance of the vectors less their
mean, a d x d sum per task, added up in two steps (row i of the matrix and a slot, then row i), so
no group grows with the tasks squared. Only the d x d matrix comes to the driver; d is the
vectors' width and doesn't grow with the table.

There the matrix is brought to tridiagonal form by Householder reflections; the leading
eigenvalues are bisected by Sturm counts (how many eigenvalues lie below a point); each
eigenvector is found by inverse iteration on the tridiagonal matrix, made orthogonal to the earlier
ones of its cluster of close eigenvalues in every step, and reflected back. Mean and components,
(components + 1) x d numbers, are broadcast; a third pass projects every row and writes the result,
whose own covariance, centred and summed the same way, gives the identity error.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part; nor do
those whose width is not the most frequent one (the larger of equals). Entries beyond
2^52 / 1024 saturate. Null ids, repeated ids and repeated rows are rows like others. Components without
variance (beyond the rank of the data, or all of a table with one distinct vector) don't exist and
give no rows; nor does an empty table. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwise.llm.common import fresh_folder, staged

SCALE, SHIFT = 1024.0, 100_000
LARGEST = float(1 << 52)
SLOTS = 64
SAFE = 1 << 62  # integers beyond this are handled as Python's
CLUSTER = 1e-3  # eigenvalues closer than this share of the matrix's norm are one cluster
EPS = float(np.finfo(float).eps)


# ---------------------------------------------------------------- vectors of a batch
def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Width -> (rows, their integer vectors) of those that take part."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null entries become NaN
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.flatnonzero(size)
    if not len(rows):
        return {}
    starts = (np.cumsum(size) - size)[rows]
    good = np.add.reduceat(~np.isfinite(flat), starts) == 0
    rows, starts = rows[good], starts[good]
    out = {}
    for width in np.unique(size[rows]).tolist():
        own = size[rows] == width
        c = flat[starts[own][:, None] + np.arange(width)]
        with np.errstate(over="ignore"):  # entries that overflow are those that saturate
            x = np.floor(np.clip(SCALE * c, -LARGEST, LARGEST)).astype(np.int64) + SHIFT
        out[width] = rows[own], x
    return out


def exact_sum(x: np.ndarray) -> list[int]:
    fits = int(np.abs(x).max()) * len(x) < SAFE
    return [int(v) for v in (x if fits else x.astype(object)).sum(axis=0)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """n x - S per entry as doubles, and the exact sums of their squares."""
    most = n * int(np.abs(x).max()) + max(map(abs, sums))
    if most * most * x.shape[1] < SAFE:
        y = n * x - np.array(sums, dtype=np.int64)
        return y.astype(float), [int(v) for v in (y * y).sum(axis=1)]
    y = n * x.astype(object) - np.array(sums, dtype=object)
    return y.astype(float), [int(v) for v in (y * y).sum(axis=1)]


# ---------------------------------------------------------------- distributed sums
def total(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Rows that take part and their exact sum, of the most frequent width."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for width, (_, x) in matrices(batch.column(0)).items():
                n, sums = found.get(width, (0, [0] * width))
                found[width] = n + len(x), [a + b for a, b in zip(sums, exact_sum(x))]
        for width, (n, sums) in found.items():
            yield pa.RecordBatch.from_pydict({
                "width": pa.array([width] * width, pa.int32()), "dim": pa.array(range(width), pa.int32()),
                "n": pa.array([n] * width, pa.int64()), "s": pa.array(sums, pa.decimal128(38, 0))})

    parts = df.select(vector).mapInArrow(partial, "width int, dim int, n long, s decimal(38,0)")
    sums = staged(parts.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")),
                  fresh_folder(df.sparkSession, "whitening-sums"))
    best = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not best:
        return 0, []
    rows = sums.where(F.col("width") == best[0].width).orderBy("dim").collect()  # one row per dimension
    return best[0].n, [int(r.s) for r in rows]


def covariance(df: DataFrame, width: int, n: int, centred) -> np.ndarray:
    """Sum over all rows of y y^T, divided by n; ``centred`` gives a batch's y, already centred."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = np.zeros((width, width))
        for batch in batches:
            y = centred(batch.column(0))
            c += y.T @ y
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(width), pa.int32()), "slot": pa.array([part % SLOTS] * width, pa.int32()),
            "part": pa.array([part] * width, pa.int32()), "row": pa.array(c.tolist(), pa.list_(pa.float64()))})

    def add(key, rows):
        rows = rows.sort_by("part")  # one order of addition, whichever task ended first
        row = np.stack(rows.column("row").to_numpy()).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "slot": pa.array([0], pa.int32()),
                         "part": pa.array([rows.column("slot")[0].as_py()], pa.int32()), "row": pa.array([row.tolist()], pa.list_(pa.float64()))})

    shape = "i int, slot int, part int, row array<double>"
    summed = df.mapInArrow(partial, shape).groupBy("i", "slot").applyInArrow(add, shape).groupBy("i", "slot").applyInArrow(add, shape)
    rows = {r.i: r.row for r in summed.select("i", "row").collect()}  # d rows of d numbers
    c = np.array([rows[i] for i in range(width)]) / n
    return (c + c.T) / 2


# ---------------------------------------------------------------- eigenvectors on the driver
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal, off-diagonal and the reflections' unit vectors."""
    a, mirrors = a.copy(), []
    d = len(a)
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        length = np.linalg.norm(v)
        if length > 0:
            v /= length
            sub = a[k + 1:, k + 1:]
            p = sub @ v
            w = p - (v @ p) * v
            sub -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1:, k] -= 2 * (v @ a[k + 1:, k]) * v
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diag: np.ndarray, off: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: eigenvalues below each x, as negative pivots of the shifted matrix."""
    count = np.zeros(len(x), dtype=int)
    q = np.full(len(x), np.inf)
    for i in range(len(diag)):
        q = diag[i] - x - (off[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)  # a pivot of zero counts as negative, here and in what follows
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues by bisection, falling."""
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low, high = float((diag - reach).min()), float((diag + reach).max())
    norm = max(abs(low), abs(high))
    tiny = max(np.finfo(float).tiny, EPS ** 2 * norm)
    rank = len(diag) - np.arange(1, k + 1)  # so many lie below the j-th largest
    lo, hi = np.full(k, low - EPS * norm), np.full(k, high + EPS * norm)
    for _ in range(1100):
        mid = (lo + hi) / 2
        if np.all((mid <= lo) | (mid >= hi) | (hi - lo <= EPS * EPS * norm)):
            break
        above = below(diag, off, mid, tiny) <= rank
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) z = b by elimination with row exchanges."""
    d = len(diag)
    main, upper, second, z = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d, b.tolist()
    for i in range(d - 1):
        low = off[i].item()
        if abs(low) > abs(main[i]):  # the next row leads
            main[i], upper[i], second[i], rest, right = low, main[i + 1], upper[i + 1], main[i], upper[i]
            z[i], z[i + 1] = z[i + 1], z[i]
            f = rest / main[i]
            main[i + 1], upper[i + 1] = right - f * upper[i], -f * second[i]
        else:
            main[i] = main[i] if abs(main[i]) > tiny else tiny
            f = low / main[i]
            main[i + 1] -= f * upper[i]
        z[i + 1] -= f * z[i]
    for i in range(d - 1, -1, -1):
        rest = z[i] - (upper[i] * z[i + 1] if i + 1 < d else 0) - (second[i] * z[i + 2] if i + 2 < d else 0)
        z[i] = rest / (main[i] if abs(main[i]) > tiny else tiny)
        if abs(z[i]) > 1e150:  # keep far from overflow; only the direction counts
            z = [v / 1e150 for v in z]
    return np.array(z)


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues, falling, and their unit eigenvectors as rows."""
    scale = float(np.abs(a).max(initial=0))
    k = min(k, len(a))
    if scale == 0 or k == 0:
        return np.zeros(0), np.zeros((0, len(a)))
    diag, off, mirrors = tridiagonal(a / scale)
    values = leading_values(diag, off, k)
    norm = float(np.abs(diag).max() + 2 * np.abs(off).max(initial=0))
    draw = np.random.default_rng(1)
    found: list[np.ndarray] = []
    since = 0  # first of the present cluster
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            since = j
        z = draw.uniform(0.5, 1.0, len(a)) * draw.choice([-1.0, 1.0], len(a))
        shift = value - 2 * EPS * norm * (j - since)  # equal values get shifts of their own
        for _ in range(6):
            z = solve_shifted(diag, off, shift, z, EPS * norm)
            z /= np.abs(z).max()
            for _ in range(2):
                for earlier in found[since:]:
                    z -= (z @ earlier) * earlier
            z /= np.linalg.norm(z)
        found.append(z)
    vectors = np.array(found)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[:, at + 1:] -= 2 * np.outer(vectors[:, at + 1:] @ v, v)
    return values * scale, vectors


# ---------------------------------------------------------------- operator
@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a component per row
    trace: float


def fit(df: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening:
    n, sums = total(df, vector)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    width = len(sums)

    def centred(column: pa.Array) -> np.ndarray:
        own = matrices(column).get(width)
        return deviations(own[1], n, sums)[0] / n if own else np.zeros((0, width))

    v = covariance(df.select(vector), width, n, centred)
    values, vectors = eigen(v, components)
    real = values > 4 * EPS * width * max(values.max(initial=0.0), 0.0)
    return Whitening(n, sums, values[real], vectors[real], float(np.trace(v)))


def project(df: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``deviation`` and ``whitened`` (one double per component) of the rows that take part."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<deviation: decimal(38,0), whitened: array<double>>")
    def projected(column: pa.Array) -> pa.Array:
        m = shared.value
        out: list = [None] * len(column)
        if own := matrices(column).get(len(m.sums)):
            y, squares = deviations(own[1], m.n, m.sums)
            white = (y / m.n) @ (m.vectors / np.sqrt(m.values)[:, None]).T
            for row, square, w in zip(own[0].tolist(), squares, white.tolist()):
                out[row] = {"deviation": square, "whitened": w}
        return pa.array(out, kind)

    return df.select(vec_id, projected(F.col(vector)).alias("p")).where("p is not null").select(vec_id, "p.deviation", "p.whitened")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity."""
    sums = white.agg(*(F.sum(F.col("whitened")[i]).alias(f"s{i}") for i in range(k))).first()
    mean = np.array([float(s) for s in sums]) / n

    def centred(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - mean

    return float(np.abs(covariance(white.select("whitened"), k, n, centred) - np.eye(k)).max())


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """``vec_id, component`` (from 1)``, n, deviation, whitened, explained, identity_error`` for every row that
    takes part and every component."""
    spark = df.sparkSession
    model = fit(df, vector, components)
    k = len(model.values)
    shape = f"{vec_id} {df.schema[vec_id].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], shape)
    white = staged(project(df, model, vec_id, vector), fresh_folder(spark, "whitening-rows"))
    error = identity_error(white, model.n, k)
    shares = F.array(*(F.lit(float(Fraction(float(e)) / Fraction(model.trace))) for e in model.values))
    long = white.select(vec_id, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(vec_id, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
