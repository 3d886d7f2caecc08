"""Whitening of embeddings: distributed covariance, leading eigenvectors by a tridiagonal form, projection of every row."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gearwatch.llm.common import free_names, without_clashes
from gearwatch.session import materialise

SCALE, COMPONENTS = 256, 4
#: Eigenvalues below this share of the trace are taken for zero: there is nothing to whiten along them.
RANK_SHARE = 1e-11
#: Eigenvalues nearer than this share of the norm form a cluster, whose vectors are made orthogonal to each other.
CLUSTER_SHARE = 1e-3
LONGEST = 2**63 - 1
OUTPUTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def householder(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix, and the reflectors that lead there."""
    a = np.array(matrix, np.float64)
    d, reflectors = len(a), []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x[1:]).max() if len(x) > 1 else 0.0
        v = np.zeros(len(x))
        if size > 0:
            v = x / np.abs(x).max()
            v[0] += math.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = 2 * (rest @ v)
            w = p - (p @ v) * v
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * (v @ x) * v
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def back_transform(vectors: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Eigenvectors (columns) of the matrix from those of its tridiagonal form."""
    out = vectors.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        out[k + 1 :] -= 2 * np.outer(reflectors[k], reflectors[k] @ out[k + 1 :])
    return out


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix are less than each number of ``at``: negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count = np.zeros(len(at), np.int64)
    pivot = np.ones(len(at))
    for i, value in enumerate(diagonal):
        square = off[i - 1] ** 2 if i else 0.0
        pivot = value - at - square / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection until no number lies between the bounds."""
    d = len(diagonal)
    reach = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    slack = np.finfo(float).eps * (np.abs(diagonal) + reach).max() * d + np.finfo(float).tiny
    low = np.full(k, (diagonal - reach).min() - slack)
    high = np.full(k, (diagonal + reach).max() + slack)
    wanted = d - np.arange(k)  # the j-th largest has at least d - j + 1 eigenvalues below any number above it
    while True:
        mid = (low + high) / 2
        if ((mid <= low) | (mid >= high)).all():
            return mid
        above = sturm_count(diagonal, off, mid) >= wanted
        high, low = np.where(above, mid, high), np.where(above, low, mid)


def shifted_solver(diagonal: np.ndarray, off: np.ndarray, shift: float):
    """A function that solves the shifted tridiagonal system: elimination with row exchanges, pivots kept off zero."""
    d = len(diagonal)
    least = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0, np.finfo(float).tiny)
    main, upper, second = diagonal - shift, np.r_[off, 0.0], np.zeros(d)
    factor, swapped = np.zeros(d), np.zeros(d, bool)
    for i in range(d - 1):
        below = off[i]
        if abs(below) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / below
            main[i], upper[i], main[i + 1], second[i], upper_next = below, main[i + 1], upper[i], upper[i + 1], 0.0
            main[i + 1] -= factor[i] * upper[i]
            upper[i + 1] = upper_next - factor[i] * second[i]
        else:
            if abs(main[i]) < least:
                main[i] = least
            factor[i] = below / main[i]
            main[i + 1] -= factor[i] * upper[i]
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(d - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        for i in range(d - 1, -1, -1):
            rest = (upper[i] * x[i + 1] if i + 1 < d else 0.0) + (second[i] * x[i + 2] if i + 2 < d else 0.0)
            x[i] = (x[i] - rest) / main[i]
        return x

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (columns) of the falling ``values``; those of a cluster are made orthogonal to each other in every round."""
    d, norm = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0, np.finfo(float).tiny)
    rng = np.random.default_rng(17)
    out = np.zeros((d, len(values)))
    start, shift = 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER_SHARE * norm:
            start = j
        shift = min(value, shift - 10 * np.finfo(float).eps * norm) if j > start else value  # equal values need shifts of their own
        solve, x = shifted_solver(diagonal, off, shift), rng.normal(size=d)
        for _ in range(rounds):
            x = solve(x / np.abs(x).max())
            for _ in range(2):
                near = out[:, start:j]
                x -= near @ (near.T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their unit eigenvectors (columns); fewer if the rest is zero."""
    size = np.abs(matrix).max() if matrix.size else 0.0
    if not size > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflectors = householder(matrix / size)
    values = leading_values(diagonal, off, min(k, len(matrix)))
    values = values[values > RANK_SHARE * diagonal.sum()]
    vectors = back_transform(inverse_iteration(diagonal, off, values), reflectors)
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Whitening:
    """What rows are projected with: size and exact sums of the fit list, eigenvalues, their vectors, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates (rows x components) of whole-number vectors."""
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over the dimensions of (n x - sum)^2; null where it is no 64-bit integer."""
        bound = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        if bound * bound * max(1, len(self.sums)) <= LONGEST:
            gap = self.n * x - np.array(self.sums, np.int64)
            return (gap * gap).sum(1).tolist()
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v <= LONGEST else None for v in out]


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """Entries times ``scale``, rounded down to whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def valid(vector: Column) -> Column:
    """Neither null nor holding a null, infinite or undefined entry."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(fit_list: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension; the driver gets one row per dimension."""

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for frame in frames:
            x = matrix_of(frame.column(0), width)
            n += len(x)
            if len(x):  # halves, so that no sum of a batch leaves 64 bits
                high, low = x >> 32, x & 0xFFFFFFFF
                total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high.sum(0), low.sum(0), strict=True)]
        yield pa.RecordBatch.from_pydict({"dim": pa.array([*range(width), -1], pa.int32()), "total": pa.array(map(str, [*total, n]), pa.string())})

    parts = fit_list.select("x").mapInArrow(add, "dim int, total string")
    rows = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["dim"]: int(r["total"]) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def covariance(fit_list: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the fit list with divisor ``n``; rows are centred before they are multiplied.

    Each task adds up one matrix, whose upper half leaves it; the driver gets one row per pair of dimensions.
    """
    width = len(sums)
    mean = np.array([s / n for s in sums])
    i, j = np.triu_indices(width)

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for frame in frames:
            x = matrix_of(frame.column(0), width) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    parts = fit_list.select("x").mapInArrow(add, "i int, j int, v double")
    rows = parts.groupBy("i", "j").agg((F.sum("v") / n).alias("v")).toPandas()
    out = np.zeros((width, width))
    out[rows["i"], rows["j"]] = out[rows["j"], rows["i"]] = rows["v"]
    return out


def prepare(rows: DataFrame, vector_column: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Rows with a valid vector and its whole numbers ``x``, and the width.

    The width is the most frequent length (the longer one of two); vectors of another length are left out like invalid ones.
    """
    good = rows.filter(valid(F.col(vector_column)) & (F.size(vector_column) > 0))
    lengths = good.groupBy(F.size(vector_column).alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    width = lengths[0]["w"] if lengths else 0
    return good.filter(F.size(vector_column) == width).withColumn("x", whole_numbers(F.col(vector_column), scale)), width


def fit(fit_list: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The leading components of a list of distinct vectors ``x`` of one width."""
    n, sums = exact_sums(fit_list, width)
    v = covariance(fit_list, n, sums) if n and width else np.zeros((width, width))
    values, vectors = leading_eigen(v, components)
    return Whitening(n, sums, values, vectors, float(np.trace(v)))


def project(rows: DataFrame, model: Whitening, width: int) -> DataFrame:
    """``rows`` (with ``x``) and their ``deviation`` and ``whitened`` coordinates as an array, ``x`` left out."""
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "x"], T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    k = len(model.values)

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            x = matrix_of(frame.column(frame.schema.get_field_index("x")), width)
            flat = model.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, k, dtype=np.int32)), pa.array(flat.ravel()))
            kept = [c for name, c in zip(frame.schema.names, frame.columns, strict=True) if name != "x"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.deviations(x), pa.int64()), lists], names=schema.names)

    return rows.mapInArrow(each, schema)


def identity_error(fit_list: DataFrame, model: Whitening, width: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = len(model.values)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    w = [F.col("whitened")[i] for i in range(k)]
    gaps = [F.abs(F.covar_pop(w[a], w[b]) - F.lit(float(a == b))) for a, b in pairs]
    row = project(fit_list.select("x"), model, width).agg(*[g.alias(f"g{i}") for i, g in enumerate(gaps)]).first()
    return max(row)


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each valid row and leading component.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out, and so are vectors of another length
    than most. Entries become whole numbers; the fit list holds every distinct vector once, so copies weigh nothing however
    many there are. Repeated ids keep their rows. Fewer components come out if the covariance has no more eigenvalues above
    zero; none for an empty table or a fit list of one vector. Extra columns are not returned. ``deviation`` is null where
    it needs more than 64 bits.
    """
    rows = without_clashes(rows, ("x", "deviation", "whitened"), (id_column, vector_column))
    vec, ident = free_names(rows, "_vector", "_id")
    light = rows.select(F.col(f"`{id_column}`").alias(ident), F.col(f"`{vector_column}`").alias(vec))
    ready, width = prepare(light, vec, scale)
    ready = ready.select(ident, "x")
    fit_list = materialise(ready.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "whitening-fit")
    model = fit(fit_list, width, components)
    k = len(model.values)
    kind = dict(light.dtypes)[ident]
    if not k:
        schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(fit_list, model, width)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    out = project(ready, model, width).select(ident, "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return out.select(
        F.col(ident).alias(id_column), (F.col("component") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", F.get(share, F.col("component")).alias("explained"), F.lit(float(error)).alias("identity_error"))
