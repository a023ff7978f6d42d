"""Operator 11: embedding whitening by LOBPCG over distributed covariance-block products.

Vectors become whole numbers floor(scale * c); the fit list is each distinct one once, packed into blocks of rows. The
covariance matrix is never formed: one Spark job multiplies it with a block of directions, as the sum over row blocks of
Xc' (Xc B) with Xc centred, and only that product, dimensions x directions, reaches the driver. Each round does a
Rayleigh-Ritz step on the span of the iterate, its residuals and the previous directions, orthonormalised with rank
decisions, until the residual |V u - e u| of every wanted pair is at most `tolerance` times the largest eigenvalue; the pairs
that are returned are certified by a product of their own. Whitened rows are a map over the table with the mean and the
components, a few numbers for each dimension.

A task holds one block of rows at a time; partial products are added per block of dimensions in a second stage.

Defined results: vectors null, empty, or with null or non-finite components, or ones beyond 2^53 / scale, take no part, nor do
vectors of another length than most distinct ones have (of equally frequent lengths, the longest); repeated rows get a result each, and
null ids stay; components whose eigenvalue is not above rounding (1e-12 of the trace) have no whitened values and no
rows, so equal vectors and empty tables give none; a deviation beyond 64 bits is null; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import mapped, materialize, table, temporary

COMPONENTS, SCALE, TOLERANCE, ROUNDS = 4, 256.0, 1e-13, 200
BLOCK_ROWS, DIMS = 1024, 256
HALF = 26


@dataclass
class Model:
    n: int
    sums: np.ndarray  # of Python integers
    values: np.ndarray
    vectors: np.ndarray  # dimensions x components
    trace: float
    residual: float  # the largest, over the largest eigenvalue
    identity_error: float
    rounds: int


def whole_rows(column: pa.Array, scale: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its whole numbers) of the vectors that take part."""
    for i, v in enumerate(column):
        if v.is_valid and len(v) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * scale) + 0.0
            if np.isfinite(x).all() and np.abs(x).max() <= 1 << 53:
                yield i, x.astype(np.int64)


def _coded(vectors: DataFrame, vector_col: str, scale: float) -> DataFrame:
    """dim, x: vectors in the narrowest integers that hold them (equal vectors are equal bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, rows = [], []
            for _, x in whole_rows(b.column(0), scale):
                most = int(np.abs(x).max())
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                dims.append(len(x))
                rows.append(x.astype(f"<i{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(rows, pa.binary())], ["dim", "x"])

    return mapped(vectors.select(vector_col), run, "dim int, x binary", 4096)


def _fit_blocks(distinct: DataFrame, dim: int) -> DataFrame:
    """block (bytes of up to BLOCK_ROWS rows), width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        out = lambda w: pa.RecordBatch.from_arrays([pa.array([b"".join(held.pop(w))], pa.binary()), pa.array([w], pa.int32())], ["block", "width"])
        for b in batches:
            for x in b.column(0).to_pylist():
                held.setdefault(w := len(x) // dim, []).append(x)
                if len(held[w]) >= BLOCK_ROWS:
                    yield out(w)
        for w in list(held):
            yield out(w)

    return mapped(distinct.select("x"), run, "block binary, width int", 4096)


def _rows_of(b: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    for block, width in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        yield np.frombuffer(block, f"<i{width}").reshape(-1, dim)


def _moments(blocks: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Rows and exact sums. Sums of high and low halves stay within 64 bits in a task; Spark adds them as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            for x in _rows_of(b, dim):
                x = x.astype(np.int64)
                n, high, low = n + len(x), high + (x >> HALF).sum(0), low + (x & (1 << HALF) - 1).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    parts = mapped(blocks, run, "i long, n long, high long, low long", 4)
    exact = parts.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    rows = exact.orderBy("i").collect()
    return int(rows[0]["n"]), np.array([(int(r["high"]) << HALF) + int(r["low"]) for r in rows], object)


def product(blocks: DataFrame, mean: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Sums over rows of Xc' (Xc B), |Xc|^2 and (Xc B)' (Xc B): two stages, tasks' parts are added by block of dimensions."""
    dim, m = directions.shape
    starts = list(range(0, dim, DIMS))
    schema = "i int, part binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mass, inner = np.zeros((dim, m)), 0.0, np.zeros((m, m))
        for b in batches:
            for x in _rows_of(b, dim):
                c = x - mean
                y = c @ directions
                total += c.T @ y
                mass += float(np.einsum("ij,ij->", c, c))
                inner += y.T @ y
        parts = [total[s : s + DIMS].tobytes() for s in starts] + [np.append(inner, mass).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([*starts, -1], pa.int32()), pa.array(parts, pa.binary())], ["i", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[i] = held.get(i, 0.0) + np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["i", "part"])

    parts = mapped(blocks, run, schema, 4)
    groups = min(len(starts) + 1, 64)
    rows = mapped(parts.repartition(groups, "i"), add, schema, 64).collect()
    by = {r["i"]: np.frombuffer(r["part"]) for r in rows}
    total = np.concatenate([by[s].reshape(-1, m) for s in starts]) if by else np.zeros((dim, m))
    return total, float(by[-1][-1]), by[-1][:-1].reshape(m, m)


def orthonormal(columns: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """A basis of what the columns span beyond `against` (orthonormal); directions lost to rounding are left out."""
    v = columns / np.maximum(np.linalg.norm(columns, axis=0), 1e-300)
    for _ in range(2):
        if against is not None and against.size:
            v = v - against @ (against.T @ v)
        u, s, _ = np.linalg.svd(v, full_matrices=False)
        v = u[:, s > 1e-10 * max(1.0, s[0] if len(s) else 0)] if v.size else v
    return v


def lobpcg(multiply, dim: int, wanted: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Largest eigenpairs of a symmetric operator: values, vectors, residual norms, rounds. multiply(B) gives V B.

    The iterate is wider than wanted, so that close eigenvalues behind the wanted ones do not slow them down.
    """
    width = min(dim, max(4 * wanted, 8))
    x = orthonormal(np.random.default_rng(seed).standard_normal((dim, width)))
    basis, previous, best, stalled = x, None, np.inf, 0
    for done in range(1, rounds + 1):
        image = multiply(basis)
        small = basis.T @ image
        e, c = np.linalg.eigh((small + small.T) / 2)
        e, c = e[::-1][:width], c[:, ::-1][:, :width]
        new, moved = basis @ c, image @ c
        residual = moved - new * e
        norms = np.linalg.norm(residual[:, :wanted], axis=0)
        worst = float(norms.max(initial=0.0))
        stalled = stalled + 1 if worst > 0.5 * best else 0
        best = min(best, worst)
        if worst <= tolerance * abs(e[0]) or new.shape[1] == dim or (stalled >= 3 and worst <= 100 * tolerance * abs(e[0])):
            return e[:wanted], new[:, :wanted], norms, done
        directions = new - x @ (x.T @ new) if previous is not None else np.zeros((dim, 0))
        x, previous = orthonormal(new), new
        held = orthonormal(residual, x)
        parts = [x, held]
        if directions.size:
            parts.append(orthonormal(directions, np.concatenate(parts, axis=1)))
        basis = np.concatenate(parts, axis=1)
    raise ArithmeticError(f"residual {worst:.3g} after {rounds} rounds")


def fit(vectors: DataFrame, vector_col: str, scale: float = SCALE, components: int = COMPONENTS) -> tuple[Model | None, int]:
    """The model, and the length of the vectors that take part; None where there is no direction of any spread."""
    coded = materialize(_coded(vectors, vector_col, scale).distinct(), "whiten-distinct")
    lengths = coded.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).head()
    if lengths is None:
        return None, 0
    dim = lengths["dim"]
    blocks = materialize(_fit_blocks(coded.filter(F.col("dim") == dim), dim), "whiten-blocks")
    n, sums = _moments(blocks, dim)
    mean = np.array([int(s) / n for s in sums])
    wanted = min(components, dim)
    trace = product(blocks, mean, np.zeros((dim, 1)))[1] / n
    if not trace > 0:
        return None, dim
    values, u, _, rounds = lobpcg(lambda b: product(blocks, mean, b)[0] / n, dim, wanted)
    keep = values > 1e-12 * trace
    values, u = values[keep], u[:, keep]
    image, _, inner = product(blocks, mean, u)
    residual = float(np.linalg.norm(image / n - u * values, axis=0).max() / values[0])
    covariance = inner / n / np.sqrt(np.outer(values, values))
    return Model(n, sums, values, u, trace, residual, float(np.abs(covariance - np.eye(len(values))).max()), rounds), dim


def whitened(vectors: DataFrame, model: Model, dim: int, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """A row for each vector of the model's length and each component."""
    n, sums, k = model.n, model.sums, len(model.values)
    mean = np.array([int(s) / n for s in sums])
    turn = model.vectors / np.sqrt(model.values)
    explained, error = model.values / model.trace, model.identity_error
    bound = max((abs(int(s)) for s in sums), default=0)

    def deviation(x: np.ndarray) -> int | None:
        most = n * int(np.abs(x).max()) + bound
        v = x * n - sums.astype(np.int64) if most < 1 << 62 else np.array([n * int(a) - int(s) for a, s in zip(x, sums)], object)
        total = int((v * v).sum()) if most * most * dim < 1 << 63 else sum(int(a) ** 2 for a in v)
        return total if total < 1 << 63 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, x) for i, x in whole_rows(b.column(1), scale) if len(x) == dim]
            at = np.array([i for i, _ in rows], np.int64)
            w = (np.array([x for _, x in rows], float).reshape(-1, dim) - mean) @ turn
            far = [deviation(x) for _, x in rows]
            m = len(rows) * k
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)).take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, n, np.int64)),
                 pa.array([v for v in far for _ in range(k)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(m, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector_col)
    return mapped(given, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double", 2048)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    with temporary(spark):
        model, dim = fit(vectors, "embedding")
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whitened(vectors, model, dim, "vec_id", "embedding")
