"""Exact nearest neighbours by pivots: Voronoi cells, triangle inequality, and bounds that tighten in a second round.

Vectors of both sets go to the nearest of a bounded number of pivots, sampled from the macro set; a cell's vectors are
packed into blocks in order of their distance from the pivot, so a full cell is many blocks, each a ring. In the first round
a micro block meets one macro block, that of the nearest ring in its cell; the k-th distances found are its bars. In
the second it meets the macro blocks that its largest bar cannot exclude: cells first, by the distances of pivots and
the rings' ends, then blocks, by ring, centre and reach. Block pairs come from an equality join on cells and meet in tiles
(`tiles`), so that a block is shuffled a few times, not once for each block it meets, and a tile gives the k best of a vector, not
each pair; a tile is the unit of work and of recovery. Bounds keep ties, so results are exact.

Cosine scores are decided the same way, on vectors of length one; a score of 0 (all that point away) bounds nothing.

Defined results: vectors null, empty, or with null or non-finite components take no part; lengths that differ are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.tiles import groups_of, sized, tiled
from strataline.runtime import mapped
from strataline.shared import materialize, temporary

LEAST_BLOCK, MOST_PIVOTS, WIDE, SLACK = 256, 1024, 8192, 1e-9


def nearest(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, kind: str = "euclid") -> tuple[np.ndarray, np.ndarray]:
    """Places in c and scores of the k best for each row of q. euclid: least distances; cosine: largest 100 cos, at least 0. Ties: smaller id."""
    rough = q @ c.T
    if kind == "euclid":
        rough = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * rough
    else:
        norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]
        rough = -np.divide(rough, norms, out=np.full_like(rough, -np.inf), where=norms > 0)
    k = min(k, len(c))
    # Candidates: all that rounding could bring among the k best; scores that count as 0 are one value.
    bar = np.partition(rough, k - 1, axis=1)[:, k - 1]
    bar = np.where(bar >= 0, np.inf, bar) if kind != "euclid" else bar
    slack = 1e-9 * (1 + np.abs(bar) + (np.abs(q).max(initial=0) ** 2 if kind == "euclid" else 0))
    at, scores = np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
    for i in range(len(q)):
        cand = np.flatnonzero(rough[i] <= bar[i] + slack[i])
        if kind == "euclid":
            d = np.sqrt(((c[cand] - q[i]) ** 2).sum(1))
            order = np.lexsort((c_ids[cand], d))[:k]
        else:
            d = np.maximum(0, -100 * rough[i][cand])
            order = np.lexsort((c_ids[cand], -d))[:k]
        at[i], scores[i] = cand[order], d[order]
    return at, scores


def _space(v: np.ndarray, kind: str) -> np.ndarray:
    """Where bounds are taken: the vectors, or for cosine their directions."""
    if kind == "euclid":
        return v
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)


def clean(vectors: DataFrame, column: str) -> DataFrame:
    """id, v of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return vectors.filter((F.size(column) > 0) & fine).select(F.col("id").cast("long").alias("id"), v.alias("v"))


def _pivots(macro: DataFrame, count: int, kind: str) -> np.ndarray:
    """At most `count` distinct vectors, chosen by a hash of the id."""
    rows = macro.orderBy(F.xxhash64("id"), "id").limit(count).select("v").collect()
    if len({len(r["v"]) for r in rows}) > 1:
        raise ValueError("feature vectors differ in length")
    return np.unique(_space(np.array([r["v"] for r in rows]), kind), axis=0) if rows else np.zeros((0, 0))


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y, to about eight digits near zero; bounds allow for it."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0.0))


_BLOCK = "block long, cell int, n int, lo double, hi double, centre binary, reach double, ids binary, m binary"


def _blocks(vectors: DataFrame, pivots: np.ndarray, kind: str, size: int) -> DataFrame:
    """Blocks of up to `size` vectors of one cell that lie in a ring about its pivot."""
    dim = pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            if {len(v) for v in b.column(1)} != {dim}:
                raise ValueError("feature vectors differ in length")
            v = flat.reshape(-1, dim)
            x = _space(v, kind)
            cell = _between(x, pivots).argmin(1)
            d = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d), b.column(0), pa.array([r.tobytes() for r in v], pa.binary())], ["cell", "d", "id", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, at = TaskContext.get().partitionId() << 32, [], None

        def out():
            nonlocal number, held
            ids, d = np.array([r[2] for r in held], "<i8"), [r[1] for r in held]
            m = np.frombuffer(b"".join(r[3] for r in held)).reshape(-1, dim)
            x = _space(m, kind)
            centre = x.mean(0)
            row = [[number], [at], [len(ids)], [min(d)], [max(d)], [centre.tobytes()], [float(np.sqrt(((x - centre) ** 2).sum(1).max()))], [ids.tobytes()], [m.tobytes()]]
            number, held = number + 1, []
            kinds = pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.float64(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [f.split()[0] for f in _BLOCK.split(", ")])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[0] != at or len(held) >= size):
                    yield out()
                at = row[0]
                held.append(row)
        if held:
            yield out()

    rows = mapped(vectors, assign, "cell int, d double, id long, x binary", 2048)
    return mapped(rows.repartitionByRange("cell", "d", "id").sortWithinPartitions("cell", "d", "id"), pack, _BLOCK, 2048)


_FOUND = "a long, micro binary, macro binary, scores binary"


def _merged(ids: list[np.ndarray], scores: list[np.ndarray], k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of several tables [n, any] of ids and scores, in order; scores NaN count as none, and fill up."""
    i, s = np.concatenate(ids, 1), np.concatenate(scores, 1)
    key = np.where(np.isnan(s), np.inf, s if kind == "euclid" else -s)
    at = np.lexsort((i, key), axis=1)[:, :k]
    i, s = np.take_along_axis(i, at, 1), np.take_along_axis(s, at, 1)
    short = ((0, 0), (0, k - i.shape[1]))
    return np.pad(i, short), np.pad(s, short, constant_values=np.nan)


def _meet(a: DataFrame, b: DataFrame, pairs: DataFrame, groups: tuple[int, int], dim: int, k: int, kind: str, same_set: bool) -> DataFrame:
    """For each micro block and tile: its vectors' ids, and ids and scores [vectors, k] of their best in the macro blocks met there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            held = {n: (np.frombuffer(i, "<i8"), np.frombuffer(m).reshape(-1, dim)) for n, i, m in zip(*(right.column(c).to_pylist() for c in ("b", "ids", "m")))}
            for block, q_ids, m, near in zip(*(left.column(c).to_pylist() for c in ("a", "ids", "m", "near"))):
                q, qi = np.frombuffer(m).reshape(-1, dim), np.frombuffer(q_ids, "<i8")
                ids, scores, some, n = [np.zeros((len(q), 0), np.int64)], [np.zeros((len(q), 0))], [], 0
                for j, b in enumerate(sorted(near)):
                    some.append(held[b])
                    n += len(held[b][0])
                    if n >= WIDE or j + 1 == len(near):
                        ci, c = np.concatenate([v[0] for v in some]), np.concatenate([v[1] for v in some])
                        at, s = nearest(q, c, ci, k + same_set, kind)
                        found = ci[at]
                        ids.append(found)
                        scores.append(np.where(found == qi[:, None], np.nan, s) if same_set else s)
                        best = _merged(ids, scores, k, kind)
                        ids, scores, some, n = [best[0]], [best[1]], [], 0
                rows.append((block, q_ids, ids[0].astype("<i8").tobytes(), scores[0].tobytes()))
        kinds = pa.int64(), pa.binary(), pa.binary(), pa.binary()
        return pa.table({c.split()[0]: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(_FOUND.split(", "), kinds))})

    return tiled(a.select(F.col("block").alias("a"), "ids", "m"), b.select(F.col("block").alias("b"), "ids", "m"), pairs, groups, run, _FOUND)


def _bars(met: DataFrame, k: int, kind: str) -> DataFrame:
    """block, bar: within which distance (for cosine, of directions) each of its vectors has k; null if one has not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bars: list[float | None] = []
            for v in b.column(1).to_pylist():
                last = np.frombuffer(v).reshape(-1, k)[:, k - 1]
                worst = float(last.max() if kind == "euclid" else last.min())  # NaN if one is
                if kind != "euclid":
                    worst = float(np.sqrt(max(0.0, 2 - worst / 50)) + 1e-7) if worst > 0 else np.nan
                bars.append(None if np.isnan(worst) else worst)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bars, pa.float64())], ["block", "bar"])

    return mapped(met.select("a", "scores"), run, "block long, bar double", 16)


def _best(found: DataFrame, k: int, kind: str) -> DataFrame:
    """micro_id, macro_id, score, n: what the tiles found, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for micro, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, scores = _merged(*([np.frombuffer(p[c], t).reshape(-1, k) for p in parts] for c, t in (("macro", "<i8"), ("scores", "<f8"))), k, kind)
                ok = ~np.isnan(scores)
                left, n = np.repeat(np.frombuffer(micro, "<i8"), k).reshape(ids.shape), np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), ids.shape)
                yield pa.RecordBatch.from_arrays([pa.array(v[ok]) for v in (left, ids, scores, n)], ["micro_id", "macro_id", "score", "n"])

    packed = found.groupBy("a").agg(F.first("micro").alias("micro"), F.collect_list(F.struct("macro", "scores")).alias("parts"))
    return mapped(packed.select("micro", "parts"), run, "micro_id long, macro_id long, score double, n int", 4)


def _cells_within(summary: DataFrame, pivots: np.ndarray, rings: dict[int, tuple[float, float]]) -> DataFrame:
    """a, cell (and the block's own bounds): the macro cells that a block's bar cannot exclude."""
    cells = np.array(sorted(rings))
    lo, hi = (np.array([rings[c][i] for c in cells.tolist()]) for i in (0, 1))
    apart = _between(pivots, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], []]
            for a, cell, a_lo, a_hi, bar in zip(*(c.to_pylist() for c in b.columns)):
                gap = apart[cell][cells]
                slack = SLACK + 1e-7 * (gap + a_hi + hi)
                least = np.maximum(gap - a_hi - hi, np.maximum(lo - gap - a_hi, a_lo - gap - hi))
                kept = cells if bar is None else cells[least - slack <= bar]
                out[0] += [a] * len(kept)
                out[1] += kept.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())], ["a", "cell"])

    return mapped(summary.select("block", "cell", "lo", "hi", "bar"), run, "a long, cell int", 256)


def _apart(dim: int):
    """Distance of two centres given as bytes, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, x, y, reach, bar = (v.to_pylist() for v in b.columns)
            p, q = (np.frombuffer(b"".join(v)).reshape(-1, dim) for v in (x, y))
            d = np.sqrt(((p - q) ** 2).sum(1))
            ok = np.array([w is None for w in bar], bool) | (d - np.array(reach) - SLACK * (1 + d) <= np.array([np.inf if w is None else w for w in bar]))
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(5).take(at)], ["a", "b", "bar"])

    return run


def knn(micro: DataFrame, macro: DataFrame, k: int, kind: str = "euclid", column: str = "features", same_set: bool = False, work: dict | None = None) -> DataFrame:
    """micro_id, macro_id, score, n (1 the best): for euclid score is the distance. same_set leaves out a row's own id.

    `work` gets the numbers of block pairs met and of all.
    """
    schema = "micro_id long, macro_id long, score double, n int"
    spark = micro.sparkSession
    with temporary(spark):
        left, right = (materialize(clean(v, column), f"knn-{n}") for v, n in ((micro, "micro"), (macro, "macro")))
        size = max(LEAST_BLOCK, 4 * k)
        pivots = _pivots(right, min(MOST_PIVOTS, max(1, right.count() // size)), kind)
        if not len(pivots):
            return spark.createDataFrame([], schema)
        dim = pivots.shape[1]
        a, b = (materialize(_blocks(v, pivots, kind, size), "knn-blocks") for v in (left, right))
        rings = {r["cell"]: (r["lo"], r["hi"]) for r in b.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        slim = lambda d, s: d.select(F.col("block").alias(s), "cell", F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"), F.col("centre").alias(f"{s}_c"), F.col("reach").alias(f"{s}_r"))
        groups = groups_of(sized(a, "m"), sized(b, "m"), spark.sparkContext.defaultParallelism)
        # First round: the macro block of the nearest ring in the cell.
        off = F.abs(F.col("a_lo") + F.col("a_hi") - F.col("b_lo") - F.col("b_hi"))
        first = slim(a, "a").join(slim(b, "b"), "cell").groupBy("a").agg(F.min_by("b", F.struct(off, "b")).alias("b"))
        first = materialize(first, "knn-first")
        met = materialize(_meet(a, b, first, groups, dim, k, kind, same_set), "knn-found")
        barred = a.select("block", "cell", "n", "lo", "hi").join(_bars(met, k, kind), "block", "left")
        # Second round: the cells, then the blocks, that the bar leaves.
        cells = _cells_within(barred, pivots, rings)
        about = slim(a, "a").drop("cell").join(barred.select(F.col("block").alias("a"), "bar"), "a")
        close = cells.join(about, "a").join(slim(b, "b"), "cell").select("a", "b", "a_c", "b_c", (F.col("a_r") + F.col("b_r")).alias("reach"), "bar")
        second = mapped(close, _apart(dim), "a long, b long, bar double", 4096).select("a", "b").join(first, ["a", "b"], "left_anti")
        if work is not None:
            second = materialize(second, "knn-second")
            work |= {"met": first.count() + second.count(), "all": a.count() * b.count()}
        more = _meet(a, b, second, groups, dim, k, kind, same_set)
        return materialize(_best(met.unionByName(more), k, kind), "knn", outlive=True)
