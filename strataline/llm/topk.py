"""Operator 3: exact top-k by inner product, columnar branch-and-bound.

Vectors become integers floor(scale * x) and are packed into blocks in vertical layout (one row of a block's matrix
holds one dimension of all its vectors), in the narrowest integers that hold them. Scores grow dimension chunk by
dimension chunk; after each chunk a candidate stays only if its partial score plus the most that the remaining mass
allows, |q_rest| * |c_rest|, reaches the k-th best score known for the query, and the survivors are compacted. Bounds keep
ties, so results are exact.

The query set is dealt in blocks against all blocks of candidates, in two rounds. In the first, each query block meets a
few candidate blocks (an equality join on a hash); its k-th best scores there are the bars it brings to the second, in
which it meets all. A whole block is skipped for a query whose bar its largest norms can't reach. A pair of blocks returns
at most k rows for each query, so nothing grows with the square of a group of equal vectors; pairs share no other state,
so a lost executor repeats its own.

Defined results: vectors null, empty, or with null or non-finite components take no part, nor do rows with a null id; a
query is never matched with its own row, but with other rows of its id; equal scores go to the smaller vec_id; rows that
repeat an id are candidates each, and a repeated query id is answered for each of its rows; vectors of another dimension
than the query's are no candidates; fewer than k candidates give fewer rows; columns besides the id and the vector are
not looked at. Components are 64-bit integers (larger ones become the largest); scores are exact, and one beyond 64 bits becomes the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm.common import mapped, materialize, table, temporary

BLOCK, QUERY_BLOCK, CHUNK = 2048, 256, 16
EXACT = 1 << 20  # components up to this stay exact in doubles at up to 2**12 dimensions
WIDEST = (1 << 63) - 1
_PACKED = "block long, dim int, width int, ids binary, asks binary, matrix binary"


def quantised(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, v (array<long>), asks (whether it is a query) of the rows that take part."""
    v = F.col(vector_col)
    x = F.transform(v, lambda e: e.cast("double"))
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    able = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    return able.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))


def pack_matrix(m: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a number, and the numbers in so many."""
    most = max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, np.ascontiguousarray(m.astype(f"<i{width}")).tobytes()


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` vectors of one dimension, as they come in a partition. A row's number is its block's plus its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple[list, list, list]] = {}
        block = TaskContext.get().partitionId() << 40

        def out(dim: int):
            nonlocal block
            ids, asks, parts = held.pop(dim)
            width, m = pack_matrix(np.concatenate(parts).reshape(-1, dim).T)
            row = [block], [dim], [width], [np.asarray(ids, "<i8").tobytes()], [np.asarray(asks, np.uint8).tobytes()], [m]
            block += len(ids)
            kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["block", "dim", "width", "ids", "asks", "matrix"])

        for b in batches:
            v = b.column(1)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum([len(x) for x in v]) if b.num_rows else []
            for i, asks, end, row in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), ends, v):
                d = len(row)
                ids, asked, parts = held.setdefault(d, ([], [], []))
                ids.append(i)
                asked.append(asks)
                parts.append(flat[end - d : end])
                if len(ids) >= size:
                    yield out(d)
        for d in list(held):
            yield out(d)

    return mapped(rows, run, _PACKED, 4096)


def unpack(dim: int, width: int, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(matrix, f"<i{width}").reshape(dim, len(i)).astype(np.int64)


_ASKED = "q_block long, q_dim int, q_width int, q_ids binary, q_rows binary, q_matrix binary"


def asked(blocks: DataFrame) -> DataFrame:
    """Blocks of up to QUERY_BLOCK queries of the blocks of all rows, with the numbers of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, dim, width, ids, asks, matrix in zip(*(c.to_pylist() for c in b.columns)):
                i, m = unpack(dim, width, ids, matrix)
                at = np.flatnonzero(np.frombuffer(asks, np.uint8))
                for some in np.split(at, range(QUERY_BLOCK, len(at), QUERY_BLOCK)) if len(at) else []:
                    q_width, q = pack_matrix(m[:, some])
                    row = [block + int(some[0])], [dim], [q_width], [i[some].tobytes()], [(block + some).astype("<i8").tobytes()], [q]
                    kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["q_block", "q_dim", "q_width", "q_ids", "q_rows", "q_matrix"])

    return mapped(blocks, run, _ASKED, 4)


def merged(queries: DataFrame) -> DataFrame:
    """Query blocks joined until they are full, as they come in a partition: each source block has few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int):
            parts = held.pop(dim)
            width, m = pack_matrix(np.concatenate([x[3] for x in parts], 1))
            row = [parts[0][0]], [dim], [width], [np.concatenate([x[1] for x in parts]).tobytes()], [np.concatenate([x[2] for x in parts]).tobytes()], [m]
            kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["q_block", "q_dim", "q_width", "q_ids", "q_rows", "q_matrix"])

        for b in batches:
            for block, dim, width, ids, rows, matrix in zip(*(c.to_pylist() for c in b.columns)):
                i, m = unpack(dim, width, ids, matrix)
                if sum(len(x[1]) for x in held.get(dim, [])) + len(i) > QUERY_BLOCK and dim in held:
                    yield out(dim)
                held.setdefault(dim, []).append((block, i, np.frombuffer(rows, "<i8"), m))
        for d in list(held):
            yield out(d)

    return mapped(queries, run, _ASKED, 64)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, held to 64 bits."""
    return np.array([max(-WIDEST - 1, min(WIDEST, x)) for x in (q.astype(object) @ c.astype(object)).tolist()], np.int64)


def search_block(
    q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, bars: np.ndarray | None = None, chunk: int = CHUNK
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places of candidates, scores), at most k a query and none below its bar; q and c are [dim, vectors] of
    64-bit integers, rows the numbers that tell a query's own row, bars a k-th best score known before."""
    dim = len(q)
    most_q, most_c = (max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (q, c))
    if most_q * most_c * dim >= 1 << 62:
        out = []
        for j in range(q.shape[1]):
            own = np.flatnonzero(c_rows != q_rows[j])
            s = exact_scores(q[:, j], c[:, own])
            best = np.lexsort((c_ids[own], ~s))[:k]
            out.append((j, own[best], s[best]))
        return out
    kind = np.float64 if max(most_q, most_c) <= EXACT and dim <= 1 << 12 else np.int64
    q, c = q.astype(kind), c.astype(kind)
    cuts = list(range(chunk, dim, chunk)) or [dim]
    rest = lambda m, at: np.sqrt((m[at:].astype(np.float64) ** 2).sum(0))
    q_rest, c_rest = [rest(q, at) for at in cuts], [rest(c, at) for at in cuts]
    reach = rest(q, 0) * rest(c, 0).max(initial=0)
    first = q[: cuts[0]].T @ c[: cuts[0]]
    out = []
    for j in range(q.shape[1]):
        bar = -np.inf if bars is None else float(bars[j])
        if reach[j] + 1e-6 * (1 + reach[j]) < bar:
            continue
        partial = first[j]
        alive = np.flatnonzero(c_rows != q_rows[j])
        if not len(alive):
            continue
        if bar == -np.inf and len(alive) >= k:
            # A first k-th best: the exact scores of those that lead after the first chunk.
            probe = alive if len(alive) <= 4 * k else alive[np.argpartition(-partial[alive], 4 * k)[: 4 * k]]
            exact = q[:, j] @ c[:, probe]
            bar = float(np.partition(exact, len(exact) - k)[len(exact) - k])
        part = partial[alive]
        for step, at in enumerate(cuts):
            top = part + q_rest[step][j] * c_rest[step][alive]
            stay = top + 1e-6 * (1 + np.abs(top)) >= bar
            alive, part = alive[stay], part[stay]
            end = cuts[step + 1] if step + 1 < len(cuts) else dim
            if at < end:
                part = part + q[at:end, j] @ c[at:end][:, alive]
            if len(part) > k:
                # Lower bounds of what is left raise the bar.
                low = part - q_rest[step + 1][j] * c_rest[step + 1][alive] if end < dim else part
                bar = max(bar, float(np.partition(low, len(low) - k)[len(low) - k]))
        best = np.lexsort((c_ids[alive], -part))[:k]
        out.append((j, alive[best], part[best].astype(np.int64)))
    return out


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """query (the number of its row), query_id, vec_id, score of pairs of a block and a query block (bars: a double for each query, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, dim, width, ids, matrix, q_dim, q_width, q_raw, q_rows, q_matrix, bars in zip(*(col.to_pylist() for col in b.columns)):
                if dim != q_dim:
                    continue
                c_ids, c = unpack(dim, width, ids, matrix)
                q_ids, q = unpack(dim, q_width, q_raw, q_matrix)
                rows = np.frombuffer(q_rows, "<i8")
                found = search_block(rows, q, block + np.arange(len(c_ids)), c_ids, c, k, None if bars is None else np.array(bars, float))
                which = np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64)
                cat = lambda i: np.concatenate([x[i] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[which]), pa.array(q_ids[which]), pa.array(c_ids[cat(1)]), pa.array(cat(2))], ["query", "query_id", "vec_id", "score"])

    columns = pairs.select("block", "dim", "width", "ids", "matrix", "q_dim", "q_width", "q_ids", "q_rows", "q_matrix", "bars")
    return mapped(columns, run, "query long, query_id long, vec_id long, score long", 4)


def with_bars(queries: DataFrame, blocks: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """queries and bars: the k-th best score of each query over the few blocks that share its hash, least numbers where those hold fewer."""
    cells = max(1, n_blocks // 2)
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(cells)).alias("cell")
    near = blocks.select("*", cell("block")).join(queries.select("*", F.lit(None).cast("array<double>").alias("bars"), cell("q_block")), "cell")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    kth = searched(near, k).withColumn("rank", rank).filter(F.col("rank") == k).select("query", "score")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(len(own)), pa.int32()), pa.array(own)], ["q_block", "place", "query"])

    placed = mapped(queries.select("q_block", "q_rows"), rows, "q_block long, place int, query long", 64).join(kth, "query", "left")
    bar = F.coalesce(F.col("score").cast("double"), F.lit(-float("inf")))
    bars = placed.groupBy("q_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", bar.alias("bar")))), lambda x: x["bar"]).alias("bars"))
    return queries.join(bars, "q_block")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query row."""
    with temporary(vectors.sparkSession):
        blocks = materialize(packed(quantised(vectors, is_query, id_col, vector_col, scale), BLOCK), "topk-blocks")
        few = materialize(asked(blocks), "topk-asked")
        n_blocks, n_queries = blocks.count(), few.agg(F.sum(F.length("q_ids") / 8)).first()[0] or 0
        parts = max(1, -(-int(n_queries) // (4 * QUERY_BLOCK)))
        queries = materialize(merged(few.repartition(parts, "q_block")), "topk-queries")
        blocks = blocks.drop("asks")
        queries = materialize(with_bars(queries, blocks, n_blocks, k), "topk-bars")
        dealt = max(1, min(n_blocks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n_blocks // 16))
        pairs = blocks.repartition(dealt, "block").crossJoin(queries.repartition(max(1, -(-queries.count() // 16)), "q_block"))
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        found = searched(pairs, k).withColumn("rank", best).filter(F.col("rank") <= k)
        return materialize(found.select("query_id", "rank", "vec_id", "score"), "topk-found", outlive=True)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n
  WHERE a.vec_id % 50 = 0 AND len(a.q) = len(b.q)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rk FROM s
)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 5
"""
