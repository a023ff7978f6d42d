"""Operator 12: mix sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source lie in an order drawn by hash, and its words form a line; a target of so many words takes the line
from its start, over again where the target exceeds the source, so every document comes floor or ceil of target/size times.
The stretch taken is cut into blocks of equal length. A source's block quota is exact; a binary tree over the output shards
splits the vector of quotas at each node: how many blocks of each source go left is one draw from the multivariate
hypergeometric distribution, as if all blocks were dealt without replacement, and what is not drawn goes right. A leaf's
counts select disjoint ranges of the places of a keyed permutation of each source's blocks. A document belongs to the block
its first word lies in; within a shard, documents are ordered by a hash.

The tree runs over bundles of BUNDLE sources first, whose totals alone are on the driver, then within each bundle, in a task
of its own, with the bundle's counts of each shard as sizes. Documents get their place on their source's line by an ordered
scan, so a source that holds most rows is spread over tasks; it meets its blocks by (source, block). All draws are
functions of the seed and of what the rows hold.

Targets share the words of all sources by weight; a target above `limit` times its source's words stops there, and the excess
goes to the others by weight, again until none is above (decided in whole numbers). A target is met to the word: the
last document of a source's stretch is taken in part, its first words, where it goes beyond the end.

Defined results: null text has no words; documents without words are never drawn; a null source is one, ordered last;
rows that repeat an id are documents each; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import documents, mapped, materialize, temporary
from strataline.operators.scan import numbered, running_sum

WEIGHTS, LIMIT, SEED = (1, 2, 3), 3, 12
SHARD_WORDS, LEAST_SHARDS, SHARD_BLOCKS = 1 << 26, 16, 256
BUNDLE, SMALL_ROWS = 1024, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, keep: Sequence[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The columns of `keep`, with mx_row (unique), mx_source, mx_size (words) and mx_hash, which orders a source's line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.regexp_count(text, F.lit(WORD)).cast("long"), F.xxhash64(F.lit(seed), F.col(id_col), text)
    return docs.select(*keep, F.monotonically_increasing_id().alias("mx_row"), F.col(source_col).cast("string").alias("mx_source"), own[0].alias("mx_size"), own[1].alias("mx_hash"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """Of rows mx_source, mx_total: with number (by code point, null last), weight, target, quota (words to take); and all words."""
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    rows = numbered(sizes, [F.asc_nulls_last("mx_source")], out="number").withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")))
    rows = materialize(rows, "mix-sources")
    words, weight = rows.agg(F.sum("mx_total"), F.sum("weight")).head()
    words, num, den = words or 0, words or 0, weight or 0
    exact = lambda v: F.lit(str(v)).cast("decimal(20,0)")
    while den:
        above = F.col("weight").cast("decimal(10,0)") * exact(num) > (F.col("mx_total") * limit).cast("decimal(20,0)") * F.lit(str(den)).cast("decimal(18,0)")
        capped, left = rows.agg(F.sum(F.when(above, F.col("mx_total") * limit).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).head()
        if (words - capped, left) == (num, den):
            break
        num, den = words - capped, left
    most = (F.col("mx_total") * limit).cast("double")
    share = F.col("weight") * F.lit(float(num)) / F.lit(float(den)) if den else most
    target = F.least(most, share)
    return rows.withColumn("target", target).withColumn("quota", F.round("target").cast("long")), words


def shard_counts(quotas: np.ndarray, capacities: np.ndarray, seed: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices, counts above zero) of a splitting tree: quotas and capacities have one sum, and all sums are kept."""
    most = np.concatenate([[0], np.cumsum(capacities)])

    def split(lo: int, hi: int, at: np.ndarray, own: np.ndarray):
        if not len(at):
            return
        if hi - lo == 1:
            yield lo, at, own
            return
        mid = (lo + hi) // 2
        draw = np.random.default_rng([*seed, lo, hi]).multivariate_hypergeometric(own, int(most[mid] - most[lo]), method="marginals")
        for a, b, part in ((lo, mid, draw), (mid, hi, own - draw)):
            yield from split(a, b, at[part > 0], part[part > 0])

    at = np.flatnonzero(quotas)
    yield from split(0, len(capacities), at, quotas[at].astype(np.int64))


def _mixed(v: np.ndarray, key: int) -> np.ndarray:
    v = (v + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    return v ^ v >> np.uint64(32)


def permuted(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0, ..., n - 1 at the given places: a Feistel network, walked until it lands below n."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = places.astype(np.uint64), np.arange(len(places)) if n > 1 else np.arange(0)
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(6):
            left, right = right, left ^ (_mixed(right, key * 8 + r + 1) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def dealt_blocks(sources: DataFrame, block: int, shards: int, seed: int = SEED) -> DataFrame:
    """number, block, shard of every block that the quotas of the sources take."""
    quotas = sources.filter("quota > 0").select("number", F.ceil(F.col("quota") / block).cast("long").alias("blocks"), F.floor(F.col("number") / BUNDLE).cast("long").alias("bundle"))
    totals = [(r["bundle"], r["n"]) for r in quotas.groupBy("bundle").agg(F.sum("blocks").alias("n")).orderBy("bundle").collect()]
    total = sum(n for _, n in totals)
    even = np.full(shards, total // shards, np.int64)
    even[: total % shards] += 1
    counts = np.zeros((len(totals), shards), np.int64)
    for shard, at, own in shard_counts(np.array([n for _, n in totals], np.int64), even, [seed, 0]):
        counts[at, shard] = own
    spark = sources.sparkSession
    given = spark.createDataFrame([(b, bytearray(c.astype("<i8").tobytes())) for (b, _), c in zip(totals, counts)], "bundle long, counts binary")

    def ranges(key: tuple[pa.Scalar, ...], bundle: pa.Table) -> pa.Table:
        rows = bundle.sort_by("number")
        numbers, own = rows["number"].to_numpy(), rows["blocks"].to_numpy()
        first, out = np.zeros(len(own), np.int64), [[], [], [], [], []]
        for shard, at, n in shard_counts(own, np.frombuffer(rows["counts"][0].as_py(), "<i8"), [seed, 1, int(key[0].as_py())]):
            for column, values in zip(out, (numbers[at], own[at], np.full(len(at), shard), first[at].copy(), n)):
                column.append(values)
            first[at] += n
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in zip(("number", "blocks", "shard", "first", "n"), out)})

    schema = "number long, blocks long, shard long, first long, n long"
    held = quotas.join(F.broadcast(given) if len(totals) * shards < 1 << 20 else given, "bundle").groupBy("bundle").applyInArrow(ranges, schema)
    places = held.repartition("number", "shard").select("number", "blocks", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, blocks, shard, place = (c.to_numpy() for c in b.columns)
            out = np.empty(len(number), np.int64)
            for s in np.unique(number).tolist():
                at = number == s
                out[at] = permuted(place[at], int(blocks[at][0]), seed * 1_000_003 + s)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(out), pa.array(shard)], ["number", "block", "shard"])

    return mapped(places, run, "number long, block long, shard long", 10_000)


def mix(docs: DataFrame, keep: Sequence[str], weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, shards: int | None = None, seed: int = SEED, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Documents (the columns of `keep` and mx_row, mx_size, mx_total, target) and draws (keep, mx_row, mx_size, epoch, shard, place, words).

    `place` orders a shard; `words` below the document's size means its first words. To write the mixture, keep the text
    and hand the draws to `write_shards`.
    """
    rows = materialize(sized(docs, keep, seed=seed, **columns), "mix-sizes")
    sources, words = targets(rows.groupBy("mx_source").agg(F.sum("mx_size").alias("mx_total")), weights, limit)
    sources = materialize(sources, "mix-targets")
    shards = shards or max(LEAST_SHARDS, -(-words // SHARD_WORDS))
    block = max(1, -(-words // (shards * SHARD_BLOCKS)))
    lined = running_sum(rows, [F.asc_nulls_last("mx_source"), "mx_hash", "mx_size", "mx_row"], F.col("mx_size"), ["mx_source"], "mx_upto")
    about = sources.select(F.col("mx_source").alias("mx_s"), "mx_total", "target", "quota", "number")
    about = F.broadcast(about) if sources.count() <= SMALL_ROWS else about
    known = lined.join(about, F.col("mx_source").eqNullSafe(F.col("mx_s"))).drop("mx_s")
    start = F.col("mx_upto") - F.col("mx_size")
    times = F.ceil((F.col("quota") - start) / F.col("mx_total")).cast("int")
    begins = F.col("epoch") * F.col("mx_total") + F.col("mx_upto") - F.col("mx_size")
    drawn = known.filter((F.col("mx_size") > 0) & (start < F.col("quota"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("mx_begin", begins).filter("mx_begin < quota")
    drawn = drawn.withColumn("block", F.floor(F.col("mx_begin") / block).cast("long")).withColumn("words", F.least(F.col("mx_size"), F.col("quota") - F.col("mx_begin")))
    draws = drawn.join(dealt_blocks(sources, block, shards, seed), ["number", "block"]).withColumn("place", F.xxhash64(F.lit(seed), "mx_hash", "mx_row", "epoch"))
    return known.select(*keep, "mx_row", "mx_size", "mx_total", "target"), draws.select(*keep, "mx_row", "mx_size", "epoch", "shard", "place", "words")


def write_shards(draws: DataFrame, path: str, text_col: str = "text") -> None:
    """The mixture as Parquet, a folder for each shard, in shuffled order; a document taken in part has its first words, joined by spaces."""
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    whole = draws.withColumn(text_col, F.when(F.col("words") < F.col("mx_size"), part).otherwise(F.col(text_col)))
    whole.repartition("shard").sortWithinPartitions("shard", "place").drop("mx_row", "mx_size", "place", "words").write.partitionBy("shard").parquet(path)


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark):
        docs, draws = mix(documents(spark, sf_dir), ["doc_id"])
        one = docs.select("mx_row", "doc_id", F.col("mx_size").alias("size"), F.col("mx_total").alias("source_size"), "target", F.lit(0).cast("long").alias("words"))
        both = one.unionByName(draws.select("mx_row", "words"), allowMissingColumns=True)
        firsts = [F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
        out = both.groupBy("mx_row").agg(*firsts, F.sum("words").alias("taken")).drop("mx_row")
        return materialize(out, "op12", outlive=True)
