"""Operator 6: SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments; of two fingerprints with at most two differing bits, one segment
differs in at most one. Each segment therefore gives 33 signatures: itself, and one with each bit wiped. Fingerprints
that close share a signature: the plain one if the segment is equal, else the one that wipes the differing bit, in
which the two stand on different sides of that bit. Signatures meet in an equality join; pairs are verified by counting
bits.

A bucket of more than `pair_cap` fingerprints never emits its pairs: there, the other segment is indexed. In a plain
bucket each fingerprint enters with its other segment and every one-bit variant of it: two that share an entry differ
in two bits at most, and every such pair shares one. In a wiped bucket, where one bit is spent, the smaller side enters
with all variants and the larger with its own value only. Linking each fingerprint to the least of its entry so loses
no link and adds none.

Defined results: null and empty texts have fingerprint zero; a text of fewer words than a shingle is one shingle; exact
copies share a fingerprint and so a component; repeated rows each get their row; a null doc_id gets a row but is never
the name of a component (null if the component has no other); columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import documents, materialize, mapped, temporary
from strataline.llm.components import components

SEED = 42
PAIR_CAP = 32
SAME_CAP = 8
BIT_OF = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def majority(hashes: list[int]) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number."""
    if not hashes:
        return 0
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)  # little-endian bytes
    out = 0
    for k in range(8):
        ones = np.bincount(lanes[:, k], minlength=256) @ BIT_OF
        out |= int(((2 * ones > len(hashes)) << np.arange(8)).sum()) << (8 * k)
    return out - (1 << 64) if out >> 63 else out


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    """Of the shingles of `size` words, repeats included."""
    w = words(text)
    if len(w) > size:
        shingles = map(b" ".join, zip(*(w[k:] for k in range(size))))
    else:
        shingles = [b" ".join(w)] if w else []
    return majority([xxhash.xxh64_intdigest(s, seed) for s in shingles])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, size) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return mapped(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


_LOW = (1 << 32) - 1


def _variants(nodes: DataFrame) -> DataFrame:
    """id, fp, key, side: 66 a node. key holds the number of the signature above its 32 bits: 0 and 33 plain, the others wiped; side is the wiped bit."""
    with_number = nodes.select("id", "fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("i"))
    segment = F.when(F.col("i") < 33, F.col("fp").bitwiseAND(F.lit(_LOW))).otherwise(F.shiftrightunsigned("fp", 32))
    rows = with_number.select("id", "fp", F.col("i").cast("bigint").alias("i"), (F.col("i") % 33 - 1).alias("bit"), segment.alias("segment"))
    plain = F.col("bit") < 0
    wiped = F.expr("segment & ~shiftleft(1L, bit)")
    side = F.when(plain, F.lit(0)).otherwise(F.expr("cast(shiftright(segment, greatest(bit, 0)) & 1L as int)"))
    return rows.select("id", "fp", F.expr("shiftleft(i, 32)").bitwiseOR(F.when(plain, F.col("segment")).otherwise(wiped)).alias("key"), side.alias("side"))


def close_pairs(nodes: DataFrame, pair_cap: int = PAIR_CAP, bits: int = 2) -> DataFrame:
    """nodes (id long, fp long; ids distinct) -> (a, b), a < b: links at `bits` (2 or 3) or fewer differing bits.

    Every pair of a bucket up to `pair_cap`. In larger ones, with two bits, links that connect the same nodes as all pairs
    would. With three bits, where links are a first pass before an exact join (`neardedup`), each node of a large plain bucket is linked
    to the one nearest to the bucket's majority of bits, most likely what the others were copied from, at any distance.
    Nodes of a fingerprint that more than `SAME_CAP` share are linked to the least of them, which stands for
    them from there on: with two bits they are one component anyway, with three the exact join finds what this leaves out.
    """
    if bits not in (2, 3):
        raise ValueError("two segments leave at most one differing bit in one of them for two or three bits")
    spark = nodes.sparkSession
    with temporary(spark):
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        nodes = materialize(nodes, "simhash-all")
        crowded = materialize(nodes.groupBy("fp").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter(F.col("n") > SAME_CAP).select("fp", "a"), "simhash-crowded")
        same = materialize(nodes.join(crowded, "fp").filter("a <> id").select("a", F.col("id").alias("b")), "simhash-same")
        nodes = materialize(nodes.join(same.select(F.col("b").alias("id")), "id", "left_anti").repartition(parts, "id"), "simhash-nodes")
        # n counts in the upper half, the nodes on side 1 in the lower.
        sums = _variants(nodes).groupBy("key").agg(F.sum(F.lit(1 << 32) + F.col("side")).alias("s"), F.min("id").alias("a"), F.max("id").alias("b"))
        n, ones = F.shiftrightunsigned("s", 32), F.col("s").bitwiseAND(F.lit(_LOW))
        plain = F.shiftrightunsigned("key", 32) % 33 == 0
        buckets = sums.select("key", n.alias("n"), ones.alias("ones"), "a", "b").filter((F.col("n") > 1) & (plain | ((F.col("ones") > 0) & (F.col("ones") < F.col("n")))))
        buckets = materialize(buckets, "simhash-buckets")
        twos = materialize(buckets.filter(F.col("n") == 2).select("a", "b").distinct(), "simhash-twos")
        fp_of = lambda name: nodes.select(F.col("id").alias(name), F.col("fp").alias(f"fp_{name}"))
        near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= bits
        twos = twos.join(fp_of("a"), "a").join(fp_of("b"), "b").filter(near("fp_a", "fp_b")).select("a", "b")
        many = materialize(buckets.filter("n > 2").select("key", "n", "ones"), "simhash-many")
        entries = materialize(_variants(nodes).join(many, "key"), "simhash-entries")
        few = entries.filter(F.col("n") <= pair_cap)
        other = few.select("key", F.col("id").alias("b"), F.col("fp").alias("fp_b"), F.col("side").alias("side_b"))
        across = (F.shiftrightunsigned("key", 32) % 33 == 0) | (F.col("side") != F.col("side_b"))
        pairs = few.join(other, "key").filter((F.col("id") < F.col("b")) & across & near("fp", "fp_b")).select(F.col("id").alias("a"), "b")
        crowds = entries.filter(F.col("n") > pair_cap)
        stars = _crowds(crowds) if bits == 2 else _hubs(crowds)
        return materialize(same.unionByName(twos).unionByName(pairs).unionByName(stars).distinct(), "simhash-pairs", outlive=True)


def _crowds(entries: DataFrame) -> DataFrame:
    """(a, b): each node linked to the least of every cell of its bucket that it shares."""
    number = F.shiftrightunsigned("key", 32)
    rest = F.when(number < 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(_LOW)))
    fewer = F.when(2 * F.col("ones") <= F.col("n"), F.lit(1)).otherwise(F.lit(0))
    spread = (number % 33 == 0) | (F.col("side") == fewer)
    zero = F.array(F.lit(0).cast("long"))
    flips = F.concat(zero, F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    cells = entries.select("id", "key", rest.alias("rest"), F.explode(F.when(spread, flips).otherwise(zero)).alias("flip")).select("id", "key", F.col("rest").bitwiseXOR(F.col("flip")).alias("cell"))
    cells = materialize(cells, "simhash-cells")
    least = materialize(cells.groupBy("key", "cell").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"), "simhash-least")
    return cells.join(least, ["key", "cell"]).filter("a <> id").select("a", F.col("id").alias("b")).distinct()


def _hubs(entries: DataFrame) -> DataFrame:
    """(a, b): each node of a plain bucket and the one nearest to its majority of bits (ties: the smaller id)."""
    plain = entries.filter(F.shiftrightunsigned("key", 32) % 33 == 0).select("key", "id", "fp")
    votes = plain.groupBy("key").agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))).alias(f"v{k}") for k in range(64)))
    middle = F.lit(0).cast("long")
    for k in range(64):
        middle = middle.bitwiseOR(F.when(2 * F.col(f"v{k}") > F.col("n"), F.lit((1 << k) - ((1 << 64) if k == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    votes = materialize(votes.select("key", middle.alias("middle")), "simhash-middles")
    far = materialize(plain.join(votes, "key").select("key", "id", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))).alias("far")), "simhash-far")
    hubs = materialize(far.groupBy("key").agg(F.min(F.struct("far", "id")).alias("hub")).select("key", F.col("hub.id").alias("hub")), "simhash-hubs")
    return far.join(hubs, "key").filter("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 3, pair_cap: int = PAIR_CAP) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = materialize(fingerprints(docs, size), "simhash-prints")
    with temporary(docs.sparkSession):
        nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
        root = components(close_pairs(nodes.select(F.col("fp").alias("id"), "fp"), pair_cap)).withColumnRenamed("node", "fp")
        rooted = materialize(nodes.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
        named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
        of_print = materialize(rooted.join(named, "root").select("fp", "component_id"), "simhash-of-print", outlive=True)
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
