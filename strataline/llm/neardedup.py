"""Near-duplicate removal for the pipeline: SimHash first, then an exact join of 5-word shingles.

Texts of the same words (case and white space aside) are one node. A pair of nodes is a link if the Jaccard similarity of
their sets of 5-word shingles is at least `similarity`; of each component, the row with the smallest doc_id stays. Links
are found in two passes:

    SimHash   Four independent 64-bit fingerprints over a node's words, weighted by 1 + log of their count, each indexed
              by the deletion-variant signatures of `simhash`, propose pairs at three or fewer differing bits. This joins
              most near copies at little cost, and misses some.
    prefixes  All nodes again: of two sets that similar, the first n - ceil(similarity * n) + 1 shingles in any common
              order share one. Nodes meet by these, first each with one node of its shingle's largest group, then all pairs
              that are not connected yet. Pairs are kept by the bounds of size, position, parities of the sets and number
              of shared prefix shingles. None of these loses a link, so the components are those of all pairs, whatever the
              first pass missed.

The common order goes by how many texts hold a shingle, counted over all of them, the rarest first: what many texts share
stands in the prefix only of texts that hold little else. The `order_size` most common shingles have their exact place, the
others, each in fewer texts than those, go by hash before them; any order gives the same links, at another cost. Both passes verify their pairs on the texts.

Defined results: null texts count as empty, and all texts without words are one group; a text of fewer words than a
shingle is one shingle; repeated rows are copies; null doc_ids come last in choosing what stays; all columns are passed
on, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import mapped, materialize, release, temporary
from strataline.llm.components import components
from strataline.llm.simhash import close_pairs, words

PRINTS = 4  # an even number
ORDER_SIZE = 1 << 20  # shingles that the order places last
SKETCH = 8  # words of 64 parities
_SKETCH = [f"s{k}" for k in range(SKETCH)]
HELD = 1 << 20  # shingles a task holds before it counts them


def shingles(text: str | None, size: int = 5) -> set[bytes]:
    w = words(text)
    if len(w) <= size:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[k:] for k in range(size)))))


def word_fingerprints(own: list[bytes]) -> list[int]:
    """PRINTS fingerprints: the bits set in over half the hashes of the different words, by weight 1 + log of the count."""
    if not own:
        return [0] * PRINTS
    counts = Counter(own)
    raw = b"".join([xxhash.xxh3_128_digest(w, k) for w in counts for k in range(PRINTS // 2)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(counts), 8 * PRINTS), axis=1).astype(np.float32)
    weight = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
    return np.packbits(2 * (weight @ bits) > weight.sum()).view(">i8").tolist()


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows apart: doc_id, and the hash of the text. Rows equal in both are repeats."""
    return F.col("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("h")


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, h, digest and number of the words, fp0.. of the word sets; no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [words(t) for t in b.column(2).to_pylist()]
            digests = [blake2b(b" ".join(w), digest_size=16).digest() for w in own]
            fps = [pa.array(p, pa.int64()) for p in zip(*map(word_fingerprints, own))] if own else [pa.array([], pa.int64())] * PRINTS
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array([len(w) for w in own], pa.int64()), *fps], ["doc_id", "h", "digest", "words", *(f"fp{k}" for k in range(PRINTS))])

    fields = "".join(f", fp{k} long" for k in range(PRINTS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select(*_keys(docs), F.col("text").cast("string")), run, f"doc_id {kind}, h binary, digest binary, words long{fields}", 500)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int = 5) -> DataFrame:
    """pairs (a, b), texts (id, text): the pairs whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            memo: dict[int, set] = {}
            ids = [b.column(0).to_pylist(), b.column(1).to_pylist()]
            for side, column in zip(ids, (2, 3)):
                for i, t in zip(side, b.column(column).to_pylist()):
                    if i not in memo:
                        memo[i] = shingles(t, size)
            yield b.select([0, 1]).filter(pa.array([jaccard(memo[x], memo[y]) >= similarity for x, y in zip(*ids)], pa.bool_()))

    one = materialize(pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"), "dedup-pairs")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return mapped(both, run, "a long, b long", 200)


def _hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in shingles(text)], np.uint64).view(np.int64)


def shingle_counts(docs: DataFrame, bits: int) -> DataFrame:
    """bucket, keys, n: for each of 2^bits buckets by the first bits of the hash, the next 32 bits of the shingles that more than one
    text holds, and in how many texts (65535 at most), packed. A row of the shuffle holds what a task saw of a bucket."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        packed = lambda v: [x.tobytes() for x in np.split(v, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(packed(keys.astype("<u4")), pa.binary()), pa.array(packed(np.minimum(n, 65535).astype("<u2")), pa.binary())], ["bucket", "keys", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                own = _hashes(t).view(np.uint64) >> np.uint64(32 - bits)
                held.append(own)
                size += len(own)
            if size > HELD:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([np.frombuffer(k, "<u4") for k, _ in rows]), return_inverse=True)
            n = np.minimum(np.bincount(at, np.concatenate([np.frombuffer(c, "<u2") for _, c in rows])), 65535).astype("<u2")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([keys[n > 1].tobytes()], pa.binary()), pa.array([n[n > 1].tobytes()], pa.binary())], ["bucket", "keys", "n"])

        for b in batches:
            for bucket, k, c in zip(*(v.to_pylist() for v in b.columns)):
                if bucket != now and rows:
                    yield out()
                    rows = []
                now = bucket
                rows.append((k, c))
        if rows:
            yield out()

    schema = "bucket long, keys binary, n binary"
    seen = mapped(docs.select(F.col("text").cast("string")), count, schema, 500)
    return mapped(seen.repartition("bucket").sortWithinPartitions("bucket"), add, schema, 200)


def _common(docs: DataFrame, n_words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of a bucket, and hashes (cut to those and 32 more, ascending) of the most common shingles, with their counts."""
    bits = min(31, max(8, (n_words // 200_000).bit_length()))
    counts = materialize(shingle_counts(docs, bits), "dedup-shingles")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(65536, np.int64)
        for b in batches:
            for c in b.column(2).to_pylist():
                sums += np.bincount(np.frombuffer(c, "<u2"), minlength=65536)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["n", "shingles"])

    by_count = {r.n: r.shingles for r in mapped(counts, histogram, "n long, shingles long").groupBy("n").agg(F.sum("shingles").alias("shingles")).collect()}
    least, total = 65536, 0
    for n in sorted(by_count, reverse=True):
        if n < 3 or total + by_count[n] > ORDER_SIZE:
            break
        least, total = n, total + by_count[n]

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, k, c in zip(*(v.to_pylist() for v in b.columns)):
                n = np.frombuffer(c, "<u2")
                kept = np.flatnonzero(n >= least)
                if len(kept):
                    keys = np.frombuffer(k, "<u4")[kept].astype(np.uint64) | np.uint64(bucket << 32)
                    yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([n[kept].tobytes()], pa.binary())], ["keys", "n"])

    got = [(np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["n"], "<u2")) for r in mapped(counts, above, "keys binary, n binary").toLocalIterator()]
    keys, n = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.uint16))
    order = np.argsort(keys)
    return bits, keys[order], n[order]


def _least(similarity: float, n: int) -> int:
    """The least number of shingles that a set of n shares with one that is similar."""
    return math.ceil(similarity * n - 1e-9)


def _prefixes(docs: DataFrame, similarity: float, n_words: int) -> DataFrame:
    """doc_id, h, n, sketch (s0..), keys of every row with words: the number of its shingles, their parities, and the first of them in the common order."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, texts = sent.value
        for b in batches:
            sizes, keys, sketches = [], [], np.zeros((b.num_rows, 64 * SKETCH), np.uint8)
            for row, t in zip(sketches, b.column(2).to_pylist()):
                own = _hashes(t)
                row[:] = np.bincount(own & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
                rank = np.zeros(len(own), np.uint16)
                if len(known):
                    cut = own.view(np.uint64) >> np.uint64(32 - bits)
                    at = np.minimum(np.searchsorted(known, cut), len(known) - 1)
                    rank = np.where(known[at] == cut, texts[at], 0)
                sizes.append(len(own))
                keys.append(own[np.lexsort((own, rank))][: len(own) - _least(similarity, len(own)) + 1])
            packed = np.packbits(sketches, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), *(pa.array(packed[:, k]) for k in range(SKETCH)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "n", *_SKETCH, "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h binary, n int, {', '.join(f'{c} long' for c in _SKETCH)}, keys array<long>"
    return mapped(docs.select(*_keys(docs), F.col("text").cast("string")), run, schema, 500).filter("n > 0")


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Of two entries (structs) of one key: what every similar pair fulfils. Each shingle that one text only has flips one parity."""
    n_a, n_b, at_a, at_b = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.place"), F.col(f"{b}.place")
    sizes = F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b) - 1e-9
    shared = F.least(at_a, at_b) + F.least(n_a - at_a, n_b - at_b)
    places = shared >= similarity / (1 + similarity) * (n_a + n_b) - 1e-9
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _SKETCH), F.lit(0))
    return sizes & places & (apart <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-9)


def _mixed(entries: DataFrame, sizes: DataFrame, rooted: DataFrame) -> DataFrame:
    """key, e (struct of id, root, n, place, sketch), big (the root with most entries of the key): entries of keys with several roots."""
    own = entries.join(rooted.select("id", "root"), "id").join(sizes, "id")
    own = materialize(own.select("key", F.struct("id", "root", "n", "place", *_SKETCH).alias("e")), "dedup-own")
    roots = own.groupBy("key", F.col("e.root").alias("root")).agg(F.count("*").alias("c"))
    several = roots.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("big")).filter("roots > 1")
    return materialize(own.join(several.select("key", F.col("big.root").alias("big")), "key"), "dedup-mixed")


def hub_pairs(mixed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each entry outside its key's largest group, with the one of that group that has the key earliest. Of copies of
    one text with changes here and there that is likely the text itself, which has no shingles of its own before the key."""
    hub = mixed.filter(F.col("e.root") == F.col("big")).groupBy("key").agg(F.min_by("e", F.struct("e.place", "e.id")).alias("x"))
    met = mixed.filter(F.col("e.root") != F.col("big")).select("key", "e").join(hub, "key").filter(_may_be_similar("e", "x", similarity))
    return met.select(F.least("e.id", "x.id").alias("a"), F.greatest("e.id", "x.id").alias("b")).distinct()


def unconnected_pairs(mixed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of different roots that may be similar; none that is similar is left out."""
    left = mixed.filter(F.col("e.root") != F.col("big"))
    right = mixed.select("key", F.col("e").alias("x"))
    once = (F.col("x.root") == F.col("big")) | (F.col("e.id") < F.col("x.id"))
    met = left.join(right, "key").filter((F.col("e.root") != F.col("x.root")) & once & _may_be_similar("e", "x", similarity))
    met = met.select(F.least("e.id", "x.id").alias("a"), F.greatest("e.id", "x.id").alias("b"), F.col("e.n").alias("n_a"), F.col("x.n").alias("n_b"))
    beyond = lambda n: F.ceil(F.lit(similarity) * F.col(n) - 1e-9) - 1  # noqa: E731  shingles outside the prefix
    sums = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    enough = F.col("c") + F.greatest(beyond("n_a"), beyond("n_b")) >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-9
    return sums.filter(enough).select("a", "b")


def _links(docs: DataFrame, named: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The similar ones of pairs (a, b) of nodes (id, doc, h), verified on the texts of docs."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ends = materialize(named.join(ends, "id", "left_semi"), "dedup-ends")
    own = docs.select(F.col("doc_id").alias("own"), _keys(docs)[1].alias("own_h"), F.col("text").cast("string").alias("text"))
    texts = own.join(ends, (F.col("own_h") == F.col("h")) & F.col("own").eqNullSafe(F.col("doc"))).select("id", "text").dropDuplicates(["id"])
    return materialize(verified(pairs, materialize(texts, "dedup-texts"), similarity), "dedup-links")


def _rerooted(rooted: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) after roots (node, root) of what were roots."""
    return rooted.join(roots.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("id", F.coalesce("now", "root").alias("root"))


def _merged(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) with the groups that links (a, b) connect made one."""
    of = lambda end, name: rooted.select(F.col("id").alias(end), F.col("root").alias(name))
    between = links.join(of("a", "u"), "a").join(of("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    return _rerooted(rooted, components(between))


def stays(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, h, times of the row that stays of each group: its key, and how many rows have that key."""
    spark = docs.sparkSession
    with temporary(spark):
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "h")
        nodes = materialize(_prints(docs), "dedup-prints")
        n_words = nodes.agg(F.sum("words")).first()[0] or 0
        times = nodes.groupBy("digest", "doc_id", "h").agg(F.count("*").alias("times"), *(F.first(f"fp{k}").alias(f"fp{k}") for k in range(PRINTS)))
        nodes = times.groupBy("digest").agg(F.min(F.struct(order.alias("key"), "times")).alias("first"), *(F.first(f"fp{k}").alias(f"fp{k}") for k in range(PRINTS)))
        nodes = materialize(nodes.drop("digest").withColumn("id", F.monotonically_increasing_id()), "dedup-nodes")
        pairs = None
        for k in range(PRINTS):
            found = close_pairs(nodes.select("id", F.col(f"fp{k}").alias("fp")), bits=3)
            pairs = found if pairs is None else pairs.unionByName(found)
            release(spark)
        pairs = materialize(pairs.distinct(), "dedup-candidates")
        named = nodes.select("id", F.col("first.key.doc").alias("doc"), F.col("first.key.h").alias("h"))
        roots = components(_links(docs, named, pairs, similarity))
        rooted = materialize(_rerooted(named.select("id", F.col("id").alias("root")), roots), "dedup-rooted")
        release(spark)
        own = _prefixes(docs, similarity, n_words).withColumnRenamed("doc_id", "own").withColumnRenamed("h", "own_h")
        met = own.join(named, (F.col("own_h") == F.col("h")) & F.col("own").eqNullSafe(F.col("doc"))).dropDuplicates(["id"])
        prefixes = materialize(met.select("id", "n", *_SKETCH, "keys"), "dedup-prefixes")
        entries = prefixes.select("id", F.posexplode("keys").alias("place", "key"))
        shared = entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
        entries = materialize(entries.join(shared, "key"), "dedup-entries")
        release(spark)
        sizes = prefixes.select("id", "n", *_SKETCH)
        for step in (hub_pairs, unconnected_pairs):
            pairs = materialize(step(_mixed(entries, sizes, rooted), similarity), "dedup-unconnected")
            rooted = materialize(_merged(rooted, _links(docs, named, pairs, similarity)), "dedup-rooted")
        final = rooted.select("id", "root")
        of_node = nodes.join(final, "id").select("first", "root")
        kept = of_node.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.key.doc").alias("doc"), F.col("f.key.h").alias("h"), F.col("f.times").alias("times"))
        return materialize(kept, "dedup-stay", outlive=True)


def keep_one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates."""
    p = "sl_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    kept = stays(docs, similarity).select(F.col("doc").alias(f"{p}doc"), F.col("h").alias(f"{p}h"), F.col("times").alias(f"{p}times"))
    keyed, all_columns = docs.withColumn(f"{p}key", _keys(docs)[1]), [F.col(f"`{c}`") for c in docs.columns]

    def of(part: DataFrame) -> DataFrame:
        return keyed.join(part, (F.col(f"{p}key") == F.col(f"{p}h")) & F.col("doc_id").eqNullSafe(F.col(f"{p}doc")))

    once, repeated = kept.filter(F.col(f"{p}times") == 1), kept.filter(F.col(f"{p}times") > 1)
    out = of(once).select(*all_columns)
    if repeated.isEmpty():
        return out
    # Rows that repeat a key: any one of them.
    one = of(repeated).groupBy(f"{p}doc", f"{p}h").agg(F.first(F.struct(*all_columns)).alias(f"{p}row"))
    return out.unionByName(one.select(*(F.col(f"{p}row.`{c}`").alias(c) for c in docs.columns)))
