"""Operator 4: benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Each benchmark item gives its windows of `window` consecutive words (an item of fewer words is one window). A document
contains a window exactly when all of the window's word shingles stand in it in sequence, so at a containment of 1 the
prefix of a window is its rarest shingle. The steps:

1. Rarity: how often each shingle of the benchmark stands in the corpus, a count with no positions.
2. Prefixes: each window keeps its rarest shingle (ties: the smaller hash, then the smaller offset). A window one of whose
   shingles is nowhere is in no document and keeps none. Only prefixes meet the documents' shingles: a match proposes one
   start, which must leave room for the window (positional and length bounds).
3. What is left is verified word by word: where the prefixes are few (`broadcast_keys`, `broadcast_bytes`; both counted
   first) in the pass that finds it, with no text leaving its place; else proposals meet their texts in a join, one of
   each group of equal texts.

Shingles have `shingle` words, fewer for windows that have fewer. What is found depends on the text alone, so hits of equal
texts are one.

Defined results: null texts have no words; a document or an item without words meets nothing; repeated items count by
their item_id, repeated rows get their row each; null item_ids are left out; extra columns are not looked at. A null
doc_id gets its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import documents, materialize, table, temporary

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """The words of WORD, A-Z in lower case: ASCII that is no letter or digit becomes a space to cut at."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, win (array of words), one row for each item and distinct window."""
    w = F.col("w")
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).filter(F.size(w) > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (window - 1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(w, s, window))).alias("win")).distinct()


def _key(k: int, at: Column, w: Column) -> Column:
    """Hash of the k words from place `at`, counted from 0."""
    return F.xxhash64(*(F.get(w, at + j) for j in range(k)))


def _text(docs: DataFrame) -> tuple[Column, Column]:
    """The text, and its hash: what is found depends on the text alone, so copies share their hits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return text.alias("text"), F.unhex(F.md5(text)).alias("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, broadcast_keys: int = 500_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    text, row = _text(docs)
    with temporary(docs.sparkSession):
        hits = materialize(matched(docs.select(row, text), benchmark, window, shingle, broadcast_keys), "decon-hits", outlive=True)
    counted = docs.select(row, "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(hits, "row", "left")
    none = F.sha2(F.lit(""), 256)
    return counted.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _nothing(rows: DataFrame, **columns: str) -> DataFrame:
    return rows.sparkSession.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in columns.items()))


def _positions(split: DataFrame, k: int, *more: str) -> DataFrame:
    """row, n_words, pos, key of each shingle of k words, and columns of split."""
    at = split.select("row", "w", F.posexplode("w").alias("pos", "word")).select("row", F.size("w").alias("n_words"), "pos", _key(k, F.col("pos"), F.col("w")).alias("key"), *more)
    return at.filter(F.col("pos") <= F.col("n_words") - k) if k > 1 else at


def _rarity(split: DataFrame, keys: DataFrame, per_k: dict[int, int], broadcast_keys: int) -> DataFrame:
    """k, key, seen of the keys that stand in the corpus."""
    out = None
    for k, n in sorted(per_k.items()):
        own = keys.filter(F.col("k") == k).select("key")
        seen = _positions(split, k).select("key").join(F.broadcast(own) if n <= broadcast_keys else own, "key")
        seen = seen.groupBy("key").agg(F.count("*").alias("seen")).select(F.lit(k).alias("k"), "key", "seen")
        out = seen if out is None else out.unionByName(seen)
    return out


def _in_place(split: DataFrame, prefix: DataFrame, sizes: list[int]) -> DataFrame:
    """row, start, size, window of the windows that stand in a text, all in one pass over it."""
    out = None
    for k in sizes:
        own = prefix.filter(F.col("k") == k).select("key", "offset", "win", "window")
        start = F.col("pos") - F.col("offset")
        room = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
        met = _positions(split, k, "w").join(F.broadcast(own), "key").filter(room & (F.slice("w", F.greatest(F.lit(1), start + 1), F.size("win")) == F.col("win")))
        met = met.select("row", start.alias("start"), F.size("win").alias("size"), "window")
        out = met if out is None else out.unionByName(met)
    return out


def _by_join(rows: DataFrame, split: DataFrame, prefix: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for any number of windows: proposals, then one text of each group of equal ones."""
    proposed = None
    for k in sizes:
        own = prefix.filter(F.col("k") == k).select("key", "offset", "win", "window")
        start = F.col("pos") - F.col("offset")
        met = _positions(split, k).join(own, "key").filter((start >= 0) & (start + F.size("win") <= F.col("n_words")))
        met = met.select("row", F.struct(start.alias("start"), "win", "window").alias("s"))
        proposed = met if proposed is None else proposed.unionByName(met)
    per_row = materialize(proposed.groupBy("row").agg(F.collect_set("s").alias("starts")), "decon-starts")
    texts = rows.join(per_row.select("row"), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    own = texts.join(per_row, "row").select("row", "starts", words(F.col("text")).alias("w"))
    # The words stand in an array of one, so that they are bound once a row and not cut anew for each start.
    right = F.get(F.transform(F.array("w"), lambda w: F.filter("starts", lambda s: F.slice(w, s["start"] + 1, F.size(s["win"])) == s["win"])), F.lit(0))
    return own.select("row", F.explode(right).alias("s")).select("row", F.col("s.start").alias("start"), F.size("s.win").alias("size"), F.col("s.window").alias("window"))


def matched(rows: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, broadcast_keys: int = 500_000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows: row (equal for equal texts), text. Per distinct row with a hit: row, n_hit, n_items, items_sha256."""
    of_item = materialize(item_windows(benchmark, window), "decon-items")
    windows = materialize(of_item.groupBy("win").agg(F.count("*").alias("n")).select("win", F.monotonically_increasing_id().alias("window")), "decon-windows")
    k_of = F.least(F.lit(shingle), F.size("win"))
    entries = None
    for k in range(1, shingle + 1):
        one = windows.filter(k_of == k).select("win", "window", F.lit(k).alias("k"), F.explode(F.sequence(F.lit(0), F.size("win") - k)).alias("offset"))
        one = one.select("window", F.size("win").alias("size"), "k", "offset", _key(k, F.col("offset"), F.col("win")).alias("key"))
        entries = one if entries is None else entries.unionByName(one)
    entries = materialize(entries, "decon-entries")
    keys = entries.select("k", "key").distinct()
    per_k = {r.k: r.n for r in keys.groupBy("k").agg(F.count("*").alias("n")).collect()}
    if not per_k:
        return _nothing(rows, row="binary", n_hit="long", n_items="long", items_sha256="string")

    #: 1. How rare each shingle is.
    split = rows.select("row", words(F.col("text")).alias("w"))
    rarity = materialize(_rarity(split, keys, per_k, broadcast_keys), "decon-rarity")

    #: 2. The rarest shingle of each window.
    least = entries.join(rarity, ["k", "key"]).groupBy("window").agg(
        F.min(F.struct("seen", "key", "offset")).alias("p"), F.first("k").alias("k"), F.count_distinct("offset").alias("present"), F.first("size").alias("size")
    )
    least = least.filter(F.col("present") == F.col("size") - F.col("k") + 1).select("window", "k", F.col("p.key").alias("key"), F.col("p.offset").alias("offset"))
    prefix = materialize(least.join(windows, "window"), "decon-prefix")
    size = prefix.agg(F.count("*").alias("n"), F.sum(F.length(F.concat_ws(" ", "win")) * 4 + F.size("win") * 16).alias("bytes"), F.collect_set("k").alias("k")).first()

    #: 3. Word by word.
    if not size.n:
        true = _nothing(rows, row="binary", start="int", size="int", window="long")
    elif size.n <= broadcast_keys and size.bytes <= broadcast_bytes:
        true = _in_place(split, prefix, sorted(size.k))
    else:
        true = _by_join(rows, split, prefix, sorted(size.k))
    true = materialize(true.distinct(), "decon-verified")
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = F.aggregate(
        "starts", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["size"]).alias("end"))
    )
    covered = true.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("starts")).select("row", cover["n"].cast("long").alias("n_hit"))
    named = of_item.join(windows, "win").select("window", F.col("item_id").cast("string").alias("item_id"))
    items = true.select("row", "window").distinct().join(named, "window").groupBy("row").agg(F.collect_set("item_id").alias("ids"))
    items = items.select("row", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("ids")), 256).alias("items_sha256"))
    return covered.join(items, "row")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark."""
    name = "sl_row"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    text, row = _text(docs)
    with temporary(docs.sparkSession):
        hits = materialize(matched(docs.select(row, text), benchmark, window, shingle).select(F.col("row").alias(name)), "decon-drop", outlive=True)
    return docs.withColumn(name, row).join(hits, name, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"
OP4_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents
), i AS (
  SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS MATERIALIZED (
  SELECT DISTINCT item_id, w[s : s + 9] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT len(win) AS n FROM win
), placed AS (
  SELECT r, s, n, w[s : s + n - 1] AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), hit AS MATERIALIZED (
  SELECT r, s, n, item_id FROM placed JOIN win USING (win)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
