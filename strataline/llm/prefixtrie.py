"""Operator 13: conversation prefix trie by an LCP-aware external mergesort.

A turn becomes a unit of 20 bytes: 16 of the SHA-256 of its role and text, and its number of words. Turns get their place
by ordered scans (`operators.scan`), so a conversation of any length spans as many tasks as it needs. A conversation is cut
into blocks of BLOCK turns; a block's sort key is the hash of all blocks before it and then its units. Keys are
range-partitioned together with the conversation id, so copies split as well. Within a partition, each Arrow batch is
sorted into a run that carries the longest common prefix (LCP) of neighbours; a loser tree merges the runs and compares
two heads only from where their LCPs with the last row out are equal. The merged stream drives a stack of the open path:
a row closes all nodes deeper than its LCP, which are then finished and handed to their parents.

What a partition's first or last row passes through may go on in the next partition: those nodes, a path's length for
each end of a partition, leave as parts, are merged by a hash of their path, and what lies below them is summed up.
Blocks beyond the first are done deepest level first; the top of a group of blocks hands its totals to the row that leads
into it. A conversation that shares no block with another needs no sort beyond there. There are as many levels as the
longest sequence of turns that two conversations share has blocks.

A partition holds about PART_BYTES of keys, so memory doesn't grow with the input. A node's ends are hashed as they
stream by, in order; so are the parts of one that spans partitions.

Defined results: rows without conv_id belong to no conversation; turns of equal number come in the order of their hash;
repeated rows are turns each; the remainders of negative ids are those of SQL (-5 % 20 = -5); other columns are not looked
at; no rows give no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import mapped, materialize, table, temporary
from strataline.operators.scan import numbered

BLOCK, PART_BYTES, SMALL_ROWS = 256, 16 << 20, 100_000
UNIT = 20
WORD = r"[^\x20\x09-\x0D]+"
_EMPTY = sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PART = f"kind int, path binary, above array<binary>, up binary, seq long, {_NODE}, words long, ends string, stub boolean"
_FIELDS = [f.split()[0] for f in _PART.replace(", ", ",").split(",")]
_BINARY = pa.binary()
_KINDS = [pa.int32(), _BINARY, pa.list_(_BINARY), _BINARY, pa.int64(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.string(), pa.bool_()]


def turn_units(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, unit of every turn that belongs to a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    words = F.regexp_count(text, F.lit(WORD))
    unit = F.unhex(F.concat(digest, F.lpad(F.hex(words.cast("long")), 8, "0")))
    return conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", unit.alias("unit"))


def borrowed_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), unit: the first turns of the conversation at the start of its twenty, then its own later ones.

    A conversation without any turns has one row without place and unit.
    """
    units = materialize(turn_units(conversations), "trie-units")  # the range partitioning looks at its input twice
    turns = numbered(units, ["conv_id", F.asc_nulls_first("turn"), "unit"], ["conv_id"], "place")
    leader = F.col("conv_id") - F.col("conv_id") % 20
    all_ids = turns.filter("place = 0").select("conv_id", borrowed_turns(F.col("conv_id")).alias("h"), leader.alias("leader"))
    heads = turns.filter((F.col("place") < 3) & (F.col("conv_id") % 20 == 0)).select(F.col("conv_id").alias("leader"), "place", "unit")
    lent = all_ids.filter("h > 0").join(heads, "leader").filter("place < h").select("conv_id", F.lit(0).alias("own"), "place", "unit")
    own = turns.filter(F.col("place") >= borrowed_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("own"), "place", "unit")
    placed = numbered(lent.unionByName(own).withColumnRenamed("place", "was"), ["conv_id", "own", "was"], ["conv_id"], "place")
    return placed.select("conv_id", "place", "unit").unionByName(all_ids.select("conv_id"), allowMissingColumns=True)


def _blocks(turns: DataFrame, size: int) -> tuple[DataFrame, int]:
    """conv_id, level, n (turns in it), full, key of every block, and the deepest level.

    A conversation's last block is never full: one of a multiple of `size` turns ends with an empty block.
    """
    level = F.floor(F.col("place") / size).cast("int")
    lengths = turns.groupBy("conv_id").agg(F.count("place").alias("n"))
    ends = lengths.select("conv_id", F.floor(F.col("n") / size).cast("int").alias("level"))
    parts = turns.filter("place IS NOT NULL").select("conv_id", level.alias("level"), F.struct("place", "unit").alias("t")).unionByName(ends, allowMissingColumns=True)
    joined = F.aggregate(F.array_sort("ts"), F.lit(b""), lambda a, t: F.concat(a, t["unit"]))
    made = parts.groupBy("conv_id", "level").agg(F.collect_list("t").alias("ts")).select("conv_id", "level", F.size("ts").alias("n"), (F.size("ts") == size).alias("full"), joined.alias("units"))
    made = materialize(made, "trie-blocks")
    deepest = made.agg(F.max("level")).head()[0] or 0
    first = F.lit(bytes(UNIT))
    if not deepest:
        return made.withColumn("key", F.concat(first, "units")).drop("units"), 0
    hashed = lambda x: F.unhex(F.substring(F.sha2(x, 256), 1, 2 * UNIT))
    whole = made.filter("full").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("level", hashed(F.col("units")).alias("h")))).alias("hs"))
    step = lambda done, b: F.concat(done, F.array(F.struct((b["level"] + 1).alias("level"), hashed(F.concat(F.element_at(done, -1)["group"], b["h"])).alias("group"))))
    chain = F.aggregate("hs", F.array(F.struct(F.lit(0).alias("level"), first.alias("group"))), step)
    groups = whole.select("conv_id", F.inline(chain)).filter("level > 0")
    keyed = made.join(groups, ["conv_id", "level"], "left").withColumn("key", F.concat(F.coalesce("group", first), "units"))
    return keyed.drop("units", "group"), deepest


def common_units(a: bytes, b: bytes, start: int) -> int:
    """Units that two keys share, of which `start` are known to be equal."""
    n = min(len(a), len(b)) // UNIT
    at = start
    while at < n and a[at * UNIT : (at + 1) * UNIT] == b[at * UNIT : (at + 1) * UNIT]:
        at += 1
    return at


def sorted_run(rows: list[tuple]) -> tuple[list[tuple], list[int]]:
    """Rows (key, conv_id, ...) in order, and the LCP of each with the one before it."""
    rows.sort(key=lambda r: r[:2])
    return rows, [0, *(common_units(a[0], b[0], 0) for a, b in zip(rows, rows[1:]))]


def merged_runs(runs: list[tuple[list[tuple], list[int]]]) -> Iterator[tuple[int, tuple]]:
    """(LCP with the row before, row) of all runs in order, by a loser tree over their heads."""
    count = len(runs)
    at, lcp = [0] * count, [0] * count  # lcp: of a run's head with the last row out

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP is then that with the winner."""
        if at[a] == len(runs[a][0]):
            return b, a
        if at[b] == len(runs[b][0]) or lcp[a] > lcp[b]:
            return a, b
        if lcp[b] > lcp[a]:
            return b, a
        x, y = runs[a][0][at[a]], runs[b][0][at[b]]
        n = common_units(x[0], y[0], lcp[a])
        won, lost = (a, b) if (x[0][n * UNIT : (n + 1) * UNIT], x[1]) <= (y[0][n * UNIT : (n + 1) * UNIT], y[1]) else (b, a)
        lcp[lost] = n
        return won, lost

    losers = [0] * count

    def build(node: int) -> int:
        if node >= count:
            return node - count
        won, losers[node] = play(build(2 * node), build(2 * node + 1))
        return won

    won = build(1) if count > 1 else 0
    while count and at[won] < len(runs[won][0]):
        rows, lcps = runs[won]
        yield lcp[won], rows[at[won]]
        at[won] += 1
        if at[won] < len(rows):
            lcp[won] = lcps[at[won]]
        node = (won + count) // 2
        while node:
            won, losers[node] = play(won, losers[node])
            node //= 2


class _Open:
    """A node of the open path."""

    __slots__ = ("children", "closed", "digest", "ends", "first", "leaves", "least", "n", "saved", "stub", "words")

    def __init__(self, words: int, first: bool):
        self.words, self.first, self.n, self.least, self.children, self.leaves, self.saved = words, first, 0, None, 0, 0, 0
        self.ends, self.digest, self.stub, self.closed = [], None, False, []

    def join(self, n: int, least: int) -> None:
        self.n, self.least = self.n + n, least if self.least is None else min(self.least, least)


def trie_parts(rows: Iterator[tuple[int, tuple]], level_depth: int, seq: int) -> Iterator[dict]:
    """Nodes from the merged stream of one partition: finished ones (kind 0; tops of groups: kind 2) and parts (kind 1).

    A finished child of a part bears its path (`up`) instead of its parent's smallest member.
    """
    path: list[_Open] = []
    before = b""
    hashed = lambda units: sha256(before[: units * UNIT]).digest()[:16]

    def close(last: bool) -> Iterator[dict]:
        e, units = path.pop(), len(path) + 1
        if path:
            path[-1].join(e.n, e.least)
        row = {"conv_id": e.least, "depth": level_depth + units - 1, "n_convs": e.n, "n_children": e.children, "n_leaves": e.leaves, "saved_tokens": e.saved, "ends_sha256": e.digest, "words": e.words, "stub": e.stub, "seq": seq}
        if e.first or last:
            own = hashed(units)
            above = [hashed(k) for k in range(1, units)]
            yield from ({**c, "up": own} for c in e.closed)
            yield {**row, "kind": 1, "path": own, "above": above, "up": above[-1] if above else None, "ends": ",".join(e.ends)}
            return
        yield from ({**c, "parent_conv_id": e.least} for c in e.closed)
        row |= {"ends_sha256": e.digest or sha256(",".join(e.ends).encode()).hexdigest(), "n_leaves": e.leaves or int(not e.children and not e.stub)}
        if not path:
            yield {**row, "kind": 2}
            return
        row |= {"kind": 0, "saved_tokens": e.saved + (e.n - 1) * e.words}
        up = path[-1]
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + row["n_leaves"], up.saved + row["saved_tokens"]
        up.closed.append(row)

    for lcp, (key, conv_id, full, given) in rows:
        while len(path) > lcp:
            yield from close(False)
        for k in range(lcp, len(key) // UNIT):
            path.append(_Open(int.from_bytes(key[(k + 1) * UNIT - 4 : (k + 1) * UNIT], "big") if k else 0, not before))
        before, top = key, path[-1]
        top.join(1, conv_id)
        top.stub = top.stub or full
        if not full:
            top.ends.append(str(conv_id))
        if given:
            leaves, saved, children, digest = given
            top.leaves, top.saved, top.children, top.digest = top.leaves + leaves, top.saved + saved, top.children + children, digest
    while path:
        yield from close(True)


def _sent(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in held], k) for f, k in zip(_FIELDS, _KINDS)], _FIELDS)

    for r in rows:
        held.append(r)
        if len(held) >= 4096:
            yield out()
            held = []
    if held:
        yield out()


def _merge_parts(parts: DataFrame) -> DataFrame:
    """One row a path, from parts that come in order; the ends are hashed as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(r, digest, any_ends):
            return {**r, "ends_sha256": r["ends_sha256"] or (digest.hexdigest() if any_ends else _EMPTY)}

        def rows():
            now, digest, any_ends = None, None, False
            for b in batches:
                for r in b.to_pylist():
                    if now is None or r["path"] != now["path"]:
                        if now is not None:
                            yield whole(now, digest, any_ends)
                        now, digest, any_ends = dict(r), sha256(), False
                    else:
                        for f in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                            now[f] += r[f]
                        now |= {"conv_id": min(now["conv_id"], r["conv_id"]), "stub": now["stub"] or r["stub"], "ends_sha256": now["ends_sha256"] or r["ends_sha256"]}
                    if r["ends"]:
                        digest.update((("," if any_ends else "") + r["ends"]).encode())
                        any_ends = True
            if now is not None:
                yield whole(now, digest, any_ends)

        yield from _sent({**r, "ends": None} for r in rows())

    return mapped(parts.repartition("path").sortWithinPartitions("path", "seq"), run, _PART, 256)


def _level(rows: DataFrame, level: int, size: int, partitions: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one level of blocks, and the tops of its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def read(b):
            keys, ids, fulls, *given = (c.to_pylist() for c in b.columns)
            given = [None if g[0] is None else g for g in zip(*given)]
            return list(zip(keys, ids, fulls, given))

        runs = [sorted_run(read(b)) for b in batches if b.num_rows]
        yield from _sent(trie_parts(merged_runs(runs), level * size, TaskContext.get().partitionId()))

    sent = rows.select("key", "conv_id", "full", "x_leaves", "x_saved", "x_children", "x_ends").repartitionByRange(partitions, "key", "conv_id")
    out = materialize(mapped(sent, run, _PART, 4096), "trie-level")
    whole = materialize(_merge_parts(out.filter("kind = 1")), "trie-parts")
    # Below a part lie other parts: a leaf is one without any children; all totals go to the parts above.
    below = whole.filter("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("more"))
    childless = (F.col("n_children") + F.coalesce("more", F.lit(0)) == 0) & ~F.col("stub")
    own = whole.join(below, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0).cast("long"))).withColumn("n_leaves", F.when(childless, 1).otherwise(F.col("n_leaves")).cast("long")).withColumn("own", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).drop("more")
    upward = own.select(F.explode(F.concat("above", F.array("path"))).alias("path"), "n_leaves", "own").groupBy("path").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("own").alias("saved_tokens"))
    summed = own.drop("n_leaves", "saved_tokens", "own").join(upward, "path").withColumn("parent_conv_id", F.lit(None).cast("long"))
    summed = materialize(summed, "trie-sums")
    tops = summed.filter("up IS NULL").unionByName(out.filter("kind = 2"), allowMissingColumns=True)
    hung = out.filter("kind = 0 AND up IS NOT NULL").unionByName(summed.filter("up IS NOT NULL"), allowMissingColumns=True)
    heads = summed.select(F.col("path").alias("up"), F.col("conv_id").alias("head"))
    heads = F.broadcast(heads) if summed.count() <= SMALL_ROWS else heads
    nodes = hung.join(heads, "up").withColumn("parent_conv_id", F.col("head"))
    columns = [f.split()[0] for f in _NODE.split(", ")]
    nodes = nodes.select(columns).unionByName(out.filter("kind = 0 AND up IS NULL").select(columns))
    return (nodes.unionByName(tops.select(columns)) if level == 0 else nodes), tops.select(columns)


def prefix_trie(turns: DataFrame, size: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """The nodes of the trie of conversations given as conv_id, place, unit (see `rebuilt`)."""
    spark = turns.sparkSession
    blocks, deepest = _blocks(turns, size)
    given = "conv_id long, level int, x_leaves long, x_saved long, x_children long, x_ends string"
    extras, tails, top = spark.createDataFrame([], given), None, 0
    blocks = blocks.withColumn("alone", F.lit(False))
    if deepest:
        sizes = blocks.filter("level > 0").groupBy("level", F.substring("key", 1, UNIT).alias("group")).agg(F.count("*").alias("members"))
        blocks = blocks.withColumn("group", F.substring("key", 1, UNIT)).join(sizes, ["level", "group"], "left").withColumn("alone", F.coalesce(F.col("members") == 1, F.lit(False))).drop("group", "members")
        blocks = materialize(blocks, "trie-levels")
        top = blocks.filter("NOT alone").agg(F.max("level")).head()[0]
        # From its first block that no other shares on, a conversation is a chain of nodes of its own.
        alone, own_hash = blocks.filter("alone"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
        lead = alone.groupBy("conv_id").agg(F.min(F.struct("level", "n")).alias("s"))
        extras = lead.select("conv_id", (F.col("s.level") - 1).alias("level"), F.lit(1).cast("long").alias("x_leaves"), F.lit(0).cast("long").alias("x_saved"), (F.col("s.n") > 0).cast("long").alias("x_children"), F.when(F.col("s.n") == 0, own_hash).otherwise(F.lit(_EMPTY)).alias("x_ends"))
        ends = alone.filter("NOT full").select("conv_id", (F.col("level") * size + F.col("n")).alias("length"))
        depths = alone.filter("n > 0").join(ends, "conv_id").select("conv_id", "length", F.explode(F.sequence(F.lit(1), "n")).alias("k"), "level").withColumn("depth", F.col("level").cast("long") * size + F.col("k"))
        last, one = F.col("depth") == F.col("length"), F.lit(1).cast("long")
        tails = depths.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), (one * 0).alias("saved_tokens"), F.when(last, own_hash).otherwise(F.lit(_EMPTY)).alias("ends_sha256"))
    shuffles, out = int(spark.conf.get("spark.sql.shuffle.partitions")), tails
    for level in range(top, -1, -1):
        rows = blocks.filter(f"level = {level} AND NOT alone")
        key_bytes = rows.agg(F.sum(F.length("key"))).head()[0] or 0
        led = rows.join(extras.filter(f"level = {level}").drop("level"), "conv_id", "left") if deepest else rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("x_leaves", "long"), ("x_saved", "long"), ("x_children", "long"), ("x_ends", "string"))))
        nodes, tops = _level(led, level, size, max(shuffles, -(-key_bytes // part_bytes)))
        out = nodes if out is None else out.unionByName(nodes)
        if level:
            handed = tops.select("conv_id", F.lit(level - 1).alias("level"), F.col("n_leaves").alias("x_leaves"), F.col("saved_tokens").alias("x_saved"), F.col("n_children").alias("x_children"), F.col("ends_sha256").alias("x_ends"))
            extras = extras.unionByName(handed)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark):
        return materialize(prefix_trie(rebuilt(table(spark, sf_dir, "conversations"))), "op13", outlive=True)


OP13_SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || ':' || coalesce(text, ''))) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), bits AS (  -- crc32 of the decimal id: each byte, then eight shifts (-1)
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM turns WHERE place = 0
), crc AS (
    SELECT conv_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(s) + 1),
            lambda i: list_prepend(CAST(ascii(substr(s, i, 1)) AS BIGINT), [CAST(-1 AS BIGINT), -1, -1, -1, -1, -1, -1, -1])))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS c
    FROM bits
), ids AS (
    SELECT conv_id, 3 - (c & 3) AS h, conv_id - conv_id % 20 AS leader FROM crc
), rebuilt AS (
    SELECT i.conv_id, 0 AS own, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.leader AND t.place < i.h
    UNION ALL
    SELECT i.conv_id, 1, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.place >= i.h
), paths AS (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)
    UNION ALL
    SELECT conv_id, 0, '', 0 FROM ids
), lasts AS (
    SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id
), nodes AS (
    SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
        coalesce(string_agg(CASE WHEN depth = length THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '') AS ends
    FROM paths p JOIN lasts l ON l.conv_id = p.conv_id GROUP BY path, depth
), children AS (
    SELECT left(path, 32 * (CAST(depth AS INTEGER) - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
    SELECT DISTINCT a.path AS above, d.path FROM paths a JOIN paths d ON a.conv_id = d.conv_id AND a.depth <= d.depth
), sums AS (
    SELECT b.above AS path, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
    FROM below b JOIN nodes n ON n.path = b.path LEFT JOIN children c ON c.path = b.path GROUP BY b.above
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN children c ON c.path = n.path
    LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (CAST(n.depth AS INTEGER) - 1))
"""
