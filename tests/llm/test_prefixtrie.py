"""Operator 13 against a trie of dictionaries."""

import random
import re
import zlib
from hashlib import sha256

import pytest

from strataline.llm import prefixtrie as T


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h, lead = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(convs.get(lead, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sums = {}
    kids = {}
    for p in sorted(nodes, key=len, reverse=True):
        if p:
            kids.setdefault(p[:-1], []).append(p)
        own = (len(nodes[p]) - 1) * (words(p[-1][1]) if p else 0)
        below = [sums[k] for k in kids.get(p, [])]
        sums[p] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return sorted(
        (min(c for c, _ in m), len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *sums[p], sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest())
        for p, m in nodes.items()
    )


def of(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn int, role string, text string, unit string, place string")
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in T.prefix_trie(T.rebuilt(df), **kw).collect())


def made(seed, n=120, length=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c - 15 if seed % 2 else c * 3
        kind = rng.random()
        if kind < 0.33:
            turns = ["same here"] * 7
        elif kind < 0.4:
            turns = [str(c)] * rng.randint(5, 3 * length)
        else:
            turns = [rng.choice(["a b", "a  b c", "d e", ""]) for _ in range(rng.randint(1, length))]
        rows += [(c, None if i == 0 and c % 5 == 0 else i, rng.choice(["user", "user", "user", None]) if c % 3 else "u", t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size", [(0, 256), (1, 256), (2, 2), (3, 4)])
def test_same_as_a_trie_of_dictionaries(spark, seed, size):
    rows = made(seed)
    assert of(spark, rows, size=size, part_bytes=1000) == brute(rows)


def test_edges(spark):
    rows = [(3, 0, "user", "lonely"), (None, 0, "user", "nobody"), (25, 1, None, None), (25, 2, "", ""), (40, 0, "user", "one two"), (41, 5, "user", "one two"), (43, 0, "a", "x" * 50_000)]
    assert of(spark, rows) == brute(rows)
    assert of(spark, []) == []
    copies = [(c, i, "user", f"turn {i}") for c in range(0, 4000, 20) for i in range(5)]
    assert of(spark, copies, size=2, part_bytes=500) == brute(copies)
    long = [(c, i, "user", f"turn {i}") for c in (0, 20, 60) for i in range(40 + c % 7)]
    assert of(spark, long, size=4) == brute(long)


def test_merging_compares_only_from_the_known_prefix():
    rng = random.Random(4)
    rows = [(bytes(T.UNIT) + b"".join(bytes([rng.randint(0, 1)]) * T.UNIT for _ in range(rng.randint(0, 6))), i) for i in range(500)]
    parts = [rows[i::7] for i in range(7)]
    got = list(T.merged_runs([T.sorted_run(list(p)) for p in parts]))
    assert [r for _, r in got] == sorted(rows)
    for (_, a), (n, b) in zip(got, got[1:]):
        assert n == T.common_units(a[0], b[0], 0)


def test_sql_gives_the_same_nodes():
    duckdb = pytest.importorskip("duckdb")
    rows = made(3)
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(c.execute(T.OP13_SQL).fetchall()) == brute(rows)
