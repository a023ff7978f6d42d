"""Operator 12 against plain water-filling and plain counts."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import mixing as M


def filled(totals, weights=(1, 2, 3), limit=3):
    """Targets by source, by resharing the excess in fractions until none is above."""
    order = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    words = sum(totals.values())
    out = {s: Fraction(words * w[s], sum(w.values())) for s in order} if order else {}
    while any(out[s] > limit * totals[s] for s in order):
        over = {s for s in order if out[s] >= limit * totals[s]}
        excess = sum(out[s] - limit * totals[s] for s in over)
        free = [s for s in order if s not in over]
        out |= {s: Fraction(limit * totals[s]) for s in over}
        for s in free:
            out[s] += excess * w[s] / sum(w[x] for x in free)
    return out


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else rng.choice(["a", "b", "z", "é", "tiny", None])
        size = rng.choice([0, 1, 5, 30]) if s != "tiny" else i % 7 == 0
        rows.append((rng.choice([i, i, 5, None]), None if size == 0 and i % 2 else "w\t" * size, s, 1))
    return rows


@pytest.mark.parametrize("n,seed", [(0, 0), (1, 0), (600, 1), (900, 2)])
def test_targets_are_met_to_the_word(spark, n, seed):
    rows = made(n, seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words int")
    docs, draws = M.mix(df, ["doc_id", "source"], shards=8)
    docs, draws = docs.collect(), draws.collect()
    size = lambda t: len((t or "").split())
    totals = {}
    for _, t, s, _ in rows:
        totals[s] = totals.get(s, 0) + size(t)
    want = filled(totals)
    assert len(docs) == len(rows)
    taken = {}
    for d in draws:
        taken.setdefault(d["mx_row"], []).append(d["words"])
    by_source = dict.fromkeys(totals, 0)
    for d in docs:
        assert abs(d["target"] - want[d["source"]]) < 1e-6 and d["mx_total"] == totals[d["source"]]
        own = taken.get(d["mx_row"], [])
        assert sum(own) <= 3 * d["mx_size"]
        by_source[d["source"]] += sum(own)
    for s, words in by_source.items():
        assert abs(words - want[s]) <= 0.5
    again = M.mix(df, ["doc_id", "source"], shards=8)[1].collect()
    assert sorted(map(repr, again)) == sorted(map(repr, draws))
    if n > 100:
        assert len({d["shard"] for d in draws}) == 8


def test_a_tree_keeps_all_sums_and_deals_without_bias():
    quotas, capacities = np.array([50, 0, 7, 200, 1]), np.array([80, 78, 50, 50])
    mean = np.zeros((5, 4))
    for seed in range(400):
        m = np.zeros((5, 4), np.int64)
        for shard, at, n in M.shard_counts(quotas, capacities, [seed]):
            m[at, shard] = n
        assert (m.sum(0) == capacities).all() and (m.sum(1) == quotas).all()
        mean += m / 400
    assert np.allclose(mean, np.outer(quotas, capacities) / 258, atol=1.5)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutations(n):
    for key in (0, 1, 99):
        assert sorted(M.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_every_block_goes_to_one_shard(spark, monkeypatch):
    monkeypatch.setattr(M, "BUNDLE", 4)
    sources = spark.createDataFrame([(i, (i * 37) % 500) for i in range(30)], "number long, quota long")
    got = M.dealt_blocks(sources, 10, 7).collect()
    want = [(i, b) for i in range(30) for b in range(-(-((i * 37) % 500) // 10))]
    assert sorted((r["number"], r["block"]) for r in got) == want
    sizes = [sum(r["shard"] == k for r in got) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "w " * (i % 9), "a" if i % 3 else "b") for i in range(200)], "doc_id long, text string, source string")
    _, draws = M.mix(df, ["doc_id", "text"], shards=4)
    M.write_shards(draws, str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.select("shard").distinct().count() == 4
    assert back.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).head()[0] == draws.agg(F.sum("words")).head()[0]
