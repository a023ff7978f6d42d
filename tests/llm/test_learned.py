"""Quality, language models, toxicity and language: held-out figures, edges, brute-force sums."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataline.llm import brown, fm, langid, quality, toxicity
from strataline.llm.common import materialize

EDGES = [None, "", " \n\t ", "a", "!!! ??? 123", "word " * 30_000, "é́ 中文 👍", "x" * 200_000, "a", None]


def test_fm_scores_are_the_pairwise_sum():
    rng = np.random.default_rng(0)
    m = fm.FM(0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    idx, val, ptr = np.array([0, 2, 5, 1]), np.array([1.0, 2.0, -1.0, 0.5]), np.array([0, 3, 3, 4])
    want = []
    for a, b in zip(ptr, ptr[1:]):
        i, x = idx[a:b], val[a:b]
        pairs = sum((m.v[i[p]] @ m.v[i[q]]) * x[p] * x[q] for p in range(len(i)) for q in range(p))
        want.append(0.3 + (m.w[i] * x).sum() + pairs)
    assert np.allclose(m.logits(idx, val, ptr), want)


def test_quality_on_held_out_rows(spark, folder, corpus):
    rows = quality.op1_quality_fm(spark, folder).collect()
    assert len(rows) == len(corpus)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(len(corpus)) if crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == corpus[r.doc_id][2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(spark, docs_of):
    docs = docs_of(spark, EDGES, [0, 1, 2, 3, 4, 5, 6, 7, 3, None])
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (5, None)], "doc_id long, label int")
    for some in (labels, labels.filter("label = 1"), labels.filter("false")):
        model = quality.train(docs, some)
        got = quality.score(docs, model).collect()
        assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
        assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(docs.filter("false"), model).count() == 0
    assert quality.score(docs.select("doc_id", "text"), model).count() == len(EDGES)


def test_language_model_against_plain_sums(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = Counter()
    for i, (t, *_) in enumerate(corpus):
        if crc32(str(i).encode()) % 7 != 2:
            counts.update(brown.tokens(t))
    n, v = sum(counts.values()), len(counts)
    rows = brown.op2_brown_lm(spark, folder).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = brown.tokens(corpus[r.doc_id][0])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("lookup", [0, 5, 1 << 17])
def test_language_model_is_a_distribution_and_joins_as_it_looks_up(spark, docs_of, lookup):
    """Over every word of a class and its unknown word, emissions sum to 1; so do transitions; the score is their plain sum."""
    texts = ["a b a c", "b a", "c c d e", None, "", "a z z", "d b d e f f"]
    docs = docs_of(spark, texts).select("doc_id", "text")
    words, by_count = brown.vocabulary(docs.filter("doc_id <> 5"), heads=3, affixes=2, lookup=lookup)
    codes = brown.coded(docs, words)
    model, tail = brown.fit(codes.filter("doc_id <> 5"), words, by_count, n_classes=3)
    counts = Counter(w for k, t in enumerate(texts) if k != 5 for w in brown.tokens(t))
    rare = {r.word: (r["class"], r.c) for r in tail.collect()}
    name = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w, 42)).view(np.int64))
    places = {w: k for k, w in enumerate(words.known)}
    assert {w: c for w, c in counts.items() if w not in places} == {w: rare[name(w)][1] for w in counts if w not in places}
    assert all(model.words.counts[k] == counts[w] for w, k in places.items()) and len(rare) == len(counts) - len(places)
    of = {w: int(model.word_class[places[w]]) if w in places else rare[name(w)][0] for w in counts}
    group = lambda w: int(model.classes[words.affix(w)])
    before = lambda w: of[w] if w in places else group(w)
    for c in range(3):
        own = [n for w, n in counts.items() if of[w] == c]
        total = sum(10 ** (math.log10(n - model.discount) - model.log_class[c]) for n in own) + 10 ** (model.log_unknown[c] - model.log_class[c])
        assert total == pytest.approx(1)
    steps = 10 ** model.steps.reshape(4, 4, 4)[:, :, :3]
    assert np.allclose(steps.sum(-1), 1)
    for r in brown.score(codes, model, tail).collect():
        want, known, one, two = 0.0, 0.0, 3, 3
        for w in brown.tokens(texts[r.doc_id]):
            c = of[w] if w in of else group(w)
            p = model.steps[(two * 4 + one) * 4 + c] + (math.log10(counts[w] - model.discount) if w in counts else model.log_unknown[c]) - model.log_class[c]
            want, known = want + p, known + (p if w in counts else 0)
            two, one = one, before(w)
        assert r.score == pytest.approx(want) and r.known_score == pytest.approx(known)


def test_gains_are_differences_of_likelihood():
    """Taking a word out of its class and putting it into each other one, by brute force."""
    rng = np.random.default_rng(8)
    own = rng.poisson(rng.choice([0.3, 3, 30], (9, 8)), (9, 8))
    now = rng.integers(0, 3, 9)

    def table(cls):
        t = np.zeros((8, 3))
        for w, c in enumerate(cls):
            t[:, c] += own[w]
        return t

    word, context = np.nonzero(own)
    got = brown.gains(table(now), brown.differences(table(now)), table(now).sum(0), word, context, own[word, context], now, 1)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    for w in range(9):
        all_of = [f(table(c)) - f(table(c).sum(0)) for c in ([*now[:w], b, *now[w + 1 :]] for b in range(3))]
        assert np.allclose(got[w] - got[w].max(), np.array(all_of) - max(all_of))


def test_every_word_seen_twice_is_clustered(spark, docs_of):
    """Two kinds of words that no ending tells apart, in two kinds of contexts, beyond the heads and beyond the table."""
    rng = np.random.default_rng(0)
    kinds = [[f"w{k}{a}{3 * 'abcdefgh'[k % 8]}" for k in range(60)] for a in "xy"]
    texts = [" ".join(x for _ in range(8) for x in (("der", "die")[k], str(rng.choice(kinds[k])), ("oben", "unten")[k])) for k in rng.integers(0, 2, 300)]
    docs = docs_of(spark, texts).select("doc_id", "text")
    for lookup in (5, 40, 1000):
        words, by_count = brown.vocabulary(docs, heads=5, affixes=16, lookup=lookup)
        model, tail = brown.fit(materialize(brown.coded(docs, words), "t"), words, by_count, n_classes=6)
        name = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w, 42)).view(np.int64))
        of = {r.word: r["class"] for r in tail.collect()} | {name(w): int(c) for w, c in zip(words.known, model.word_class)}
        seen = [Counter(of[name(w.encode())] for w in k if name(w.encode()) in of) for k in kinds]
        assert sum(max(c.values()) for c in seen) >= 0.9 * sum(sum(c.values()) for c in seen)
        assert seen[0].most_common(1)[0][0] != seen[1].most_common(1)[0][0]


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.7, (13, 13)).astype(float)
    counts[:6, 6:12] += 5
    counts[:, 12] = 0

    def likelihood(cls):
        one = np.eye(4)[cls]
        t = one.T @ counts @ one
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    start = brown.exchange(counts, 3, passes=0)
    assert likelihood(brown.exchange(counts, 3, passes=1)) >= likelihood(start)
    assert likelihood(brown.exchange(counts, 3)) >= likelihood(brown.exchange(counts, 3, passes=1)) - 1e-9


def test_language_model_edges(spark, docs_of):
    docs = docs_of(spark, EDGES, [0, 1, 2, 3, 4, 5, 6, 7, 3, None]).select("doc_id", "text")
    model, tail = brown.train(docs.filter("false"))
    got = brown.score(brown.coded(docs, model.words), model, tail).collect()
    assert len(got) == len(EDGES) and all(r.n_known == 0 and math.isfinite(r.score) for r in got)
    model, tail = brown.train(docs)
    assert brown.score(brown.coded(docs, model.words), model, tail).count() == len(EDGES)
    assert brown.score(brown.coded(docs.filter("false"), model.words), model, tail).count() == 0


def test_toxicity_on_held_out_rows(spark, folder, corpus):
    rows = toxicity.op5_toxicity_chain(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.toxic == bool(corpus[r.doc_id][3]) for r in held)
    assert {"p_kind_1", "p_kind_2", "score"} <= set(rows[0].asDict())


def test_later_links_use_earlier_ones():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(40)]
    docs = [np.unique(rng.integers(0, 40, 8)) for _ in range(600)]
    first = np.array([float(3 in d or 5 in d) for d in docs])
    chain = toxicity.fit(docs, words, {"first": first, "second": first})
    assert chain.links[1].before[0] > 0.5


def test_kinds_are_found_without_a_list():
    """Two sets of words that never stand together in a toxic row become two kinds, each learned by its own model."""
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    docs, y = [], []
    for k in range(600):
        own = set(rng.integers(20, 60, 8).tolist())
        bad = k % 3 == 0
        if bad:
            own |= set(rng.choice(np.arange(0, 10) + 10 * (k % 2), 3, replace=False).tolist())
        docs.append(np.array(sorted(own)))
        y.append(float(bad))
    groups = toxicity.word_groups(docs, np.array(y), 60, 2)
    assert {len(set(groups[:10])), len(set(groups[10:20]))} == {1} and {groups[0], groups[10]} == {0, 1} and (groups[20:] == -1).all()
    chain = toxicity.fit_kinds(docs, words, np.array(y))
    one, other = (chain.proba(" ".join(words[k] for k in ks)) for ks in ((1, 2, 30), (11, 12, 30)))
    assert (one[0] > 0.5) != (other[0] > 0.5) and min(one[2], other[2]) > 0.5 > chain.proba(f"{words[30]} {words[31]}")[2]


def test_toxicity_edges(spark, docs_of):
    docs = docs_of(spark, EDGES, [0, 1, 2, 3, 4, 5, 6, 7, 3, None])
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    docs = docs.withColumn("toxic", F.lit(1)).withColumn("words", F.lit("x"))
    for some in (labels, labels.filter("toxic = 0"), labels.filter("false")):
        got = toxicity.score(docs, toxicity.train(docs, some)).collect()
        assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)


def test_language_on_held_out_rows(spark, folder, corpus):
    rows = langid.op7_langid(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == corpus[r.doc_id][1] for r in held]) > 0.98


def test_language_edges(spark, docs_of):
    docs = docs_of(spark, EDGES, [0, 1, 2, 3, 4, 5, 6, 7, 3, None])
    train = spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (None, "x", "zz"), (3, "q", None)], "doc_id long, text string, lang string")
    for some in (train, train.filter("false"), train.filter("lang = 'en'")):
        got = langid.predict(docs, langid.train(some)).collect()
        assert len(got) == len(EDGES)
        for r, t in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(zip(docs.select("doc_id").collect(), EDGES), key=lambda p: str(p[0].doc_id))):
            if not langid.has_letter(t[1]):
                assert (r.lang_pred, r.score) == ("und", 0.0)
            assert r.lang_pred != "zz"


def test_grams_of_a_long_text_are_those_of_the_whole():
    t = "abc def " * 20_000
    short, long = langid.grams("abc def " * 10), langid.grams(t)
    assert set(np.flatnonzero(short)) <= set(np.flatnonzero(long)) and len(np.flatnonzero(long)) <= len(np.flatnonzero(short)) + 4 and abs(long.sum() / len(t) - 3) < 0.1


def test_language_idf_counts_all_training_rows(spark, docs_of, corpus):
    docs = docs_of(spark, [t for t, *_ in corpus]).withColumn("lang", F.lit("aa"))
    held = sum((langid.grams(t) > 0).astype(int) for t, *_ in corpus)
    want = np.log((1 + len(corpus)) / (1 + held)) + 1
    assert np.allclose(langid.train(docs, max_train=40).idf, want)
