"""Operators with exact answers, against brute force and round trips."""

import hashlib
import random
import re
from datetime import date, timedelta
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import components, decontaminate, eliasfano, feistel, neardedup, packing, pii, simhash, tokenbin, tokens, topk

EDGES = [None, "", " \n\t ", "a", "!!! ??? 123", "word " * 3_000, "é́ 中文 👍", "x" * 50_000, "a", None]
IDS = [0, 1, 2, 3, 4, 5, 6, 7, 3, None]


def groups(n, linked):
    p = list(range(n))

    def root(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root(a), root(b)
                p[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


# ------------------------------------------------------------------------------------------------------------- top-k


@pytest.mark.parametrize("kind", ["random", "same", "large"])
def test_topk_against_all_pairs(spark, kind):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 24))
    if kind == "same":
        v[50:200] = v[50]
    if kind == "large":
        v[::9] *= 1e5
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(256 * v).astype(np.int64)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for i in range(0, 300, 50):
        s = q @ q[i]
        want = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
        assert got[i] == {n + 1: (j, s[j]) for n, j in enumerate(want)}


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [2.0, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (5, [2.0, 1.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1.0, 2, 3) for r in rows], "vec_id long, embedding array<float>, score double, rank int, block int")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    # A query with a repeated id meets the other row of it.
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted([(0, 1, 5), (0, 2, 5), (0, 3, 50), (0, 4, 50)] + 2 * [(50, 1, 5), (50, 2, 5), (50, 3, 0), (50, 4, 50)])
    assert topk.top_k(df.filter("false"), F.lit(True)).count() == 0


def test_topk_with_bars_from_other_blocks(spark, monkeypatch):
    """Many small blocks, so that bars, skipped blocks and merged query blocks count; repeated ids and equal vectors among them."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 20)) * rng.choice([0.01, 1, 1, 5], size=(400, 1))
    v[100:180] = v[100]
    ids = [int(x) for x in rng.integers(0, 300, 400)]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, v)], "vec_id long, embedding array<double>").repartition(3)
    q, ids = np.floor(256 * v).astype(np.int64), np.array(ids)
    want = []
    for j in np.flatnonzero(ids % 10 == 0):
        s = q @ q[j]
        best = [x for x in np.lexsort((ids, -s)) if x != j][:5]
        want += [(int(ids[j]), n + 1, int(ids[x]), int(s[x])) for n, x in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect())) == sorted(want)


def test_scores_beyond_64_bits():
    big = np.array([[1 << 62, 3], [1 << 62, 5]], np.int64)
    (j, at, s), *_ = topk.search_block(np.array([9]), big[:, :1], np.arange(2), np.arange(2), np.column_stack([big[:, 0], -big[:, 0]]), 5)
    assert (j, at.tolist(), s.tolist()) == (0, [0, 1], [(1 << 63) - 1, -(1 << 63)])


# ----------------------------------------------------------------------------------------------------------- windows


def hits(text, items, n=10):
    split = lambda t: re.findall(decontaminate.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, names = split(text), set(), set()
    for name, t in items:
        own = split(t)
        for k in range(max(1, len(own) - n + 1)) if own and name is not None else ():
            win = own[k : k + n]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    names.add(name)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("keys", [0, 500_000])
def test_decontamination_against_brute_force(spark, docs_of, keys):
    rng = random.Random(2)
    words = ["a", "b", "c", "É", "7", "x-y"]
    item = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, item(14)), (2, item(10)), (3, "B"), (4, "b c"), (5, None), (6, " .,"), (2, item(12)), (None, "a"), (7, "one two three four five six seven eight nine ten eleven"), (8, "ONE two three four five six seven eight nine ten eleven")]
    texts = [*EDGES, *(item(rng.randint(1, 60)) for _ in range(40)), "so ONE, two three four five six seven eight nine; ten eleven", "four five six seven eight nine ten eleven twelve", items[0][1] + " " + items[0][1]]
    docs = docs_of(spark, texts, list(range(100, 100 + len(texts))))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(docs, bench, broadcast_keys=keys).collect()}
    assert got == {100 + k: hits(t, items) for k, t in enumerate(texts)}
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, r in got.items() if not r[-1]}


def test_decontamination_of_nothing(spark, docs_of):
    docs = docs_of(spark, EDGES, IDS)
    bench = spark.createDataFrame([(1, "word " * 12)], "item_id long, text string")
    none = decontaminate.decontaminate(docs, bench.filter("false")).collect()
    assert len(none) == len(EDGES) and not any(r.contaminated for r in none)
    assert decontaminate.decontaminate(docs.filter("false"), bench).count() == 0


# ------------------------------------------------------------------------------------------------------ near copies


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    edges += [(rng.randint(400, 440), rng.randint(400, 440)) for _ in range(30)] + [(None, 5), (1, 0)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {(a, b) for a, b in edges if a is not None and a != b}
    names = sorted({x for e in linked for x in e})
    at = {x: i for i, x in enumerate(names)}
    pairs = {(at[a], at[b]) for a, b in linked} | {(at[b], at[a]) for a, b in linked}
    want = groups(len(names), lambda a, b: (a, b) in pairs)
    assert got == {x: names[want[i]] for i, x in enumerate(names)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cap", [2, 6, 32])
def test_close_pairs_connect_what_is_close(spark, cap):
    rng = np.random.default_rng(0)
    fps = set()
    for b in (0, 1, -1, *rng.integers(-(2**62), 2**62, 4)):
        for _ in range(60):
            v = int(b) & (2**64 - 1)
            for k in rng.integers(0, 64, rng.integers(0, 4)):
                v ^= 1 << int(k)
            fps.add(v - (1 << 64) if v >> 63 else v)
    fps = sorted(fps)
    nodes = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    pairs = simhash.close_pairs(nodes, cap)
    far = lambda a, b: ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count()
    assert all(far(r.a, r.b) <= 2 and r.a < r.b for r in pairs.collect())
    got = {r.node: r.root for r in components.components(pairs).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == groups(len(fps), lambda a, b: far(a, b) <= 2)


def test_fingerprint_by_the_book():
    import xxhash

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ("", "A", "one TWO", "a b c", "a b c d a b c d", "É x y z é Q", "one two three four five six\tseven"):
        assert simhash.fingerprint(t) & (2**64 - 1) == plain(t)


def test_near_duplicates_edges(spark, docs_of):
    docs = docs_of(spark, EDGES, IDS)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(EDGES)
    zero = [r for r in got if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {0}
    assert simhash.near_duplicates(docs.filter("false")).count() == 0


def test_one_of_each_near_copy_stays(spark, docs_of):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(120)) for _ in range(20)]
    texts = list(base)
    for t in base[:10]:
        w = t.split()
        w[rng.randrange(120)] = "changed"
        texts += [" ".join(w), t.upper(), t.replace(" ", "\n")]
    half = base[12].split()
    texts.append(" ".join(half[:60] + [f"v{k}" for k in range(60)]))
    docs = docs_of(spark, texts)
    sets = [neardedup.shingles(t) for t in texts]
    want = {r for r in groups(len(texts), lambda a, b: neardedup.jaccard(sets[a], sets[b]) >= 0.8)}
    kept = neardedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    edge = neardedup.keep_one_of_each(docs_of(spark, EDGES, IDS)).collect()
    assert sorted(r.doc_id for r in edge) == [0, 3, 4, 5, 6, 7]
    assert neardedup.keep_one_of_each(docs.filter("false")).count() == 0


# ------------------------------------------------------------------------------------------------------ pseudonyms


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations_move_everything_and_go_back(n):
    p = feistel.Permutation(b"k", b"t", n)
    v = [p.forward(i) for i in range(n)]
    assert sorted(v) == list(range(n)) and [p.back(x) for x in v] == list(range(n)) and (n == 1 or all(i != x for i, x in enumerate(v)))


KEY = b"a key for tests"
FOUND = {
    "mail a.b+c@mail.example.com now": ("a.b+c", "email"),
    "call +1 (017) 555-7713, ok": ("+1 (017) 555-7713", "phone"),
    "card 4845168114407329.": ("4845168114407329", "card"),
    "card 4111-1111-1111-1111": ("4111-1111-1111-1111", "card"),
    "at 97.51.17.173.": ("97.51.17.173", "ip"),
    "ssn 078-05-1120": ("078-05-1120", "ssn"),
    "GB82 WEST 1234 5698 7654 32": ("GB82 WEST 1234 5698 7654 32", "iban"),
    "born 1987-02-28": ("1987-02-28", "date"),
    "on 28/02/1987.": ("28/02/1987", "date"),
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"': ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "secret"),
    'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!': ("9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "secret"),
}


@pytest.mark.parametrize("text", FOUND)
def test_finds_keep_their_format_and_go_back(text):
    value, kind = FOUND[text]
    (a, b, k), *more = pii.find(text)
    assert (text[a:b], k, more) == (value, kind, [])
    new, _ = pii.pseudonymise_text(text, KEY)
    assert value not in new
    (a, b, k), *_ = pii.find(new)
    assert k == kind and pii.replace(new[a:b], kind, KEY, back=True) == value
    shape = lambda s: re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "9", s))
    assert kind == "secret" or shape(new[a:b]) == shape(value)
    other, _ = pii.pseudonymise_text(text, key=b"another")
    assert other != new


def test_what_fails_its_check_stays():
    for t in ("4845168114407328", "999.1.1.1", "000-12-3456", "1987-02-30", "GB82 WEST 1234 5698 7654 33", "version 2.0.", "CC BY-NC 4.0.", "1.2.3.4.5", "a@b", "plain words", ""):
        assert pii.pseudonymise_text(t, KEY) == (t, [])


def written_dates(form, year):
    """By brute force: all strings of a form (d, m, Y; dd and mm with a leading zero) that a calendar has."""
    days = [date(year, 1, 1) + timedelta(k) for k in range(366 if year % 4 == 0 and year % 100 or year % 400 == 0 else 365)]
    parts = lambda d: {"d": str(d.day), "dd": f"{d.day:02d}", "m": str(d.month), "mm": f"{d.month:02d}", "Y": str(d.year)}
    return ["".join(parts(d).get(x, x) for x in re.findall(r"[a-zY]+|[-/.]", form)) for d in days]


@pytest.mark.parametrize("form", ["Y-mm-dd", "Y/m/d", "Y-m-dd", "dd.mm.Y", "dd/mm/Y", "mm/dd/Y", "d/m/Y", "m/d/Y", "d-mm-Y"])
def test_dates_are_permuted_within_their_shape(form):
    shape = lambda s: re.sub(r"\d", "9", s)
    all_of = {x for y in (1999, 2000) for f in {form, form.replace("d", "#").replace("m", "d").replace("#", "m")} for x in written_dates(f, y)} if form[0] != "Y" else {x for y in (1999, 2000) for x in written_dates(form, y)}
    new = {}
    for value in all_of:
        assert pii.find(value) == [(0, len(value), "date")]
        out = pii.replace(value, "date", KEY)
        assert out != value and shape(out) == shape(value) and pii.find(out) == [(0, len(out), "date")]
        assert pii.replace(out, "date", KEY, back=True) == value
        new[out] = value
    assert len(new) == len(all_of)


def test_a_shape_of_dates_is_one_set():
    """Every rank of a shape is a written date of it, each once, and nothing else is."""
    for shape in ((True, 2, 2, ""), (False, 2, 2, ""), (False, 1, 2, "1"), (False, 2, 1, "0"), (True, 1, 1, "")):
        _, _, before = pii._written(shape)
        texts = [pii._date_text(shape, "-", r) for r in (*range(before[101]), before[-1] - 1)]
        assert len(set(texts)) == len(texts)
        assert all(pii._date_rank(pii._DATE.fullmatch(t)) == r for t, r in zip(texts, (*range(before[101]), before[-1] - 1)))


@pytest.mark.parametrize("value", ["9.8.7.6", "10.20.30.40", "001.002.003.004", "192.168.001.9", "255.255.255.255"])
def test_addresses_keep_their_digits(value):
    new = pii.replace(value, "ip", KEY)
    assert new != value and [len(x) for x in new.split(".")] == [len(x) for x in value.split(".")] and all(int(x) < 256 for x in new.split("."))
    assert [x[0] == "0" and len(x) > 1 for x in new.split(".")] == [x[0] == "0" and len(x) > 1 for x in value.split(".")]
    assert pii.replace(new, "ip", KEY, back=True) == value


@pytest.mark.parametrize("value", ["İ", "ж.Юрий", "jos\u00e9", "STRASSE.ß", "名前", "\u212a9", "Ÿ1", "a_b"])
def test_local_parts_of_any_letters(value):
    text = f"to {value}@example.com"
    (a, b, kind), *_ = pii.find(text)
    new = pii.replace(text[a:b], kind, KEY)
    assert (kind, text[a:b]) == ("email", value) and new != value and len(new) == len(value)
    assert pii.replace(new, kind, KEY, back=True) == value


def test_secrets_that_read_as_hex_stay_so():
    for k in range(200):
        value = "1234567890" * 3 + "12" + "abcdefz"[k % 7] + str(k)
        new = pii.replace(value, "secret", KEY)
        assert pii.hex_like(new) == pii.hex_like(value) and new != value and pii.replace(new, "secret", KEY, back=True) == value


def test_only_plain_digits_count():
    for t in ("0\u0660\u0660-12-3456", "\u0661\u0662\u0663-45-6789", "2020-0\u0661-02", "4845168114407\u0663\u0662\u0669", "1.2.3.\u0664", "+1 (\u0660\u0661\u0667) 555-7713"):
        for a, b, _ in pii.find(t):
            assert t[a:b].isascii()
        pii.pseudonymise_text(t, KEY)


def test_any_string_passes():
    rng = random.Random(3)
    alphabet = "0123456789" * 4 + "--//..+() @=:ABCGDEFabcdef" + "\u0660\u0663\u00b2\u2460\u0130\u017f\u212a\u00e9\u4e2d\U0001f44d\u0000\n" + "tokensecret"
    for _ in range(20_000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
        new, found = pii.pseudonymise_text(t, KEY)
        assert len(new) == len(t) and all(a < b for a, b, _ in found)
        for a, b, kind in found:
            assert pii.replace(new[a:b], kind, KEY, back=True) == t[a:b]


def test_the_key_comes_from_outside(spark, docs_of):
    docs = docs_of(spark, ["at 97.51.17.173"])
    text = lambda **k: pii.pseudonymise(docs, **k).first().text
    assert text() == text() == pii.pseudonymise_text("at 97.51.17.173", pii.key_of(spark))[0]
    spark.conf.set(pii.KEY_SETTING, "of the session")
    try:
        assert text() == text(key=b"of the session") != text(key=b"another")
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    clash = docs.withColumn("n_pii", F.lit("x")).withColumn("PII_kinds", F.lit(1))
    row = pii.pseudonymise(clash, report=True).first()
    assert (row.n_pii, row.pii_kinds) == (1, "ip")


def test_equal_values_stay_linked(spark, docs_of):
    docs = docs_of(spark, ["+1 (017) 555-7713 x", "y +1 (017) 555-7713", *EDGES], [10, 11, *IDS])
    out = pii.pseudonymise(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id in (10, 11)}
    assert got[10][:-2] == got[11][2:] != "+1 (017) 555-7713"
    report = pii.pseudonymise(docs.select("doc_id", "text"), report=True).collect()
    assert len(report) == len(EDGES) + 2 and {r.n_pii for r in report} == {0, 1}
    assert sum(r.text is None for r in report) == 2


def test_personal_data_in_long_texts():
    t = "1" * 100_000 + " " + "a" * 100_000 + "@x.com " + "9" * 50_000 + " 97.51.17.173 " + "@" * 20_000 + "1-" * 20_000
    assert "97.51.17.173" not in pii.pseudonymise_text(t, KEY)[0]


# ---------------------------------------------------------------------------------------------------- ids, packing


def test_elias_fano_selects_everything():
    rng = np.random.default_rng(0)
    for v in ([], [0], [0, 0, 0], [5] * 700, np.sort(rng.integers(0, 10**12, 3000)), np.cumsum(rng.integers(0, 3, 5000)), [2**40]):
        e = eliasfano.EliasFano(eliasfano.encode(np.array(v, np.uint64)))
        assert e.all().tolist() == [int(x) for x in v] == [e.select(k) for k in range(e.n)]
        with pytest.raises(IndexError):
            e.select(len(v))
    n = 100_000
    assert len(eliasfano.encode(np.cumsum(rng.integers(100, 900, n)))) * 8 / n < 13


def test_select_many_is_select():
    rng = np.random.default_rng(1)
    for n, most in ((1, 5), (255, 1), (257, 3), (5000, 1000), (3000, 0)):
        v = np.cumsum(rng.integers(0, most + 1, n))
        f = eliasfano.EliasFano(eliasfano.encode(v))
        some = np.flatnonzero(rng.random(n) < 0.3)
        assert f.select_many(np.arange(n)).tolist() == v.tolist() and f.select_many(some).tolist() == v[some].tolist() == [f.select(k) for k in some.tolist()]
    with pytest.raises(IndexError):
        f.select_many(np.array([n]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_like_whole_texts(name):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(name)
    whole, enc, rng = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(1)
    alphabet = [*" \n\t abcdÉéß.,'$!1239_-()\"@²½ªµ", "中", "👍", "<|endoftext|>", "İ", "Σ", "\x01", "\x1c", "'s", "'ll", " the", "The", " ", ".\n", "\r\n", "\u201c", "\u2019", "\u0416", "\u0443", "\u0301", "\u0308", "\u0928\u094d", "\uac00", "\u1100\u1161", "\u2003", "\u3000", "\u200b", "\u0130", "\u03c2", "\u1e9b"]
    texts = ["".join(rng.choice(alphabet[: rng.choice([20, 30, len(alphabet)])]) for _ in range(rng.randrange(40))) for _ in range(4000)]
    for t, b in zip(texts, enc.encode(texts)):
        assert np.frombuffer(b, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_token_segments_read_back(spark, docs_of, tmp_path, vocabulary):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    texts = [*EDGES[:-1], *(f"text number {k} " * (k % 7) for k in range(60))]
    ids = [5, 3, -9, 1, 40, 2, 8, 7, 1, *range(100, 158), None, None]
    path = str(tmp_path / "segments")
    tokenbin.write(docs_of(spark, texts, ids), path, vocabulary, end_id=2, segment_ids=500, partitions=3)
    want, start = [], 0
    got = tokenbin.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, *sorted(i for i in ids if i is not None)]
    rank = {(r.doc_id, r.ids_crc32): k for k, r in enumerate(got)}
    crc = lambda t: crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    for i, t in sorted(zip(ids, texts), key=lambda p: rank[p[0], crc(p[1])]):
        own = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(own), crc32(own.tobytes())))
        start += len(own)
    assert list(map(tuple, got)) == want
    segments = [tokenbin.Segment(r.payload) for r in spark.read.parquet(path).orderBy("part", "segment").collect()]
    assert [s.doc_id(k) for s in segments for k in range(s.n_docs)] == [r.doc_id for r in got]
    assert [crc32(s.document(k).astype("<u4").tobytes()) for s in segments for k in range(s.n_docs)] == [r.ids_crc32 for r in got]
    empty = str(tmp_path / "none")
    tokenbin.write(docs_of(spark, []), empty, vocabulary, end_id=2)
    assert tokenbin.read(spark, empty).count() == 0


def test_equal_doc_ids_are_dealt_out(spark, docs_of, tmp_path, vocabulary):
    """A third of all rows with one id, and copies of one text: still whole, in order, over several parts."""
    texts = [f"text {k % 40}" for k in range(300)]
    ids = [7 if k % 3 == 0 else k for k in range(300)]
    path = str(tmp_path / "segments")
    tokenbin.write(docs_of(spark, texts, ids), path, vocabulary, end_id=2, segment_ids=64, partitions=6)
    got = tokenbin.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(ids)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert spark.read.parquet(path).filter("first_id <= 7").select("part").distinct().count() > 1


def test_sum_of_squares_choice_by_brute_force():
    rng = np.random.default_rng(2)
    room, lengths = 40, rng.integers(1, 41, 400)
    seq, off = packing.sum_of_squares(lengths, room)
    used: dict[int, int] = {}
    for k, n in enumerate(lengths):
        gaps = {s: room - u for s, u in used.items() if u < room}
        cost = {}
        for s, g in gaps.items():
            if g >= n:
                after = [h for t, h in gaps.items() if t != s] + ([g - n] if g > n else [])
                cost[s] = sum(after.count(h) ** 2 for h in set(after))
        if cost:
            assert cost[seq[k]] == min(cost.values())
        else:
            assert seq[k] not in used
        assert off[k] == used.get(seq[k], 0)
        used[seq[k]] = used.get(seq[k], 0) + n


def test_packing_is_whole_and_tight(spark, docs_of, vocabulary):
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(vocabulary), random.Random(3)
    texts = [*EDGES, *(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 90))) for _ in range(150))]
    ids = [*IDS, *range(100, 250)]
    rows = packing.pack_documents(docs_of(spark, texts, ids), vocabulary, 2, room=64).collect()
    total, by = 0, {}
    want = {}
    for i, t in zip(ids, texts):
        own = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(own)
        for p, (a, n) in enumerate(packing.cut_lengths(len(own), 64)):
            want.setdefault((i, p), []).append((a, n, crc32(own[a : a + n].tobytes())))
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= 1.03 * total / 64 + 1
    assert packing.pack_documents(docs_of(spark, []), vocabulary, 2).count() == 0


def test_pipeline_dedup_finds_nearly_all_links_of_real_tables(spark):
    """Against every pair at 0.8 and more in the driver's tables: at most one document in a hundred too many stays."""
    import os
    from collections import Counter

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(path)
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: neardedup.shingles(r.text) for r in rows}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((max(a, b), min(a, b)) for own in holders.values() for k, a in enumerate(own) for b in own[:k])
    at = {i: k for k, i in enumerate(sorted(sets))}
    linked = {(at[a], at[b]) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8}
    names = sorted(sets)
    want = {names[g] for g in groups(len(names), lambda a, b: (a, b) in linked)}
    kept = {r.doc_id for r in neardedup.keep_one_of_each(docs).collect()}
    assert want <= kept and len(kept - want) <= 0.01 * len(kept)


@pytest.mark.parametrize("cap", [3, 32])
def test_nodes_that_share_fingerprints(spark, cap):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 3)]
    fps = [b ^ (1 << int(rng.integers(0, 62))) if rng.random() < 0.3 else b for b in base for _ in range(30)]
    nodes = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    for bits in (2, 3):
        got = {r.node: r.root for r in components.components(simhash.close_pairs(nodes, cap, bits)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == groups(len(fps), lambda a, b: ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2)


def test_a_crowd_of_near_copies_meets_its_original(spark, docs_of):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(150)]
    texts = []
    for k in range(120):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(150)] = f"new{k}x{rng.randint(0, 9999)}"
        texts.append(" ".join(w))
    texts.insert(60, " ".join(base))
    sets = [neardedup.shingles(t) for t in texts]
    near = {i for i in range(len(texts)) if neardedup.jaccard(sets[i], sets[60]) >= 0.8}
    kept = {r.doc_id for r in neardedup.keep_one_of_each(docs_of(spark, texts)).collect()}
    assert len(kept & near) == 1 and len(near) > 100


def stay_by_brute_force(texts):
    """The first of each component of all pairs at 0.8 and more."""
    sets = [neardedup.shingles(t) for t in texts]
    return set(groups(len(texts), lambda a, b: neardedup.jaccard(sets[a], sets[b]) >= 0.8))


def test_dedup_of_a_crowd_of_a_thousand(spark, docs_of):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(150)]
    texts = []
    for k in range(1200):
        w = list(base)
        for at in rng.sample(range(150), 3):
            w[at] = f"new{k}x{at}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    assert {r.doc_id for r in neardedup.keep_one_of_each(docs_of(spark, texts)).collect()} == stay_by_brute_force(texts)


def test_dedup_of_texts_of_the_same_words(spark, docs_of):
    rng = random.Random(10)
    lines = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(12)) for _ in range(20)]
    texts = []
    for k in range(20):
        rng.shuffle(lines)
        w = " ".join(lines).split()
        texts.append(" ".join(w))
        w[rng.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    want = stay_by_brute_force(texts)
    assert len(want) == 20
    assert {r.doc_id for r in neardedup.keep_one_of_each(docs_of(spark, texts)).collect()} == want


def test_dedup_of_short_texts(spark, docs_of):
    rng = random.Random(11)
    texts = []
    for size in (12, 30, 60, 100, 150):
        for _ in range(60):
            w = [f"w{rng.randint(0, 3000)}" for _ in range(size)]
            texts.append(" ".join(w))
            for at in rng.sample(range(size), rng.randint(1, max(1, size // 40))):
                w[at] = f"v{rng.randint(0, 3000)}"
            texts.append(" ".join(w if rng.random() < 0.7 else w[: -max(1, size // 10)]))
    assert {r.doc_id for r in neardedup.keep_one_of_each(docs_of(spark, texts)).collect()} == stay_by_brute_force(texts)


@pytest.mark.parametrize("value, kind", [
    ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("DE89370400440532013000", "iban"), ("NO93 8601 1117 947", "iban"),
    ("+33 1 23 45 67 89", "phone"), ("+49.30.1234567", "phone"), ("555 123 4567", "phone"), ("+1 (555) 123-4567", "phone"), ("+1-555-123-4567", "phone"), ("(555) 123 4567", "phone"),
])
@pytest.mark.parametrize("after", ["", ".", " BIC COBADEFF", " IN FULL", " EUR 50", " A1 B2 C3", ", 2024"])
def test_what_follows_hides_no_personal_data(value, kind, after):
    text = f"see {value}{after}"
    (a, b, k), *_ = pii.find(text)
    assert (text[a:b], k) == (value, kind)
    new, _ = pii.pseudonymise_text(text, KEY)
    assert new != text and new.startswith("see ") and new.endswith(after)
    (a, b, _), *_ = pii.find(new)
    assert pii.replace(new[a:b], kind, KEY, back=True) == value


def test_numbers_after_a_phone_number():
    for text, value in (("+33 1 23 45 67 89 50 EUR", "+33 1 23 45 67 89"), ("+1 555 123 4567 2024 12 31", "+1 555 123 4567"), ("+33 (0)1 23 45 67 89", "+33 (0)1 23 45 67 89")):
        assert [text[a:b] for a, b, _ in pii.find(text)] == [value]
    text = "AB12 CDEF 1234 5678 DE89 3704 0044 0532 0130 00"
    assert [text[a:b] for a, b, k in pii.find(text) if k == "iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert pii.find("+0.12345678 and +1.2345678") == []
