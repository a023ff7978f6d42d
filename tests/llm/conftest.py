import json
import os
import random

import pytest

EDGE = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, word string, row int"


def edge_docs(spark, texts, ids=None):
    """Documents with columns whose names clash with those operators use within."""
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, "x", "y", 3) for i, t in zip(ids, texts)], EDGE)


@pytest.fixture(scope="session")
def docs_of():
    return edge_docs


@pytest.fixture(scope="session")
def corpus():
    """Short prose in two invented languages, half of the labelled junk; (texts, langs, quality, toxic)."""
    rng = random.Random(5)
    syll = {"aa": ["ka", "lo", "mi", "ta", "ren", "sol"], "bb": ["zwu", "xif", "gro", "vek", "puz", "hjo"]}
    common = {"aa": ["the", "of", "and"], "bb": ["el", "una", "con"]}
    out = []
    for i in range(400):
        lang = "aa" if i % 3 else "bb"
        words = [rng.choice(common[lang]) if rng.random() < 0.3 else "".join(rng.choice(syll[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 80))]
        bad = i % 5 == 0
        toxic = i % 7 == 0
        if bad:
            words = [w.upper() + rng.choice(["!!", "$$$", "%%%"]) for w in words]
        if toxic:
            for w in ("idiot", "pathetic", "scum"):
                words.insert(rng.randrange(len(words)), w)
        out.append((" ".join(words) + ".", lang, int(not bad), int(toxic)))
    return out


@pytest.fixture(scope="session")
def folder(spark, corpus, tmp_path_factory):
    """A small set of tables like the driver's."""
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, f"s{i % 4}", len(t)) for i, (t, lang, _, _) in enumerate(corpus)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, (_, _, q, x) in enumerate(corpus)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, " ".join(corpus[3][0].split()[2:16])), (1, corpus[11][0])], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


@pytest.fixture(scope="session")
def vocabulary(tmp_path_factory):
    public = pytest.importorskip("public_tokenizers")
    assert json and os
    return public.path("byte_bpe_50k.json")
