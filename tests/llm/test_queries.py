"""Every query through a folder of tables with nulls, repeats, clashing columns, and through empty tables."""

import pytest

from strataline.llm import registry

TEXTS = [None, "", " \n\t ", "a", "!!! ??? 123", "word " * 3000, "one two three four five six seven eight nine ten eleven", "x" * 50_000, "a", "same row", "same row", "at 97.51.17.173"]
IDS = [0, 1, 2, 3, 4, 5, 6, 7, 3, 8, 8, None]
COLUMNS = {
    "op1_quality_fm": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_brown_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op3_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op4_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_toxicity_chain": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "toxic": "boolean"},
    "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_pii_feistel": {"doc_id": "bigint", "text": "string"},
    "op9_token_segments": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_sum_of_squares_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11_whiten": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op13_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
}


@pytest.fixture(scope="module")
def folders(spark, docs_of, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    tables = {
        "documents": docs_of(spark, TEXTS, IDS),
        "labels": spark.createDataFrame([(1, 1, 0, "x"), (3, 0, 1, "y"), (3, 0, 1, "y"), (None, 1, 1, None), (5, None, None, "z"), (99, 1, 0, "w")], "doc_id long, quality int, toxic int, text string"),
        "benchmark": spark.createDataFrame([(1, "ONE two three four five six seven eight nine ten", 4), (1, None, 5), (None, "a", 6)], "item_id long, text string, doc_id int"),
        "embeddings": spark.createDataFrame([(0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (50, None, 2), (51, [1.0, float("nan")], 3), (None, [1.0, 1.0], 4)], "vec_id long, embedding array<float>, score int"),
        "conversations": spark.createDataFrame([(0, 0, "user", None, 1), (0, 0, "user", None, 1), (0, None, None, "a b", 2), (None, 1, "user", "x", 3), (7, 2, "user", "y", 4)], "conv_id int, turn int, role string, text string, depth int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{full}/{name}.parquet")
        df.filter("false").write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_through_a_folder(spark, folders, name):
    if name.startswith(("op9", "op10")):
        pytest.importorskip("public_tokenizers")
    full, empty = folders
    out = registry.QUERIES[name](spark, full)
    assert {c: t for c, t in out.dtypes if c in COLUMNS[name]} == COLUMNS[name]
    rows = out.collect()
    if name == "op3_topk":
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in rows) == [(0, 1, 0), (0, 1, 0)]
    elif name == "op11_whiten":  # the vectors that are left are two
        assert sorted((r.vec_id is None, r.component) for r in rows) == [(False, 1), (False, 1), (True, 1)]
    elif name == "op13_prefix_trie":
        assert [r.n_convs for r in rows if r.parent_conv_id is None] == [2]
    elif name == "op10_sum_of_squares_packing":
        assert sorted({r.doc_id for r in rows}, key=str) == sorted(set(IDS), key=str)
    else:
        assert sorted((r.doc_id for r in rows), key=str) == sorted(IDS, key=str)
    assert registry.QUERIES[name](spark, empty).count() == 0
