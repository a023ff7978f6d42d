import corpus_pipeline
from strataline.llm import decontaminate, neardedup, pii, registry


def test_stages_take_effect(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows, before = out.collect(), {r.doc_id: r for r in docs.collect()}
        kept = {r.doc_id for r in rows}
        assert kept <= set(before) and len(kept) == len(rows)
        gone = set(before) - kept
        if name.startswith("quality"):
            assert gone == {i for i in before if not corpus[i][2]}
        if name.startswith("benchmark"):
            leaks = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect() if r.contaminated}
            assert gone == leaks and 11 in leaks
        if name == "PII":
            assert not gone and all(r.text == pii.pseudonymise_text(before[r.doc_id].text, pii.key_of(spark))[0] and r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_dedup_stage_against_brute_force(spark, docs_of, corpus):
    docs = docs_of(spark, [t for t, *_ in corpus] + [corpus[0][0], corpus[1][0].lower()])
    kept = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    sets = [neardedup.shingles(r.text) for r in docs.orderBy("doc_id").collect()]
    dropped = {i for i in range(len(sets)) if any(neardedup.jaccard(sets[i], sets[j]) >= 0.8 for j in range(i))}
    assert kept == set(range(len(sets))) - dropped


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_stages_take_edges(spark, docs_of, tmp_path):
    """Nulls everywhere, empty and long texts, repeated rows, clashing columns, empty tables."""
    texts = [None, "", " \n ", "a", "!!! ??? 123", "word " * 3000, "x" * 50_000, "mail a.b@c.example.com", "a", None, "same row here", "same row here"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 10, 10]
    docs = docs_of(spark, texts, ids)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1), (3, 1), (None, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "word " * 12), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (docs, docs.filter("false")):
        now = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(tmp_path))
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            now = spark.createDataFrame(out.collect(), docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert {r.doc_id for r in last} == {r.doc_id for r in now.collect()}
    kept = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    assert kept == {0, 3, 4, 5, 6, 7, 10}
