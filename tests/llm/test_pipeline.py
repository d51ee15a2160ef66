import corpus_pipeline as cp
from stmtflow.llm.catalog import QUERIES


def test_stages_over_the_small_tables(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    source = spark.read.parquet(f"{sf_small}/documents.parquet")
    toxic = {r.doc_id for r in QUERIES["op10_toxicity"](spark, sf_small).filter("predicted = 1").collect()}
    clean = {r.doc_id for r in source.collect()} - toxic
    assert {r.doc_id for r in seen["toxicity"].collect()} == clean
    kept = {r.doc_id for r in seen["ngram_join"].collect()}
    groups = {r.doc_id: r.class_id for r in __import__("stmtflow.llm.ngram_join", fromlist=["x"]).duplicate_groups(seen["toxicity"]).collect()}
    assert kept == set(groups.values())
    assert seen["pii"].count() == len(kept)
    mixed = {r.doc_id: r["count"] for r in seen["mixing"].groupBy("doc_id").count().collect()}
    assert set(mixed) <= kept and max(mixed.values()) <= 2
    assert {r.doc_id for r in seen["packing"].collect()} == set(mixed)


def test_run(spark, sf_small):
    assert cp.run(spark, sf_small).count() > 0


def test_stages_over_odd_and_empty_tables(spark, sf_small, odd_docs, no_docs):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd_docs, sf_small), stage(spark, no_docs, sf_small)
        assert none.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == odd_docs.columns and none.columns == odd_docs.columns, name
        rows, n = got.collect(), odd_docs.count()
        if name == "toxicity":
            assert 0 < len(rows) <= n
        elif name == "ngram_join":
            texts = [r["text"] or "" for r in rows]
            assert len(texts) == len(set(texts)) < n
        elif name == "pii":
            assert len(rows) == n and not any("a.b@c.de" in (r["text"] or "") for r in rows)
            assert sum(r["text"] is None for r in rows) == sum(r["text"] is None for r in odd_docs.collect())
