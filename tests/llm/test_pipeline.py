import corpus_pipeline
from fleetframe.llm import ngram_join, pii, quality, queries, toxicity


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier",
        "toxicity",
        "ngram_jaccard_join",
        "pii",
        "packing",
    ]
    names = list(queries.all_queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


def test_each_stage_works_on_what_was_kept(spark, bundled, tmp_path):
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs = bundled("documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, docs, folder).write.parquet(out)
        after = spark.read.parquet(out)
        if name == "packing":
            rows = after.collect()
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert sorted(after.columns) == sorted(columns) and 0 < after.count() <= docs.count()
        if name == "quality_classifier":
            model = quality.train(docs, bundled("labels"))
            wanted = quality.scored(docs, model).filter("selected")
        elif name == "toxicity":
            model = toxicity.train(docs, bundled("labels"), toxicity.learnable())
            wanted = toxicity.scored(docs, model, ~toxicity.learnable()).filter("predicted = 0")
        elif name == "ngram_jaccard_join":
            wanted = ngram_join.joined(docs).filter("kept")
        else:
            wanted = docs
            assert pii.found(after, None).selectExpr("sum(n_email + n_ip + n_card + n_phone) n").first()["n"] == 0
        assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in wanted.collect())
        docs = after


def test_empty_documents(spark, bundled):
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    empty = bundled("documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
