import corpus_pipeline


def test_stages_keep_the_columns_and_catch_planted_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = docs.where("doc_id < 3").collect()
    extra = [(10_000, rows[1].text, "en", "p", 1), (10_001, "x y z. " + bench, "en", "p", 1), (10_002, "12 34 !!", "en", "p", 1), (10_003, None, None, None, None)]
    df = docs.union(spark.createDataFrame(extra, docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == docs.columns, name
    kept = {r.doc_id for r in df.collect()}
    assert not kept & {10_000, 10_001, 10_002, 10_003}
    out = corpus_pipeline.STAGES[-1][1](spark, df, sf)
    assert out.count() == len(kept) and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_of_an_empty_table_with_an_extra_column(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0).selectExpr("*", "'x' as score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns[-1] == "score" and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0
