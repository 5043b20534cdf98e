import __spark_entry__ as entry
import corpus_pipeline


def test_registered():
    q = entry.queries()
    assert {k.split("_")[0] for k in q if k.startswith("op")} == {f"op{n}" for n in range(1, 11)} and "pipeline" in q
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert set(entry.oracle_sql()) <= set(q)


def test_pipeline(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.unionAll(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 100_000)).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, str(tmp_path))
        assert now.columns == before.columns
        now = now.checkpoint()
        sizes.append(now.count())
    assert now.filter("doc_id >= 100000").count() == 0 and all(sizes)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == sizes[-1] and out.filter("n_tokens <> size(ids)").count() == 0
