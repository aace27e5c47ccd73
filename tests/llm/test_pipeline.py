import corpus_pipeline
from faultline.llm.skew import held


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = held(stage(spark, docs, tables), f"test-{name}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    packed = corpus_pipeline.run(spark, tables)
    assert packed.select("doc_id").distinct().count() == counts[3]
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
