"""Pipeline against brute force and by hand."""

import corpus_pipeline
from corpus_cases import prose


def test_pipeline_stages(spark, tmp_path):
    en = [(i, prose(i, 80), "en", "s", 1) for i in range(40)]
    rows = en + [(100, en[0][1], "en", "s", 1), (101, en[1][1] + " more", "en", "s", 1), (102, "12345", "en", "s", 1), (103, "z " + prose(500, 30), "en", "s", 1), (104, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(500, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.collect()})
    assert seen[0] == set(range(40)) | {100, 101, 103} and seen[1] == seen[0] - {100} and seen[2] == seen[1] - {101} and seen[3] == seen[2] - {103}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == seen[3]
