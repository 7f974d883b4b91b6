"""Empty tables, nulls, clashing columns, very long texts, and ids of any type."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelwright.llm import fingerprints, language_id, license_scan, line_dedup, ngram_join, packing, substring_dedup, toxicity
from panelwright.llm.common import prepare
from corpus_cases import frame, prose


@pytest.mark.parametrize("kind", ["string", "smallint", "decimal(20,0)", "date"])
def test_any_type_of_id(spark, kind):
    prepare(spark)
    rows = [(None if i == 7 else i, prose(i, 40)) for i in range(20)]
    docs = spark.createDataFrame(rows, "i int, text string")
    docs = docs.select((F.date_add(F.lit("2020-01-01"), F.col("i")) if kind == "date" else F.col("i").cast(kind)).alias("doc_id"), "text")
    assert packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id").distinct().count() == 20
    assert fingerprints.fingerprinted(docs).select("doc_id", "n_chars").count() == 20


def test_empty_tables(spark, rows):
    none = frame(spark, rows).limit(0)
    assert fingerprints.fingerprinted(none).count() == 0 and line_dedup.deduplicated(none).count() == 0 and ngram_join.near_duplicate_classes(none).count() == 0
    assert packing.packed(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0 and substring_dedup.without_repeats(none).count() == 0 and license_scan.license_digest(none).count() == 0


def test_columns_that_clash_with_the_operators_own(spark):
    prepare(spark)
    clashing = ["score", "lang_pred", "held_out", "margin", "evidence", "words", "kind", "toxic", "h", "place", "r", "block", "label", "tree", "look"]
    docs = spark.createDataFrame([(i, prose(i, 30) if i else None, "en") for i in range(40)], "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in clashing})
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "word": F.lit("y")})
    assert sorted(language_id.language_predictions(docs).columns) == ["doc_id", "held_out", "lang_pred", "score"] and language_id.language_predictions(docs).count() == 40
    assert toxicity.toxicity_scores(docs, labels).count() == 40 and ngram_join.near_duplicate_classes(docs).count() == 40
    assert line_dedup.without_repeated_lines(docs.withColumn("n_chars", F.lit(1).cast("long"))).filter("score <> 7").count() == 0
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 40


def test_stages_of_empty_tables_and_of_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)]):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(rows, schema), str(tmp_path))
            assert out.count() == {"language_id": 0, "best_fit_packing": len(rows)}.get(name, len(rows) and (3 if name != "ngram_jaccard_join" else 2)), name


def test_one_very_long_text(spark):
    docs = frame(spark, [(1, prose(5, 120_000) + "\n" + "cc by nc " * 20_000), (2, prose(5, 40))])
    assert license_scan.license_digest(docs).filter("doc_id = 1").first().n_base >= 19_999
    assert substring_dedup.without_repeats(docs).filter("doc_id = 1").first().n_words == 180_000
    assert fingerprints.fingerprinted(docs).count() == 2 and ngram_join.near_duplicate_classes(docs).count() == 2
