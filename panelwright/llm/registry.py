"""The registered queries of this subpackage: thin callers of its operators over the given tables."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline

from panelwright.llm import oracles
from panelwright.llm.common import prepare, table
from panelwright.llm.conversation_trie import prefix_trie
from panelwright.llm.decontaminate import contamination
from panelwright.llm.fingerprints import fingerprinted
from panelwright.llm.language_id import language_predictions
from panelwright.llm.license_scan import license_digest
from panelwright.llm.line_dedup import deduplicated
from panelwright.llm.ngram_join import near_duplicate_classes
from panelwright.llm.packing import packed
from panelwright.llm.quality import resampled
from panelwright.llm.quality_rules import quality_verdicts
from panelwright.llm.substring_dedup import without_repeats
from panelwright.llm.toxicity import toxicity_scores
from panelwright.llm.whitening import whitened


def op1_document_fingerprints(spark, sf_dir):
    prepare(spark)
    return fingerprinted(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs)


def op3_quality_classifier(spark, sf_dir):
    prepare(spark)
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), whole=True)


def op4_benchmark_decontamination(spark, sf_dir):
    prepare(spark)
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("r")


def op5_toxicity(spark, sf_dir):
    prepare(spark)
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark, sf_dir):
    prepare(spark)
    return language_predictions(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark, sf_dir):
    prepare(spark)
    return near_duplicate_classes(table(spark, sf_dir, "documents")).drop("r", "component")


def op8_license_scans(spark, sf_dir):
    prepare(spark)
    return license_digest(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark, sf_dir):
    prepare(spark)
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_substring_dedup(spark, sf_dir):
    prepare(spark)
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_quality_rules(spark, sf_dir):
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("lang", "source")


def op12_embedding_whitening(spark, sf_dir):
    prepare(spark)
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_conversation_prefix_trie(spark, sf_dir):
    prepare(spark)
    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_document_fingerprints": op1_document_fingerprints,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_toxicity": op5_toxicity,
        "op6_language_id": op6_language_id,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_license_scans": op8_license_scans,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_quality_rules": op11_quality_rules,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
    }


def oracle_sql():
    return {
        "op2_line_dedup": oracles.LINE_DEDUP,
        "op4_benchmark_decontamination": oracles.DECONTAMINATION,
        "op13_conversation_prefix_trie": oracles.PREFIX_TRIE,
    }
