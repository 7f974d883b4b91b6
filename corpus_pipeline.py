"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows to the shared folder and reads them
again, so that a lost executor costs one task and not the whole chain. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.common import prepare, saved, table
from panelwright.llm.decontaminate import without_contaminated
from panelwright.llm.language_id import in_a_known_language
from panelwright.llm.line_dedup import without_repeated_lines
from panelwright.llm.ngram_join import keep_one_of_each
from panelwright.llm.packing import packed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the byte network knows, with a score of a half or more; others go, null, empty and letterless texts among them.

    Rows with null doc_ids and repeated rows are judged like others. Without a labelled row nothing is known, so all go; an empty table stays empty.
    """
    prepare(spark)
    return in_a_known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those of which nothing is left go.

    Earlier is by doc_id (nulls first), then row key, then line number. Null and empty texts stay as they are; rows alike in doc_id and text are treated alike.
    """
    return without_repeated_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least doc_id (nulls last), of its repeated rows one.

    Null, empty and wordless texts are in no class but with rows alike in doc_id and text. An empty table stays empty.
    """
    prepare(spark)
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none, and an empty benchmark takes nothing out. Repeated rows are judged alike."""
    prepare(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; null and empty texts are one end token, repeated rows are packed each for itself, an empty table gives no piece."""
    prepare(spark)
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A trained network, hashed candidates and a packing order are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
