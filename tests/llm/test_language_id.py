"""Language id against brute force and by hand."""

import zlib

from panelwright.llm import language_id
from panelwright.llm.common import prepare
from corpus_cases import labelled_texts


def test_language_id_held_out(spark):
    prepare(spark)
    rows = labelled_texts() + [(1000, None, "xx"), (1001, "123 !!", "xx"), (1002, "", None), (None, "thandere thandere", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_predictions(docs).collect()}
    held = [(i, lang) for i, _, lang in rows[:300] if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows[:300])
    assert len(held) > 30 and sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "xx"
    kept = language_id.in_a_known_language(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 1000").count() == 0 and kept.count() >= 290
    assert language_id.language_predictions(docs.limit(0)).count() == 0
