"""License scan against brute force and by hand."""

import time

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import license_scan
from corpus_cases import frame


def test_license_scan(spark):
    rows = [(1, "Released under the M.I.T. license"), (2, "Released UNDER THE MIT LICENSE. under the mit license"), (3, "licensd under teh apache license, version 2.0"), (4, None), (5, "all right reserved"), (6, "permit nothing"), (7, "CC BY-NC 4.0")]
    got = {r.doc_id: r for r in license_scan.license_digest(frame(spark, rows)).collect()}
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 1, 5, "mit")
    assert got[3].base_labels == "apache-2" and got[5].labels == "all-rights-reserved" and 0.9 < got[5].score < 1
    assert got[4].n_words == 0 and got[4].labels == "" and got[6].labels == "" and got[7].base_labels == "cc-by-nc"


def test_close_notices_keep_their_own_spans(spark):
    text = "x released undr te mit license released under the mit license y"
    assert [x[1:4] for x in license_scan.fuzzy_spans(text) if x[0] == "mit"] == [(2, 30, 2), (31, 61, 0)]
    one = license_scan.license_digest(frame(spark, [(1, text)])).first()
    assert one.n_spans == 2 and one.spans == "mit:2:30:2 mit:31:61:0" and one.n_base == 1 and one.first_word == 7


def test_exact_places_by_sql_and_in_long_texts(spark):
    rng = np.random.default_rng(6)
    words = ["Under", "the", "MIT", "license", "cc", "BY", "nc", "apache", "version", "2", "x"]
    rows = [(i, " ".join(rng.choice(words, 200)) if i % 2 else "under the MIT license, cc by-nc " * i) for i in range(60)] + [(98, None), (99, "")]
    assert [w for _, w in license_scan.exact_places(("cc by nc " * 60_000).strip())] == list(range(0, 180_000, 3))
    got = sorted((r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_digest(frame(spark, rows)).collect())
    documents = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})  # noqa: F841
    phrases = [(p.split(" "), label) for p, label in license_scan.PHRASES.items()]
    hits = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p) - 1}] = {p})) - 1 AS s FROM docs" for p, label in phrases)
    sql = f"""WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)
    SELECT doc_id, count(s), min(s), max(s), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM docs LEFT JOIN ({hits}) USING (doc_id) GROUP BY doc_id"""
    assert got == sorted(duckdb.sql(sql).fetchall())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, len(license_scan.NOTICES) - 1), st.integers(0, 1 << 30))
def test_fuzzy_notices_are_found_with_errors_up_to_the_bound(which, seed):
    notice, label = list(license_scan.NOTICES.items())[which]
    rng = np.random.default_rng(seed)
    damaged = list(notice)
    for i in rng.choice(len(notice), int(rng.integers(0, len(notice) // 10 + 1)), replace=False):
        damaged[i] = "#"
    assert label in {s[0] for s in license_scan.fuzzy_spans("before " + "".join(damaged) + " after")}


def _exhaustive(words, notice, label):
    """The best match in the whole text, then in what is before and after it, and so on."""
    errors, _, _, pattern = license_scan._plan(notice, license_scan.CHARS_PER_ERROR)
    own, todo = [], [(0, len(words))]
    while todo:
        low, high = todo.pop()
        found = pattern.search(words, low, high) if high - low >= len(notice) - errors else None
        if found:
            own.append((label, found.start(), found.end(), sum(found.fuzzy_counts), len(notice)))
            todo += [(max(found.end(), found.start() + 1), high), (low, found.start())]
    return sorted(own)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30))
def test_spans_equal_an_exhaustive_search(seed):
    rng, names, parts = np.random.default_rng(seed), list(license_scan.NOTICES), []
    for _ in range(int(rng.integers(1, 6))):
        text = list(names[int(rng.integers(len(names)))] if rng.random() < 0.4 else names[0])
        for i in rng.integers(0, len(text), int(rng.integers(0, len(text) // 10 + 2))):
            text[i] = str(rng.choice(["#", "", text[i] + "z"]))
        parts += ["".join(text), *(["the mit x"] if rng.random() < 0.4 else [])]
    words = " ".join(parts)
    got = license_scan.fuzzy_spans(words)
    for notice, label in license_scan.NOTICES.items():
        assert sorted(x for x in got if x[0] == label and x[4] == len(notice)) == _exhaustive(words, notice, label)


def test_time_is_in_proportion_to_the_places():
    took = []
    for times in (1600, 6400):
        began = time.process_time()
        assert len(license_scan.fuzzy_spans(("releasd under the mit license " * times).strip())) == times
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2 and took[1] < 4


def test_notices_before_a_better_one_are_found():
    text = "licensxd undxr cc by nc 4 0 licensed under cc by nc 4 0 licensedd under cc by nc 4 0"
    got = [x for x in license_scan.fuzzy_spans(text) if x[0] == "cc-by-nc"]
    assert len(got) == 3 and got[0][3] == 2 and got[1][3] == 0 and [x[1] for x in got] == sorted(x[1] for x in got)
