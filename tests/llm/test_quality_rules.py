"""Quality rules: statistics against plain Python, estimates against numpy's concentration steps, odd tables."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.llm import quality_rules
from corpus_cases import frame, plain, prose


def counted(text):
    text = text or ""
    words = plain(text)
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    hit = {k for i, g in enumerate(grams) if often[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if plain(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_plain_python(spark, rows):
    texts = [t for _, t in rows] + ["a b c a b c", "x x x x", "x x x", "a\t b\x0bc\x0cd\re\n", "#*$%&|<>", "é ü ß   x", " lead and trail ", "l\nl\n l\n\n\nl", "€" * 50 + " 😀 " * 60, "one two three " * 3000]
    got = quality_rules.text_statistics(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [counted(t) for t in texts]
    assert [r.base_failed for r in got] == [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in map(counted, texts)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#", max_size=80), min_size=20, max_size=40))
def test_statistics_of_drawn_texts(spark, texts):
    got = quality_rules.text_statistics(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [counted(t) for t in texts]


def _least_determinant(z, share, factor, floor):
    """numpy: the best of many random starts and of all steps until nothing changes."""
    rng, best, h = np.random.default_rng(0), None, int(np.ceil(share * len(z)))
    for _ in range(60):
        near = z[rng.choice(len(z), 6, replace=False)]
        for _ in range(60):
            m, c = near.mean(axis=0), factor * np.cov(near.T, bias=True) + floor
            d = ((z - m) @ np.linalg.inv(c) * (z - m)).sum(axis=1)
            near = z[np.argsort(d)[:h]]
        value = np.linalg.slogdet(factor * np.cov(near.T, bias=True) + floor)[1]
        best = min(best, (value, near.mean(axis=0).tolist())) if best else (value, near.mean(axis=0).tolist())
    return best


def test_estimates_are_those_of_least_determinant(spark):
    rng = np.random.default_rng(5)
    mix = np.array([[1, 0, 0, 0], [0.6, 0.8, 0, 0], [-0.3, 0.2, 0.9, 0], [0.1, 0.1, 0.1, 1]])
    clean = rng.standard_normal((400, 4)) @ mix.T * 2 + 10
    odd = rng.standard_normal((90, 4)) * 0.3 + [18, 2, 17, 3]
    z = np.round(np.vstack([clean, odd]) * quality_rules.UNIT).astype(int)
    points = spark.createDataFrame([("g", *map(int, r), 1) for r in z] + [("alone", *map(int, z[0]), 1)], "g string, z0 long, z1 long, z2 long, z3 long, w long")
    floor = np.diag(np.square(quality_rules.FLOORS))
    shapes = quality_rules._starts(points)
    for _ in range(12):
        shapes = quality_rules.saved(quality_rules._concentrated(points, shapes), "t")
    found = shapes.filter("g = 'g'").orderBy("logdet").first()
    value, centre = _least_determinant(z / quality_rules.UNIT, quality_rules.SHARE, quality_rules._consistency(quality_rules.SHARE), floor)
    # The subset may be greater by what shares the last bucket of distances.
    assert abs(found.logdet - value) < 0.12 and np.abs(np.array([found.m0, found.m1, found.m2, found.m3]) - centre).max() < 0.15
    judged = points.join(quality_rules.robust_estimates(points).drop("n"), "g").filter("g = 'g'").select(quality_rules._distance().alias("d"), "z0", "z1").collect()
    far = {(r.z0, r.z1) for r in judged if r.d > quality_rules._chi2_quantile(quality_rules.CERTAIN, 4)}
    assert {(int(a), int(b)) for a, b in z[400:, :2]} <= far and len(far) <= 91


def test_rejects_junk_keeps_the_rest_without_python(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(i, int(rng.integers(50, 400)))) for i in range(200)] + [(i, prose(i, 120).replace(" ", "### ")) for i in range(200, 230)] + [(300, None), (301, ""), (302, "few words"), (None, prose(1, 60)), (None, prose(1, 60))]
    docs = frame(spark, rows).withColumns({"g": F.lit(1), "kept": F.lit("x"), "words": F.lit(2), "lang": F.when(F.col("doc_id") % 7 == 0, None).otherwise("en")})
    out = quality_rules.quality_verdicts(docs)
    assert "Python" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    got = out.collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.kept} == set(range(200)) | {None} and sum(r.kept for r in got) == 202
    assert all(r.distance is None for r in got if r.base_failed)


def test_empty_table_and_quantiles(spark, rows):
    assert quality_rules.quality_verdicts(frame(spark, rows).limit(0)).count() == 0
    assert quality_rules._chi2_quantile(0.95, 4) == pytest.approx(9.487729, abs=1e-6) and quality_rules._chi2_quantile(0.99, 6) == pytest.approx(16.811894, abs=1e-6)


def test_one_very_long_text(spark):
    rng = np.random.default_rng(9)
    text = " ".join(f"w{i}" for i in rng.integers(0, 60, 60_000)) + "\n" + "again and again\n" * 2000
    got = quality_rules.text_statistics(frame(spark, [(1, text), (2, "y" * 200_000)])).orderBy("doc_id").collect()
    assert (got[0].n_words, got[0].word_chars, got[0].n_symbols, got[0].n_dup_lines, got[0].n_repeat_words) == counted(text) and got[1].word_chars == 200_000
