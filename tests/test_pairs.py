"""Statistics of pairs of columns in one pass: against direct computation, and as many exchanges whatever the number of columns."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import labels, profile


def tail(x, df):
    """By the recurrence over two degrees, in exact order of terms."""
    h = x / 2
    a, out = (0.5, math.erfc(math.sqrt(h))) if df % 2 else (1.0, math.exp(-h))
    while a < df / 2:
        out += math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if h else 0.0
        a += 1
    return min(1.0, out)


def test_chi_square_tail(spark):
    cases = [(x, df) for x in (0.0, 1e-9, 0.3, 3.841458820694124, 12.4, 12.6, 18.307038053275146, 90.0, 800.0, 1600.0) for df in (1, 2, 3, 4, 7, 10, 24, 25, 401, 1500)] + [(5.0, 0)]
    got = spark.createDataFrame(cases, "x double, df int").withColumn("p", profile.chi2_tail(F.col("x"), F.col("df"))).collect()
    for r in got[:-1]:
        assert r.p == pytest.approx(tail(r.x, r.df), rel=1e-8, abs=1e-12)
    assert got[-1].p is None and abs(tail(18.307038053275146, 10) - 0.05) < 1e-9


def frame(spark, n=800):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.choice(["x", "y"], n), "b": rng.choice(["p", "q"], n), "c": rng.choice(list("klmn"), n), "d": rng.integers(0, 6, n).astype(float), "e": np.round(rng.standard_normal(n), 1), "i": np.arange(n)})
    pdf["f"] = np.where(rng.random(n) < 0.7, pdf.d * 2 + rng.integers(0, 3, n), np.nan)
    pdf.loc[::7, "c"] = None
    pdf.loc[pdf.a == "x", "b"] = np.where(rng.random((pdf.a == "x").sum()) < 0.7, "p", "q")
    df = spark.createDataFrame(pdf).withColumn("f", F.when(~F.isnan("f"), F.col("f")))
    return pdf, df


def chi2(a, b):
    known = a.notna() & b.notna()
    o = pd.crosstab(a[known], b[known]).to_numpy().astype(float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    gap = np.abs(o - e)
    if o.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    return (gap**2 / e).sum(), o.sum(), *o.shape


def test_tables_of_pairs(spark):
    pdf, df = frame(spark)
    pairs = list(itertools.combinations("abcd", 2))
    got = {r._p: r for r in profile.contingencies(df, pairs).collect()}
    for k, (a, b) in enumerate(pairs):
        x, n, r, c = chi2(pdf[a], pdf[b])
        assert (got[k].n, got[k].r, got[k].c) == (n, r, c) and got[k].chi2 == pytest.approx(x, rel=1e-9)
    gaps = profile.missingness_tests(df, [("a", "c"), ("d", "f"), ("a", "b")]).collect()
    assert [(r.by, r["column"]) for r in sorted(gaps, key=lambda r: r.column)] == [("a", "b"), ("a", "c"), ("d", "f")]
    for r in gaps:
        x, n, *_ = chi2(pdf[r.by], pdf[r["column"]].isna())
        assert r.n == n and r.chi2 == pytest.approx(x, rel=1e-9, abs=1e-9)
        assert r.verdict == ("does not vary" if r["column"] == "b" else "at random") and (r.p is None or r.p == pytest.approx(tail(x, r.df), rel=1e-8))


def test_ranks_of_pairs(spark):
    pdf, df = frame(spark)
    for r in profile.spearman(df, ["d", "e", "f", "i"]).collect():
        assert r.rho == pytest.approx(pdf[[r.a, r.b]].dropna().corr(method="spearman").iloc[0, 1], abs=1e-9)


def test_exchanges_do_not_grow_with_columns(spark):
    _, df = frame(spark, 60)
    wide = df.select("*", *[F.col("d").alias(f"d{k}") for k in range(6)])
    for make in (lambda x, c: profile.contingencies(x, list(itertools.combinations(c, 2))), profile.spearman, lambda x, c: profile.functional_dependencies(x, list(itertools.permutations(c, 2)))):
        few, many = (make(wide, c)._jdf.queryExecution().executedPlan().toString().count("Exchange ") for c in (["d", "e"], ["d", "e", "f", *[f"d{k}" for k in range(6)]]))
        assert few == many <= 12


def test_summary_of_splits(spark):
    rows = [(1, 1, "train", 1), (1, 2, "test", 0), (2, 3, "test", None), (None, 4, "train", 1), (None, 5, "test", 1), (3, 1, "valid", 0), (3, 2, "train", 1)]
    got = {r.split: tuple(r)[1:] for r in labels.split_summary(spark.createDataFrame(rows, "entity_id int, month_index int, split string, y int"), "y").collect()}
    assert got == {"train": (3, 1.0, 2, 1, 4, 2), "test": (3, 0.5, 2, 2, 5, 1), "valid": (1, 0.0, 1, 1, 1, 1)}
