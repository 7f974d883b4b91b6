"""Exact quantiles against numpy, the order of the longs, and plans without a buffer of all values."""

import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.operators import metrics, profile, quantiles, review

SHARES = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.94, 0.995, 1.0]


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x) + 0.0))[0]
    return -n if x < 0 else n


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=50, max_size=200))
def test_longs_order_as_doubles_do(spark, drawn):
    edges = [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf")] + [float(2.0**k) for k in range(-1074, 1024, 7)] + [float(np.nextafter(2.0**k, 0)) for k in range(-1021, 1024, 5)]
    df = spark.createDataFrame([(x,) for x in drawn + edges], "x double")
    k = quantiles.ordered_long(F.col("x"))
    for r in df.select("x", k.alias("k"), quantiles._double(k).alias("y")).collect():
        assert r.k == bits(r.x) and r.y == r.x


@pytest.mark.parametrize("few", [3, 1 << 20])
def test_groups_ties_nulls_and_weights(spark, few, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW_ROWS", few)
    rng = np.random.default_rng(few)
    x = np.concatenate([rng.lognormal(3, 4, 4000), np.zeros(3000), -rng.random(500) * 1e-9, rng.integers(0, 5, 2500).astype(float)])
    rows = [([None, "a", "b"][i % 3], None if i % 17 == 0 else float(v), i % 4) for i, v in enumerate(x)] + [("empty", None, 1), ("one", 7.5, 1)]
    df = spark.createDataFrame(rows, "g string, x double, w int")
    pdf = pd.DataFrame(rows, columns=["g", "x", "w"])
    for weight in (None, "w"):
        got = {r.g: r for r in quantiles.exact_quantiles(df, "x", SHARES, ["g"], weight).collect()}
        assert set(got) == {None, "a", "b", "one"}
        for g, r in got.items():
            part = pdf[pdf.g.isna() if g is None else pdf.g == g].dropna(subset="x")
            values = np.repeat(part.x, part.w) if weight else part.x
            assert r.n == len(values) and np.allclose(r.q, np.quantile(values, SHARES), rtol=1e-12, atol=0)


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert quantiles.exact_quantiles(none, "x", [0.5], ["g"]).count() == 0
    assert quantiles.exact_quantiles(none, "x", [0.5]).first().q == [None]


def test_two_million_distinct_values_without_a_buffer(spark):
    df = spark.range(2_000_000).select(((F.col("id") * 7919 % 2_000_003).cast("double") / 7).alias("x"), F.lit(1).alias("y"), F.lit("g").alias("g"))
    values = np.arange(2_000_000) * 7919 % 2_000_003 / 7
    got = quantiles.exact_quantiles(df, "x", SHARES).first()
    assert np.allclose(got.q, np.quantile(values, SHARES), rtol=1e-12)
    for out in (profile.profile_numeric(df, ["x"]), metrics.calibration_table(df, y="y", p="x"), review.rescale(df, "x", "s"), review.robust_drivers(df.limit(50), ["x"]), review.anomaly_by(df.withColumn("probability", F.lit(0.5)), "g", "x")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan.lower() and "median" not in plan.lower()
