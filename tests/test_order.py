"""What depends on an order over all rows: running totals and last known values in parts, as-of joins without a key, concordance without pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import concordance as K
from panelwright.operators import joins, prefix


@pytest.mark.parametrize("small", [0, 10_000])
def test_running_totals_small_and_in_parts(spark, small, monkeypatch):
    monkeypatch.setattr(prefix, "SMALL", small)
    rows = [([None, "a", "b"][i % 3], float(i * 7919 % 1009), i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = prefix.running_totals(df, "v", {"cum": "n"}, ["g"], descending=True).collect()
    assert len(got) == 600
    for r in got:
        assert r.cum == sum(n for g, v, n in rows if g == r.g and v >= r.v)


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_asof_without_a_key(spark, parts):
    rng = np.random.default_rng(parts or 0)
    left = [(i, int(rng.integers(0, 300))) for i in range(200)] + [(900, -5)]
    right = [(int(t), None if t % 4 == 0 else int(t) * 10, f"s{t}" if t % 3 else None) for t in rng.choice(300, 60, replace=False)]
    out = joins.asof_backward(spark.createDataFrame(left, "id int, t int"), spark.createDataFrame(right, "t int, a int, b string"), "t", ["a", "b"], parts=parts)
    got = {r.id: (r.a, r.b) for r in out.collect()}
    for i, t in left:
        before = sorted(r for r in right if r[0] <= t)
        assert got[i] == (next((r[1] for r in reversed(before) if r[1] is not None), None), next((r[2] for r in reversed(before) if r[2] is not None), None))
    if parts:
        plan = out._jdf.queryExecution().executedPlan().toString()
        # Only what each part hands on, a row a part, comes together in one place.
        assert all("Aggregate(key=[_part" in x[:200] for x in plan.split("Exchange SinglePartition")[1:])


def brute(rows):
    pairs = right = 0
    for t, x, e in rows:
        for t2, x2, e2 in rows:
            if e and (t2 > t or (t2 == t and not e2)):
                pairs += 1
                right += (x2 < x) + (x2 == x) / 2
    return pairs, right / pairs if pairs else None


@pytest.mark.parametrize("block_rows", [100_000, 40, 7])
@pytest.mark.parametrize("kind", ["mixed", "one time", "one risk", "whole", "no events"])
def test_concordance_equals_pairs(spark, block_rows, kind):
    rng = np.random.default_rng(len(kind))
    n = 250
    t = {"mixed": rng.choice([5.0, 5.5, 9.25], n) + (rng.random(n) < 0.5) * np.round(rng.random(n) * 9, 2), "one time": np.full(n, 3.0)}.get(kind, np.round(rng.random(n) * 40))
    x = np.full(n, 1.5) if kind == "one risk" else np.round(rng.standard_normal(n), 1)
    e = np.zeros(n, int) if kind == "no events" else (rng.random(n) < 0.4).astype(int)
    rows = list(zip(t.tolist(), x.tolist(), e.tolist()))
    df = spark.createDataFrame([*rows, (None, 1.0, 1), (1.0, None, 1), (2.0, 1.0, None)], "t double, x double, e int")
    got = K.concordance(df, "t", "e", "x", block_rows).first()
    pairs, share = brute(rows)
    assert got.pairs == pairs and (got.concordance == pytest.approx(share, abs=1e-12) if pairs else got.concordance is None)


def test_concordance_of_a_million_continuous_times(spark):
    df = spark.range(1_000_000).select((F.rand(1) * 1000 + F.col("id") / 1e9).alias("t"), F.rand(2).alias("x0"), (F.rand(3) < 0.3).cast("int").alias("e")).withColumn("x", F.col("x0") - F.col("t") / 2000)
    df = df.select("t", "e", "x").cache()
    got = K.concordance(df, "t", "e", "x")
    assert "BroadcastNestedLoopJoin Inner" not in got._jdf.queryExecution().executedPlan().toString()
    row = got.first()
    pdf = df.toPandas()
    t, e = pdf.t.to_numpy(), pdf.e.to_numpy()
    later = np.arange(len(t))[::-1]
    pairs = int(e[np.argsort(t)] @ later)
    assert row.pairs == pairs
    assert row.concordance == pytest.approx(K.right_pairs(t, pdf.x.to_numpy(), np.ones(len(t)), e) / pairs, abs=1e-12)
    df.unpersist()
