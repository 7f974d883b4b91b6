"""Shapley values, staged stops, folds, hazards and the next-state report, each against direct computation."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from panelwright.operators import hazard, metrics, models, review, survival, trees
from panelwright.plans import modelling
from panelwright.sources.session import saved
from panelwright.sources.tables import Tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    out = []
    for i in range(700):
        a, b, c = rng.standard_normal(), rng.integers(0, 4), "uvw"[rng.integers(3)]
        y = int(rng.random() < 1 / (1 + math.exp(-(1.4 * a - b + 1 + (c == "u")))))
        out.append((i, float(a), float(b), c, y, "train" if i < 400 else "valid" if i < 600 else "test", "ABCD"[int(b)], "ABCD"[min(3, int(b) + y)]))
    return spark.createDataFrame(out, "seq long, a double, b double, c string, y int, split string, current_status string, next_state string").cache()


def expectation(t, x, known, at=0):
    """A tree's value where features outside `known` go down both branches."""
    if t["left"][at] < 0:
        return t["value"][at]
    f, kids = t["feature"][at], (t["left"][at], t["right"][at])
    if f in known:
        left = t["goes_left"][at, int(x[f])] if t["categorical"][at] else x[f] <= t["cut"][at]
        return expectation(t, x, known, kids[0] if left else kids[1])
    return sum(t["count"][k] * expectation(t, x, known, k) for k in kids) / t["count"][at]


def test_shapley_values_equal_enumeration(spark, rows):
    shaped, prepared = models.prepared(rows, ["a", "b"], ["c"], "y")
    model = models.fit_prepared(prepared, "y", depth=3, rounds=6)[0]
    every = shaped.transform(models.typed(rows, ["a", "b"], ["c"]))
    got = {(r.seq, r.feature): r for r in trees.tree_attributions(every, model, ["a", "b", "c"], ["seq"]).collect()}
    table = trees.node_table(spark, model)
    for r in every.filter("seq % 47 = 0").select("seq", "features", "c").collect():
        x, total = r.features.toArray(), 0.0
        for i, name in enumerate("abc"):
            others, value = [j for j in range(3) if j != i], 0.0
            for k in range(3):
                for s in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(2 - k) / 6
                    value += w * sum(expectation(t, x, {*s, i}) - expectation(t, x, set(s)) for t in table)
            assert got[r.seq, name].contribution == pytest.approx(value, abs=1e-9)
            total += value
        assert total + got[r.seq, "a"].expected == pytest.approx(sum(expectation(t, x, {0, 1, 2}) for t in table), abs=1e-9)


def test_stop_at_the_round_that_brute_force_finds(rows):
    shaped, prepared = models.prepared(rows, ["a", "b"], ["c"], "y")
    train, valid, values = prepared.filter("split = 'train'"), prepared.filter("split = 'valid'"), []
    for k in range(1, 8):
        model = GBTClassifier(labelCol="y", weightCol="weight", maxDepth=2, maxIter=k, stepSize=0.1, subsamplingRate=0.8, seed=7, maxBins=64).fit(train)
        values.append(metrics.binary_metrics(model.transform(valid).withColumn("p", models.vector_to_array("rawPrediction")[1]), "y").first()["average_precision"])
    model, chosen, ap = models.fit_prepared(prepared, "y", depth=2, rounds=7, patience=3)
    assert chosen == trees.best_round(values, 3) == model.getNumTrees and ap == pytest.approx(values[chosen - 1], abs=1e-9)
    assert trees.best_round([0.1, 0.3, 0.3, 0.2, 0.4], 2) == 2 and trees.best_round([0.1, 0.3, 0.3, 0.2, 0.4], 3) == 5 and trees.best_round([None, None], 1) == 1
    best, trace = models.grid_search(rows, ["a", "b"], ["c"], "y", [{"depth": 1, "rounds": 2}, {"depth": 3, "rounds": 4, "step": 0.2}])
    assert len(trace) == 2 and all(1 <= t["chosen_rounds"] <= 4 for t in trace) and best.stages[-1].getNumTrees == max(trace, key=lambda t: t["average_precision"])["chosen_rounds"]


def test_folds_are_stratified(rows):
    got = models.stratified_folds(rows, "y", ["seq"], 3).groupBy("y", "_f").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in got if r.y == y]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


def test_one_vs_rest_and_log_loss(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.dirichlet([1, 1, 1], 300), 2)
    y = rng.choice(list("xyz"), 300, p=[0.5, 0.3, 0.2])
    df = spark.createDataFrame([(str(c), [float(v) for v in q], "x") for c, q in zip(y, p)], "y string, s array<double>, h string")
    area = {}
    for k, c in enumerate("xyz"):
        own, rest = p[y == c, k], p[y != c, k]
        area[c] = ((own[:, None] > rest).sum() + (own[:, None] == rest).sum() / 2) / (len(own) * len(rest))
    got = {r["class"]: r.roc_auc for r in metrics.one_vs_rest(df, "y", "s", ["x", "y", "z"]).collect()}
    assert got == pytest.approx(area, abs=1e-12)
    row = metrics.multiclass_metrics(df, "y", "h", "s", ["x", "y", "z"]).first()
    own = np.clip(p[np.arange(300), [list("xyz").index(c) for c in y]], 2.0**-52, 1 - 2.0**-52)
    assert row.macro_roc_auc == pytest.approx(np.mean(list(area.values()))) and row.log_loss == pytest.approx(-np.log(own).mean())


def test_next_state_report(rows):
    model, report = models.next_state_report(rows, ["a", "b"], trees=10)
    got = {(r.split, r.model): r for r in report.collect()}
    assert len(got) == 8 and sum(r.chosen for r in got.values()) == 2
    chosen = next(r.model for r in got.values() if r.chosen)
    assert got["valid", chosen].macro_f1 == max(got["valid", m].macro_f1 for m in ("forest", "forest, balanced"))
    pdf = rows.toPandas()
    test = pdf[pdf.split == "test"]
    assert got["test", "persistence"].accuracy == pytest.approx((test.current_status == test.next_state).mean()) and got["test", "persistence"].log_loss is None
    train, classes = pdf[pdf.split == "train"], sorted(pdf[pdf.split == "train"].next_state.unique())
    loss = [-math.log(((train[(train.current_status == s)].next_state == n).sum() + 0.5) / ((train.current_status == s).sum() + 0.5 * len(classes))) for s, n in zip(test.current_status, test.next_state)]
    assert got["test", "transitions"].log_loss == pytest.approx(np.mean(loss))


def test_unseen_states_take_the_shares_of_all(spark):
    train = spark.createDataFrame([("A", "B"), ("A", "B"), ("A", "C"), (None, "B")], "current_status string, next_state string")
    out, classes = models.markov_scores(train, spark.createDataFrame([("A",), ("Z",), (None,)], "current_status string"))
    got = {r.current_status: (r.scores, r.said) for r in out.collect()}
    assert classes == ["B", "C"] and got["A"] == ([2.5 / 4, 1.5 / 4], "B") and got["Z"] == ([3 / 5, 2 / 5], "B") == got[None]


def test_hazards_and_robust_errors(spark):
    rng = np.random.default_rng(7)
    n, ridge = 200, 0.05
    x = np.column_stack([rng.standard_normal(n), rng.integers(0, 2, n)])
    entry, span = rng.integers(0, 10, n), np.ceil(rng.exponential(12 * np.exp(-0.5 * x[:, 0]))).astype(int)
    out, d, who = entry + np.maximum(1, np.minimum(span, 25)), (span <= 25).astype(int), rng.integers(0, 120, n)
    df = spark.createDataFrame([(int(w), int(a), float(b), int(e), float(u), float(v), i % 4 > 0) for i, (w, a, b, e, (u, v)) in enumerate(zip(who, entry, out, d, x))], "entity_id int, entry_age int, exit_age double, event_default int, u double, v double, t boolean")
    got = {r.covariate: r for r in hazard.cox_report(df, ["u", "v"], fit_on="t", ridge=ridge).collect()}
    t = np.arange(n) % 4 > 0
    z = (x[t] - x[t].mean(0)) / x[t].std(0)
    a, b, e, w = entry[t], out[t], d[t], who[t]
    beta, penalty = np.zeros(2), ridge * len(np.unique(b))
    for _ in range(30):
        r = np.exp(z @ beta)
        g, h = -penalty * beta, penalty * np.eye(2)
        for age in np.unique(b[e == 1]):
            at = (a < age) & (b >= age)
            m = (r[at, None] * z[at]).sum(0) / r[at].sum()
            s = (r[at, None, None] * z[at][:, :, None] * z[at][:, None, :]).sum(0) / r[at].sum()
            dead = (b == age) & (e == 1)
            g, h = g + z[dead].sum(0) - dead.sum() * m, h + dead.sum() * (s - np.outer(m, m))
        beta = beta + np.linalg.solve(h, g)
    r, u = np.exp(z @ beta), np.zeros_like(z)
    for age in np.unique(b[e == 1]):
        at = (a < age) & (b >= age)
        m, dead = (r[at, None] * z[at]).sum(0) / r[at].sum(), (b == age) & (e == 1)
        u[dead] += z[dead] - m
        u[at] -= r[at, None] * (z[at] - m) * dead.sum() / r[at].sum()
    by = np.array([u[w == k].sum(0) for k in np.unique(w)])
    se = np.sqrt(np.diag(np.linalg.inv(h) @ by.T @ by @ np.linalg.inv(h)))
    for i, c in enumerate("uv"):
        s = x[t, i].std()
        assert got[c].coef == pytest.approx(beta[i] / s, abs=1e-6) and got[c].se == pytest.approx(se[i] / s, abs=1e-6) and got[c].p == pytest.approx(math.erfc(abs(beta[i] / se[i]) / math.sqrt(2)), abs=1e-6)
    for name, part in (("train", t), ("test", ~t)):
        risk, pairs, right = ((x - x[t].mean(0)) / x[t].std(0)) @ beta, 0, 0.0
        for i in np.flatnonzero(part & (d == 1)):
            for j in np.flatnonzero(part & ((out > out[i]) | ((out == out[i]) & (d == 0)))):
                pairs, right = pairs + 1, right + (risk[j] < risk[i]) + (risk[j] == risk[i]) / 2
        assert got["u"][f"concordance_{name}"] == pytest.approx(right / pairs, abs=1e-9) and got["u"][f"n_{name}"] == part.sum()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_the_scorecard_keeps_its_contract(spark):
    card = saved(modelling.scorecard(Tables(spark, DATA)), "card")
    kinds = ["none", *[r[0] for r in card.select("predicted_exception_type").distinct().collect() if r[0] != "none"]]
    probabilities = ["prob_default_12m", "prob_delinquency_3m", "prob_delinquency_6m", "prob_prepayment_12m", "exception_probability", "next_state_confidence", "anomaly_score"]
    found = review.check_contract(card, "seq", probabilities, {"predicted_next_state": [*survival.STATES, "PaidOff"], "predicted_exception_type": kinds}, {"predicted_exception_type": ("exception_probability", 0.5, "none")}, ["entity_id", "recommended_action", "action_reason"], ["is_recommendation"])
    assert {r["check"]: r.violations for r in found.collect()} == dict.fromkeys([r["check"] for r in found.collect()], 0)
    order = card.select("prob_default_12m", "seq").collect()
    assert card.count() == card.select("entity_id").distinct().count() and len(order) == card.count()
    broken = card.withColumn("exception_probability", F.lit(0.1)).withColumn("predicted_exception_type", F.lit("dpd_breach")).withColumn("is_recommendation", F.lit(False))
    worse = {r["check"]: r.violations for r in review.check_contract(broken, "seq", [], {}, {"predicted_exception_type": ("exception_probability", 0.5, "none")}, [], ["is_recommendation"]).collect()}
    assert worse == {"repeated_keys": 0, "gate_predicted_exception_type": card.count(), "untrue_is_recommendation": card.count()}
