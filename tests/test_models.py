"""Fitted models, trees, forests, scenarios and packs against direct computation on small frames."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import labels, models, packs, prefix, profile, review, scenarios, textguard, trees
from panelwright.sources.session import ship_package


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    out = []
    for i in range(900):
        a, b, c = rng.normal(), rng.normal(), "uvw"[int(rng.integers(3))]
        y = int(rng.random() < 1 / (1 + math.exp(-(1.5 * a - b + (c == "u")))))
        out.append((i, float(a), None if i % 50 == 0 else float(b), c, y, "train" if i < 500 else "valid" if i < 700 else "test", "pqr"[int(a > 0) + int(b > 0)]))
    return spark.createDataFrame(out, "seq long, a double, b double, c string, y int, split string, kind string").cache()


@pytest.fixture(scope="module")
def boosted(rows):
    return models.fit_gbt(rows, ["a", "b"], ["c"], "y", depth=3, rounds=8)


def test_logistic_equals_newton(rows):
    model = models.fit_logistic(rows, ["a", "b"], "y", reg=0.01)
    got = {r.seq: r.p for r in models.score(model, rows, "p", ["a", "b"]).collect()}
    data = rows.toPandas()
    train = data[data.split == "train"]
    med = train[["a", "b"]].median()
    x = train[["a", "b"]].fillna(med)
    mean, std = x.mean(), x.std()
    z, y = ((x - mean) / std).to_numpy(), train.y.to_numpy()
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    beta, x1 = np.zeros(3), np.column_stack([z, np.ones(len(z))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ beta))
        g = x1.T @ (w * (p - y)) / w.sum() + 0.01 * np.append(beta[:2], 0)
        h = (x1 * (w * p * (1 - p))[:, None]).T @ x1 / w.sum() + 0.01 * np.diag([1, 1, 0])
        beta = beta - np.linalg.solve(h, g)
    every = ((data[["a", "b"]].fillna(med) - mean) / std).to_numpy()
    want = 1 / (1 + np.exp(-(np.column_stack([every, np.ones(len(every))]) @ beta)))
    assert max(abs(got[i] - p) for i, p in zip(data.seq, want)) < 2e-3


def test_score_keeps_the_columns(rows, boosted):
    out = models.score(boosted, rows, "p", ["a", "b"], ["c"])
    assert out.columns == [*rows.columns, "p"] and out.filter("p between 1e-6 and 1 - 1e-6").count() == 900


@pytest.mark.parametrize("kind", ["isotonic", "platt"])
def test_calibration_is_monotone_and_fits(rows, boosted, kind):
    out = models.score(boosted, rows, "p", ["a", "b"], ["c"])
    valid = out.filter("split = 'valid'")
    got = models.calibrated(valid, out, "y", kind=kind).select("seq", "split", "p", "p_cal", "y").toPandas().sort_values(["p", "p_cal"])
    assert (np.diff(got.p_cal) >= -1e-9).all() and got.p_cal.between(0, 1).all()
    own = got[got.split == "valid"]
    assert abs(own.p_cal.mean() - own.y.mean()) < 0.02
    if kind == "isotonic":  # pool adjacent violators
        blocks = []
        for p, part in own.groupby("p"):
            blocks.append([part.y.sum(), len(part), [p]])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, n, ps = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ps]
        want = {p: s / n for s, n, ps in blocks for p in ps}
        assert max(abs(want[p] - q) for p, q in zip(own.p, own.p_cal)) < 1e-6


def test_choose_calibrator_and_grid(rows, boosted):
    out = models.score(boosted, rows, "p", ["a", "b"], ["c"])
    assert models.choose_calibrator(out.filter("split = 'valid'"), "y") in ("isotonic", "platt")
    assert models.choose_calibrator(out.filter("split = 'valid' and y = 1"), "y") == "platt"
    model, trace = models.grid_search(rows, ["a", "b"], ["c"], "y", [{"depth": 1, "rounds": 1}, {"depth": 3, "rounds": 5}])
    assert len(trace) == 2 and trace[1]["average_precision"] >= trace[0]["average_precision"] and model.stages[-1].getNumTrees >= 1


def test_contributions_add_up_to_the_log_odds(rows, boosted):
    shaped, model = boosted.stages[0].transform(models.typed(rows, ["a", "b"], ["c"])), boosted.stages[-1]
    attr = trees.tree_attributions(shaped, model, ["a", "b", "c"], ["seq"]).groupBy("seq").agg(F.sum("contribution").alias("s"), F.first("expected").alias("e"), F.count("*").alias("n"))
    p = models.score(boosted, rows, "p", ["a", "b"], ["c"]).select("seq", "p")
    got = attr.join(p, "seq").toPandas()
    assert len(got) == 900 and (got.n == 3).all()
    assert np.abs(got.s + got.e - np.log(got.p / (1 - got.p))).max() < 1e-6


def test_staged_spread_by_hand(spark, rows, boosted):
    shaped, model = boosted.stages[0].transform(models.typed(rows, ["a", "b"], ["c"])), boosted.stages[-1]
    got = trees.staged_spread(shaped, model, ["seq"], stages=100).toPandas().set_index("seq")
    features = {r.seq: r.features for r in shaped.limit(20).select("seq", "features").collect()}
    for seq, x in features.items():
        sums = np.cumsum([w * t.predict(x) for t, w in zip(model.trees, model.treeWeights)])
        p = 1 / (1 + np.exp(-2 * sums))
        assert np.allclose(got.loc[seq, ["staged_mean", "staged_std", "staged_p10", "staged_p90"]], [p.mean(), p.std(), np.quantile(p, 0.1), np.quantile(p, 0.9)])


def test_exception_types_beat_the_majority(rows):
    flagged = rows.withColumn("exception_required", F.lit(1)).withColumnRenamed("kind", "exception_type")
    _, report = models.exception_type_report(flagged, ["a", "b"])
    got = {(r.split, r.model): r for r in report.collect()}
    test = flagged.filter("split = 'test'").toPandas()
    most = flagged.filter("split = 'train'").toPandas().exception_type.mode()[0]
    assert abs(got["test", "majority"].accuracy - (test.exception_type == most).mean()) < 1e-9
    assert got["test", "forest"].accuracy > got["test", "majority"].accuracy + 0.2


def test_late_training_end_never_enters_the_embargo(spark):
    df = spark.createDataFrame([(1, m, 1.0) for m in range(80)], "entity_id int, month_index int, y double")
    plain = {r.month_index: r.split for r in labels.purged_split(df, "y", 12).collect()}
    assert {r.month_index: r.split for r in labels.purged_split(df, "y", 12, train_end=79).collect()} == plain
    early = {r.month_index: r.split for r in labels.purged_split(df, "y", 12, train_end=20).collect()}
    assert max(m for m, s in early.items() if s == "train") == 20 and min(m for m, s in early.items() if s == "valid") == 21
    assert max(m for m, s in early.items() if s == "valid") == max(m for m, s in plain.items() if s == "valid")
    gap = min(m for m, s in plain.items() if s == "test") - max(m for m, s in plain.items() if s == "valid")
    assert gap > 12 and {m for m, s in early.items() if s == "test"} == {m for m, s in plain.items() if s == "test"}


def test_dependencies_leave_out_groups_without_a_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", None), (None, 5)], "g string, v int")
    row = profile.functional_dependencies(df, [("g", "v")]).first()
    assert (row.groups, row.violations, row.holds, row.rate) == (2, 1, False, 0.5)


def test_drivers_take_medians_of_the_rows_to_fit_on(spark):
    df = spark.createDataFrame([(i, float(i % 3), 1.0, i < 30) for i in range(30)] + [(99, 100.0, 1.0, False), (98, 1.0, 7.0, False)], "seq int, x double, y double, fit boolean")
    got = {r.seq: r.drivers for r in review.robust_drivers(df, ["x", "y"], 1, "fit").collect()}
    assert got[99] == ["x"] and got[98] == ["y"]


def test_forest_finds_outliers_and_ignores_rows_not_fitted_on(spark):
    ship_package(spark)
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), True) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000 + i, 9.0, -9.0, False) for i in range(3)] + [(2000, None, 0.0, False)]
    df = spark.createDataFrame(rows, "seq long, x double, y double, fit boolean")
    got = review.isolation_forest(df, ["x", "y"], "seq", trees=60, fit_on="fit").toPandas().sort_values("raw", ascending=False)
    assert set(got.seq.head(3)) == {1000, 1001, 1002} and len(got) == 404 and got.raw.between(0, 1).all()


@pytest.mark.parametrize("parts, descending", [(1, False), (4, True), (7, False)])
def test_running_totals_equal_a_sort(spark, parts, descending):
    rng = np.random.default_rng(5)
    values = sorted({round(float(v), 3) for v in rng.normal(size=300)})
    data = [(g, v, int(rng.integers(5))) for g in ("a", None) for v in values]
    got = prefix.running_totals(spark.createDataFrame(data, "g string, v double, n int"), "v", {"cum": "n"}, ["g"], descending, parts).collect()
    want = {}
    for g in ("a", None):
        total = 0
        for _, v, n in sorted((x for x in data if x[0] == g), key=lambda x: x[1], reverse=descending):
            total += n
            want[g, v] = total
    assert {(r.g, r.v): r.cum for r in got} == want and len(got) == len(data)


def test_macro_fit_equals_least_squares(spark):
    rng = np.random.default_rng(7)
    months = [(100 + k, float(rng.normal()), float(rng.normal())) for k in range(40)]
    macro = spark.createDataFrame(months, "pno int, unemployment_rate double, hpi_yoy_growth double")
    rates, x, y, w = [], [], [], []
    for pno, u, h in months:
        r, n = float(rng.normal()), int(rng.integers(25, 90))
        p = 1 / (1 + math.exp(-(0.3 * u - 0.7 * h + 0.2 * r - 1 + 0.1 * rng.normal())))
        rates.append(("Current", pno, n, p, 0.2, r))
        x.append([1, u, h, r])
        y.append(math.log(p / (1 - p)))
        w.append(n)
    fit = scenarios.macro_transition_fit(spark.createDataFrame(rates, "current_status string, pno int, n int, deteriorate double, prepay double, rate_incentive double"), macro)
    got = {r.kind: r for r in fit.collect()}
    x, y, w = np.array(x), np.array(y), np.sqrt(np.array(w, float))
    beta = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
    one = got["deteriorate"]
    assert np.allclose([one.intercept, one.unemployment_rate, one.hpi_yoy_growth, one.rate_incentive], beta, atol=1e-6) and one.months == 40
    assert abs(got["prepay"].intercept - math.log(0.25)) < 1e-6 and got["prepay"].r2 is None
    scen = scenarios.build_scenarios(macro.withColumn("market_mortgage_rate", F.lit(5.0)))
    shifts = scenarios.fitted_shifts(fit, scen, macro.withColumn("market_mortgage_rate", F.lit(5.0)), "adverse_credit")
    # Scenario paths are rounded, so the shifts are as exact as those.
    assert abs(shifts["Current"][0] - (3 * beta[1] - 0.1 * beta[2])) < 1e-3 and set(shifts) == {"Current"}


def test_engines_side_by_side(spark):
    scores = spark.createDataFrame([("base", 0.1, 0.0, 0.0), ("bad", 0.3, 0.2, 2.0)], "scenario_name string, mean_score double, delta double, relative double")
    paths = [("base", 12, "Default", 0.1), ("base", 12, "DQ30", 0.2), ("base", 11, "Default", 9.0), ("bad", 12, "Default", 0.25), ("bad", 12, "Prepaid", 0.3)]
    got = {r.scenario_name: r for r in scenarios.compare_engines(scores, spark.createDataFrame(paths, "scenario_name string, horizon_month int, state string, share double")).collect()}
    assert math.isclose(got["bad"].delta_defaulted, 0.15) and math.isclose(got["bad"].delta_delinquent, -0.2) and math.isclose(got["bad"].prepaid, 0.3) and got["base"].delta_defaulted == 0 and got["bad"].engine_a_delta == 0.2


def test_packs_and_their_numbers(spark):
    df = spark.createDataFrame([(7, "2001-02", "rate of 12.5% at 1,200", 3.14159, float("nan"), True)], "entity_id long, reporting_month string, note string, p double, q double, b boolean")
    out = packs.build_pack(df, ["p", "q"], "note", facts={"reporting_month": None, "note": None})
    pack = json.loads(out.select(F.to_json("pack")).first()[0])
    assert pack["record"]["entity_id"].startswith("LN-") and pack["model_predictions"] == {"p": 3.1416} and pack["top_drivers"].startswith("rate")
    numbers = set(out.select(packs.pack_numbers(out, "pack")).first()[0])
    assert {3.1416, 314.16, 3.0, 3.14, 12.5, 1250.0, 0.125, 1200.0, 12.0} <= numbers and not any(math.isnan(x) for x in numbers)
    rows = spark.range(20).select("id", (F.col("id") * 2).alias("twice"))
    lists = packs.build_list_pack({"top": rows, "low": rows}, {"top": [F.desc("id")], "low": [F.asc("id")]}, 3)
    one = lists.first()
    assert [r.id for r in one.top] == [19, 18, 17] and [r.twice for r in one.low] == [0, 2, 4]
    nested = lists.select(F.struct("top", "low").alias("pack"))
    assert {19.0, 38.0, 1900.0, 0.0, 4.0} <= set(nested.select(packs.pack_numbers(nested, "pack")).first()[0])


def test_guard_summary(spark):
    df = spark.createDataFrame([("the model suggests a review of 12.", 12.0), ("this will default, review 99", 12.0), (None, 1.0)], "text string, v double")
    guarded = textguard.usefulness_check(textguard.grounding_check(df, "text", F.array("v")), "text", [])
    row = textguard.summarise(guarded).first()
    assert (row["rows"], row.passed, row.blocked, row.causal, row.ungrounded_numbers, row.null_advice, row.pass_rate) == (3, 1, 2, 1, 1, 0, 0.3333)
