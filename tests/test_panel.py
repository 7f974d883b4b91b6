"""Panel operators: registered queries against DuckDB on the smallest tables, and small cases by hand."""

import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from panelwright.functions import columns as C
from panelwright.operators import clean, joins, metrics, models, profile, review, survival, textguard
from panelwright.plans import registry
from panelwright.sources import files
from panelwright.sources.tables import Tables
from panelwright.streaming import feed

DATA = "/root/testdata/sf0.001"
CHECKED = sorted(registry.oracle_sql())


def tidy(value):
    return repr(float(value)) if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool) else str(value)


def same(x, y):
    try:
        return x == y or math.isclose(float(x), float(y), abs_tol=2e-5)
    except ValueError:
        return False


def is_fraction(value):
    return isinstance(value, (float, decimal.Decimal)) and math.isfinite(value) and value != int(value)


def paired(ours, theirs):
    """Both tables' rows in one order: by the columns without fractions as text, then by those with fractions as numbers, so that a rounding does not change what stands side by side."""
    loose = [any(is_fraction(r[k]) for r in (*ours, *theirs)) for k in range(len((*ours, *theirs)[0]))] if ours or theirs else []
    number = lambda v: (v is None or isinstance(v, str), float(v) if isinstance(v, (int, float, decimal.Decimal)) else 0.0)
    key = lambda r: ([tidy(v) for v, x in zip(r, loose) if not x], [number(v) for v, x in zip(r, loose) if x])
    return zip(sorted(ours, key=key), sorted(theirs, key=key))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    got = registry.queries()[name](spark, DATA)
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    ours, theirs = [tuple(r[n] for n in names) for r in got.collect()], want.fetchall()
    assert len(ours) == len(theirs)
    # Sums in another order may fall on the other side of a rounding.
    assert [(x, y) for a, b in paired(ours, theirs) for x, y in zip(map(tidy, a), map(tidy, b)) if not same(x, y)] == []


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_bands_and_codes(spark):
    df = spark.createDataFrame([(579.0,), (580.0,), (None,), (9999.0,), (780.0,)], "x double")
    edges, labels = [580, 620, 660, 700, 740, 780], C.CREDIT_BANDS
    assert [r[0] for r in df.select(C.band("x", edges, labels, "left", (9999.0,))).collect()] == ["<580", "580-619", None, None, "780+"]
    assert [r[0] for r in df.select(C.bucket("x", [0, 580, 1000])).collect()] == [0, 0, None, None, 1]


def test_outcome_columns_are_refused():
    assert clean.assert_no_leakage(["age", "rate"]) == ["age", "rate"]
    for bad in ("next_state", "next_anything", "default_flag"):
        with pytest.raises(ValueError):
            clean.assert_no_leakage(["age", bad])
    with pytest.raises(ValueError):
        models.fit_logistic(None, ["next_state"], "y")


def test_latest_wins_prefers_unknown_times(spark):
    rows = [(1, "2024-01-01", 1), (1, None, 2), (2, "2024-01-01", 3), (2, "2024-01-01", 4)]
    got = joins.latest_wins(spark.createDataFrame(rows, "k int, ts string, n int"), ["k"], "ts", ["n"])
    assert sorted((r.k, r.n) for r in got.collect()) == [(1, 2), (2, 4)]


def test_metrics_by_hand(spark):
    same = spark.createDataFrame([(1, 0.5), (0, 0.5)] * 10, "y int, p double")
    row = metrics.binary_metrics(same).first()
    assert (row.roc_auc, row.ks) == (0.5, 0.0)
    perfect = metrics.binary_metrics(spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, p double")).first()
    assert (perfect.roc_auc, perfect.average_precision) == (1.0, 1.0)
    assert metrics.binary_metrics(spark.createDataFrame([(1, 0.9)], "y int, p double")).first().roc_auc is None


def test_lift_ranks_ties_without_one_window(spark, capsys):
    df = spark.createDataFrame([(i % 2, 0.5 if i else 0.9, i) for i in range(10)], "y int, p double, k int")
    out = metrics.lift_at_k(df, 0.4, ["k"])
    assert (out.first().rows, out.first().rate) == (4, 0.5)  # k = 0, then 1, 2, 3
    assert metrics.lift_at_k(df, 1.0, ["k"]).first().rate == 0.5
    out.explain()
    assert "row_number" not in capsys.readouterr().out


def test_survival_by_hand(spark):
    rows = [(0, 1.0, 1, 0), (0, 2.0, 0, 1), (1, 3.0, 1, 0), (0, 3.0, 0, 0), (2, 4.0, 0, 0)]
    v = spark.createDataFrame(rows, "entry_age int, exit_age double, event_default int, event_prepay int")
    km = {r.age: r.survival for r in survival.kaplan_meier(v, "event_default", last_age=4).collect()}
    assert km[0.0] == 1 and math.isclose(km[1.0], 2 / 3) and math.isclose(km[3.0], 2 / 3 * 2 / 3)
    cif = {r.age: (r.cif_first, r.cif_second) for r in survival.cumulative_incidence(v).collect()}
    assert math.isclose(cif[1.0][0], 1 / 3) and math.isclose(cif[2.0][1], 2 / 3 * 1 / 3) and all(a + b <= 1 for a, b in cif.values())


def test_cox_finds_the_sign(spark):
    rows = [(0, float(5 + (i % 10) + 10 * (i % 2)), 1, float(i % 2)) for i in range(200)]
    v = spark.createDataFrame(rows, "entry_age int, exit_age double, event_default int, x double")
    assert models.fit_cox(v, ["x"])["x"] < -0.5


def test_isolation_forest_sees_the_outlier(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(400)] + [(1000, 500.0, 500.0), (1001, None, None)], "seq long, a double, b double")
    got = {r.seq: r.raw for r in review.isolation_forest(df, ["a", "b"], "seq", trees=20).collect()}
    assert len(got) == 402 and max(got, key=got.get) == 1000


def test_isolation_forest_is_fitted_on_training_rows(spark):
    rows = [(i, float(i % 10), 1) for i in range(300)] + [(1000 + i, 900.0 + i % 10, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, a double, train int")
    got = {r.seq: r.raw for r in review.isolation_forest(df, ["a"], "seq", trees=20, fit_on="train = 1").collect()}
    assert len(got) == 600 and min(got[1000 + i] for i in range(300)) >= max(got[i] for i in range(300))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_anomaly_columns_are_there(spark):
    from panelwright.plans import modelling

    got = modelling.QUERIES["m1_isolation_forest"](Tables(spark, DATA))
    assert len(modelling.ANOMALY) == 18 and got.count() > 0 and got.filter("raw is null or raw <= 0 or raw >= 1").count() == 0


def test_text_guard(spark):
    rows = ["The model estimate is 12.5%. Please review.", "It is 99 because of rates, likely.", "1. The draft says 1,250.", r"A model \frac{1}{2}", None]
    df = spark.createDataFrame([(t, 12.5, 1250.0) for t in rows], "t string, a double, b double")
    got = textguard.usefulness_check(textguard.grounding_check(df, "t", F.array("a", "b")), "t", []).collect()
    assert [r.grounded for r in got[:4]] == [True, False, True, False] and got[0].useful and not got[1].useful
    assert [r.n_ungrounded for r in got[:3]] == [0, 1, 0]


def test_full_text_guard(spark):
    rows = [
        (r"The delta is $-2 \times 10^{-5}$ against base. Recommendation.", "incomplete"), ("This loan will default. Model.", "incomplete"), ("The pack does not hold 5 of these.", "incomplete"),
        ("Draft: 0.5 of it. Reviewer to examine the document status.", "complete"), ("Model: the document status is fine; contact the servicer about 77.5.", "complete"), (r"x^{2} by the model", None), (None, None),
    ]
    df = spark.createDataFrame([(t, d, -2e-5, 0.5) for t, d in rows], "t string, document_status string, a double, b double")
    got = textguard.usefulness_check(textguard.grounding_check(df, "t", F.array("a", "b")), "t", ["document_status"]).collect()
    assert [r.latex for r in got] == [True, False, False, False, False, True, None]
    assert [r.n_ungrounded for r in got[:5]] == [0, 0, 0, 0, 1] and [r.n_numbers for r in got[:5]] == [1, 0, 0, 1, 1]
    assert got[1].causal and got[2].refusal and [r.grounded for r in got[:5]] == [False, False, True, True, False]
    assert got[3].null_advice == ["document_status"] and not got[3].useful and got[4].null_advice == [] and got[4].useful


def test_guard_marks_and_numbers(spark):
    rows = ["1. one 2\n 12) two 3.\n4.\n5 6.", "1234. x 1.\n        7. y\n         8. z", "a 3.", "$5 and $6", "cost $ and $5", "10^2 or 3 times 10^-2}", r"2\times10^{3} 5.10^2"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select(textguard.without_list_markers(F.col("t")).alias("w"), textguard.latex_flags(F.col("t")).alias("l"), textguard.normalise_latex(F.col("t")).alias("n")).collect()
    assert [r.w for r in got[:3]] == [" one 2\n two 3.\n\n5 6.", "1234. x 1.\n y\n         8. z", "a 3."]
    assert [r.l for r in got[2:]] == [False, True, False, False, True]
    assert got[5].n == "1e2 or 3e-2" and got[6].n == "2e3 5.10^2"


def test_files(spark, tmp_path):
    (tmp_path / "perf_2019.txt").write_text("A|1|x\nB||2\nC|bad|3\n")
    got = files.read_positional(spark, str(tmp_path / "perf_2019.txt"), ["id", "n", "z"], {"id": "string", "n": "int"}, {"n": 1})
    assert [(r.id, r.n, r.vintage) for r in got.collect()] == [("A", 1, "2019"), ("B", 1, "2019"), ("C", 1, "2019")]
    assert files.audit_layout(spark, str(tmp_path / "perf_2019.txt"), 3).first().bad_lines == 0
    files.write_table(spark.range(5).withColumn("p", F.col("id") % 2), str(tmp_path / "out"), partition_by=["p"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    (tmp_path / "s.csv").write_text("observation_date,value\n2024-01-01,.\n2024-01-02,3.5\n")
    assert [r.value for r in files.read_series(spark, str(tmp_path / "s.csv")).collect()] == [3.5]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, f"2024-01-{1 + i % 28:02d}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, ts string, n int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = feed.latest_records(stream, ["k"], ["ts", "n"], str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    got = feed.read_latest(spark, str(tmp_path / "out"), ["k"], ["ts", "n"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, feed.newest(df, ["k"], ["ts", "n"]).collect()))
    timed = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("at", F.to_timestamp("ts"))
    scores = feed.window_scores(feed.flagged(timed, {"odd": F.col("n") % 2 == 1}), "at", "odd")
    q = scores.writeStream.outputMode("complete").format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(rows), sum(violations) from scores").first() == (60, 30)
