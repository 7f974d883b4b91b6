"""The frames that fitted queries read are one line from the tables."""

import re

import pytest
from pyspark.sql import functions as F

from panelwright.operators import joins, rules
from panelwright.operators import features as X
from panelwright.operators import labels as L
from panelwright.plans import decisions, modelling
from panelwright.plans.panel import EXITS, featured
from panelwright.plans.quality import reconciled, scored
from panelwright.sources.tables import Tables

DATA = "/root/testdata/sf0.01"


def scans(df, column):
    """How often the plan reads a table that has the column."""
    return len(re.findall(rf"Scan parquet [^\n]*\[[^\]\n]*{column}", df._jdf.queryExecution().executedPlan().toString()))


def test_the_modelled_frame_reads_each_table_once_for_each_use(spark):
    got = modelling.labelled(Tables(spark, DATA))
    # The feed and the macro series.
    assert scans(got, "l_orderkey") == 2
    assert "exception_type" in got.columns and not set(rules.PRIORITY) & set(got.columns)


def test_the_modelled_frame_equals_its_parts_joined(spark):
    t = Tables(spark, DATA)
    breaches = rules.resolve_priority(rules.breach_flags(reconciled(t))).select("seq", "exception_type", "exception_required")
    rows = L.attach_targets(X.build_features(joins.attach_macro(scored(t), t.macro())), EXITS)
    want = joins.attach_scores(L.purged_split(rows, modelling.TARGET, 12), breaches, ["seq"])
    got = modelling.labelled(t)
    assert sorted(got.columns) == sorted(want.columns)
    whole = lambda df: df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    assert whole(got) == whole(want)


@pytest.mark.parametrize("name", ["ranked"])
def test_ranked_records_are_written_once(spark, name):
    assert scans(getattr(decisions, name)(Tables(spark, DATA)), "l_orderkey") == 0


def test_the_modelled_frame_is_deduplicated_and_sorted_once(spark):
    plan = modelling.labelled(Tables(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "_island" not in plan
    # Partial and final, for the panel and for the feed.
    assert len(re.findall(r"WindowGroupLimit ", plan)) == 4


def test_streak_by_hand(spark):
    late = [0, 0, None, 1, 0, 0, 1, 1, 0]
    df = spark.createDataFrame([(1, m, x) for m, x in enumerate(late)] + [(2, 5, 1), (2, 7, 0), (3, 1, 0)], "entity_id int, month_index int, late int")
    got = {(r.entity_id, r.month_index): r.s for r in X.streak(df, "late", "s").collect()}
    assert [got[1, m] for m in range(9)] == [0, 1, 2, 0, 1, 2, 0, 0, 1] and (got[2, 5], got[2, 7], got[3, 1]) == (0, 1, 0)
    assert X.streak(df, "late", "s").schema["s"].dataType.simpleString() == "int"


def test_the_featured_frame_equals_the_one_with_the_feed(spark):
    t = Tables(spark, DATA)
    got, macro = modelling._featured_rows(t)
    want = L.purged_split(L.attach_targets(featured(t), EXITS), modelling.TARGET, 12).select(*modelling.STRESSED)
    whole = lambda df: df.select(F.xxhash64(*modelling.STRESSED).cast("decimal(20,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    assert whole(got) == whole(want)
    last = lambda df: {tuple(r) for r in df.select("entity_id", "seq").collect()}
    assert last(got.filter("latest")) == last(X.snapshot(want))
    assert macro.count() == t.macro().count()


@pytest.mark.parametrize("name", ["l3_score_scenarios_fitted", "l11_compare_engines"])
def test_macro_values_are_computed_once_and_the_feed_is_not_joined(spark, monkeypatch, name):
    calls, macro = [], Tables.macro
    monkeypatch.setattr(Tables, "macro", lambda self: calls.append(1) or macro(self))
    monkeypatch.setattr(Tables, "feed", lambda self: pytest.fail("no column of the feed is read"))
    assert modelling.QUERIES[name](Tables(spark, "/root/testdata/sf0.001")) is not None and calls == [1]
