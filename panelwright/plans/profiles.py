"""Queries over profiles, dependencies and drift, with their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelwright.operators import labels as L
from panelwright.operators import profile as P
from panelwright.plans.oracle import MACRO_VIEW, select
from panelwright.plans.panel import purged_sql, targeted, targets_sql
from panelwright.plans.quality import cleaned, deduped, reconciled, rounded
from panelwright.sources.tables import Tables

NUMERIC = ["current_balance", "interest_rate", "days_past_due", "loan_age_months"]
CATEGORICAL = ["credit_score_band", "current_status", "occupancy_type", "loan_purpose"]
GAPS = ["interest_rate", "credit_score_band", "ltv_band", "dti_band", "days_past_due"]
BOUNDARY = "1999-06"


def _tests(t: Tables):
    return rounded(P.missingness_tests(deduped(t), [("state", "dti_band"), ("servicer_name", "credit_score_band")]), "chi2", "cramers_v", "p")


def _rank_pairs(t):
    return rounded(P.spearman(cleaned(t), ["balance_clean", "dpd_clean", "age_clean"]), "rho")


BY_TARGET = {"next_3m_delinquency_flag": 3, "next_12m_default_flag": 12}


def _by_target(t):
    rows = targeted(t)
    for target, horizon in BY_TARGET.items():
        rows = L.purged_split(rows, target, horizon).withColumnRenamed("split", f"split_{target}")
    out = P.drift_by_target(rows, {target: f"split_{target}" for target in BY_TARGET}, ["current_balance", "days_past_due"], ["current_status"])
    return rounded(out, "psi", "ks", "missing_before", "missing_after")


def _sided(t):
    return deduped(t).withColumn("before", F.col("reporting_month") <= BOUNDARY)


def _months(t):
    series = t.raw("orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return P.resample_months(series, "day", "o_totalprice").withColumn("month", F.col("month").cast("string"))


QUERIES = {
    "e1_profile_numeric": lambda t: rounded(P.profile_numeric(deduped(t), NUMERIC), "mean", "std", "skew", "p01", "p25", "p50", "p75", "p99", digits=4),
    "e2_profile_categorical": lambda t: rounded(P.profile_categorical(deduped(t), CATEGORICAL).drop("top"), "mode_share", "entropy"),
    "e3_co_missingness": lambda t: rounded(P.co_missingness(deduped(t), GAPS), "corr"),
    "e4_top_co_missing": lambda t: rounded(P.co_missingness(deduped(t), GAPS), "corr").orderBy(F.desc("corr"), "a", "b").limit(4),
    "e5_missing_by": lambda t: rounded(P.missing_by(deduped(t), "servicer_name", GAPS), *GAPS),
    "e6_missingness_tests": _tests,
    "e7_missing_summary": lambda t: rounded(P.missing_summary(deduped(t), GAPS), "mean_missing"),
    "e8_spearman": _rank_pairs,
    "e9_cramers_v": lambda t: rounded(P.cramers_v(deduped(t), ["credit_score_band", "ltv_band", "current_status"]), "v"),
    "e10_functional_dependencies": lambda t: rounded(P.functional_dependencies(deduped(t), [("servicer_name", "state"), ("entity_id", "servicer_name"), ("state", "servicer_name")]), "rate"),
    "e11_psi_numeric": lambda t: rounded(P.psi_numeric(_sided(t), "current_balance", "before"), "psi"),
    "e12_psi_categorical": lambda t: rounded(P.psi_categorical(_sided(t), "current_status", "before"), "psi"),
    "e13_ks_two_sample": lambda t: rounded(P.ks_two_sample(_sided(t), "current_balance", "before"), "ks"),
    "e14_drift_report": lambda t: rounded(P.drift_report(deduped(t), "reporting_month", BOUNDARY, ["current_balance", "days_past_due"], ["current_status", "credit_score_band"]), "psi", "ks", "missing_before", "missing_after"),
    "e15_drift_by_target": _by_target,
    "e16_target_stability": lambda t: rounded(P.target_stability(deduped(t).withColumn("late", F.when(F.col("days_past_due").isNotNull(), (F.col("days_past_due") >= 30).cast("int"))), "late", "reporting_month"), "rate", "min_rate", "max_rate", "std_rate"),
    "e17_build_summary": lambda t: reconciled(t).groupBy("current_status").agg(F.count("*").alias("rows"), F.count_distinct("entity_id").alias("entities"), F.count_distinct("servicer_name").alias("servicers"), F.sum("svc_present").alias("with_feed")),
    "e18_resample_months": _months,
    "e19_calibration_facts": lambda t: rounded(P.calibration_facts(t.macro(), "unemployment_rate").unionByName(P.calibration_facts(t.macro(), "unemployment_rate", skip=(23960, 23965)).withColumn("column", F.lit("unemployment_rate_skipped"))), "max_change", "min_change"),
}

_PROFILE = """SELECT '{0}' AS "column", count(*) AS n, count(*) - count({0}) AS missing, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, CAST(min({0}) AS DOUBLE) AS min, CAST(max({0}) AS DOUBLE) AS max, round(skewness({0}), 4) AS skew, sum(CASE WHEN {0} = 0 THEN 1 ELSE 0 END) AS zeros, sum(CASE WHEN {0} < 0 THEN 1 ELSE 0 END) AS negatives, count(DISTINCT {0}) AS distinct, round(quantile_cont({0}, 0.01e0), 4) AS p01, round(quantile_cont({0}, 0.25e0), 4) AS p25, round(quantile_cont({0}, 0.5e0), 4) AS p50, round(quantile_cont({0}, 0.75e0), 4) AS p75, round(quantile_cont({0}, 0.99e0), 4) AS p99,
 (SELECT sum(CASE WHEN {0} < a - 3 * (b - a) OR {0} > b + 3 * (b - a) THEN 1 ELSE 0 END) FROM one, (SELECT quantile_cont({0}, 0.25e0) AS a, quantile_cont({0}, 0.75e0) AS b FROM one)) AS outliers FROM one"""
_CATEGORY = """SELECT '{0}' AS "column", (SELECT count(*) FROM one) AS n, (SELECT count(*) FROM one WHERE {0} IS NULL) AS missing, count(*) AS distinct, arg_max(v, (k, w)) AS mode, round(max(k) / sum(k), 6) AS mode_share, round(-sum(k / t * ln(k / t)) / ln(count(*)), 6) AS entropy FROM (SELECT {0} AS v, count(*) AS k, sum(count(*)) OVER () AS t, -row_number() OVER (ORDER BY {0}) AS w FROM one WHERE {0} IS NOT NULL GROUP BY {0})"""
_CORR = "SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr(CASE WHEN {a} IS NULL THEN 1 ELSE 0 END, CASE WHEN {b} IS NULL THEN 1 ELSE 0 END), 0), 6) AS corr FROM one"
_CO = " UNION ALL ".join(_CORR.format(a=a, b=b) for a, b in combinations(GAPS, 2))
_CELLS = """cells_{k} AS (SELECT a, b, count(*) AS o FROM (SELECT {a} AS a, {b} AS b FROM one) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
full_{k} AS (SELECT na, nb, coalesce(o, 0) AS o, (SELECT sum(o) FROM cells_{k}) AS n, (SELECT count(DISTINCT a) FROM cells_{k}) AS r, (SELECT count(DISTINCT b) FROM cells_{k}) AS c FROM (SELECT a, sum(o) AS na FROM cells_{k} GROUP BY 1) CROSS JOIN (SELECT b, sum(o) AS nb FROM cells_{k} GROUP BY 1) LEFT JOIN cells_{k} USING (a, b)),
chi_{k} AS (SELECT n, r, c, sum(CASE WHEN r = 2 AND c = 2 THEN greatest(abs(o - na * nb / n) - least(0.5e0, abs(o - na * nb / n)), 0) ** 2 ELSE (o - na * nb / n) ** 2 END / (na * nb / n)) AS chi2 FROM full_{k} GROUP BY 1, 2, 3)"""
# The tail of an even number of degrees, which both tests have: all groups are of an odd number of categories.
_TAIL = "(exp(-chi2 / 2) * list_sum(list_transform(range(CAST((r - 1) * (c - 1) // 2 AS BIGINT)), lambda i: pow(chi2 / 2, i) / gamma(i + 1e0))))"
_PAIRS = list(combinations(["credit_score_band", "ltv_band", "current_status"], 2))
_RHO = "SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS ra, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS rb FROM (SELECT {a} AS x, {b} AS y FROM clean WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"
_FD = "SELECT '{a}' AS determinant, '{b}' AS dependent, count(*) AS groups, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS violations, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) = 0 AS holds, round(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM (SELECT {a}, count(DISTINCT {b}) AS k FROM one WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)"
_SIDE = f"(reporting_month <= '{BOUNDARY}')"


def _psi_n(c: str, one: str = "one", _SIDE: str = _SIDE) -> str:
    return f"""(SELECT CASE WHEN min(ne) >= 50 AND min(na) >= 50 THEN sum((a - e) * ln(a / e)) END FROM (
  SELECT ne, na, greatest(coalesce(sum(CASE WHEN s THEN 1 END), 0) / ne, 1e-6) AS e, greatest(coalesce(sum(CASE WHEN NOT s THEN 1 END), 0) / na, 1e-6) AS a
  FROM (SELECT list_distinct(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS raw_edges FROM {one} WHERE {_SIDE} AND {c} IS NOT NULL) q,
    (SELECT sum(CASE WHEN {_SIDE} THEN 1 ELSE 0 END) AS ne, sum(CASE WHEN {_SIDE} THEN 0 ELSE 1 END) AS na FROM {one} WHERE {c} IS NOT NULL) n,
    LATERAL (SELECT list_sort(raw_edges) AS edges) z, LATERAL (SELECT unnest(range(1, len(edges))) AS bin) u
    LEFT JOIN (SELECT {c} AS v, {_SIDE} AS s FROM {one} WHERE {c} IS NOT NULL) d ON v >= edges[bin] AND (v < edges[bin + 1] OR bin = len(edges) - 1 AND v = edges[bin + 1])
  GROUP BY bin, ne, na))"""


def _psi_c(c: str, one: str = "one", _SIDE: str = _SIDE) -> str:
    return f"""(SELECT CASE WHEN min(ne) >= 50 AND min(na) >= 50 THEN sum((a - e) * ln(a / e)) END FROM (SELECT max(ne) AS ne, max(na) AS na, greatest(sum(CASE WHEN {_SIDE} THEN 1 ELSE 0 END) / max(ne), 1e-6) AS e, greatest(sum(CASE WHEN {_SIDE} THEN 0 ELSE 1 END) / max(na), 1e-6) AS a
  FROM {one}, (SELECT sum(CASE WHEN {_SIDE} THEN 1 ELSE 0 END) AS ne, sum(CASE WHEN {_SIDE} THEN 0 ELSE 1 END) AS na FROM {one} WHERE {c} IS NOT NULL) WHERE {c} IS NOT NULL GROUP BY {c} HAVING sum(CASE WHEN {_SIDE} THEN 1 ELSE 0 END) > 0))"""


def _ks(c: str, one: str = "one", _SIDE: str = _SIDE) -> str:
    return f"(SELECT CASE WHEN max(ne) > 50 AND max(na) > 50 THEN max(abs(e / ne - a / na)) END FROM (SELECT sum(CASE WHEN {_SIDE} THEN 1 ELSE 0 END) OVER w AS e, sum(CASE WHEN {_SIDE} THEN 0 ELSE 1 END) OVER w AS a, sum(CASE WHEN {_SIDE} THEN 1 ELSE 0 END) OVER () AS ne, sum(CASE WHEN {_SIDE} THEN 0 ELSE 1 END) OVER () AS na FROM {one} WHERE {c} IS NOT NULL WINDOW w AS (ORDER BY {c} RANGE UNBOUNDED PRECEDING)))"


def _drift(c: str, numeric: bool, one: str = "one", _SIDE: str = _SIDE, first: str = "") -> str:
    psi, ks = (_psi_n(c, one, _SIDE), _ks(c, one, _SIDE)) if numeric else (_psi_c(c, one, _SIDE), "NULL")
    return f"""SELECT {first}'{c}' AS "column", round(psi, 6) AS psi, round(CAST(ks AS DOUBLE), 6) AS ks, round(mb, 6) AS missing_before, round(ma, 6) AS missing_after, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS severity
  FROM (SELECT {psi} AS psi, {ks} AS ks, (SELECT avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM {one} WHERE {_SIDE}) AS mb, (SELECT avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM {one} WHERE NOT {_SIDE}) AS ma)"""


_FACTS = "SELECT '{0}' AS \"column\", round(max(d), 6) AS max_change, round(min(d), 6) AS min_change, max(unemployment_rate) AS max, min(unemployment_rate) AS min, arg_max(unemployment_rate, pno) AS last FROM (SELECT *, unemployment_rate - lag(unemployment_rate, 12) OVER (ORDER BY pno) AS d FROM ({1}) {2})"

ORACLES = {
    "e1_profile_numeric": select(" UNION ALL ".join(_PROFILE.format(c) for c in NUMERIC)),
    "e2_profile_categorical": select(" UNION ALL ".join(_CATEGORY.format(c) for c in CATEGORICAL)),
    "e3_co_missingness": select(_CO),
    "e4_top_co_missing": select(f"SELECT * FROM ({_CO}) ORDER BY corr DESC, a, b LIMIT 4"),
    "e5_missing_by": select("SELECT servicer_name, " + ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS {c}" for c in GAPS) + " FROM one GROUP BY 1"),
    "e6_missingness_tests": select(
        ", " + _CELLS.format(k=1, a="state", b="dti_band IS NULL") + ", " + _CELLS.format(k=2, a="servicer_name", b="credit_score_band IS NULL")
        + " UNION ALL ".join(f"\nSELECT '{a}' AS \"by\", '{b}' AS \"column\", n, round(chi2, 6) AS chi2, (r - 1) * (c - 1) AS df, round(sqrt(chi2 / (n * (least(r, c) - 1))), 6) AS cramers_v, round({_TAIL}, 6) AS p, CASE WHEN {_TAIL} < 0.01 THEN 'depends on group' ELSE 'at random' END AS verdict FROM chi_{k}" for k, a, b in ((1, "state", "dti_band"), (2, "servicer_name", "credit_score_band")))
    ),
    "e7_missing_summary": select("SELECT count(*) AS rows, sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS rows_with_missing, round(avg(k) / 5, 6) AS mean_missing FROM (SELECT " + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in GAPS) + " AS k FROM one)"),
    "e8_spearman": select(" UNION ALL ".join(_RHO.format(a=a, b=b) for a, b in combinations(["balance_clean", "dpd_clean", "age_clean"], 2))),
    "e9_cramers_v": select(
        ", " + ", ".join(_CELLS.format(k=i, a=a, b=b) for i, (a, b) in enumerate(_PAIRS))
        + " UNION ALL ".join(f"\nSELECT '{a}' AS a, '{b}' AS b, n, round(sqrt(greatest(0, chi2 / n - (r - 1) * (c - 1) / (n - 1)) / (least(r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)) - 1)), 6) AS v FROM chi_{i} WHERE n >= 500" for i, (a, b) in enumerate(_PAIRS))
    ),
    "e10_functional_dependencies": select(" UNION ALL ".join(_FD.format(a=a, b=b) for a, b in [("servicer_name", "state"), ("entity_id", "servicer_name"), ("state", "servicer_name")])),
    "e11_psi_numeric": select(f"SELECT 'current_balance' AS \"column\", round({_psi_n('current_balance')}, 6) AS psi"),
    "e12_psi_categorical": select(f"SELECT 'current_status' AS \"column\", round({_psi_c('current_status')}, 6) AS psi"),
    "e13_ks_two_sample": select(f"SELECT 'current_balance' AS \"column\", round({_ks('current_balance')}, 6) AS ks"),
    "e14_drift_report": select(" UNION ALL ".join(_drift(c, n) for c, n in (("current_balance", True), ("days_past_due", True), ("current_status", False), ("credit_score_band", False)))),
    "e15_drift_by_target": select(targets_sql() + ", " + ", ".join(f"{purged_sql(t, h, f'split{h}')}, used{h} AS (SELECT * FROM split{h} WHERE split IN ('train', 'test'))" for t, h in BY_TARGET.items()) + " UNION ALL ".join(" " + _drift(c, n, f"used{h}", "(split = 'train')", f"'{t}' AS target, ") for t, h in BY_TARGET.items() for c, n in (("current_balance", True), ("days_past_due", True), ("current_status", False)))),
    "e16_target_stability": select("SELECT 'late' AS target, round((SELECT avg(CASE WHEN days_past_due >= 30 THEN 1 ELSE 0 END) FROM one WHERE days_past_due IS NOT NULL), 6) AS rate, (SELECT count(*) FROM one WHERE days_past_due IS NULL) AS censored, round(min(r), 6) AS min_rate, round(max(r), 6) AS max_rate, round(stddev_samp(r), 6) AS std_rate FROM (SELECT reporting_month, avg(CASE WHEN days_past_due >= 30 THEN 1 ELSE 0 END) AS r FROM one WHERE days_past_due IS NOT NULL GROUP BY 1)"),
    "e17_build_summary": select("SELECT current_status, count(*) AS rows, count(DISTINCT entity_id) AS entities, count(DISTINCT servicer_name) AS servicers, sum(svc_present) AS with_feed FROM recon GROUP BY 1"),
    "e18_resample_months": "WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m), f AS (SELECT month, last_value(v IGNORE NULLS) OVER (ORDER BY month) AS value FROM s LEFT JOIN m USING (month)) SELECT CAST(month AS VARCHAR) AS month, round(value, 4) AS value, round(value / lag(value, 12) OVER (ORDER BY month) - 1, 5) AS yoy FROM f",
    "e19_calibration_facts": f"WITH macro AS ({MACRO_VIEW}) " + _FACTS.format("unemployment_rate", "SELECT * FROM macro", "m") + " UNION ALL " + _FACTS.format("unemployment_rate_skipped", "SELECT * FROM macro WHERE pno NOT BETWEEN 23960 AND 23965", "m"),
}
