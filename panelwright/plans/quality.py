"""Queries over cleaning, joining and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import columns as C
from panelwright.operators import clean, joins, rules
from panelwright.plans.oracle import DAYS, RULES, STATUS, select
from panelwright.sources.tables import FEED_TIES, Tables

KEYS = ["entity_id", "month_index"]


def deduped(t: Tables):
    return clean.dedupe_keys(t.panel(), KEYS, ["seq"])


def latest_feed(t: Tables):
    return joins.latest_wins(t.feed(), KEYS, "received_at", FEED_TIES)


def reconciled(t: Tables):
    return joins.reconcile(deduped(t), latest_feed(t))


def cleaned(t: Tables):
    return clean.repair_panel(reconciled(t))  # which has a row a key


def flagged(t: Tables):
    return rules.run_rules(rules.prepare_for_rules(cleaned(t)), rules.default_rules())


def scored(t: Tables):
    return rules.score_records(flagged(t), rules.default_rules())


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _bands(t):
    lower = C.band("current_balance", [50000, 150000, 300000], ["low", "mid", "high", "top"], closed="left", sentinels=(9999.0,))
    days = C.band("days_past_due", [0, 30, 60, 90], ["0", "30", "60", "90", "90+"], sentinels=(9999.0,))
    return deduped(t).select("seq", lower.alias("balance_band"), days.alias("days_band"), C.map_codes("current_status", C.STATUS_DAYS).cast("int").alias("status_days"), C.map_codes("exit_code", {"01": "Prepaid", "02": "Default"}, "none").alias("exit_state"))


def _ordinals(t):
    return deduped(t).select("seq", C.ordinal("credit_score_band", C.CREDIT_BANDS).alias("credit_ord"), C.ordinal("ltv_band", C.LTV_BANDS).alias("ltv_ord"), C.ordinal("dti_band", C.DTI_BANDS).alias("dti_ord"), C.map_codes("current_status", C.STATUS_ORDER).cast("int").alias("status_ord"))


def _months(t):
    first = t.raw("orders").select("o_orderkey", C.month_number("o_orderdate").alias("pno"), C.shift_month("o_orderdate", -1).cast("string").alias("month_before"))
    return clean.index_months(first, "pno", 23952, 23999)


def _grades(t):
    out = rules.score_batches(scored(t), ["month_index", "servicer_name"], rules.default_rules())
    return rounded(out, "mean_score", "share_critical", "violations_per_record", "top_rule_rate")


def _patched(t):
    new = t.raw("supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("c_custkey"), F.concat(F.lit("patched "), "s_name").alias("c_name"))
    return clean.patch_table(t.raw("customer").select("c_custkey", "c_name", "c_mktsegment"), new, "c_custkey")


def _statics(t):
    return joins.attach_static(deduped(t), "entity_id", "occupancy_type", "month_index", "first_occupancy").select("seq", "first_occupancy")


def _macro(t):
    out = joins.attach_macro(deduped(t), t.macro())
    return rounded(out.select("seq", "market_mortgage_rate", "unemployment_rate", "hpi_yoy_growth", "unemployment_rate_chg", "hpi_yoy_growth_chg"), "unemployment_rate_chg", "hpi_yoy_growth_chg", digits=5)


def _asof_any(t):
    """The greatest balance reported on the last day with reports, for all entities together; sorted in parts, however few the rows."""
    left = deduped(t).select("seq", F.to_date("last_updated_at").alias("day"))
    right = t.feed().groupBy(F.to_date("received_at").alias("day")).agg(F.max("reported_balance").alias("balance"))
    return joins.asof_backward(left, right, "day", ["balance"], parts=16).select("seq", "balance")


def _asof(t):
    feed = latest_feed(t).filter("reported_balance is not null").select("entity_id", "month_index", "reported_balance")
    left = deduped(t).select("seq", *KEYS)
    return joins.asof_backward(left, feed, "month_index", ["reported_balance"], ["entity_id"]).select("seq", "month_index", "reported_balance")


def _breaches(t):
    return rules.resolve_priority(rules.breach_flags(reconciled(t))).select("seq", *rules.PRIORITY, "exception_type", "exception_required")


QUERIES = {
    "a5_sample_entities": lambda t: clean.sample_entities(t.panel(), "entity_id", "state", 40, 7).select("seq", "entity_id", "state"),
    "a12_rules_table": lambda t: flagged(t).agg(*[F.sum(r.flag).alias(r.name) for r in rules.default_rules()]).unpivot([], [r.name for r in rules.default_rules()], "name", "violations").join(F.broadcast(rules.rules_table(t.spark, rules.default_rules())), "name"),
    "b1_band_and_map_codes": _bands,
    "b8_month_shift_and_index": _months,
    "b11_mask_days": lambda t: clean.mask_days(deduped(t)).select("seq", "dpd_clean", "dpd_repaired"),
    "b12_mask_rate": lambda t: clean.mask_rate(deduped(t)).select("seq", "rate_clean", "rate_repaired"),
    "b13_mask_implausible": lambda t: clean.mask_implausible(deduped(t)).select("seq", "balance_clean", "balance_repaired"),
    "b14_repair_age": lambda t: clean.repair_age(deduped(t)).select("seq", "age_clean", "age_repaired"),
    "b15_reporting_lag": lambda t: clean.reporting_lag(deduped(t)).select("seq", "lag_days", "is_stale"),
    "b16_dedupe_keys": lambda t: deduped(t).select("entity_id", "month_index", "seq"),
    "b17_mask_ids": lambda t: t.raw("customer").select("c_custkey", C.masked_id("c_custkey").alias("masked")),
    "b18_ordinal": _ordinals,
    "b19_lookup": lambda t: clean.lookup(t.raw("customer"), "c_mktsegment", ["BUILDING", "MACHINERY"], ["c_custkey", "c_mktsegment"]),
    "b21_project_contract": lambda t: clean.project_contract(deduped(t), ["entity_id", "month_index", "not_there", "seq", "current_status"]),
    "b22_patch_table": _patched,
    "c1_latest_wins": lambda t: latest_feed(t).select(*KEYS, "reported_balance", "reported_status", "l_orderkey", "l_linenumber"),
    "c2_count_duplicates": lambda t: joins.count_duplicates(t.feed(), KEYS),
    "c3_find_orphans": lambda t: joins.find_orphans(latest_feed(t), deduped(t), KEYS).select(*KEYS, "reported_status"),
    "c4_reconcile": lambda t: rounded(reconciled(t).select("seq", "svc_balance", "svc_status", "svc_dpd", "svc_present", "balance_gap", "balance_gap_rel", "status_conflict", "dpd_gap"), "svc_balance", "balance_gap", "balance_gap_rel"),
    "c6_attach_static": _statics,
    "c7_attach_macro": _macro,
    "c8_asof_backward": lambda t: rounded(_asof(t), "reported_balance"),
    "c8_asof_without_key": lambda t: rounded(_asof_any(t), "balance"),
    "c10_restrict_entities": lambda t: joins.restrict_entities(deduped(t), t.raw("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("entity_id")), keep=False).select("seq", "entity_id"),
    "d1_prepare_for_rules": lambda t: rounded(rules.prepare_for_rules(cleaned(t)).select("seq", "balance_growth", "expected_dpd"), "balance_growth"),
    "d2_run_rules": lambda t: flagged(t).select("seq", *[r.flag for r in rules.default_rules()]),
    "d20_rule_summary": lambda t: rounded(rules.rule_summary(flagged(t), rules.default_rules()), "violation_rate"),
    "d21_score_records": lambda t: scored(t).select("seq", "penalty", "dq_score", "violations", "dq_band"),
    "d22_score_batches": lambda t: _grades(t).drop("top_rule", "top_rule_rate"),
    "d23_top_failing_rule": lambda t: _grades(t).select("month_index", "servicer_name", "top_rule", "top_rule_rate"),
    "d24_rollup_scores": lambda t: rounded(rules.rollup_scores(scored(t), "servicer_name", 10), "mean_score"),
    "d25_repair_summary": lambda t: rounded(clean.repair_summary(cleaned(t)), "rate"),
    "d26_band_distribution": lambda t: rounded(rules.band_distribution(scored(t)), "share"),
    "d26_headline": lambda t: rounded(rules.headline(scored(t)), "mean_score", "median_score", "share_with_violations"),
    "d27_breach_flags": lambda t: _breaches(t).drop("exception_type", "exception_required"),
    "d28_resolve_priority": lambda t: _breaches(t).groupBy("exception_type").agg(F.count("*").alias("rows"), F.sum("exception_required").alias("required")),
    "d29_rules_fired": lambda t: flagged(t).select("seq", rules.rules_fired(rules.default_rules()).alias("fired")),
}


_NAMES = list(RULES)
#: The dimension of each rule in order (fixed values).
DIMENSIONS = ["temporal", "temporal", "temporal", "validity", "validity", "consistency", "validity", "consistency", "validity", "consistency", "completeness", "completeness", "timeliness", "reconciliation", "reconciliation", "reconciliation", "consistency"]
_BATCH = "SELECT month_index, servicer_name, count(*) AS rows, avg(dq_score) AS mean_score, min(dq_score) AS min_score, avg(CASE WHEN dq_band = 'critical' THEN 1 ELSE 0 END) AS share_critical, avg(violations) AS violations_per_record, " + ", ".join(f"avg(vr_{n}) AS {n}" for n in _NAMES) + " FROM scored WHERE servicer_name IS NOT NULL AND month_index IS NOT NULL GROUP BY 1, 2"
_TOP = f"greatest({', '.join(_NAMES)})"
_BREACH = f"""
b AS (SELECT *, lag(current_balance) OVER (PARTITION BY entity_id ORDER BY month_index, seq) AS pb FROM recon),
breaches AS (
  SELECT seq, CASE WHEN orig_pno > pno OR last_updated_at < period_end OR abs(loan_age_months - (pno - orig_pno)) > 2 THEN 1 ELSE 0 END AS date_breach,
    CASE WHEN abs(current_balance) > 1 AND balance_gap / abs(current_balance) > 0.01e0 AND balance_gap > 500 THEN 1 ELSE 0 END AS reconciliation_breach,
    CASE WHEN document_status IN ('missing', 'exception') THEN 1 ELSE 0 END AS document_breach,
    CASE WHEN coalesce(abs(days_past_due - {DAYS}), 0) > 29 OR days_past_due > 900 OR days_past_due < 0 THEN 1 ELSE 0 END AS dpd_breach,
    CASE WHEN (current_balance - pb) / nullif(abs(pb), 0) > 0.005e0 OR current_balance > 1.02e0 * original_balance OR current_balance < 0 THEN 1 ELSE 0 END AS balance_breach,
    CASE WHEN date_diff('day', CAST(period_end AS DATE), CAST(last_updated_at AS DATE)) > 75 THEN 1 ELSE 0 END AS stale_breach
  FROM b
)
"""
_KIND = "CASE " + " ".join(f"WHEN {p} = 1 THEN '{p}'" for p in rules.PRIORITY) + " ELSE 'none' END"


def _ord(column: str, values: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}e0" for i, v in enumerate(values)) + " END"


ORACLES = {
    "a5_sample_entities": select("SELECT seq, entity_id, state FROM raw WHERE (state, entity_id) IN (SELECT state, entity_id FROM (SELECT state, entity_id, row_number() OVER (PARTITION BY state ORDER BY md5(concat(entity_id, '|7'))) AS n FROM (SELECT DISTINCT state, entity_id FROM raw)) WHERE n <= 40)"),
    "a12_rules_table": select(" UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT sum(vr_{n}) FROM flags) AS violations, {i} AS position, '{d}' AS dimension, {s}e0 AS severity" for i, ((n, (s, _)), d) in enumerate(zip(RULES.items(), DIMENSIONS)))),
    "b1_band_and_map_codes": select(f"SELECT seq, CASE WHEN current_balance IS NULL OR current_balance = 9999 THEN NULL WHEN current_balance < 50000 THEN 'low' WHEN current_balance < 150000 THEN 'mid' WHEN current_balance < 300000 THEN 'high' ELSE 'top' END AS balance_band, CASE WHEN days_past_due IS NULL OR days_past_due = 9999 THEN NULL WHEN days_past_due <= 0 THEN '0' WHEN days_past_due <= 30 THEN '30' WHEN days_past_due <= 60 THEN '60' WHEN days_past_due <= 90 THEN '90' ELSE '90+' END AS days_band, {DAYS} AS status_days, CASE exit_code WHEN '01' THEN 'Prepaid' WHEN '02' THEN 'Default' ELSE 'none' END AS exit_state FROM one"),
    "b8_month_shift_and_index": "SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS pno, CAST(CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_before, year(o_orderdate) * 12 + month(o_orderdate) - 1 - 23952 AS month_index FROM orders WHERE year(o_orderdate) * 12 + month(o_orderdate) - 1 BETWEEN 23952 AND 23999",
    "b11_mask_days": select("SELECT seq, dpd_clean, dpd_repaired FROM clean"),
    "b12_mask_rate": select("SELECT seq, rate_clean, rate_repaired FROM clean"),
    "b13_mask_implausible": select("SELECT seq, balance_clean, balance_repaired FROM clean"),
    "b14_repair_age": select("SELECT seq, age_clean, age_repaired FROM clean"),
    "b15_reporting_lag": select("SELECT seq, lag_days, is_stale FROM clean"),
    "b16_dedupe_keys": select("SELECT entity_id, month_index, seq FROM one"),
    "b17_mask_ids": "SELECT c_custkey, concat('LN-', upper(substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 10))) AS masked FROM customer",
    "b18_ordinal": select(f"SELECT seq, {_ord('credit_score_band', C.CREDIT_BANDS)} AS credit_ord, {_ord('ltv_band', C.LTV_BANDS)} AS ltv_ord, {_ord('dti_band', C.DTI_BANDS)} AS dti_ord, {STATUS} AS status_ord FROM one"),
    "b19_lookup": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "b21_project_contract": select("SELECT entity_id, month_index, seq, current_status FROM one"),
    "b22_patch_table": "SELECT c_custkey, coalesce('patched ' || s_name, c_name) AS c_name, c_mktsegment FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 = 0) ON s_suppkey = c_custkey",
    "c1_latest_wins": select("SELECT entity_id, month_index, reported_balance, reported_status, l_orderkey, l_linenumber FROM latest"),
    "c2_count_duplicates": select("SELECT count(*) AS rows, count(DISTINCT (entity_id, month_index)) AS keys, count(*) - count(DISTINCT (entity_id, month_index)) AS duplicates FROM feed"),
    "c3_find_orphans": select("SELECT entity_id, month_index, reported_status FROM latest WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.entity_id = latest.entity_id AND one.month_index = latest.month_index)"),
    "c4_reconcile": select("SELECT seq, round(svc_balance, 6) AS svc_balance, svc_status, svc_dpd, svc_present, round(balance_gap, 6) AS balance_gap, round(balance_gap_rel, 6) AS balance_gap_rel, status_conflict, dpd_gap FROM recon"),
    "c6_attach_static": select("SELECT seq, first_occupancy FROM one LEFT JOIN (SELECT entity_id, arg_min(occupancy_type, month_index) AS first_occupancy FROM one WHERE occupancy_type IS NOT NULL GROUP BY 1) USING (entity_id)"),
    "c7_attach_macro": select("SELECT seq, market_mortgage_rate, unemployment_rate, hpi_yoy_growth, round(uc, 5) AS unemployment_rate_chg, round(hc, 5) AS hpi_yoy_growth_chg FROM one LEFT JOIN (SELECT *, unemployment_rate - lag(unemployment_rate, 12) OVER (ORDER BY pno) AS uc, hpi_yoy_growth - lag(hpi_yoy_growth, 12) OVER (ORDER BY pno) AS hc FROM macro) m USING (pno)"),
    "c8_asof_without_key": select("SELECT seq, round(f.balance, 6) AS balance FROM (SELECT seq, CAST(last_updated_at AS DATE) AS day FROM one) o ASOF LEFT JOIN (SELECT CAST(received_at AS DATE) AS day, max(reported_balance) AS balance FROM feed GROUP BY 1 HAVING max(reported_balance) IS NOT NULL) f ON o.day >= f.day"),
    "c8_asof_backward": select("SELECT seq, o.month_index, round(f.reported_balance, 6) AS reported_balance FROM one o ASOF LEFT JOIN (SELECT * FROM latest WHERE reported_balance IS NOT NULL) f ON o.entity_id = f.entity_id AND o.month_index >= f.month_index"),
    "c10_restrict_entities": select("SELECT seq, entity_id FROM one WHERE entity_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"),
    "d1_prepare_for_rules": select("SELECT seq, round(balance_growth, 6) AS balance_growth, expected_dpd FROM ready"),
    "d2_run_rules": select("SELECT seq, " + ", ".join(f"vr_{n}" for n in _NAMES) + " FROM flags"),
    "d20_rule_summary": select(" UNION ALL ".join(f"SELECT '{n}' AS rule, sum(vr_{n}) AS violations, round(avg(vr_{n}), 6) AS violation_rate FROM flags" for n in _NAMES)),
    "d21_score_records": select("SELECT seq, penalty, dq_score, violations, dq_band FROM scored"),
    "d22_score_batches": select(f"SELECT month_index, servicer_name, rows, round(mean_score, 6) AS mean_score, min_score, round(share_critical, 6) AS share_critical, round(violations_per_record, 6) AS violations_per_record, CASE WHEN mean_score <= 70 THEN 'D' WHEN mean_score <= 82 THEN 'C' WHEN mean_score <= 91 THEN 'B' ELSE 'A' END AS grade FROM ({_BATCH})"),
    "d23_top_failing_rule": select(f"SELECT month_index, servicer_name, CASE {' '.join(f'WHEN {n} = {_TOP} THEN ' + repr(n) for n in _NAMES)} END AS top_rule, round({_TOP}, 6) AS top_rule_rate FROM ({_BATCH})"),
    "d24_rollup_scores": select("SELECT servicer_name, count(*) AS rows, round(avg(dq_score), 6) AS mean_score FROM scored WHERE servicer_name IS NOT NULL GROUP BY 1 ORDER BY avg(dq_score), servicer_name LIMIT 10"),
    "d25_repair_summary": select(" UNION ALL ".join(f"SELECT '{n}' AS repair, sum({n}) AS repaired, round(avg({n}), 6) AS rate FROM clean" for n in ("dpd_repaired", "rate_repaired", "balance_repaired", "age_repaired"))),
    "d26_band_distribution": select("SELECT dq_band, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM scored GROUP BY 1"),
    "d26_headline": select("SELECT count(*) AS rows, round(avg(dq_score), 6) AS mean_score, round(median(dq_score), 6) AS median_score, round(avg(CASE WHEN violations > 0 THEN 1 ELSE 0 END), 6) AS share_with_violations FROM scored"),
    "d27_breach_flags": select(f", {_BREACH} SELECT seq, {', '.join(rules.PRIORITY)} FROM breaches"),
    "d28_resolve_priority": select(f", {_BREACH} SELECT {_KIND} AS exception_type, count(*) AS rows, sum(CASE WHEN {_KIND} <> 'none' THEN 1 ELSE 0 END) AS required FROM breaches GROUP BY 1"),
    "d29_rules_fired": select("SELECT seq, concat_ws('; ', " + ", ".join(f"CASE WHEN vr_{n} = 1 THEN '{n}' END" for n in _NAMES) + ") AS fired FROM flags"),
}
