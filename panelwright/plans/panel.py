"""Queries over features, labels and splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import features as X
from panelwright.operators import joins
from panelwright.operators import labels as L
from panelwright.plans.oracle import DAYS, STATUS, select
from panelwright.plans.quality import cleaned, deduped, rounded
from panelwright.sources.session import saved
from panelwright.sources.tables import Tables

EXITS = {"01": "Prepaid", "02": "Default"}
FEATURES = [
    "status_ord", "balance_ratio", "term_progress", "rate_incentive", "incentive_positive", "log_original_balance", "log_balance", "calendar_month", "vintage_year", "status_ord_lag1", "status_ord_lag3", "status_ord_lag6",
    "dpd_clean_lag1", "status_ord_delta", "dpd_clean_delta", "dpd_max_3", "dpd_max_6", "dpd_max_12", "late_count_3", "late_count_12", "ever_late", "worst_status", "clean_streak", "balance_change_1", "balance_change_3",
    "balance_flat", "amortisation", "amortisation_residual", "payment_ratio", "seasoning", "growth_positive", "doc_problem", "manual_source", "gap_filled", "missing_count",
]
MORE = ["dpd_status_residual", "dpd_gap_filled", "scheduled_payment", "dti_ord", "property_type_missing", "occupancy_type_missing", "rate_clean_missing", "dpd_clean_missing"]
_ROUND = ["scheduled_payment", "dpd_gap_filled", "balance_ratio", "term_progress", "rate_incentive", "incentive_positive", "log_original_balance", "log_balance", "balance_change_1", "balance_change_3", "amortisation", "amortisation_residual", "payment_ratio", "growth_positive", "gap_filled"]


def featured(t: Tables):
    return X.build_features(joins.attach_macro(cleaned(t), t.macro()))


def part(*names):
    return lambda t: rounded(featured(t).select("seq", *names), *[n for n in names if n in _ROUND], digits=5)


def targeted(t: Tables):
    return L.attach_targets(deduped(t), EXITS)


TARGET = "next_12m_default_flag"


def _split(t):
    return L.purged_split(saved(targeted(t), "targeted"), TARGET, 12)


def _folds(t):
    out = None
    for k, fold in enumerate(L.expanding_folds(targeted(t), TARGET, 12)):
        one = fold.groupBy("split").agg(F.count("*").alias("rows"), F.min("month_index").alias("first_month"), F.max("month_index").alias("last_month")).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "f1_lags": part("status_ord_lag1", "status_ord_lag3", "status_ord_lag6", "dpd_clean_lag1"),
    "f2_deltas": part("status_ord_delta", "dpd_clean_delta"),
    "f3_rolling": part("dpd_max_3", "dpd_max_6", "dpd_max_12", "late_count_3", "late_count_12"),
    "f5_running": part("ever_late", "worst_status"),
    "f7_streak": part("clean_streak"),
    "f8_pct_change": part("balance_change_1", "balance_change_3", "balance_flat", "growth_positive"),
    "f10_ratios": part("balance_ratio", "term_progress", "log_original_balance", "log_balance", "amortisation"),
    "f12_incentive": part("rate_incentive", "incentive_positive"),
    "f13_annuity": part("payment_ratio"),
    "f14_missing_indicators": part("missing_count", "gap_filled"),
    "f17_gaps_and_payments": part(*MORE),
    "f16_residuals": part("amortisation_residual", "doc_problem", "manual_source"),
    "f18_bucket": part("seasoning", "calendar_month", "vintage_year"),
    "f20_build_features": part(*FEATURES),
    "f22_running_flag": lambda t: deduped(t).select("seq", X.running(F.col("modification_flag")).alias("ever_modified")),
    "f23_snapshot": lambda t: X.snapshot(deduped(t)).select("entity_id", "seq", "month_index", "current_status"),
    "g1_status_next": lambda t: L.status_next(deduped(t), EXITS).select("seq", "next_state"),
    "g3_attach_targets": lambda t: targeted(t).select("seq", "next_3m_delinquency_flag", "next_6m_delinquency_flag", "next_12m_default_flag", "next_12m_prepayment_flag"),
    "g4_strict_default": lambda t: L.attach_targets(deduped(t), EXITS, ("Default",)).select("seq", "next_12m_default_flag"),
    "h1_purged_split": lambda t: _split(t).select("seq", "split"),
    "h2_entity_disjoint_split": lambda t: L.entity_disjoint_split(targeted(t), TARGET, 12).select("seq", "split"),
    "h3_random_split": lambda t: L.random_split(targeted(t), TARGET).select("seq", "split"),
    "h4_expanding_folds": _folds,
    "h5_split_summary": lambda t: rounded(L.split_summary(_split(t), TARGET), "rate"),
}

_W = "(PARTITION BY entity_id ORDER BY month_index)"
_FEATURED = f"""
, base AS (
  SELECT c.*, market_mortgage_rate, {STATUS} AS status_ord, CASE WHEN {STATUS} > 0 THEN 1 ELSE 0 END AS late, balance_clean / nullif(original_balance, 0) AS balance_ratio,
    age_clean / nullif(CAST(age_clean + remaining_term_months AS DOUBLE), 0) AS term_progress, rate_clean - market_mortgage_rate AS rate_incentive,
    pno % 12 + 1 AS calendar_month, CAST(floor(orig_pno / 12) AS INT) AS vintage_year, ln(1 + original_balance) AS log_original_balance, ln(1 + balance_clean) AS log_balance
  FROM clean c LEFT JOIN (SELECT pno, market_mortgage_rate FROM macro) USING (pno)
),
wide AS (
  SELECT *, lag(status_ord, 1) OVER w AS status_ord_lag1, lag(status_ord, 3) OVER w AS status_ord_lag3, lag(status_ord, 6) OVER w AS status_ord_lag6, lag(dpd_clean, 1) OVER w AS dpd_clean_lag1,
    status_ord - lag(status_ord) OVER w AS status_ord_delta, dpd_clean - lag(dpd_clean) OVER w AS dpd_clean_delta,
    max(dpd_clean) OVER (PARTITION BY entity_id ORDER BY month_index ROWS 2 PRECEDING) AS dpd_max_3, max(dpd_clean) OVER (PARTITION BY entity_id ORDER BY month_index ROWS 5 PRECEDING) AS dpd_max_6, max(dpd_clean) OVER (PARTITION BY entity_id ORDER BY month_index ROWS 11 PRECEDING) AS dpd_max_12,
    sum(late) OVER (PARTITION BY entity_id ORDER BY month_index ROWS 2 PRECEDING) AS late_count_3, sum(late) OVER (PARTITION BY entity_id ORDER BY month_index ROWS 11 PRECEDING) AS late_count_12,
    max(late) OVER w AS ever_late, CASE WHEN status_ord IS NOT NULL THEN max(status_ord) OVER w END AS worst_status, sum(late) OVER w AS island,
    (balance_clean - lag(balance_clean) OVER w) / nullif(abs(lag(balance_clean) OVER w), 0) AS balance_change_1, (balance_clean - lag(balance_clean, 3) OVER w) / nullif(abs(lag(balance_clean, 3) OVER w), 0) AS balance_change_3
  FROM base WINDOW w AS {_W}
),
feat AS (
  SELECT seq, status_ord, calendar_month, vintage_year, status_ord_lag1, status_ord_lag3, status_ord_lag6, dpd_clean_lag1, status_ord_delta, dpd_clean_delta, dpd_max_3, dpd_max_6, dpd_max_12, late_count_3, late_count_12, ever_late, worst_status,
    row_number() OVER (PARTITION BY entity_id, island ORDER BY month_index) - 1 AS clean_streak,
    round(balance_ratio, 5) AS balance_ratio, round(term_progress, 5) AS term_progress, round(rate_incentive, 5) AS rate_incentive, round(CASE WHEN rate_incentive IS NOT NULL THEN greatest(rate_incentive, 0) END, 5) AS incentive_positive,
    round(log_original_balance, 5) AS log_original_balance, round(log_balance, 5) AS log_balance, round(balance_change_1, 5) AS balance_change_1, round(balance_change_3, 5) AS balance_change_3,
    CASE WHEN abs(balance_change_1) < 1e-6 THEN 1 ELSE 0 END AS balance_flat, round(1 - balance_ratio, 5) AS amortisation,
    round(balance_ratio - (1 - pow(CASE WHEN term_progress IS NOT NULL THEN least(greatest(term_progress, 0), 1) END, 1.6e0)), 5) AS amortisation_residual,
    round(CASE WHEN pow(1 + rate_clean / 1200, greatest(age_clean + remaining_term_months, 1)) <> 1 THEN original_balance * (rate_clean / 1200) * pow(1 + rate_clean / 1200, greatest(age_clean + remaining_term_months, 1)) / (pow(1 + rate_clean / 1200, greatest(age_clean + remaining_term_months, 1)) - 1) END / nullif(balance_clean, 0), 5) AS payment_ratio,
    CASE WHEN age_clean <= -1 OR age_clean > 1000 THEN NULL WHEN age_clean <= 6 THEN 0 WHEN age_clean <= 12 THEN 1 WHEN age_clean <= 24 THEN 2 WHEN age_clean <= 36 THEN 3 WHEN age_clean <= 60 THEN 4 WHEN age_clean <= 120 THEN 5 WHEN age_clean <= 1000 THEN 6 END AS seasoning,
    round(CASE WHEN balance_change_1 IS NOT NULL THEN greatest(balance_change_1, 0) END, 5) AS growth_positive, CASE WHEN document_status <> 'complete' THEN 1 ELSE 0 END AS doc_problem, CASE WHEN source_system = 'manual_upload' THEN 1 ELSE 0 END AS manual_source,
    round(coalesce(balance_gap_rel, 0), 5) AS gap_filled, round(coalesce(dpd_gap, 0), 5) AS dpd_gap_filled, dpd_clean - {DAYS} AS dpd_status_residual, CASE dti_band WHEN '<=20' THEN 0 WHEN '20-30' THEN 1 WHEN '30-36' THEN 2 WHEN '36-43' THEN 3 WHEN '>43' THEN 4 END AS dti_ord,
    round(CASE WHEN pow(1 + rate_clean / 1200, greatest(age_clean + remaining_term_months, 1)) <> 1 THEN original_balance * (rate_clean / 1200) * pow(1 + rate_clean / 1200, greatest(age_clean + remaining_term_months, 1)) / (pow(1 + rate_clean / 1200, greatest(age_clean + remaining_term_months, 1)) - 1) END, 5) AS scheduled_payment,
    CASE WHEN property_type IS NULL THEN 1 ELSE 0 END AS property_type_missing, CASE WHEN occupancy_type IS NULL THEN 1 ELSE 0 END AS occupancy_type_missing, CASE WHEN rate_clean IS NULL THEN 1 ELSE 0 END AS rate_clean_missing, CASE WHEN dpd_clean IS NULL THEN 1 ELSE 0 END AS dpd_clean_missing,
    CASE WHEN interest_rate IS NULL THEN 1 ELSE 0 END + CASE WHEN credit_score_band IS NULL THEN 1 ELSE 0 END + CASE WHEN ltv_band IS NULL THEN 1 ELSE 0 END + CASE WHEN dti_band IS NULL THEN 1 ELSE 0 END + CASE WHEN days_past_due IS NULL THEN 1 ELSE 0 END AS missing_count
  FROM wide
)
"""


def _feat(*names: str) -> str:
    return select(f"{_FEATURED} SELECT seq, {', '.join(names)} FROM feat")


def targets_sql(default: str = "'DQ90plus', 'Default'") -> str:
    def any_of(states: str, h: int) -> str:
        hit = f"max(CASE WHEN next_state IN ({states}) THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY month_index ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
        seen = f"count(*) OVER (PARTITION BY entity_id ORDER BY month_index ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
        return f"CASE WHEN {hit} > 0 THEN 1e0 WHEN closed = 1 OR ({seen} >= {h} AND last - month_index >= {h}) THEN 0e0 END"

    late = "'DQ30', 'DQ60', 'DQ90plus', 'Default'"
    return f"""
, nexts AS (
  SELECT *, coalesce(lead(current_status) OVER w, CASE WHEN lead(month_index) OVER w IS NULL THEN CASE exit_code WHEN '01' THEN 'Prepaid' WHEN '02' THEN 'Default' END END) AS next_state, max(month_index) OVER () AS last
  FROM one WINDOW w AS {_W}
),
closing AS (SELECT *, max(CASE WHEN next_state IN ('Prepaid', 'Default', 'PaidOff') THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id) AS closed FROM nexts),
target AS (
  SELECT *, {any_of(late, 3)} AS next_3m_delinquency_flag, {any_of(late, 6)} AS next_6m_delinquency_flag, {any_of(default, 12)} AS next_12m_default_flag, {any_of("'Prepaid'", 12)} AS next_12m_prepayment_flag
  FROM closing
)
"""


def purged_sql(target: str, horizon: int, name: str = "split", source: str = "target") -> str:
    """A table of rows with their split; twelve months of test and validation."""
    test, valid = horizon + 5, 2 * horizon + 6
    return f"{name} AS (SELECT *, CASE WHEN {target} IS NULL OR month_index > last - {horizon} THEN 'excluded' WHEN month_index >= last - {test} THEN 'test' WHEN month_index <= last - {valid + 6} THEN 'train' WHEN month_index <= last - {valid} THEN 'valid' ELSE 'embargo' END AS split FROM {source})"


_PURGED = f"{targets_sql()}, split AS (SELECT *, CASE WHEN next_12m_default_flag IS NULL OR month_index > last - 12 THEN 'excluded' WHEN month_index >= last - 17 THEN 'test' WHEN month_index <= last - 36 THEN 'train' WHEN month_index <= last - 30 THEN 'valid' ELSE 'embargo' END AS split FROM target)"
_HASH = "CAST(concat('0x', substr(md5(concat({0}, '|{1}')), 1, 8)) AS BIGINT) / 4294967296e0"

ORACLES = {
    "f1_lags": _feat("status_ord_lag1", "status_ord_lag3", "status_ord_lag6", "dpd_clean_lag1"),
    "f2_deltas": _feat("status_ord_delta", "dpd_clean_delta"),
    "f3_rolling": _feat("dpd_max_3", "dpd_max_6", "dpd_max_12", "late_count_3", "late_count_12"),
    "f5_running": _feat("ever_late", "worst_status"),
    "f7_streak": _feat("clean_streak"),
    "f8_pct_change": _feat("balance_change_1", "balance_change_3", "balance_flat", "growth_positive"),
    "f10_ratios": _feat("balance_ratio", "term_progress", "log_original_balance", "log_balance", "amortisation"),
    "f12_incentive": _feat("rate_incentive", "incentive_positive"),
    "f13_annuity": _feat("payment_ratio"),
    "f14_missing_indicators": _feat("missing_count", "gap_filled"),
    "f17_gaps_and_payments": _feat(*MORE),
    "f16_residuals": _feat("amortisation_residual", "doc_problem", "manual_source"),
    "f18_bucket": _feat("seasoning", "calendar_month", "vintage_year"),
    "f20_build_features": _feat(*FEATURES),
    "f22_running_flag": select(f"SELECT seq, max(modification_flag) OVER {_W} AS ever_modified FROM one"),
    "f23_snapshot": select("SELECT entity_id, seq, month_index, current_status FROM one QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY month_index DESC) = 1"),
    "g1_status_next": select(f"{targets_sql()} SELECT seq, next_state FROM nexts"),
    "g3_attach_targets": select(f"{targets_sql()} SELECT seq, next_3m_delinquency_flag, next_6m_delinquency_flag, next_12m_default_flag, next_12m_prepayment_flag FROM target"),
    "g4_strict_default": select(targets_sql("'Default'") + " SELECT seq, next_12m_default_flag FROM target"),
    "h1_purged_split": select(f"{_PURGED} SELECT seq, split FROM split"),
    "h2_entity_disjoint_split": select(f"{_PURGED} SELECT seq, CASE WHEN split = 'test' AND NOT x < 0.35e0 THEN 'excluded' WHEN split IN ('train', 'valid') AND x < 0.35e0 THEN 'excluded' ELSE split END AS split FROM (SELECT *, {_HASH.format('entity_id', 11)} AS x FROM split)"),
    "h3_random_split": select(f"{targets_sql()} SELECT seq, CASE WHEN next_12m_default_flag IS NULL THEN 'excluded' WHEN x < 0.7e0 THEN 'train' WHEN x < 0.85e0 THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, {_HASH.format('seq', 13)} AS x FROM target)"),
    "h4_expanding_folds": select(f"{targets_sql()} SELECT split, count(*) AS rows, min(month_index) AS first_month, max(month_index) AS last_month, fold FROM (SELECT *, CASE WHEN next_12m_default_flag IS NULL OR month_index > last - 12 THEN 'excluded' WHEN month_index >= last - 17 THEN 'test' WHEN month_index <= last - 36 - 6 * fold THEN 'train' WHEN month_index <= last - 30 THEN 'valid' ELSE 'embargo' END AS split FROM target, (SELECT unnest([0, 1, 2]) AS fold)) GROUP BY split, fold"),
    "h5_split_summary": select(f"{_PURGED} SELECT split, count(*) AS rows, round(avg(next_12m_default_flag), 6) AS rate, count(DISTINCT entity_id) AS entities, min(month_index) AS first_month, max(month_index) AS last_month, count(DISTINCT CASE WHEN entity_id IN (SELECT entity_id FROM split WHERE split = 'train') THEN entity_id END) AS shared_with_train FROM split GROUP BY 1"),
}
