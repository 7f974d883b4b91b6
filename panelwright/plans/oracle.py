"""DuckDB SQL that follows the operators step by step, as common table expressions that the single checks select from."""

from __future__ import annotations

from panelwright.sources.tables import FEED, MACRO, PAIRS, PANEL

_NAMES = {n: n for n in ("orders", "customer", "nation", "region", "lineitem")}

RULES = {
    "origination_after_reporting": (14.0, "orig_pno > pno"),
    "last_updated_before_period_end": (8.0, "last_updated_at < period_end"),
    "loan_age_inconsistent": (9.0, "abs(loan_age_months - (pno - orig_pno)) > 2"),
    "negative_balance": (16.0, "current_balance < 0"),
    "balance_exceeds_original": (12.0, "current_balance > original_balance * 1.02e0"),
    "balance_increase_mom": (7.0, "balance_growth > 0.005e0 AND modification_flag = 0"),
    "dpd_sentinel": (10.0, "days_past_due IN (9999, -1, 999)"),
    "status_dpd_mismatch": (11.0, "abs(dpd_clean - expected_dpd) > 29"),
    "rate_out_of_range": (10.0, "interest_rate <= 0.5e0 OR interest_rate > 25"),
    "remaining_term_inconsistent": (6.0, "coalesce(loan_age_months + remaining_term_months NOT IN (180, 240, 360), true)"),
    "missing_critical_field": (9.0, "credit_score_band IS NULL OR ltv_band IS NULL OR dti_band IS NULL"),
    "document_incomplete": (7.0, "document_status IN ('missing', 'exception')"),
    "stale_reporting": (6.0, "lag_days > 75"),
    "feed_balance_break": (13.0, "balance_gap_rel > 0.01e0 AND balance_gap > 500"),
    "feed_status_conflict": (11.0, "status_conflict = 1"),
    "feed_record_absent": (3.0, "svc_present = 0"),
    "terminal_with_balance": (12.0, "current_status IN ('Prepaid', 'PaidOff', 'Default') AND current_balance > 1000"),
}
_FLAGS = ", ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END AS vr_{n}" for n, (_, p) in RULES.items())
_PENALTY = " + ".join(f"vr_{n} * {s}e0" for n, (s, _) in RULES.items())
_COUNT = " + ".join(f"vr_{n}" for n in RULES)
DAYS = "CASE current_status WHEN 'DQ30' THEN 30 WHEN 'DQ60' THEN 60 WHEN 'DQ90plus' THEN 90 WHEN 'Default' THEN 180 WHEN 'Current' THEN 0 WHEN 'Prepaid' THEN 0 WHEN 'PaidOff' THEN 0 END"
STATUS = "CASE current_status WHEN 'Current' THEN 0 WHEN 'DQ30' THEN 1 WHEN 'DQ60' THEN 2 WHEN 'DQ90plus' THEN 3 WHEN 'Default' THEN 4 WHEN 'Prepaid' THEN -1 WHEN 'PaidOff' THEN -1 END"
MACRO_VIEW = MACRO.format(**_NAMES)
PAIRS_VIEW = PAIRS.format(**_NAMES)

PREFIX = f"""
WITH raw AS ({PANEL.format(**_NAMES)}),
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY entity_id, month_index ORDER BY seq) = 1),
feed AS ({FEED.format(**_NAMES)}),
latest AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY entity_id, month_index ORDER BY received_at DESC NULLS FIRST, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1),
macro AS ({MACRO_VIEW}),
recon AS (
  SELECT p.*, f.reported_balance AS svc_balance, f.reported_status AS svc_status, f.reported_dpd AS svc_dpd,
    CASE WHEN f.reported_balance IS NULL THEN 0 ELSE 1 END AS svc_present, abs(f.reported_balance - current_balance) AS balance_gap,
    abs(f.reported_balance - current_balance) / nullif(abs(current_balance), 0) AS balance_gap_rel,
    CASE WHEN f.reported_balance IS NOT NULL AND f.reported_status <> current_status THEN 1 ELSE 0 END AS status_conflict,
    abs(f.reported_dpd - days_past_due) AS dpd_gap
  FROM one p LEFT JOIN latest f USING (entity_id, month_index)
),
clean AS (
  SELECT *,
    CASE WHEN days_past_due IN (9999, -1, 999) OR days_past_due < 0 OR days_past_due > 400 THEN NULL ELSE days_past_due END AS dpd_clean,
    CASE WHEN days_past_due IN (9999, -1, 999) OR days_past_due < 0 OR days_past_due > 400 THEN 1 ELSE 0 END AS dpd_repaired,
    CASE WHEN interest_rate <= 0.5e0 OR interest_rate > 25 THEN NULL ELSE interest_rate END AS rate_clean,
    CASE WHEN interest_rate <= 0.5e0 OR interest_rate > 25 THEN 1 ELSE 0 END AS rate_repaired,
    CASE WHEN current_balance < 0 OR current_balance > 3 * original_balance THEN NULL ELSE current_balance END AS balance_clean,
    CASE WHEN current_balance < 0 OR current_balance > 3 * original_balance THEN 1 ELSE 0 END AS balance_repaired,
    CASE WHEN abs(loan_age_months - (pno - orig_pno)) > 2 THEN 1 ELSE 0 END AS age_repaired,
    CASE WHEN (CASE WHEN abs(loan_age_months - (pno - orig_pno)) > 2 THEN pno - orig_pno ELSE loan_age_months END) >= 0
      THEN (CASE WHEN abs(loan_age_months - (pno - orig_pno)) > 2 THEN pno - orig_pno ELSE loan_age_months END) END AS age_clean,
    date_diff('day', CAST(period_end AS DATE), CAST(last_updated_at AS DATE)) AS lag_days,
    CASE WHEN date_diff('day', CAST(period_end AS DATE), CAST(last_updated_at AS DATE)) > 75 THEN 1 ELSE 0 END AS is_stale
  FROM recon
),
ready AS (
  SELECT *, CASE WHEN abs(prev_balance) > 1 THEN (current_balance - prev_balance) / abs(prev_balance) ELSE 0 END AS balance_growth, {DAYS} AS expected_dpd
  FROM (SELECT *, lag(current_balance) OVER (PARTITION BY entity_id ORDER BY month_index) AS prev_balance FROM clean)
),
flags AS (SELECT *, {_FLAGS} FROM ready),
scored AS (
  SELECT *, CASE WHEN dq_score <= 50 THEN 'critical' WHEN dq_score <= 75 THEN 'poor' WHEN dq_score <= 90 THEN 'watch' ELSE 'clean' END AS dq_band
  FROM (SELECT *, {_PENALTY} AS penalty, greatest(0, least(100, 100 - ({_PENALTY}))) AS dq_score, {_COUNT} AS violations FROM flags)
)
"""


def select(body: str) -> str:
    return PREFIX + body


def unpivoted(columns: list[str], source: str, name: str, value: str, expression: str) -> str:
    """One row for each column, of an expression in `{}`."""
    return " UNION ALL ".join(f"SELECT '{c}' AS {name}, {expression.format(c)} AS {value} FROM {source}" for c in columns)
