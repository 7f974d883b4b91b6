"""Queries over metrics, survival curves and transitions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import labels as L
from panelwright.operators import metrics as M
from panelwright.operators import survival as S
from panelwright.operators.models import markov_scores
from panelwright.plans.oracle import PAIRS_VIEW, select
from panelwright.plans.panel import EXITS, targeted, targets_sql
from panelwright.plans.quality import cleaned, deduped, rounded, scored
from panelwright.sources.session import saved
from panelwright.sources.tables import Tables


def frame(t: Tables):
    return S.survival_frame(L.status_next(cleaned(t), EXITS))


def matrix(t: Tables):
    return S.transition_matrix(L.status_next(deduped(t), EXITS))


def _classes(t):
    said = F.when(F.col("l_linestatus") == "F", F.when(F.col("p") > 0.5, "R").otherwise("A")).otherwise("N")
    raw = [F.col("p"), 1 - F.col("p"), (F.col("l_suppkey") % 10) / 10]
    return t.pairs().withColumn("said", said).withColumn("scores", F.array(*[F.round((x + 0.1) / (raw[0] + raw[1] + raw[2] + 0.3), 12) for x in raw]))


def _markov(t):
    """Rows from month 50 on, scored by the transitions before it; Default is left out of these, so that one state is unseen."""
    rows = L.status_next(deduped(t), EXITS)
    out, _ = markov_scores(rows.filter("month_index < 50 AND current_status <> 'Default'"), rows.filter("month_index >= 50"))
    return rounded(out.groupBy("current_status", "said").agg(F.count("*").alias("rows"), F.max(F.array_max("scores")).alias("p")), "p")


def _compare(t):
    pairs = t.pairs().withColumn("q", F.round(1 - F.col("p"), 3))
    one = M.binary_metrics(pairs, p="p").select(F.lit("returned").alias("target"), F.lit("plain").alias("model"), "roc_auc")
    two = M.binary_metrics(pairs, p="q").select(F.lit("returned").alias("target"), F.lit("flipped").alias("model"), "roc_auc")
    return M.compare_models(one.unionByName(two), ["flipped", "plain"], "roc_auc")


def _milestones(t):
    km = S.kaplan_meier(frame(t), "event_default", by="state")
    return km.filter(F.col("age").isin(12.0, 24.0, 36.0, 48.0, 60.0)).withColumn("age", F.col("age").cast("int")).groupBy("state").pivot("age", [12, 24, 36, 48, 60]).agg(F.round(F.first("cumulative"), 6))


def _paths(t):
    p = S.project_states(matrix(t), 6).filter("state = 'Default'")
    return p.groupBy("horizon_month").pivot("start_state", S.STATES).agg(F.round(F.first("p"), 6))


def _overstated(t):
    v = saved(frame(t), "frame")
    return rounded(S.overstatement(S.cumulative_incidence(v), S.kaplan_meier(v, "event_default")).select("age", "overstatement"), "overstatement")


TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

QUERIES = {
    "i1_prior": lambda t: rounded(t.pairs().agg(F.avg("y").alias("prior"), F.count("*").alias("n")), "prior"),
    "i7_thresholds": lambda t: rounded(M.recall_at_precision(t.pairs(), 0.3).unionByName(M.recall_at_precision(t.pairs(), 0.5)).unionByName(M.recall_at_precision(t.pairs(), 0.999)), "recall", "best_precision"),
    "i10_markov_classifier": _markov,
    "i11_persistence": lambda t: M.per_class(L.status_next(deduped(t), EXITS).filter("next_state is not null"), "next_state", "current_status").select("class", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1")),
    "j1_pr_curve": lambda t: rounded(M.pr_curve(t.pairs()).select("threshold", "tp", "fp", "precision", "recall"), "precision", "recall"),
    "j3_best_f1": lambda t: rounded(M.best_f1(t.pairs()), "f1"),
    "j8_lift_at_k": lambda t: rounded(M.lift_at_k(t.pairs(), 0.1, TIES), "base", "rate", "lift"),
    "j9_binary_metrics": lambda t: rounded(M.binary_metrics(t.pairs()), "rate", "roc_auc", "average_precision", "lift", "ks", "brier", "log_loss"),
    "j10_multiclass_metrics": lambda t: rounded(M.multiclass_metrics(_classes(t), "l_returnflag", "said", "scores", ["A", "N", "R"]), "accuracy", "macro_f1", "weighted_f1", "log_loss", "macro_roc_auc"),
    "j11_per_class": lambda t: rounded(M.per_class(_classes(t), "l_returnflag", "said"), "precision", "recall", "f1"),
    "j12_calibration_table": lambda t: rounded(M.calibration_table(t.pairs()), "mean_score", "observed", "gap"),
    "j13_calibration_error": lambda t: rounded(M.expected_calibration_error(t.pairs()), "ece"),
    "j14_agreement": lambda t: rounded(M.agreement(t.pairs(), 0.06), "cut", "flagged", "precision", "recall", "base", "lift"),
    "j15_error_by_segment": lambda t: rounded(M.error_by_segment(t.pairs(), "l_linestatus", 0.6), "actual", "predicted", "false_positive", "false_negative", "gap"),
    "j16_error_profile": lambda t: rounded(M.error_profile(t.pairs().withColumn("suppkey", F.col("l_suppkey").cast("double")).withColumn("partkey", F.col("l_partkey").cast("double")), ["suppkey", "partkey"], 0.6), "mean", digits=4),
    "j17_compare_models": lambda t: rounded(_compare(t), "flipped", "plain", "gain"),
    "k1_survival_frame": lambda t: rounded(frame(t), "rate", "log_original_balance"),
    "k2_low_score_groups": lambda t: S.low_score_groups(scored(t), "servicer_name"),
    "k3_kaplan_meier": lambda t: rounded(S.kaplan_meier(frame(t), "event_default"), "survival", "cumulative"),
    "k4_cumulative_incidence": lambda t: rounded(S.cumulative_incidence(frame(t)), "cif_first", "cif_second", "event_free"),
    "k5_overstatement": _overstated,
    "k7_concordance": lambda t: rounded(S.concordance(frame(t).filter("rate is not null"), "exit_age", "event_default", "rate"), "concordance"),
    "k8_transition_matrix": lambda t: rounded(matrix(t), "p"),
    "k9_project_states": lambda t: rounded(S.project_states(matrix(t), 12), "p"),
    "k10_projected_vs_observed": lambda t: rounded(S.projected_vs_observed(matrix(t), targeted(t)), "observed", "projected", "error"),
    "k11_milestones": _milestones,
    "k12_censoring_summary": lambda t: S.censoring_summary(frame(t)),
    "k13_pivot_path": _paths,
}

_CURVE = f"""WITH pairs AS ({PAIRS_VIEW}), c AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM pairs GROUP BY 1),
curve AS (SELECT p AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS a, sum(neg) OVER () AS b FROM c WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, tp / (tp + fp) AS precision, tp / a AS recall FROM curve)
"""
_RAP = "SELECT {0}e0 AS target, round(coalesce((SELECT max(recall) FROM pr WHERE precision >= {0}e0), 0), 6) AS recall, (SELECT min(threshold) FROM pr WHERE precision >= {0}e0 AND recall = (SELECT max(recall) FROM pr WHERE precision >= {0}e0)) AS threshold, round((SELECT max(precision) FROM pr), 6) AS best_precision"
_BINARY = "(SELECT sum(pos * (b - fp + neg / 2)) / max(a * b) FROM curve)"
_PER = """per AS (SELECT class, coalesce(support, 0) AS support, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(said + support, 0), 0) AS f1
  FROM (SELECT class, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(said, 0) AS said FROM (SELECT y AS class, count(*) AS support, sum(CASE WHEN y = h THEN 1 ELSE 0 END) AS hit FROM yh GROUP BY 1) FULL JOIN (SELECT h AS class, count(*) AS said FROM yh GROUP BY 1) USING (class)))"""
_YH = f"WITH pairs AS ({PAIRS_VIEW}), yh AS (SELECT l_returnflag AS y, CASE WHEN l_linestatus = 'F' THEN CASE WHEN p > 0.5e0 THEN 'R' ELSE 'A' END ELSE 'N' END AS h FROM pairs), {_PER} "
_BINS = f"WITH pairs AS ({PAIRS_VIEW}), e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM pairs), bins AS (SELECT greatest(1, len(list_filter(edges, lambda x: x < p))) AS bin, y, p FROM pairs, e), t AS (SELECT bin, count(*) AS n, avg(p) AS mean_score, avg(y) AS observed, avg(y) - avg(p) AS gap FROM bins GROUP BY 1) "

_FRAME = f"""{targets_sql()}
, withnext AS (SELECT c.*, n.next_state FROM clean c JOIN (SELECT seq, next_state FROM nexts) n USING (seq)),
agg AS (
  SELECT entity_id, greatest(min(age_clean), 0) AS entry_age, greatest(max(age_clean), 0) AS last_age, max(month_index) AS last_month, min(CASE WHEN current_status IN ('DQ90plus', 'Default') THEN age_clean END) AS t_default,
    arg_max(next_state, month_index) FILTER (WHERE next_state IS NOT NULL) AS last_state, median(rate_clean) AS rate, (SELECT max(month_index) FROM one) AS panel_end,
    arg_min(credit_score_band, month_index) FILTER (WHERE credit_score_band IS NOT NULL) AS credit_score_band, arg_min(servicer_name, month_index) AS servicer_name, arg_min(state, month_index) AS state,
    arg_min(occupancy_type, month_index) FILTER (WHERE occupancy_type IS NOT NULL) AS occupancy_type, arg_min(original_balance, month_index) AS original_balance
  FROM withnext GROUP BY 1
),
ev AS (SELECT *, CASE WHEN last_state = 'Prepaid' THEN last_age END AS t_prepay FROM agg),
evs AS (SELECT *, CASE WHEN t_default IS NOT NULL AND (t_prepay IS NULL OR t_default <= t_prepay) THEN 1 ELSE 0 END AS event_default FROM ev),
evp AS (SELECT *, CASE WHEN t_prepay IS NOT NULL AND event_default = 0 THEN 1 ELSE 0 END AS event_prepay, CASE WHEN event_default = 1 THEN t_default ELSE last_age END AS ex FROM evs),
v AS (
  SELECT entity_id, entry_age, greatest(CAST(ex AS DOUBLE), entry_age + 0.5e0) AS exit_age, greatest(CAST(ex - entry_age AS DOUBLE), 0.5e0) AS duration, event_default, event_prepay, event_default + event_prepay AS event_any,
    CASE WHEN event_default = 1 THEN 'default' WHEN event_prepay = 1 THEN 'prepay' ELSE 'censored' END AS event_type, CASE WHEN event_default + event_prepay = 0 AND last_month >= panel_end THEN 1 ELSE 0 END AS administratively_censored,
    CASE WHEN entry_age > 0 THEN 1 ELSE 0 END AS left_truncated, round(rate, 6) AS rate, round(ln(1 + original_balance), 6) AS log_original_balance, CASE WHEN occupancy_type = 'investment' THEN 1 ELSE 0 END AS is_investment, credit_score_band, servicer_name, state
  FROM evp
)
"""
_RISK = """
, risk AS (SELECT age, d, p, (SELECT count(*) FROM v WHERE entry_age < age AND exit_age >= age) AS at_risk FROM (SELECT exit_age AS age, sum(event_default) AS d, sum(event_prepay) AS p FROM v GROUP BY 1)),
km AS (SELECT age, CASE WHEN max(CASE WHEN d = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(ln(CASE WHEN d = at_risk THEN 1 ELSE 1 - d / at_risk END)) OVER w) END AS s FROM risk WHERE at_risk > 0 WINDOW w AS (ORDER BY age)),
grid AS (SELECT CAST(unnest(range(0, 121)) AS DOUBLE) AS age),
kmgrid AS (SELECT g.age, coalesce(k.s, 1) AS survival, 1 - coalesce(k.s, 1) AS cumulative FROM grid g ASOF LEFT JOIN km k ON g.age >= k.age),
aj0 AS (SELECT age, at_risk, d, p, CASE WHEN max(CASE WHEN d + p = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(ln(CASE WHEN d + p = at_risk THEN 1 ELSE 1 - (d + p) / at_risk END)) OVER w) END AS f FROM risk WHERE at_risk > 0 AND d + p > 0 AND age <= 120 WINDOW w AS (ORDER BY age)),
aj AS (SELECT age, at_risk, sum(b * d / at_risk) OVER w AS cif_first, sum(b * p / at_risk) OVER w AS cif_second, f AS event_free FROM (SELECT *, coalesce(lag(f) OVER (ORDER BY age), 1) AS b FROM aj0) WINDOW w AS (ORDER BY age))
"""
_STATES = ", ".join(f"'{s}'" for s in S.STATES)
_MATRIX = f"""{targets_sql()}
, states AS (SELECT unnest([{_STATES}]) AS s),
cells AS (SELECT a.s AS from_state, b.s AS to_state, (SELECT count(*) FROM nexts WHERE current_status = a.s AND next_state = b.s) AS n FROM states a, states b),
matrix AS (SELECT from_state, to_state, n, CASE WHEN from_state IN ('Default', 'Prepaid') THEN CASE WHEN from_state = to_state THEN 1e0 ELSE 0e0 END ELSE (n + 0.25e0) / sum(n + 0.25e0) OVER (PARTITION BY from_state) END AS p FROM cells)
"""
_POWERS = (
    ", p1 AS (SELECT from_state AS start_state, to_state AS state, p FROM matrix)"
    + "".join(f", p{k} AS (SELECT x.start_state, m.to_state AS state, sum(x.p * m.p) AS p FROM p{k - 1} x JOIN matrix m ON x.state = m.from_state GROUP BY 1, 2)" for k in range(2, 13))
    + ", powers AS (" + " UNION ALL ".join(f"SELECT *, {k} AS horizon_month FROM p{k}" for k in range(1, 13)) + ")"
)

ORACLES = {
    "i1_prior": f"SELECT round(avg(y), 6) AS prior, count(*) AS n FROM ({PAIRS_VIEW})",
    "i7_thresholds": _CURVE + " UNION ALL ".join(_RAP.format(x) for x in ("0.3", "0.5", "0.999")),
    "i10_markov_classifier": select(f"""{targets_sql()}, old AS (SELECT current_status AS s, next_state AS y FROM nexts WHERE month_index < 50 AND current_status <> 'Default' AND next_state IS NOT NULL), ys AS (SELECT DISTINCT y FROM old),
own AS (SELECT s, y, (SELECT count(*) FROM old o WHERE o.s = a.s AND o.y = ys.y) + 0.5e0 AS n FROM (SELECT DISTINCT s FROM old) a, ys), alls AS (SELECT y, count(*) + 1e0 AS n FROM old GROUP BY 1),
said AS (SELECT s, first(y ORDER BY n DESC, y) AS said, max(n) / sum(n) AS p FROM own GROUP BY 1), prior AS (SELECT first(y ORDER BY n DESC, y) AS said, max(n) / sum(n) AS p FROM alls)
SELECT current_status, coalesce(d.said, prior.said) AS said, count(*) AS rows, round(max(coalesce(d.p, prior.p)), 6) AS p FROM nexts LEFT JOIN said d ON current_status = d.s, prior WHERE month_index >= 50 GROUP BY 1, 2"""),
    "i11_persistence": select(f"{targets_sql()}, yh AS (SELECT next_state AS y, current_status AS h FROM nexts WHERE next_state IS NOT NULL), {_PER} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per"),
    "j1_pr_curve": _CURVE + "SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr",
    "j3_best_f1": _CURVE + ", f AS (SELECT threshold, 2 * precision * recall / (precision + recall) AS f1 FROM pr) SELECT round(max(f1), 6) AS f1, (SELECT min(threshold) FROM f WHERE f1 = (SELECT max(f1) FROM f)) AS threshold FROM f",
    "j8_lift_at_k": f"WITH pairs AS ({PAIRS_VIEW}), r AS (SELECT y, row_number() OVER (ORDER BY p DESC, {', '.join(TIES)}) AS k, count(*) OVER () AS n FROM pairs) SELECT 0.1e0 AS share, CAST(floor(max(n) * 0.1e0) AS BIGINT) AS rows, round(avg(y), 6) AS base, round(avg(y) FILTER (WHERE k <= floor(n * 0.1e0)), 6) AS rate, round(avg(y) FILTER (WHERE k <= floor(n * 0.1e0)) / avg(y), 6) AS lift FROM r",
    "j9_binary_metrics": _CURVE + f"SELECT count(*) AS n, round(avg(y), 6) AS rate, round({_BINARY}, 6) AS roc_auc, round((SELECT sum(pos / a * precision) FROM pr), 6) AS average_precision, round((SELECT sum(pos / a * precision) FROM pr) / avg(y), 6) AS lift, round((SELECT max(abs(tp / a - fp / b)) FROM curve), 6) AS ks, round(avg((p - y) ** 2), 6) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-7), 1 - 1e-7)) ELSE ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)) END), 6) AS log_loss FROM pairs",
    "j10_multiclass_metrics": _YH + """, sc AS (SELECT l_returnflag AS y, c, (CASE c WHEN 'A' THEN p WHEN 'N' THEN 1 - p ELSE (l_suppkey % 10) / 10e0 END + 0.1e0) / (1 + (l_suppkey % 10) / 10e0 + 0.3e0) AS s FROM pairs, (VALUES ('A'), ('N'), ('R')) k(c)),
ct AS (SELECT c, s, sum(CASE WHEN y = c THEN 1 ELSE 0 END) AS a, sum(CASE WHEN y = c THEN 0 ELSE 1 END) AS b FROM (SELECT y, c, round(s, 12) AS s FROM sc) GROUP BY 1, 2),
au AS (SELECT c, sum(a * (below + b / 2)) / (sum(a) * sum(b)) AS auc FROM (SELECT *, coalesce(sum(b) OVER (PARTITION BY c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ct) GROUP BY 1)
SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, (SELECT round(avg(-ln(s)), 6) FROM sc WHERE c = y) AS log_loss, (SELECT round(avg(auc), 6) FROM au) AS macro_roc_auc FROM per""",
    "j11_per_class": _YH + "SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per",
    "j12_calibration_table": _BINS + "SELECT bin, n, round(mean_score, 6) AS mean_score, round(observed, 6) AS observed, round(gap, 6) AS gap FROM t",
    "j13_calibration_error": _BINS + "SELECT round(sum(abs(gap) * n) / sum(n), 6) AS ece FROM t",
    "j14_agreement": f"WITH pairs AS ({PAIRS_VIEW}), f AS (SELECT y, c, CASE WHEN p >= c THEN 1 ELSE 0 END AS f FROM pairs, (SELECT quantile_cont(p, 0.94e0) AS c FROM pairs)) SELECT round(max(c), 6) AS cut, round(avg(f), 6) AS flagged, round(sum(f * y) / sum(f), 6) AS precision, round(sum(f * y) / sum(y), 6) AS recall, round(avg(y), 6) AS base, round(sum(f * y) / sum(f) / avg(y), 6) AS lift FROM f",
    "j15_error_by_segment": f"SELECT l_linestatus, count(*) AS n, round(avg(y), 6) AS actual, round(avg(p), 6) AS predicted, round(avg(CASE WHEN p >= 0.6e0 AND y = 0 THEN 1 ELSE 0 END), 6) AS false_positive, round(avg(CASE WHEN p < 0.6e0 AND y = 1 THEN 1 ELSE 0 END), 6) AS false_negative, round(avg(p) - avg(y), 6) AS gap FROM ({PAIRS_VIEW}) GROUP BY 1",
    "j16_error_profile": f"WITH k AS (SELECT CASE WHEN p >= 0.6e0 AND y = 0 THEN 'false_positive' WHEN p < 0.6e0 AND y = 1 THEN 'false_negative' WHEN p >= 0.6e0 THEN 'true_positive' ELSE 'true_negative' END AS kind, * FROM ({PAIRS_VIEW})) SELECT kind, 'suppkey' AS \"column\", round(avg(l_suppkey), 4) AS mean FROM k GROUP BY 1 UNION ALL SELECT kind, 'partkey', round(avg(l_partkey), 4) FROM k GROUP BY 1",
    "j17_compare_models": _CURVE + f"SELECT 'returned' AS target, round(1 - {_BINARY}, 6) AS flipped, round({_BINARY}, 6) AS plain, round(2 * {_BINARY} - 1, 6) AS gain",
    "k1_survival_frame": select(f"{_FRAME} SELECT * FROM v"),
    "k2_low_score_groups": select(", m AS (SELECT servicer_name, avg(dq_score) AS m FROM scored WHERE servicer_name IS NOT NULL GROUP BY 1) SELECT servicer_name FROM m WHERE m <= (SELECT quantile_cont(m, 0.25e0) FROM m)"),
    "k3_kaplan_meier": select(f"{_FRAME} {_RISK} SELECT age, round(survival, 6) AS survival, round(cumulative, 6) AS cumulative FROM kmgrid"),
    "k4_cumulative_incidence": select(f"{_FRAME} {_RISK} SELECT age, at_risk, round(cif_first, 6) AS cif_first, round(cif_second, 6) AS cif_second, round(event_free, 6) AS event_free FROM aj"),
    "k5_overstatement": select(f"{_FRAME} {_RISK} SELECT a.age, round(k.cumulative - a.cif_first, 6) AS overstatement FROM aj a ASOF LEFT JOIN kmgrid k ON a.age >= k.age"),
    "k7_concordance": select(f"{_FRAME} SELECT sum(w) AS pairs, round(sum(w * r) / sum(w), 6) AS concordance FROM (SELECT 1 AS w, CASE WHEN y.rate < x.rate THEN 1e0 WHEN y.rate = x.rate THEN 0.5e0 ELSE 0 END AS r FROM v x JOIN v y ON (y.exit_age > x.exit_age OR (y.exit_age = x.exit_age AND y.event_default = 0)) WHERE x.event_default = 1 AND x.rate IS NOT NULL AND y.rate IS NOT NULL)"),
    "k8_transition_matrix": select(f"{_MATRIX} SELECT from_state, to_state, n, round(p, 6) AS p FROM matrix"),
    "k9_project_states": select(f"{_MATRIX} {_POWERS} SELECT start_state, state, round(p, 6) AS p, horizon_month FROM powers"),
    "k10_projected_vs_observed": select(f"{_MATRIX} {_POWERS} SELECT o.start_state, o.n, round(o.observed, 6) AS observed, round(p.p, 6) AS projected, round(abs(p.p - o.observed), 6) AS error FROM (SELECT current_status AS start_state, count(*) AS n, avg(next_12m_default_flag) AS observed FROM target WHERE next_12m_default_flag IS NOT NULL GROUP BY 1 HAVING count(*) >= 30) o JOIN powers p ON p.start_state = o.start_state AND p.horizon_month = 12 AND p.state = 'Default'"),
    "k11_milestones": select(f"{_FRAME}, big AS (SELECT state FROM v GROUP BY 1 HAVING count(*) >= 40), risk AS (SELECT state, age, d, (SELECT count(*) FROM v w WHERE w.state = x.state AND entry_age < age AND exit_age >= age) AS at_risk FROM (SELECT state, exit_age AS age, sum(event_default) AS d FROM v JOIN big USING (state) GROUP BY 1, 2) x), km AS (SELECT state, age, CASE WHEN max(CASE WHEN d = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(ln(CASE WHEN d = at_risk THEN 1 ELSE 1 - d / at_risk END)) OVER w) END AS s FROM risk WHERE at_risk > 0 WINDOW w AS (PARTITION BY state ORDER BY age)), seen AS (SELECT state, g, 1 - coalesce((SELECT arg_max(s, age) FROM km WHERE km.state = big.state AND age <= g), 1) AS c FROM big, (SELECT unnest([12, 24, 36, 48, 60]) AS g)) SELECT state, " + ", ".join(f'round(max(CASE WHEN g = {g} THEN c END), 6) AS \"{g}\"' for g in (12, 24, 36, 48, 60)) + " FROM seen GROUP BY 1"),
    "k12_censoring_summary": select(f"{_FRAME} SELECT event_type, count(*) AS n, median(duration) AS median_duration, sum(administratively_censored) AS administrative, sum(left_truncated) AS left_truncated FROM v GROUP BY 1"),
    "k13_pivot_path": select(f"{_MATRIX} {_POWERS} SELECT horizon_month, " + ", ".join(f"round(max(CASE WHEN start_state = '{s}' THEN p END), 6) AS \"{s}\"" for s in S.STATES) + " FROM powers WHERE state = 'Default' AND horizon_month <= 6 GROUP BY 1"),
}
