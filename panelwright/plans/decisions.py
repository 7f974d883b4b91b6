"""Queries over scenarios, review, attributions, actions and the text guard, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.columns import bucket
from panelwright.operators import features as X
from panelwright.operators import joins
from panelwright.operators import labels as L
from panelwright.operators import review as R
from panelwright.operators import scenarios as Z
from panelwright.operators import survival as S
from panelwright.operators import textguard as G
from panelwright.plans.evaluation import _MATRIX, _POWERS, matrix
from panelwright.plans.oracle import PAIRS_VIEW, STATUS, select
from panelwright.plans.panel import EXITS, featured, targets_sql
from panelwright.plans.quality import deduped, rounded, scored
from panelwright.sources.session import saved
from panelwright.sources.tables import Tables


def snap(t: Tables):
    return X.snapshot(featured(t)).filter("rate_clean is not null")


def scen(t: Tables):
    return Z.build_scenarios(t.macro())


def _cross(t):
    out = Z.apply_scenario(snap(t), scen(t), 12)
    return rounded(out.select("seq", "scenario_name", (F.col("rate_clean") - F.col("scn_market_mortgage_rate")).alias("incentive"), (F.col("scn_unemployment_rate") - F.col("unemployment_rate")).alias("unemployment_gap")), "incentive", "unemployment_gap", digits=5)


def _fit(t):
    rates = Z.monthly_rates(L.status_next(featured(t).drop("next_state"), EXITS))
    return rounded(Z.macro_transition_fit(rates, t.macro()), "intercept", "unemployment_rate", "hpi_yoy_growth", "rate_incentive", "r2", digits=4)


SHIFTS = {"Current": (0.4, -0.2), "DQ30": (0.3, 0.0), "DQ60": (0.2, 0.1)}


def ranked(t: Tables):
    """Scored records with an anomaly score, a probability and a predicted type, for the review operators; what they read of them is written once."""
    rows = saved(scored(t).select("seq", "servicer_name", "violations", (F.col("penalty") + F.col("seq") % 7).alias("raw")), "ranked")
    out = R.rescale(rows, "raw", "score")
    kind = F.when(F.col("seq") % 3 == 0, "document_breach").when(F.col("seq") % 3 == 1, "date_breach").otherwise("dpd_breach")
    return out.withColumn("probability", F.col("violations") / 17).withColumn("predicted_type", kind)


COEFFICIENTS = {"dpd_clean": 0.02, "balance_growth": 0.5, "rate_clean": -0.3}


def attributed(t: Tables):
    return R.linear_attributions(scored(t), COEFFICIENTS, ["seq"])


def probabilities(t: Tables):
    return deduped(t).select("seq", "current_status", *[((F.col("seq") * k % 97) / 97.0).alias(n) for n, k in (("exception_probability", 3), ("prob_default_12m", 5), ("prob_delinquency_3m", 7), ("prob_delinquency_6m", 11), ("prob_prepayment_12m", 13))])


def _driven(t):
    rows = scored(t).select("seq", "month_index", F.coalesce("dpd_clean", F.lit(0.0)).alias("dpd"), "lag_days", "penalty", "loan_age_months")
    return R.robust_drivers(rows, ["dpd", "lag_days", "penalty", "loan_age_months"], fit_on="month_index < 50")


def _attached(t):
    card = scored(t).select("seq", "current_status", "violations", "dq_score")
    drivers = _driven(t).select("seq", F.array_join("drivers", "|").alias("drivers"))
    return joins.attach_scores(card, drivers, ["seq"])


def _queue(t):
    return rounded(R.review_queue(ranked(t), 50).select("seq", "priority", "predicted_type"), "priority")


def _advised(t):
    """Documents with a sentence that quotes a number of theirs and points at a field, and the fields' values: every third status is complete, every fourth flag is 0."""
    i = F.col("doc_id")
    said = F.when(i % 5 == 0, F.concat(F.lit(" Reviewer to verify the document status of "), i.cast("string"))).when(i % 5 == 1, F.concat(F.lit("\n12. Confirm modification_flag by model, 0.5 "), (i + 7).cast("string"))).when(i % 5 == 2, " This will default. 100.3").otherwise("")
    docs = t.raw("documents").select("doc_id", F.concat("text", said).alias("text"), "n_chars")
    return docs.withColumns({"document_status": F.when(i % 3 == 0, " Complete ").otherwise("missing"), "modification_flag": i % 4})


def _guard(t):
    guarded = G.grounding_check(_advised(t), "text", F.array(F.col("doc_id").cast("double"), F.col("n_chars").cast("double")))
    return G.usefulness_check(guarded, "text", ["document_status", "modification_flag"])


def _latex(t):
    """Sentences with LaTeX around numbers of each document."""
    i, k = F.col("doc_id").cast("string"), (F.col("doc_id") % 7).cast("string")
    said = F.concat(F.lit("of -"), i, F.lit(r".5 \times 10^{-"), k, F.lit(r"} and $10 ^ "), k, F.lit(r"$ \cdot 2, not 2"), i, F.lit("10^3 nor "), k, F.lit("times 10^x"))
    return t.raw("documents").select("doc_id", G.latex_flags(said).alias("latex"), G.normalise_latex(said).alias("plain"))


QUERIES = {
    "c12_attach_scores": _attached,
    "l1_build_scenarios": scen,
    "l2_apply_scenario": _cross,
    "l3_score_scenarios": lambda t: rounded(Z.score_scenarios(snap(t), scen(t)), "mean_score", "delta", "relative"),
    "l4_segment_impacts": lambda t: rounded(Z.segment_impacts(snap(t), scen(t), "state"), *Z.SHOCKS, "delta_adverse_credit", "delta_high_prepayment"),
    "l5_bucket": lambda t: featured(t).select("seq", bucket("rate_incentive", [-9, -1, -0.5, 0, 0.5, 1, 9]).alias("incentive_bucket")),
    "l6_driver_decomposition": lambda t: rounded(Z.driver_decomposition(snap(t), scen(t), "adverse_credit"), "effect", "share", digits=5),
    "l7_macro_transition_fit": _fit,
    "c13_macro_design": lambda t: rounded(rounded(Z.macro_design(Z.monthly_rates(L.status_next(featured(t).drop("next_state"), EXITS)), t.macro()), "deteriorate", "prepay"), "rate_incentive", digits=4),
    "l8_stressed_matrix": lambda t: rounded(Z.stressed_matrix(matrix(t), SHIFTS), "p"),
    "l9_portfolio_projection": lambda t: rounded(Z.portfolio_projection(X.snapshot(deduped(t)), S.project_states(matrix(t), 12)), "share"),
    "l10_scenario_summary": lambda t: rounded(Z.scenario_summary(scen(t), t.macro()), *[f"shift_{c}" for c in Z.MACRO], digits=5),
    "m2_rescale": lambda t: rounded(ranked(t).select("seq", "score"), "score"),
    "m3_robust_drivers": lambda t: _driven(t).select("seq", F.array_join("drivers", "|").alias("drivers")),
    "m4_review_queue": _queue,
    "m5_anomaly_by": lambda t: rounded(R.anomaly_by(ranked(t), "servicer_name"), "mean_score", "share_high", "mean_probability"),
    "m6_gate_type": lambda t: ranked(t).groupBy(R.gate_type("predicted_type", "probability", 0.2).alias("gated")).agg(F.count("*").alias("rows")),
    "m7_driver_frequency": lambda t: rounded(R.driver_frequency(_driven(t)), "share"),
    "n2_global_importance": lambda t: rounded(R.global_importance(attributed(t)), "mean_abs", "mean_signed", "corr", "share", digits=5),
    "n3_local_explanations": lambda t: rounded(R.local_explanations(attributed(t), "seq", 20, 2), "contribution", "total"),
    "n4_driver_strings": lambda t: R.driver_strings(attributed(t), ["seq"], 1).groupBy("drivers").agg(F.count("*").alias("rows")),
    "n6_confidence_band": lambda t: t.pairs().select("p", (F.col("p") / 20).alias("spread")).groupBy(R.confidence_band("p", "spread").alias("band")).agg(F.count("*").alias("rows")),
    "n8_describe": lambda t: rounded(t.pairs().agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"), F.min("p").alias("min"), F.percentile("p", 0.25).alias("p25"), F.median("p").alias("p50"), F.percentile("p", 0.75).alias("p75"), F.max("p").alias("max")), "mean", "std", "p25", "p50", "p75"),
    "n9_linear_attributions": lambda t: rounded(attributed(t).drop("value"), "contribution"),
    "o2_action_rules": lambda t: probabilities(t).select("seq", R.action_rules().alias("action")),
    "o3_check_contract": lambda t: R.check_contract(probabilities(t), "seq", ["prob_default_12m", "exception_probability"], {"current_status": ["Current", "DQ30", "DQ60", "DQ90plus"]}),
    "p4_parse_numbers": lambda t: t.raw("documents").select("doc_id", F.size(F.coalesce(G.parse_numbers(G.without_list_markers(F.col("text"))), F.array())).alias("n_numbers"), F.round(F.aggregate(F.filter(G.parse_numbers(G.without_list_markers(F.col("text"))), lambda x: F.abs(x) < 1e9), F.lit(0.0), lambda a, x: a + x), 4).alias("total")),
    "p5_grounding_check": lambda t: _guard(t).select("doc_id", "n_numbers", "n_ungrounded", "causal", "refusal", "framed", "latex", "grounded"),
    "p6_normalise_latex": _latex,
    "p7_usefulness_check": lambda t: _guard(t).select("doc_id", F.array_join("null_advice", ",").alias("null_advice"), "useful"),
    "p8_summarise": lambda t: G.summarise(_guard(t)),
}

_BASE = f", base AS (SELECT c.*, {STATUS} AS status_ord, m.market_mortgage_rate, m.unemployment_rate, m.hpi_yoy_growth, rate_clean - m.market_mortgage_rate AS rate_incentive FROM clean c LEFT JOIN macro m USING (pno, reporting_month))"
_SCEN = """, lastm AS (SELECT arg_max(market_mortgage_rate, pno) AS a, arg_max(unemployment_rate, pno) AS b, arg_max(hpi_yoy_growth, pno) AS c FROM macro),
scen AS (SELECT n AS scenario_name, h AS horizon_month, round(a + s0 * h / 12, 4) AS market_mortgage_rate, round(b + s1 * h / 12, 4) AS unemployment_rate, round(c + s2 * h / 12, 5) AS hpi_yoy_growth
  FROM lastm, (VALUES ('base', 0e0, 0e0, 0e0), ('adverse_credit', 0e0, 3e0, -0.1e0), ('high_prepayment', -1e0, 0e0, 0e0)) s(n, s0, s1, s2), (SELECT CAST(unnest(range(1, 13)) AS INT) AS h))"""
_SNAP = ", snap AS (SELECT * FROM base WHERE rate_clean IS NOT NULL AND seq IN (SELECT seq FROM one QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY month_index DESC) = 1))"


def _p(rate: str, unemployment: str, hpi: str) -> str:
    return f"(1 / (1 + exp(-(-3 + 0.4e0 * (rate_clean - {rate}) + 0.3e0 * {unemployment} - 5e0 * {hpi} + 0.8e0 * status_ord))))"


_X = ", x AS (SELECT p.*, s.scenario_name, s.market_mortgage_rate AS sm, s.unemployment_rate AS su, s.hpi_yoy_growth AS sh FROM snap p, scen s WHERE s.horizon_month = 12)"
_LIN = _BASE + _SCEN + _SNAP + _X
_SCN, _OWN = _p("sm", "su", "sh"), _p("market_mortgage_rate", "unemployment_rate", "hpi_yoy_growth")
_DRIVERS = {"market_mortgage_rate": _p("sm", "unemployment_rate", "hpi_yoy_growth"), "unemployment_rate": _p("market_mortgage_rate", "su", "hpi_yoy_growth"), "hpi_yoy_growth": _p("market_mortgage_rate", "unemployment_rate", "sh")}
_WORSE = " OR ".join(f"from_state = '{s}' AND to_state IN ({', '.join(repr(x) for x in t)})" for s, t in Z.WORSE.items())
_SHIFT = "CASE " + " ".join(f"WHEN from_state = '{s}' AND kind = 'worse' THEN {a}e0 WHEN from_state = '{s}' AND kind = 'prepay' THEN {b}e0" for s, (a, b) in SHIFTS.items()) + " ELSE 0e0 END"
_HIT = ", ".join(repr(s) for s in SHIFTS)
_STRESS = f"""
, kinds AS (SELECT *, CASE WHEN {_WORSE} THEN 'worse' WHEN to_state = 'Prepaid' AND from_state IN ('Current', 'DQ30', 'DQ60', 'DQ90plus') THEN 'prepay' ELSE 'stay' END AS kind FROM matrix),
curs AS (SELECT *, sum(p) OVER (PARTITION BY from_state, kind) AS cur, {_SHIFT} AS shift FROM kinds),
qs AS (SELECT *, CASE WHEN from_state IN ({_HIT}) AND kind <> 'stay' AND cur > 0 AND cur < 1 THEN p * least(greatest(1 / (1 + exp(-(ln(cur / (1 - cur)) + shift))), 1e-5), 0.95e0) / cur ELSE p END AS q FROM curs),
ls AS (SELECT *, 1 - sum(CASE WHEN kind <> 'stay' THEN q ELSE 0 END) OVER (PARTITION BY from_state) AS l, sum(CASE WHEN kind = 'stay' THEN q ELSE 0 END) OVER (PARTITION BY from_state) AS st FROM qs),
fs AS (SELECT from_state, to_state, CASE WHEN kind = 'stay' AND from_state IN ({_HIT}) AND l > 0 AND st > 0 THEN q * l / st ELSE greatest(q, 0) END AS q FROM ls)
SELECT from_state, to_state, round(q / sum(q) OVER (PARTITION BY from_state), 6) AS p FROM fs"""
_RANKED = ", qq AS (SELECT quantile_cont(penalty + seq % 7, 0.005e0) AS lo, quantile_cont(penalty + seq % 7, 0.995e0) AS hi FROM scored), ranked AS (SELECT *, greatest(0, least(1, (penalty + seq % 7 - lo) / nullif(hi - lo, 0))) AS score, violations / 17 AS probability, CASE WHEN seq % 3 = 0 THEN 'document_breach' WHEN seq % 3 = 1 THEN 'date_breach' ELSE 'dpd_breach' END AS predicted_type FROM scored, qq)"
_COLS = ["dpd", "lag_days", "loan_age_months", "penalty"]
_DEV = f"""
, src AS (SELECT seq, month_index, coalesce(dpd_clean, 0) AS dpd, lag_days, penalty, loan_age_months FROM scored),
meds AS (SELECT {', '.join(f'median({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in _COLS)} FROM src WHERE month_index < 50),
devs AS (SELECT {', '.join(f'median(abs({c} - m_{c})) AS d_{c}' for c in _COLS)} FROM src, meds WHERE month_index < 50),
zs AS ({' UNION ALL '.join(f"SELECT seq, '{c}' AS c, coalesce(abs({c} - m_{c}) / CASE WHEN d_{c} > 0 THEN 1.4826e0 * d_{c} WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 0) AS z FROM src, meds, devs" for c in _COLS)}),
drv AS (SELECT seq, c, row_number() OVER (PARTITION BY seq ORDER BY z DESC, c) AS k FROM zs)
"""
_ATTR = ", attr AS (" + " UNION ALL ".join(f"SELECT seq, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, coalesce({b}e0 * ({c} - (SELECT avg({c}) FROM scored)), 0) AS contribution FROM scored" for c, b in COEFFICIENTS.items()) + ")"
_KINDS = " OR ".join(f"current_status = '{s}' AND next_state IN ({', '.join(repr(x) for x in t)})" for s, t in Z.WORSE.items())
_XS = range(1, 4)
# Weighted least squares on three values, from sums around their means, by Cramer's rule.
_SQUARES = f"""{targets_sql()}{_BASE}
, r AS (SELECT current_status, pno, count(*) AS n, avg(CASE WHEN {_KINDS} THEN 1 ELSE 0 END) AS deteriorate, avg(CASE WHEN next_state = 'Prepaid' THEN 1 ELSE 0 END) AS prepay, avg(rate_incentive) AS x3
  FROM base JOIN (SELECT seq, next_state FROM nexts) USING (seq) WHERE current_status IN ({', '.join(repr(s) for s in Z.WORSE)}) AND next_state IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 25),
d AS (SELECT r.*, m.unemployment_rate AS x1, m.hpi_yoy_growth AS x2 FROM r JOIN macro m USING (pno) WHERE x3 IS NOT NULL AND m.unemployment_rate IS NOT NULL AND m.hpi_yoy_growth IS NOT NULL),
l AS ({' UNION ALL '.join(f"SELECT current_status, '{k}' AS kind, n, x1, x2, x3, ln(least(greatest({k}, 1e-4), 1 - 1e-4) / (1 - least(greatest({k}, 1e-4), 1 - 1e-4))) AS y FROM d" for k in ("deteriorate", "prepay"))}),
means AS (SELECT current_status, kind, count(*) AS months, {', '.join(f'sum(n * x{i}) / sum(n) AS m{i}' for i in _XS)}, sum(n * y) / sum(n) AS my FROM l GROUP BY 1, 2 HAVING count(*) >= 12),
s AS (SELECT current_status, kind, months, m1, m2, m3, my, {', '.join(f'sum(n * (x{i} - m{i}) * (x{j} - m{j})) AS a{i}{j}' for i in _XS for j in _XS)}, {', '.join(f'sum(n * (x{i} - m{i}) * (y - my)) AS a{i}0' for i in _XS)}, sum(n * (y - my) ** 2) AS t FROM l JOIN means USING (current_status, kind) GROUP BY ALL),
""" + "fits AS (SELECT *, " + ", ".join("(" + " + ".join(f"{'-' if odd else ''}a1{p} * a2{q} * a3{w}" for p, q, w, odd in (((0 if c == k else c), (0 if e == k else e), (0 if f == k else f), o) for c, e, f, o in ((1, 2, 3, 0), (2, 3, 1, 0), (3, 1, 2, 0), (3, 2, 1, 1), (2, 1, 3, 1), (1, 3, 2, 1)))) + f") AS d{k}" for k in (-1, 1, 2, 3)).replace("d-1", "det") + " FROM s), betas AS (SELECT *, d1 / det AS b1, d2 / det AS b2, d3 / det AS b3 FROM fits) "
_PROBS = ", probs AS (SELECT seq, current_status, " + ", ".join(f"(seq * {k} % 97) / 97e0 AS {n}" for n, k in (("exception_probability", 3), ("prob_default_12m", 5), ("prob_delinquency_3m", 7), ("prob_delinquency_6m", 11), ("prob_prepayment_12m", 13))) + " FROM one)"
_ANY = lambda words: " OR ".join(f"contains(lower(text), '{w}')" for w in words)
_LINES = "string_split(text, chr(10))"
_BODY = "ltrim(l, concat(' ', chr(9)))"
_DIGITS = f"len(regexp_extract({_BODY}, '^[0-9]*'))"
_REST = f"substr({_BODY}, {_DIGITS} + 2)"
_MARKER = f"{_DIGITS} BETWEEN 1 AND {G.MARKER_DIGITS} AND len(l) - len({_BODY}) <= {G.INDENT} AND substr({_BODY}, {_DIGITS} + 1, 1) IN ('.', ')') AND (regexp_matches({_REST}, '^[[:space:]]') OR ({_REST} = '' AND i < len({_LINES})))"
_UNLISTED = f"array_to_string(list_transform({_LINES}, lambda l, i: CASE WHEN {_MARKER} THEN {_REST} ELSE l END), chr(10))"
_NUMBERS = rf"list_transform(regexp_extract_all({_UNLISTED}, '{G.NUMBER}', 1), lambda x: TRY_CAST(regexp_replace(x, '[,%+]', '', 'g') AS DOUBLE))"
_SMALL = ", ".join(f"{x}e0" for x in G.SMALL)
_ALLOWED = "list_distinct(flatten(list_transform([doc_id, doc_id * 100e0, doc_id / 100e0, n_chars, n_chars * 100e0, n_chars / 100e0], lambda x: [x, round(x, 0), round(x, 1), round(x, 2), round(x, 3)])))"
_ADVISED = """SELECT doc_id, n_chars, concat(text, CASE doc_id % 5 WHEN 0 THEN concat(' Reviewer to verify the document status of ', doc_id) WHEN 1 THEN concat(chr(10), '12. Confirm modification_flag by model, 0.5 ', doc_id + 7) WHEN 2 THEN ' This will default. 100.3' ELSE '' END) AS said,
  doc_id % 3 = 0 AS complete, doc_id % 4 = 0 AS unmodified FROM documents WHERE text IS NOT NULL"""
_MARKED = " OR ".join(f"contains(said, '{m}')" for m in G.LATEX_MARKERS) + " OR len(list_filter(string_split(said, chr(10)), lambda l: len(list_filter(string_split(l, '$')[2:-2], lambda x: regexp_matches(x, '[0-9]'))) > 0)) > 0"
# No document has a power of ten; the marks alone are dropped.
_PLAIN = r"CASE WHEN latex THEN replace(replace(replace(said, '\times', ' '), '\cdot', ' '), '$', '') ELSE said END"
_BEFORE = lambda name: f"(contains(low, '{name}') AND (" + " OR ".join(f"contains(substr(low, greatest(1, instr(low, '{name}') - 120), least(instr(low, '{name}') - 1, 120)), '{w}')" for w in G.ACTION) + "))"
_GUARD = f"""WITH d AS ({_ADVISED}), m AS (SELECT *, ({_MARKED}) AS latex, lower(said) AS low FROM d), p AS (SELECT *, {_PLAIN} AS text FROM m),
n AS (SELECT *, list_filter({_NUMBERS}, lambda x: x IS NOT NULL AND NOT list_contains([{_SMALL}], x)) AS numbers, {_ALLOWED} AS allowed FROM p),
f AS (SELECT doc_id, len(numbers) AS n_numbers, len(list_filter(numbers, lambda x: len(list_filter(allowed, lambda a: abs(x - a) <= greatest(0.005e0, abs(a) * 0.005e0))) = 0)) AS n_ungrounded, ({_ANY(G.CAUSAL).replace('lower(text)', 'low')}) AS causal,
  ({_ANY(G.REFUSAL).replace('lower(text)', 'low')}) AS refusal, ({_ANY(G.FRAMING + G.REFUSAL).replace('lower(text)', 'low')}) AS framed, latex, ({_ANY(G.ACTION).replace('lower(text)', 'low')}) AS act,
  concat_ws(',', CASE WHEN complete AND ({_BEFORE('document_status')} OR {_BEFORE('document status')}) THEN 'document_status' END, CASE WHEN unmodified AND ({_BEFORE('modification_flag')} OR {_BEFORE('modification flag')}) THEN 'modification_flag' END) AS null_advice FROM n),
g AS (SELECT *, n_ungrounded = 0 AND NOT causal AND framed AND NOT latex AS grounded, null_advice = '' AND act AS useful FROM f) """
_PARSED = f"SELECT doc_id, coalesce(len(numbers), 0) AS n_numbers, round(list_reduce(list_prepend(0e0, list_filter(numbers, lambda x: abs(x) < 1e9)), lambda a, b: a + b), 4) AS total FROM (SELECT doc_id, {_NUMBERS} AS numbers FROM documents)"

ORACLES = {
    "c12_attach_scores": select(f"{_DEV} SELECT seq, current_status, violations, dq_score, drivers FROM scored LEFT JOIN (SELECT seq, string_agg(c, '|' ORDER BY k) AS drivers FROM drv WHERE k <= 3 GROUP BY 1) USING (seq)"),
    "l1_build_scenarios": select(f"{_SCEN} SELECT * FROM scen"),
    "l2_apply_scenario": select(f"{_LIN} SELECT seq, scenario_name, round(rate_clean - sm, 5) AS incentive, round(su - unemployment_rate, 5) AS unemployment_gap FROM x"),
    "l3_score_scenarios": select(f"{_LIN}, m AS (SELECT scenario_name, avg({_SCN}) AS s FROM x GROUP BY 1), b AS (SELECT s AS b FROM m WHERE scenario_name = 'base') SELECT scenario_name, round(s, 6) AS mean_score, round(s - b, 6) AS delta, round(s / b - 1, 6) AS relative FROM m, b"),
    "l4_segment_impacts": select(f"{_LIN}, m AS (SELECT state, " + ", ".join(f"avg(CASE WHEN scenario_name = '{n}' THEN {_SCN} END) AS {n}" for n in Z.SHOCKS) + " FROM x WHERE state IS NOT NULL GROUP BY 1) SELECT state, round(base, 6) AS base, round(adverse_credit, 6) AS adverse_credit, round(high_prepayment, 6) AS high_prepayment, round(adverse_credit - base, 6) AS delta_adverse_credit, round(high_prepayment - base, 6) AS delta_high_prepayment FROM m"),
    "l5_bucket": select(f"{_BASE} SELECT seq, CASE WHEN rate_incentive <= -9 THEN NULL WHEN rate_incentive <= -1 THEN 0 WHEN rate_incentive <= -0.5e0 THEN 1 WHEN rate_incentive <= 0 THEN 2 WHEN rate_incentive <= 0.5e0 THEN 3 WHEN rate_incentive <= 1 THEN 4 WHEN rate_incentive <= 9 THEN 5 END AS incentive_bucket FROM base"),
    "l6_driver_decomposition": select(f"{_LIN}, e AS (SELECT avg({_SCN} - {_OWN}) AS total, " + ", ".join(f"avg({p} - {_OWN}) AS {c}" for c, p in _DRIVERS.items()) + " FROM x WHERE scenario_name = 'adverse_credit')" + " UNION ALL ".join(f" SELECT '{n}' AS driver, round({e}, 5) AS effect, round({e} / total, 5) AS share FROM e" for n, e in [*((c, c) for c in _DRIVERS), ("interaction", "(total - " + " - ".join(_DRIVERS) + ")")])),
    "c13_macro_design": select(f"{_SQUARES.split('l AS (')[0].rstrip().rstrip(',')} SELECT current_status, pno, n, round(deteriorate, 6) AS deteriorate, round(prepay, 6) AS prepay, round(x3, 4) AS rate_incentive, x1 AS unemployment_rate, x2 AS hpi_yoy_growth FROM d"),
    "l7_macro_transition_fit": select(f"{_SQUARES} SELECT current_status, kind, months, round(my - b1 * m1 - b2 * m2 - b3 * m3, 4) AS intercept, round(b1, 4) AS unemployment_rate, round(b2, 4) AS hpi_yoy_growth, round(b3, 4) AS rate_incentive, round(CASE WHEN t > 1e-12 THEN (b1 * a10 + b2 * a20 + b3 * a30) / t END, 4) AS r2 FROM betas"),
    "l8_stressed_matrix": select(f"{_MATRIX} {_STRESS}"),
    "l9_portfolio_projection": select(f"{_MATRIX} {_POWERS}, sh AS (SELECT current_status AS start_state, count(*) / sum(count(*)) OVER () AS w FROM (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY month_index DESC) = 1) GROUP BY 1), ok AS (SELECT * FROM sh WHERE start_state IN ({', '.join(repr(s) for s in S.STATES)})) SELECT 0 AS horizon_month, start_state AS state, round(w, 6) AS share FROM ok UNION ALL SELECT horizon_month, state, round(sum(p * w), 6) FROM powers JOIN ok USING (start_state) GROUP BY 1, 2"),
    "l10_scenario_summary": select(f"{_SCEN} SELECT scenario_name, market_mortgage_rate, unemployment_rate, hpi_yoy_growth, round(market_mortgage_rate - a, 5) AS shift_market_mortgage_rate, round(unemployment_rate - b, 5) AS shift_unemployment_rate, round(hpi_yoy_growth - c, 5) AS shift_hpi_yoy_growth FROM scen, lastm WHERE horizon_month = 12"),
    "m2_rescale": select(f"{_RANKED} SELECT seq, round(score, 6) AS score FROM ranked"),
    "m3_robust_drivers": select(f"{_DEV} SELECT seq, string_agg(c, '|' ORDER BY k) AS drivers FROM drv WHERE k <= 3 GROUP BY 1"),
    "m4_review_queue": select(f"{_RANKED}, pr AS (SELECT *, 0.6e0 * probability + 0.4e0 * score AS priority FROM ranked), rk AS (SELECT *, row_number() OVER (ORDER BY priority DESC, seq) AS a, row_number() OVER (PARTITION BY predicted_type ORDER BY priority DESC, seq) AS b FROM pr) SELECT seq, round(priority, 6) AS priority, predicted_type FROM rk WHERE a <= 50 OR b <= 7"),
    "m5_anomaly_by": select(f"{_RANKED}, ct AS (SELECT quantile_cont(score, 0.9e0) AS c FROM ranked) SELECT servicer_name, count(*) AS rows, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN score > c THEN 1 ELSE 0 END), 6) AS share_high, round(avg(probability), 6) AS mean_probability FROM ranked, ct GROUP BY 1"),
    "m6_gate_type": select(f"{_RANKED} SELECT CASE WHEN probability < 0.2e0 THEN 'none' ELSE predicted_type END AS gated, count(*) AS rows FROM ranked GROUP BY 1"),
    "m7_driver_frequency": select(f"{_DEV} SELECT c AS driver, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM drv WHERE k = 1 GROUP BY 1"),
    "n2_global_importance": select(f"{_ATTR}, g AS (SELECT feature, avg(abs(contribution)) AS ma, avg(contribution) AS ms, corr(value, contribution) AS co FROM attr GROUP BY 1) SELECT feature, round(ma, 5) AS mean_abs, round(ms, 5) AS mean_signed, round(co, 5) AS corr, round(ma / sum(ma) OVER (), 5) AS share, CASE WHEN co > 0.05 THEN 'up' WHEN co < -0.05 THEN 'down' ELSE 'mixed' END AS direction FROM g"),
    "n3_local_explanations": select(f"{_ATTR}, tt AS (SELECT seq, sum(contribution) AS total FROM attr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT seq, rank, feature, round(contribution, 6) AS contribution, round(total, 6) AS total FROM (SELECT a.*, total, row_number() OVER (PARTITION BY a.seq ORDER BY abs(contribution) DESC, feature) AS rank FROM attr a JOIN tt USING (seq)) WHERE rank <= 2"),
    "n4_driver_strings": select(f"{_ATTR}, top AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY abs(contribution) DESC, feature) AS k FROM attr) SELECT concat(replace(feature, '_', ' '), ' (', CASE WHEN contribution >= 0 THEN '+' ELSE '-' END, printf('%.2f', round_even(abs(contribution), 2)), ')') AS drivers, count(*) AS rows FROM top WHERE k = 1 GROUP BY 1"),
    "n6_confidence_band": f"SELECT CASE WHEN least(p, 1 - p) + 3 * p / 20 < 0.1e0 THEN 'high' WHEN least(p, 1 - p) + 3 * p / 20 < 0.25e0 THEN 'medium' ELSE 'low' END AS band, count(*) AS rows FROM ({PAIRS_VIEW}) GROUP BY 1",
    "n8_describe": f"SELECT count(p) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, min(p) AS min, round(quantile_cont(p, 0.25e0), 6) AS p25, round(median(p), 6) AS p50, round(quantile_cont(p, 0.75e0), 6) AS p75, max(p) AS max FROM ({PAIRS_VIEW})",
    "n9_linear_attributions": select(f"{_ATTR} SELECT seq, feature, round(contribution, 6) AS contribution FROM attr"),
    "o2_action_rules": select(f"{_PROBS} SELECT seq, CASE " + " ".join(f"WHEN {c} >= {t}e0 THEN '{n}'" for n, c, t in R.ACTIONS) + " ELSE 'monitor_no_action' END AS action FROM probs"),
    "o3_check_contract": select(f"{_PROBS} SELECT 'repeated_keys' AS \"check\", count(*) - count(DISTINCT seq) AS violations FROM probs UNION ALL SELECT 'range_prob_default_12m', count(*) FROM probs WHERE NOT coalesce(prob_default_12m BETWEEN 0 AND 1, false) UNION ALL SELECT 'range_exception_probability', count(*) FROM probs WHERE NOT coalesce(exception_probability BETWEEN 0 AND 1, false) UNION ALL SELECT 'words_current_status', count(*) FROM probs WHERE current_status NOT IN ('Current', 'DQ30', 'DQ60', 'DQ90plus')"),
    "p4_parse_numbers": _PARSED,
    "p5_grounding_check": _GUARD + "SELECT doc_id, n_numbers, n_ungrounded, causal, refusal, framed, latex, grounded FROM g",
    "p6_normalise_latex": "SELECT doc_id, true AS latex, concat('of -', doc_id, '.5e-', doc_id % 7, ' and 1e', doc_id % 7, '   2, not 2', doc_id, '10^3 nor ', doc_id % 7, 'times 10^x') AS plain FROM documents",
    "p7_usefulness_check": _GUARD + "SELECT doc_id, null_advice, useful FROM g",
    "p8_summarise": _GUARD + "SELECT count(*) AS rows, count(*) FILTER (WHERE grounded AND useful) AS passed, count(*) FILTER (WHERE NOT (grounded AND useful)) AS blocked, CAST(sum(n_ungrounded) AS BIGINT) AS ungrounded_numbers, count(*) FILTER (WHERE null_advice <> '') AS null_advice, round(count(*) FILTER (WHERE grounded AND useful) / count(*), 4) AS pass_rate, count(*) FILTER (WHERE NOT grounded) AS ungrounded, count(*) FILTER (WHERE causal) AS causal, count(*) FILTER (WHERE NOT useful) AS not_useful FROM g",
}
