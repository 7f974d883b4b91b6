"""Stress scenarios: macro paths, scoring under them, what drives the change, stressed transitions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.survival import STATES

MACRO = ["market_mortgage_rate", "unemployment_rate", "hpi_yoy_growth"]
#: Shock at the horizon for each macro value (fixed values).
SHOCKS = {"base": (0.0, 0.0, 0.0), "adverse_credit": (0.0, 3.0, -0.10), "high_prepayment": (-1.0, 0.0, 0.0)}
#: What counts as worse for each state (fixed values).
WORSE = {"Current": ["DQ30", "DQ60", "DQ90plus", "Default"], "DQ30": ["DQ60", "DQ90plus", "Default"], "DQ60": ["DQ90plus", "Default"], "DQ90plus": ["Default"]}


def build_scenarios(macro: DataFrame, shocks: dict = SHOCKS, horizon: int = 12, on: str = "pno") -> DataFrame:
    """scenario_name, horizon_month and the macro values: the last month's plus a shock that grows linearly."""
    last = macro.agg(*[F.max_by(c, on).alias(c) for c in MACRO])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario_name"), *[F.lit(float(x)).alias(f"s{i}") for i, x in enumerate(s)]) for n, s in shocks.items()]))
    path = last.select("*", rows.alias("s")).select(*MACRO, "s.*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_month"))
    digits = (4, 4, 5)
    return path.select("scenario_name", "horizon_month", *[F.round(F.col(c) + F.col(f"s{i}") * F.col("horizon_month") / horizon, digits[i]).alias(c) for i, c in enumerate(MACRO)])


def fitted_scorer(slopes: dict[str, float], intercept: float, rest: dict[str, float]):
    """A scorer from a fitted logistic model: slopes of incentive, unemployment and house prices, and of further columns of the snapshot."""

    def scorer(rate: Column, unemployment: Column, hpi: Column) -> Column:
        z = F.lit(intercept) + slopes["rate_incentive"] * (F.col("rate_clean") - rate) + slopes["unemployment_rate"] * unemployment + slopes["hpi_yoy_growth"] * hpi
        for c, b in rest.items():
            z = z + b * F.col(c).cast("double")
        return 1 / (1 + F.exp(-z))

    return scorer


def linear_scorer(rate: Column, unemployment: Column, hpi: Column) -> Column:
    """A fixed logistic scorer over incentive, macro values and status; stands in for a model where a closed form is wanted."""
    z = -3.0 + 0.4 * (F.col("rate_clean") - rate) + 0.3 * unemployment - 5.0 * hpi + 0.8 * F.col("status_ord")
    return 1 / (1 + F.exp(-z))


def apply_scenario(snapshot: DataFrame, scenarios: DataFrame, horizon: int) -> DataFrame:
    """Each snapshot row under each scenario: own macro values become the scenario's; few scenario rows are sent everywhere."""
    shocked = scenarios.filter(F.col("horizon_month") == horizon).select("scenario_name", *[F.col(c).alias(f"scn_{c}") for c in MACRO])
    return snapshot.crossJoin(F.broadcast(shocked))


def score_scenarios(snapshot: DataFrame, scenarios: DataFrame, horizon: int = 12, scorer=linear_scorer) -> DataFrame:
    """Mean score of each scenario, and its distance from base; scorer gives the probability from three columns of macro values."""
    p = scorer(*[F.col(f"scn_{c}") for c in MACRO])
    means = apply_scenario(snapshot, scenarios, horizon).groupBy("scenario_name").agg(F.avg(p).alias("mean_score"))
    base = means.filter("scenario_name = 'base'").select(F.col("mean_score").alias("base_score"))
    out = means.join(F.broadcast(base))
    return out.select("scenario_name", "mean_score", (F.col("mean_score") - F.col("base_score")).alias("delta"), (F.col("mean_score") / F.col("base_score") - 1).alias("relative"))


def segment_impacts(snapshot: DataFrame, scenarios: DataFrame, by: str, horizon: int = 12, scorer=linear_scorer) -> DataFrame:
    p = scorer(*[F.col(f"scn_{c}") for c in MACRO])
    names = list(SHOCKS)
    wide = apply_scenario(snapshot, scenarios, horizon).dropna(subset=[by]).withColumn("p", p).groupBy(by).pivot("scenario_name", names).agg(F.avg("p"))
    return wide.withColumns({f"delta_{n}": F.col(n) - F.col("base") for n in names if n != "base"})


def driver_decomposition(snapshot: DataFrame, scenarios: DataFrame, name: str, horizon: int = 12, scorer=linear_scorer) -> DataFrame:
    """What each macro value alone does to the mean score, the rest as interaction, and shares of the whole: one pass."""
    rows = apply_scenario(snapshot, scenarios.filter(F.col("scenario_name") == name), horizon)
    own, new = [F.col(c) for c in MACRO], [F.col(f"scn_{c}") for c in MACRO]
    base, full = scorer(*own), scorer(*new)
    alone = {c: scorer(*[new[j] if j == i else own[j] for j in range(3)]) for i, c in enumerate(MACRO)}
    sums = rows.agg(F.avg(full - base).alias("total"), *[F.avg(p - base).alias(c) for c, p in alone.items()])
    sums = sums.withColumn("interaction", F.col("total") - reduce(lambda a, b: a + b, [F.col(c) for c in MACRO]))
    return sums.unpivot("total", [*MACRO, "interaction"], "driver", "effect").select("driver", "effect", (F.col("effect") / F.when(F.abs("total") > 1e-12, F.col("total"))).alias("share"))


def scenario_summary(scenarios: DataFrame, macro: DataFrame, horizon: int = 12, on: str = "pno") -> DataFrame:
    last = macro.agg(*[F.max_by(c, on).alias(f"last_{c}") for c in MACRO])
    end = scenarios.filter(F.col("horizon_month") == horizon).join(F.broadcast(last))
    return end.select("scenario_name", *MACRO, *[(F.col(c) - F.col(f"last_{c}")).alias(f"shift_{c}") for c in MACRO])


def compare_engines(scores: DataFrame, paths: DataFrame, horizon: int = 12) -> DataFrame:
    """Two ways to see a scenario, side by side: scenario_name, engine_a_delta (of mean scores), and of the projected shares at the horizon the sums
    defaulted, prepaid, delinquent and their distance from base. scores as of score_scenarios, paths: scenario_name, horizon_month, state, share."""
    end = paths.filter(F.col("horizon_month") == horizon)
    of = lambda *states: F.sum(F.when(F.col("state").isin(*states), F.col("share")).otherwise(0.0))
    sums = end.groupBy("scenario_name").agg(of("Default").alias("defaulted"), of("Prepaid").alias("prepaid"), of("DQ30", "DQ60", "DQ90plus").alias("delinquent"))
    names = ["defaulted", "prepaid", "delinquent"]
    base = sums.filter("scenario_name = 'base'").select(*[F.col(c).alias(f"_{c}") for c in names])
    out = sums.join(F.broadcast(base)).select("scenario_name", *names, *[(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in names])
    return scores.select("scenario_name", F.col("delta").alias("engine_a_delta")).join(out, "scenario_name")


def macro_design(rates: DataFrame, macro: DataFrame, on: str = "pno") -> DataFrame:
    """Monthly rates beside the month's macro values, rows with an unknown one dropped."""
    return rates.join(F.broadcast(macro.select(on, "unemployment_rate", "hpi_yoy_growth")), on).dropna()


def fitted_shifts(fit: DataFrame, scenarios: DataFrame, macro: DataFrame, name: str, horizon: int = 12, on: str = "pno") -> dict[str, tuple[float, float]]:
    """Shift of the log odds of getting worse and of prepaying for each state under a scenario: the fit's slopes times the macro values' distance from the last month. A few dozen numbers."""
    x = scenario_summary(scenarios.filter(F.col("scenario_name") == name), macro, horizon, on).first()
    d = {"unemployment_rate": x["shift_unemployment_rate"], "hpi_yoy_growth": x["shift_hpi_yoy_growth"], "rate_incentive": -x["shift_market_mortgage_rate"]}
    shift = {(r["current_status"], r["kind"]): sum(r[c] * v for c, v in d.items()) for r in fit.collect()}
    return {s: (shift.get((s, "deteriorate"), 0.0), shift.get((s, "prepay"), 0.0)) for s in {s for s, _ in shift}}


def exact_mean(column: str) -> Column:
    """The mean of known values from a decimal sum of doubles as they are (to twenty decimals): the same in whatever order rows come. For rates: values that are not finite or from 1e18 on count as unknown."""
    exact = F.col(column).try_cast("decimal(38,20)")
    return F.sum(exact).cast("double") / F.nullif(F.count(exact), F.lit(0))


def monthly_rates(df: DataFrame, least: int = 25) -> DataFrame:
    """Per state and month: rows, share that gets worse, share that prepays, mean incentive."""
    worse = reduce(lambda a, b: a | b, [(F.col("current_status") == s) & F.col("next_state").isin(t) for s, t in WORSE.items()])
    known = df.filter(F.col("current_status").isin(list(WORSE)) & F.col("next_state").isNotNull())
    rates = known.groupBy("current_status", "pno").agg(F.count("*").alias("n"), F.avg(worse.cast("int")).alias("deteriorate"), F.avg((F.col("next_state") == "Prepaid").cast("int")).alias("prepay"), exact_mean("rate_incentive").alias("rate_incentive"))
    return rates.filter(F.col("n") >= least)


def macro_transition_fit(rates: DataFrame, macro: DataFrame, least_months: int = 12) -> DataFrame:
    """Weighted least squares of the log odds on unemployment, house prices and incentive, for each state and kind, from sums of products."""
    x = ["unemployment_rate", "hpi_yoy_growth", "rate_incentive"]
    rows = macro_design(rates, macro)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.least(F.greatest(F.col(k), F.lit(1e-4)), F.lit(1 - 1e-4)).alias("p")) for k in ("deteriorate", "prepay")]))
    long = rows.select("current_status", "n", *x, kinds.alias("k")).select("current_status", "n", *x, "k.kind", F.log(F.col("k.p") / (1 - F.col("k.p"))).alias("y")).withColumn("one", F.lit(1.0))
    terms = ["one", *x, "y"]
    products = {(a, b): F.sum(F.col("n") * F.col(a) * F.col(b)) for i, a in enumerate(terms) for b in terms[i:]}
    sums = long.groupBy("current_status", "kind").agg(F.count("*").alias("months"), *[c.alias(f"{a}:{b}") for (a, b), c in products.items()]).filter(F.col("months") >= least_months)
    # A few rows: one for each state and kind.
    out = []
    for r in sums.collect():
        g = np.array([[r[f"{a}:{b}"] if f"{a}:{b}" in r else r[f"{b}:{a}"] for b in terms] for a in terms])
        beta = np.linalg.lstsq(g[:4, :4], g[:4, 4], rcond=None)[0]
        total = g[4, 4] - g[0, 4] ** 2 / g[0, 0]
        left = g[4, 4] - 2 * beta @ g[:4, 4] + beta @ g[:4, :4] @ beta
        out.append((r["current_status"], r["kind"], int(r["months"]), *map(float, beta), float(1 - left / total) if total > 1e-12 else None))
    return rates.sparkSession.createDataFrame(out, "current_status string, kind string, months int, intercept double, unemployment_rate double, hpi_yoy_growth double, rate_incentive double, r2 double")


def stressed_matrix(matrix: DataFrame, shifts: dict[str, tuple[float, float]], states: list[str] = STATES) -> DataFrame:
    """The matrix with each state's odds of getting worse and of prepaying shifted, the rest of the row rescaled."""
    row = Window.partitionBy("from_state")
    kind = F.lit("stay")
    for s, targets in WORSE.items():
        kind = F.when((F.col("from_state") == s) & F.col("to_state").isin(targets), "worse").otherwise(kind)
    kind = F.when(F.col("from_state").isin(list(WORSE)) & (F.col("to_state") == "Prepaid"), "prepay").otherwise(kind)
    shift = F.lit(0.0)
    for s, (down, out) in shifts.items():
        here = F.col("from_state") == s
        shift = F.when(here & (F.col("kind") == "worse"), down).when(here & (F.col("kind") == "prepay"), out).otherwise(shift)
    now = matrix.withColumn("kind", kind).withColumn("shift", shift)
    part = F.sum("p").over(Window.partitionBy("from_state", "kind"))
    moved = 1 / (1 + F.exp(-(F.log(F.col("cur") / (1 - F.col("cur"))) + F.col("shift"))))
    ratio = F.when((F.col("kind") != "stay") & (F.col("cur") > 0) & (F.col("cur") < 1), F.least(F.greatest(moved, F.lit(1e-5)), F.lit(0.95)) / F.col("cur")).otherwise(1.0)
    out = now.withColumn("cur", part).withColumn("q", F.when(F.col("from_state").isin(list(shifts)), F.col("p") * ratio).otherwise(F.col("p")))
    left = 1 - F.sum(F.when(F.col("kind") != "stay", F.col("q")).otherwise(0.0)).over(row)
    stay = F.sum(F.when(F.col("kind") == "stay", F.col("q")).otherwise(0.0)).over(row)
    out = out.withColumn("left", left).withColumn("stay", stay)
    q = F.when((F.col("kind") == "stay") & F.col("from_state").isin(list(shifts)) & (F.col("left") > 0) & (F.col("stay") > 0), F.col("q") * F.col("left") / F.col("stay")).otherwise(F.greatest("q", F.lit(0.0)))
    out = out.withColumn("q", q)
    return out.select("from_state", "to_state", (F.col("q") / F.sum("q").over(row)).alias("p"))


def portfolio_projection(snapshot: DataFrame, powers: DataFrame, states: list[str] = STATES) -> DataFrame:
    """Shares of the states at each horizon, from the snapshot's shares and the matrix's powers."""
    counts = snapshot.groupBy("current_status").agg(F.count("*").alias("n"))
    shares = counts.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).filter(F.col("current_status").isin(states)).select(F.col("current_status").alias("start_state"), "w")
    later = powers.join(F.broadcast(shares), "start_state").groupBy("horizon_month", "state").agg(F.sum(F.col("p") * F.col("w")).alias("share"))
    return shares.select(F.lit(0).alias("horizon_month"), F.col("start_state").alias("state"), F.col("w").alias("share")).unionByName(later)
