"""Time to event with late entry, competing events, and state transitions; curves come from counts by age, so they cost one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.concordance import concordance  # noqa: F401
from panelwright.operators.quantiles import exact_quantiles
from panelwright.sources.session import saved

ENTITY, MONTH = "entity_id", "month_index"
STATES = ["Current", "DQ30", "DQ60", "DQ90plus", "Default", "Prepaid"]
ABSORBING = ["Default", "Prepaid"]


def survival_frame(panel: DataFrame, last_index: int | None = None) -> DataFrame:
    """One row for each entity: entry and exit age, the first event (default wins ties), censoring, and covariates.

    Needs age_clean, current_status, next_state and the covariate columns. Covariates are first known values, or medians.
    """
    c = F.col
    known = lambda name: F.min_by(name, F.when(c(name).isNotNull(), c(MONTH))).alias(name)
    frame = panel.groupBy(ENTITY).agg(
        F.greatest(F.min("age_clean"), F.lit(0)).alias("entry_age"),
        F.greatest(F.max("age_clean"), F.lit(0)).alias("last_age"),
        F.max(MONTH).alias("last_month"),
        F.min(F.when(c("current_status").isin("DQ90plus", "Default"), c("age_clean"))).alias("t_default"),
        F.max_by("next_state", F.when(c("next_state").isNotNull(), c(MONTH))).alias("last_state"),
        F.median("rate_clean").alias("rate"),
        known("credit_score_band"), known("servicer_name"), known("state"), known("occupancy_type"), known("original_balance"),
    )
    end = F.lit(last_index) if last_index is not None else c("panel_end")
    if last_index is None:
        frame = saved(frame, "entities")
        frame = frame.join(F.broadcast(frame.agg(F.max("last_month").alias("panel_end"))))
    t_prepay = F.when(c("last_state") == "Prepaid", c("last_age"))
    default = c("t_default").isNotNull() & (t_prepay.isNull() | (c("t_default") <= t_prepay))
    prepay = t_prepay.isNotNull() & ~default
    exit_age = F.when(default, c("t_default")).otherwise(c("last_age"))
    out = frame.withColumns({"event_default": default.cast("int"), "event_prepay": prepay.cast("int"), "_exit": exit_age})
    return out.select(
        ENTITY, "entry_age", F.greatest(c("_exit").cast("double"), c("entry_age") + 0.5).alias("exit_age"), F.greatest((c("_exit") - c("entry_age")).cast("double"), F.lit(0.5)).alias("duration"),
        "event_default", "event_prepay", (c("event_default") + c("event_prepay")).alias("event_any"),
        F.when(c("event_default") == 1, "default").when(c("event_prepay") == 1, "prepay").otherwise("censored").alias("event_type"),
        ((c("event_default") + c("event_prepay") == 0) & (c("last_month") >= end)).cast("int").alias("administratively_censored"), (c("entry_age") > 0).cast("int").alias("left_truncated"),
        "rate", F.log1p("original_balance").alias("log_original_balance"), F.coalesce((c("occupancy_type") == "investment").cast("int"), F.lit(0)).alias("is_investment"),
        "credit_score_band", "servicer_name", "state",
    )


def low_score_groups(scored: DataFrame, by: str, q: float = 0.25) -> DataFrame:
    """Groups whose mean score is at or under the quantile of group means; none if all are alike."""
    means = scored.dropna(subset=[by]).groupBy(by).agg(F.avg("dq_score").alias("m"))
    cut = means.agg(F.percentile("m", q).alias("cut"), F.count_distinct("m").alias("k"))
    return means.join(F.broadcast(cut)).filter((F.col("k") > 1) & (F.col("m") <= F.col("cut"))).select(by)


def risk_table(v: DataFrame, events: list[str], by: list[str] = ()) -> DataFrame:
    """age, at_risk (entered before the age and not gone before it), and the counts of each event, at every exit age."""
    none = [F.lit(0).alias(e) for e in events]
    gone = F.struct(F.col("exit_age").cast("double").alias("age"), F.lit(1).alias("out"), F.lit(0).alias("came"), *[F.col(e).cast("int").alias(e) for e in events])
    here = F.struct(F.col("entry_age").cast("double").alias("age"), F.lit(0).alias("out"), F.lit(1).alias("came"), *none)
    both = v.select(*by, F.explode(F.array(gone, here)).alias("_r")).select(*by, "_r.*").groupBy(*by, "age").agg(*[F.sum(c).alias(c) for c in ("out", "came", *events)])
    # Ages are months or half of one: a window holds as many rows as ages that occur.
    w = Window.partitionBy(*by).orderBy("age").rowsBetween(Window.unboundedPreceding, -1)
    risk = F.coalesce(F.sum("came").over(w), F.lit(0)) - F.coalesce(F.sum("out").over(w), F.lit(0))
    return both.withColumn("at_risk", risk).filter("out > 0").select(*by, "age", "at_risk", *events)


def _product(factor, w):
    """Running product of factors in 0..1, with 0 kept."""
    zero = F.max((factor <= 0).cast("int")).over(w)
    return F.when(zero == 1, 0.0).otherwise(F.exp(F.sum(F.when(factor > 0, F.log(factor)).otherwise(0.0)).over(w)))


def kaplan_meier(v: DataFrame, event: str, by: str | None = None, least: int = 40, last_age: int = 120) -> DataFrame:
    """Survival on an age grid, as a step function; groups with under `least` members are left out."""
    keys = [by] if by else []
    sized = v
    if by:
        large = v.groupBy(by).agg(F.count("*").alias("_k")).filter(F.col("_k") >= least).select(by)
        sized = v.join(large, by, "left_semi")
    w = Window.partitionBy(*keys).orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    curve = risk_table(sized, [event], keys).filter("at_risk > 0")
    curve = curve.withColumn("survival", _product(1 - F.col(event) / F.col("at_risk"), w)).select(*keys, "age", "survival")
    grid = (sized.select(*keys).distinct() if keys else v.sparkSession.range(1).select()).select("*", F.explode(F.sequence(F.lit(0), F.lit(last_age))).alias("age")).withColumn("age", F.col("age").cast("double"))
    from panelwright.operators.joins import asof_backward

    on_grid = asof_backward(grid, curve, "age", ["survival"], keys).withColumn("survival", F.coalesce("survival", F.lit(1.0)))
    return on_grid.withColumn("cumulative", 1 - F.col("survival"))


def cumulative_incidence(v: DataFrame, first: str = "event_default", second: str = "event_prepay", last_age: int = 120) -> DataFrame:
    """Aalen-Johansen incidence of two competing events at each event age."""
    t = risk_table(v, [first, second]).filter(F.col("at_risk") > 0).filter((F.col(first) + F.col(second) > 0) & (F.col("age") <= last_age))
    w = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    free = _product(1 - (F.col(first) + F.col(second)) / F.col("at_risk"), w)
    t = t.withColumn("event_free", free).withColumn("_before", F.coalesce(F.lag("event_free").over(Window.orderBy("age")), F.lit(1.0)))
    return t.select("age", "at_risk", F.sum(F.col("_before") * F.col(first) / F.col("at_risk")).over(w).alias("cif_first"), F.sum(F.col("_before") * F.col(second) / F.col("at_risk")).over(w).alias("cif_second"), "event_free")


def overstatement(cif: DataFrame, km: DataFrame) -> DataFrame:
    """How far one minus Kaplan-Meier lies over the incidence."""
    from panelwright.operators.joins import asof_backward

    return asof_backward(cif, km.select("age", "cumulative"), "age", ["cumulative"]).withColumn("overstatement", F.col("cumulative") - F.col("cif_first"))


def transition_matrix(df: DataFrame, states: list[str] = STATES, smooth: float = 0.25) -> DataFrame:
    """from_state, to_state, n, p over all cells: smoothed and normalised; absorbing states keep to themselves."""
    cells = df.filter(F.col("current_status").isin(states) & F.col("next_state").isin(states)).groupBy(F.col("current_status").alias("from_state"), F.col("next_state").alias("to_state")).agg(F.count("*").alias("n"))
    one = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in states])).alias("from_state"))
    grid = one.select("from_state", F.explode(F.array(*[F.lit(s) for s in states])).alias("to_state"))
    full = grid.join(F.broadcast(cells), ["from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum(F.col("n") + smooth).over(Window.partitionBy("from_state"))
    p = F.when(F.col("from_state").isin(ABSORBING), (F.col("from_state") == F.col("to_state")).cast("double")).otherwise((F.col("n") + smooth) / total)
    return full.withColumn("p", p)


def project_states(matrix: DataFrame, horizon: int) -> DataFrame:
    """start_state, horizon_month, state, p: the matrix's powers. The matrix is a few dozen cells, so the driver multiplies it."""
    cells = {(r.from_state, r.to_state): r.p for r in matrix.select("from_state", "to_state", "p").collect()}
    states = sorted({s for cell in cells for s in cell})
    one = np.array([[cells.get((a, b), 0.0) for b in states] for a in states]).reshape(len(states), len(states))
    rows, now = [], np.eye(len(states))
    for k in range(1, horizon + 1):
        now = now @ one
        rows += [(a, k, b, float(now[i, j])) for i, a in enumerate(states) for j, b in enumerate(states)]
    return matrix.sparkSession.createDataFrame(rows, "start_state string, horizon_month int, state string, p double")


def projected_vs_observed(matrix: DataFrame, targeted: DataFrame, horizon: int = 12, least: int = 30) -> DataFrame:
    """Projected default share of each start state against the observed rate of the forward label."""
    seen = targeted.filter(F.col("next_12m_default_flag").isNotNull()).groupBy(F.col("current_status").alias("start_state")).agg(F.count("*").alias("n"), F.avg("next_12m_default_flag").alias("observed")).filter(F.col("n") >= least)
    said = project_states(matrix, horizon).filter((F.col("horizon_month") == horizon) & (F.col("state") == "Default")).select("start_state", F.col("p").alias("projected"))
    return seen.join(F.broadcast(said), "start_state").withColumn("error", F.abs(F.col("projected") - F.col("observed")))


def censoring_summary(v: DataFrame) -> DataFrame:
    middle = exact_quantiles(v, "duration", [0.5], ["event_type"]).select("event_type", F.col("q")[0].alias("median_duration"))
    return v.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("administratively_censored").alias("administrative"), F.sum("left_truncated").alias("left_truncated")).join(middle, "event_type", "left")
