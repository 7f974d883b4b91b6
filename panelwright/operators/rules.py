"""Declarative quality rules: flags, record scores, batch grades, exception types."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import STATUS_DAYS, band, flag, map_codes


@dataclass(frozen=True)
class Rule:
    name: str
    dimension: str
    severity: float
    predicate: Column

    @property
    def flag(self) -> str:
        return f"vr_{self.name}"


def default_rules() -> list[Rule]:
    """The seventeen rules in their order; severities are fixed values."""
    c = F.col
    return [
        Rule("origination_after_reporting", "temporal", 14.0, c("orig_pno") > c("pno")),
        Rule("last_updated_before_period_end", "temporal", 8.0, c("last_updated_at") < c("period_end")),
        Rule("loan_age_inconsistent", "temporal", 9.0, F.abs(c("loan_age_months") - (c("pno") - c("orig_pno"))) > 2),
        Rule("negative_balance", "validity", 16.0, c("current_balance") < 0),
        Rule("balance_exceeds_original", "validity", 12.0, c("current_balance") > c("original_balance") * 1.02),
        Rule("balance_increase_mom", "consistency", 7.0, (c("balance_growth") > 0.005) & (c("modification_flag") == 0)),
        Rule("dpd_sentinel", "validity", 10.0, c("days_past_due").isin(9999.0, -1.0, 999.0)),
        Rule("status_dpd_mismatch", "consistency", 11.0, F.abs(c("dpd_clean") - c("expected_dpd")) > 29),
        Rule("rate_out_of_range", "validity", 10.0, (c("interest_rate") <= 0.5) | (c("interest_rate") > 25)),
        # A missing term counts as inconsistent.
        Rule("remaining_term_inconsistent", "consistency", 6.0, F.coalesce(~(c("loan_age_months") + c("remaining_term_months")).isin(180, 240, 360), F.lit(True))),
        Rule("missing_critical_field", "completeness", 9.0, c("credit_score_band").isNull() | c("ltv_band").isNull() | c("dti_band").isNull()),
        Rule("document_incomplete", "completeness", 7.0, c("document_status").isin("missing", "exception")),
        Rule("stale_reporting", "timeliness", 6.0, c("lag_days") > 75),
        Rule("feed_balance_break", "reconciliation", 13.0, (c("balance_gap_rel") > 0.01) & (c("balance_gap") > 500)),
        Rule("feed_status_conflict", "reconciliation", 11.0, c("status_conflict") == 1),
        Rule("feed_record_absent", "reconciliation", 3.0, c("svc_present") == 0),
        Rule("terminal_with_balance", "consistency", 12.0, c("current_status").isin("Prepaid", "PaidOff", "Default") & (c("current_balance") > 1000)),
    ]


def rules_table(spark, rules: list[Rule]) -> DataFrame:
    """The rules as rows."""
    return spark.createDataFrame([(i, r.name, r.dimension, r.severity) for i, r in enumerate(rules)], "position int, name string, dimension string, severity double")


def prepare_for_rules(df: DataFrame, entity: str = "entity_id", month: str = "month_index") -> DataFrame:
    """Adds growth since the entity's row before (0 without a usable one) and the days that the status stands for."""
    prev = F.lag("current_balance").over(Window.partitionBy(entity).orderBy(month))
    usable = prev.isNotNull() & (F.abs(prev) > 1)
    growth = F.when(usable, (F.col("current_balance") - prev) / F.abs(prev)).otherwise(0.0)
    return df.withColumns({"balance_growth": growth, "expected_dpd": map_codes("current_status", STATUS_DAYS)})


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One 0/1 column for each rule; unknown counts as no violation."""
    return df.select("*", *[flag(r.predicate).alias(r.flag) for r in rules])


def rule_summary(flags: DataFrame, rules: list[Rule]) -> DataFrame:
    """Violations and their rate, one pass over the rows for all rules."""
    sums = flags.agg(F.count("*").alias("rows"), *[F.sum(r.flag).alias(r.name) for r in rules])
    return sums.unpivot("rows", [r.name for r in rules], "rule", "violations").select("rule", "violations", (F.col("violations") / F.col("rows")).alias("violation_rate"))


def score_records(flags: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds penalty, dq_score in 0..100, violations and the score's band."""
    penalty = reduce(lambda a, b: a + b, [F.col(r.flag) * r.severity for r in rules])
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - penalty))
    out = flags.withColumns({"penalty": penalty, "dq_score": score, "violations": reduce(lambda a, b: a + b, [F.col(r.flag) for r in rules])})
    return out.withColumn("dq_band", band("dq_score", [50, 75, 90], ["critical", "poor", "watch", "clean"]))


def score_batches(scored: DataFrame, by: list[str], rules: list[Rule]) -> DataFrame:
    """A grade for each batch, and its most frequent violation: one aggregation; rows without a batch are left out."""
    rates = [F.avg(r.flag).alias(r.flag) for r in rules]
    critical = F.avg((F.col("dq_band") == "critical").cast("int"))
    out = scored.dropna(subset=by).groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg("dq_score").alias("mean_score"), F.min("dq_score").alias("min_score"), critical.alias("share_critical"), F.avg("violations").alias("violations_per_record"), *rates
    )
    top = F.greatest(*[F.col(r.flag) for r in rules])
    first = F.coalesce(*[F.when(F.col(r.flag) == top, r.name) for r in rules])
    graded = out.withColumns({"grade": band("mean_score", [70, 82, 91], ["D", "C", "B", "A"]), "top_rule": first, "top_rule_rate": top})
    return graded.drop(*[r.flag for r in rules])


def rollup_scores(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k groups with the lowest mean score."""
    return scored.dropna(subset=[by]).groupBy(by).agg(F.count("*").alias("rows"), F.avg("dq_score").alias("mean_score")).orderBy("mean_score", by).limit(k)


def band_distribution(scored: DataFrame) -> DataFrame:
    """Rows and share of each band."""
    counts = scored.groupBy("dq_band").agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1))))


def headline(scored: DataFrame) -> DataFrame:
    """Mean, median and share of records with a violation."""
    return scored.agg(F.count("*").alias("rows"), F.avg("dq_score").alias("mean_score"), F.median("dq_score").alias("median_score"), F.avg((F.col("violations") > 0).cast("int")).alias("share_with_violations"))


def rules_fired(rules: list[Rule]) -> Column:
    """Names of the violated rules in their order."""
    return F.concat_ws("; ", *[F.when(F.col(r.flag) == 1, r.name) for r in rules])


#: Exception types, the first that holds names the record (fixed values).
PRIORITY = ["date_breach", "reconciliation_breach", "document_breach", "dpd_breach", "balance_breach", "stale_breach"]


def breach_flags(recon: DataFrame, entity: str = "entity_id", month: str = "month_index") -> DataFrame:
    """Six breach flags of a reconciled panel."""
    c = F.col
    prev = F.lag("current_balance").over(Window.partitionBy(entity).orderBy(month, "seq"))
    growth = (c("current_balance") - prev) / F.nullif(F.abs(prev), F.lit(0.0))
    days = F.coalesce(F.abs(c("days_past_due") - map_codes("current_status", STATUS_DAYS)), F.lit(0.0))
    rel = F.when(F.abs("current_balance") > 1, c("balance_gap") / F.abs("current_balance"))
    flags = {
        "date_breach": (c("orig_pno") > c("pno")) | (c("last_updated_at") < c("period_end")) | (F.abs(c("loan_age_months") - (c("pno") - c("orig_pno"))) > 2),
        "reconciliation_breach": (rel > 0.01) & (c("balance_gap") > 500),
        "document_breach": c("document_status").isin("missing", "exception"),
        "dpd_breach": (days > 29) | (c("days_past_due") > 900) | (c("days_past_due") < 0),
        "balance_breach": (growth > 0.005) | (c("current_balance") > 1.02 * c("original_balance")) | (c("current_balance") < 0),
        "stale_breach": F.datediff("last_updated_at", "period_end") > 75,
    }
    return recon.withColumns({k: flag(v) for k, v in flags.items()})


def resolve_priority(flags: DataFrame, order: list[str] = PRIORITY) -> DataFrame:
    """exception_type: the first breach in order, or none; exception_required: whether there is one."""
    kind = F.coalesce(*[F.when(F.col(f) == 1, f) for f in order], F.lit("none"))
    return flags.withColumn("exception_type", kind).withColumn("exception_required", (F.col("exception_type") != "none").cast("int"))
