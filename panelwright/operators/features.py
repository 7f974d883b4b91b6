"""Backward-looking features of a panel: all windows run over one partitioning, rows counted, not calendar months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import CREDIT_BANDS, DTI_BANDS, LTV_BANDS, STATUS_DAYS, STATUS_ORDER, annuity, bucket, map_codes, ordinal, positive_or_null
from panelwright.operators.clean import assert_no_leakage

ENTITY, MONTH = "entity_id", "month_index"


def history(entity: str = ENTITY, month: str = MONTH):
    return Window.partitionBy(entity).orderBy(month)


def lags(columns: list[str], ks=(1, 3, 6)) -> dict[str, Column]:
    w = history()
    return {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in ks}


def deltas(columns: list[str]) -> dict[str, Column]:
    w = history()
    return {f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in columns}


def rolling(value: Column, name: str, how=F.max, widths=(3, 6, 12)) -> dict[str, Column]:
    """Over the current row and those before it."""
    return {f"{name}_{k}": how(value).over(history().rowsBetween(1 - k, 0)) for k in widths}


def running(value: Column, how=F.max) -> Column:
    return how(value).over(history().rowsBetween(Window.unboundedPreceding, 0))


def streak(df: DataFrame, flag: str, out: str) -> DataFrame:
    """Rows since the flag was last set; a start without it counts from 0 too. It needs no order but the history's."""
    numbered = df.withColumn("_row", F.row_number().over(history()))
    since = running(F.when(F.col(flag) != 0, F.col("_row")))
    return numbered.withColumn(out, F.col("_row") - F.coalesce(since, F.lit(1))).drop("_row")


def pct_change(column: str, k: int) -> Column:
    before = F.lag(column, k).over(history())
    return (F.col(column) - before) / positive_or_null(F.abs(before))


def missing_indicators(columns: list[str]) -> dict[str, Column]:
    ind = {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}
    return ind | {"missing_count": sum(ind.values(), F.lit(0))}


def build_features(df: DataFrame) -> DataFrame:
    """A cleaned, reconciled panel with macro columns, and its features; nothing here looks ahead."""
    c = F.col
    base = df.withColumns(
        {
            "status_ord": map_codes("current_status", STATUS_ORDER).cast("int"),
            "credit_ord": ordinal("credit_score_band", CREDIT_BANDS),
            "ltv_ord": ordinal("ltv_band", LTV_BANDS),
            "dti_ord": ordinal("dti_band", DTI_BANDS),
            "balance_ratio": c("balance_clean") / positive_or_null("original_balance"),
            "term_progress": c("age_clean") / positive_or_null((c("age_clean") + c("remaining_term_months")).cast("double")),
            "rate_incentive": c("rate_clean") - c("market_mortgage_rate"),
            "calendar_month": (c("pno") % 12 + 1).cast("int"),
            "vintage_year": F.floor(c("orig_pno") / 12).cast("int"),
            "log_original_balance": F.log1p(F.greatest(c("original_balance"), F.lit(0.0))),
            "log_balance": F.log1p(F.when(c("balance_clean").isNotNull(), F.greatest(c("balance_clean"), F.lit(0.0)))),
        }
    )
    late = F.when(c("status_ord") > 0, 1).otherwise(0)
    base = base.withColumn("late", late)
    w = history()
    full = base.withColumns(
        lags(["status_ord", "dpd_clean"])
        | deltas(["status_ord", "dpd_clean"])
        | rolling(c("dpd_clean"), "dpd_max")
        | rolling(c("late"), "late_count", F.sum)
        | {
            "ever_late": running(c("late")),
            "worst_status": F.when(c("status_ord").isNotNull(), running(c("status_ord"))),
            "balance_change_1": pct_change("balance_clean", 1),
            "balance_change_3": pct_change("balance_clean", 3),
            "months_seen": F.row_number().over(w),
        }
    )
    full = streak(full, "late", "clean_streak")
    payment = annuity(c("original_balance"), c("rate_clean") / 1200, (c("age_clean") + c("remaining_term_months")).cast("double"))
    progress = F.when(c("term_progress").isNotNull(), F.least(F.greatest(c("term_progress"), F.lit(0.0)), F.lit(1.0)))
    return full.withColumns(
        {
            "balance_flat": F.coalesce((F.abs("balance_change_1") < 1e-6).cast("int"), F.lit(0)),
            "amortisation": 1 - c("balance_ratio"),
            "amortisation_residual": c("balance_ratio") - (1 - F.pow(progress, F.lit(1.6))),
            "incentive_positive": F.when(c("rate_incentive").isNotNull(), F.greatest(c("rate_incentive"), F.lit(0.0))),
            "payment_ratio": payment / positive_or_null("balance_clean"),
            "seasoning": bucket("age_clean", [-1, 6, 12, 24, 36, 60, 120, 1000]),
            "growth_positive": F.when(c("balance_change_1").isNotNull(), F.greatest(c("balance_change_1"), F.lit(0.0))),
            "doc_problem": F.coalesce((c("document_status") != "complete").cast("int"), F.lit(0)),
            "manual_source": F.coalesce((c("source_system") == "manual_upload").cast("int"), F.lit(0)),
            "gap_filled": F.coalesce("balance_gap_rel", F.lit(0.0)),
            "dpd_gap_filled": F.coalesce("dpd_gap", F.lit(0.0)),
            "dpd_status_residual": c("dpd_clean") - map_codes("current_status", STATUS_DAYS),
            "scheduled_payment": payment,
        }
        | {f"{name}_missing": c(name).isNull().cast("int") for name in ("property_type", "occupancy_type", "rate_clean", "dpd_clean")}
        | missing_indicators(["interest_rate", "credit_score_band", "ltv_band", "dti_band", "days_past_due"])
    )


#: What models may use.
NUMERIC = [
    "status_ord", "credit_ord", "ltv_ord", "dti_ord", "balance_ratio", "term_progress", "rate_incentive", "log_original_balance", "dpd_clean", "status_ord_lag1", "dpd_max_3",
    "dpd_max_6", "dpd_max_12", "late_count_3", "late_count_6", "late_count_12", "ever_late", "clean_streak", "balance_flat", "amortisation_residual", "missing_count", "gap_filled",
]
CATEGORICAL = ["state", "loan_purpose", "occupancy_type", "property_type", "current_status", "document_status", "source_system"]


def design_matrix(df: DataFrame, numeric: list[str], categorical: list[str], out: str = "features"):
    """Unfitted stages that impute, index and assemble; refuses columns that tell the outcome."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler

    assert_no_leakage([*numeric, *categorical])
    typed = df.withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(c, F.lit("missing")) for c in categorical})
    filled = [f"{c}_in" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=filled)]
    codes = [f"{c}_code" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=codes, handleInvalid="keep", stringOrderType="frequencyDesc"))
    stages.append(VectorAssembler(inputCols=[*filled, *codes], outputCol=out))
    return typed, Pipeline(stages=stages)


def snapshot(df: DataFrame, entity: str = ENTITY, month: str = MONTH) -> DataFrame:
    """Each entity's last row, whole."""
    last = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(month)))
    return df.withColumn("_n", last).filter("_n = 1").drop("_n")
