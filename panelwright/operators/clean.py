"""Repairing single values, rows and keys of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import flag

#: Columns that tell the outcome, which no feature may use (fixed values).
OUTCOMES = {
    "prepayment_flag", "default_flag", "next_state", "loss_severity_band", "exception_required", "exception_type", "terminal_next", "status_next",
    "next_3m_delinquency_flag", "next_6m_delinquency_flag", "next_12m_default_flag", "next_12m_prepayment_flag",
}


def index_months(df: DataFrame, number: str, first: int, last: int, out: str = "month_index") -> DataFrame:
    """Zero-based month in the window; rows outside are dropped."""
    return df.filter(F.col(number).between(first, last)).withColumn(out, F.col(number) - first)


def mask_values(df: DataFrame, source: str, bad: Column, out: str, repaired: str) -> DataFrame:
    """out is source without bad values, repaired says where one was taken out."""
    bad = F.coalesce(bad, F.lit(False))
    return df.withColumns({out: F.when(~bad, F.col(source)), repaired: bad.cast("int")})


def mask_days(df: DataFrame) -> DataFrame:
    c = F.col("days_past_due")
    return mask_values(df, "days_past_due", c.isin(9999.0, -1.0, 999.0) | (c < 0) | (c > 400), "dpd_clean", "dpd_repaired")


def mask_rate(df: DataFrame) -> DataFrame:
    c = F.col("interest_rate")
    return mask_values(df, "interest_rate", c.isin(0.0, 99.99, -1.0) | (c <= 0.5) | (c > 25), "rate_clean", "rate_repaired")


def mask_implausible(df: DataFrame, source: str = "current_balance", ref: str = "original_balance", factor: float = 3.0) -> DataFrame:
    c = F.col(source)
    return mask_values(df, source, (c < 0) | (c > factor * F.col(ref)), "balance_clean", "balance_repaired")


def repair_age(df: DataFrame, age: str = "loan_age_months", orig: str = "orig_pno", now: str = "pno", tolerance: int = 2) -> DataFrame:
    """The age implied by the months where the reported one is too far off; a negative age is none."""
    implied = F.col(now) - F.col(orig)
    off = flag(F.abs(F.col(age) - implied) > tolerance)
    out = F.when(off == 1, implied).otherwise(F.col(age))
    return df.withColumns({"age_clean": F.when(out >= 0, out), "age_repaired": off})


def reporting_lag(df: DataFrame, updated: str = "last_updated_at", end: str = "period_end", stale_days: int = 75) -> DataFrame:
    lag = F.datediff(updated, end)
    return df.withColumns({"lag_days": lag, "is_stale": flag(lag > stale_days)})


def dedupe_keys(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", first).filter("_n = 1").drop("_n")


def repair_panel(df: DataFrame) -> DataFrame:
    """All repairs and the reporting lag, row by row."""
    return reporting_lag(repair_age(mask_implausible(mask_rate(mask_days(df)))))


def clean_panel(df: DataFrame, keys=("entity_id", "month_index"), order=("seq",)) -> DataFrame:
    """All repairs, the reporting lag, and one row for each key."""
    return repair_panel(dedupe_keys(df, list(keys), list(order)))


def repair_summary(df: DataFrame, flags=("dpd_repaired", "rate_repaired", "balance_repaired", "age_repaired")) -> DataFrame:
    """How many rows each repair touched, and their share: one pass."""
    sums = df.agg(F.count("*").alias("rows"), *[F.sum(f).alias(f) for f in flags])
    return sums.unpivot("rows", list(flags), "repair", "repaired").select("repair", "repaired", (F.col("repaired") / F.col("rows")).alias("rate"))


def assert_no_leakage(columns: list[str]) -> list[str]:
    """The columns, or an error if one tells the outcome."""
    bad = sorted(c for c in columns if c in OUTCOMES or c.startswith("next_"))
    if bad:
        raise ValueError(f"columns tell the outcome: {bad}")
    return columns


def lookup(df: DataFrame, column: str, values: list, columns: list[str]) -> DataFrame:
    """The given columns of the rows whose `column` is one of a few values: a filter that reaches the scan."""
    return df.filter(F.col(column).isin(*values)).select(*columns)


def project_contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """The contract's columns that are there, in its order."""
    return df.select(*[c for c in columns if c in df.columns])


def patch_table(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """df with the overrides' values where they have the key."""
    new = [c for c in overrides.columns if c != key]
    renamed = overrides.withColumnsRenamed({c: f"_{c}" for c in new})
    return df.join(renamed, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in new else F.col(c) for c in df.columns])


def sample_entities(df: DataFrame, entity: str, strata: str, n: int, seed: int) -> DataFrame:
    """All rows of n entities of each stratum, drawn by a portable hash."""
    draw = F.md5(F.concat_ws("|", F.col(entity).cast("string"), F.lit(str(seed))))
    ranked = df.select(strata, entity).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(strata).orderBy(draw)))
    return df.join(ranked.filter(F.col("_n") <= n).select(strata, entity), [strata, entity], "left_semi")
