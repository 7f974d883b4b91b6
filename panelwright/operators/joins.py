"""Bringing tables together: feeds, dimensions, macro series, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import flag
from panelwright.operators.prefix import last_known


def latest_wins(feed: DataFrame, keys: list[str], ts: str, ties: list[str]) -> DataFrame:
    """The last record of each key; one without a time counts as last."""
    order = [F.desc_nulls_first(ts), *[F.desc(t) for t in ties]]
    return feed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def count_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, keys, duplicates: rows beyond the first of their key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum(F.col("n") - 1).alias("duplicates"))


def find_orphans(feed: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """Feed rows whose key the panel lacks."""
    return feed.join(panel.select(*keys), keys, "left_anti")


def reconcile(panel: DataFrame, feed: DataFrame, keys=("entity_id", "month_index")) -> DataFrame:
    """panel with the feed's latest record and the gaps to it; a record without a balance counts as absent."""
    new = feed.select(*keys, F.col("reported_balance").alias("svc_balance"), F.col("reported_status").alias("svc_status"), F.col("reported_dpd").alias("svc_dpd"))
    out = panel.join(new, list(keys), "left")
    present = F.col("svc_balance").isNotNull()
    gap = F.abs(F.col("svc_balance") - F.col("current_balance"))
    return out.withColumns(
        {
            "svc_present": present.cast("int"),
            "balance_gap": gap,
            "balance_gap_rel": gap / F.nullif(F.abs("current_balance"), F.lit(0.0)),
            "status_conflict": flag(present & (F.col("svc_status") != F.col("current_status"))),
            "dpd_gap": F.abs(F.col("svc_dpd") - F.col("days_past_due")),
        }
    )


def attach_static(panel: DataFrame, entity: str, value: str, order: str, out: str) -> DataFrame:
    """Each entity's first known value of a column on all its rows."""
    first = panel.filter(F.col(value).isNotNull()).groupBy(entity).agg(F.min_by(value, order).alias(out))
    return panel.join(first, entity, "left")


def attach_macro(panel: DataFrame, macro: DataFrame, on: str = "pno", lag: int = 12) -> DataFrame:
    """The month's macro values and their change over `lag` rows, computed on the short monthly table."""
    w = Window.orderBy(on)
    diffs = {f"{c}_chg": F.col(c) - F.lag(c, lag).over(w) for c in ("market_mortgage_rate", "unemployment_rate", "hpi_yoy_growth")}
    return panel.join(F.broadcast(macro.drop("reporting_month").withColumns(diffs)), on, "left")


def asof_backward(left: DataFrame, right: DataFrame, on: str, columns: list[str], by: list[str] = (), parts: int | None = None) -> DataFrame:
    """For each left row the values of the last right row at or before it, within `by`: one sort, no pairs.

    Without `by`, more rows than one window may hold (or any number, where `parts` is given) are sorted in parts, and each part takes over the last values of those before it.
    """
    both = left.select("*", F.lit(1).alias("_left"), *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]).unionByName(
        right.select(*by, on, *columns).withColumn("_left", F.lit(0)), allowMissingColumns=True
    )
    if by:
        w = Window.partitionBy(*by).orderBy(on, "_left").rowsBetween(Window.unboundedPreceding, 0)
        filled = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    else:
        filled = last_known(both, on, "_left", columns, parts)
    return filled.filter("_left = 1").drop("_left")


def attach_recon(panel: DataFrame, feed: DataFrame, keys=("entity_id", "month_index")) -> DataFrame:
    """panel with the feed's latest record under recon_ names, for labelling; recon_record_present is 1 where it has a balance."""
    names = {"reported_balance": "recon_reported_balance", "reported_status": "recon_reported_status", "reported_dpd": "recon_reported_dpd", "received_at": "recon_received_at"}
    out = panel.join(feed.select(*keys, *[F.col(a).alias(b) for a, b in names.items()]), list(keys), "left")
    return out.withColumn("recon_record_present", F.col("recon_reported_balance").isNotNull().cast("int"))


def attach_scores(df: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """df with the scores of its rows, by key; a row without a score keeps nulls."""
    return df.join(scores, keys, "left")


def restrict_entities(df: DataFrame, entities: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of the given entities, or of all others."""
    return df.join(entities, entities.columns, "left_semi" if keep else "left_anti")
