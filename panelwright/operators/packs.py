"""Grounding packs: the facts a text may quote, as nested columns, and the numbers in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.columns import masked_id
from panelwright.operators.textguard import allowed_numbers, parse_numbers

#: Facts of a record and the digits they are rounded to; None for words and whole numbers.
FACTS = {
    "reporting_month": None, "servicer_name": None, "current_status": None, "dpd_clean": 0, "age_clean": 0, "credit_score_band": None, "ltv_band": None, "balance_clean": 2, "modification_flag": None,
    "document_status": None, "dq_score": 1,
}


def build_pack(df: DataFrame, predictions: list[str], drivers: str | None = None, entity: str = "entity_id", facts: dict[str, int | None] = FACTS) -> DataFrame:
    """df with pack: struct of record (masked id, rounded facts), model_predictions (to 4 digits), top_drivers, provenance. NaN and infinite numbers are null."""

    def told(c: str, digits: int | None) -> Column:
        if digits is None:
            return F.col(c)
        x = F.col(c).cast("double")
        return F.round(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), digits)

    record = F.struct(masked_id(entity).alias("entity_id"), *[told(c, d).alias(c) for c, d in facts.items() if c in df.columns])
    provenance = F.struct(F.lit("fitted models").alias("predictions"), F.lit("narration only").alias("text"))
    return df.withColumn("pack", F.struct(record.alias("record"), F.struct(*[told(c, 4).alias(c) for c in predictions]).alias("model_predictions"), (F.col(drivers) if drivers else F.lit("")).alias("top_drivers"), provenance.alias("provenance")))


def build_list_pack(parts: dict[str, DataFrame], orders: dict[str, list], k: int = 5) -> DataFrame:
    """One row: an array column for each part, of its first k rows in order, as structs. Top-k is taken before rows meet."""
    out = None
    for name, df in parts.items():
        top = df.orderBy(*orders[name]).limit(k).withColumn("_at", F.monotonically_increasing_id())
        ranked = F.array_sort(F.collect_list(F.struct("_at", F.struct(*df.columns).alias("row"))))
        one = top.agg(F.transform(ranked, lambda x: x["row"]).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def pack_numbers(df: DataFrame, pack: str) -> Column:
    """All numbers in a pack, in numbers and in words, with those times and by a hundred and rounded to 0 to 3 places."""
    leaves: list[Column] = []

    def walk(column: Column, kind) -> None:
        name = kind.typeName()
        if name == "struct":
            for field in kind.fields:
                walk(column[field.name], field.dataType)
        elif name == "array":
            leaves.append(_in_array(column, kind.elementType))
        else:
            leaves.append(_numbers(column, name))

    walk(F.col(pack), df.schema[pack].dataType)
    values = F.filter(F.flatten(F.array(*leaves)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return allowed_numbers(values)


def _numbers(value: Column, kind: str) -> Column:
    if kind == "string":
        return F.coalesce(parse_numbers(value), F.array().cast("array<double>"))
    if kind in ("boolean", "date", "timestamp", "void"):
        return F.array().cast("array<double>")
    return F.array(value.cast("double"))


def _in_array(column: Column, kind) -> Column:
    if kind.typeName() == "struct":
        each = lambda x: F.flatten(F.array(*[_numbers(x[f.name], f.dataType.typeName()) for f in kind.fields]))
    else:
        each = lambda x: _numbers(x, kind.typeName())
    return F.coalesce(F.flatten(F.transform(column, each)), F.array().cast("array<double>"))
