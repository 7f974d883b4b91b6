"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days past due that a status stands for (fixed values).
STATUS_DAYS = {"Current": 0, "DQ30": 30, "DQ60": 60, "DQ90plus": 90, "Default": 180, "Prepaid": 0, "PaidOff": 0}
#: Severity order of statuses; ended accounts are below all (fixed values).
STATUS_ORDER = {"Current": 0, "DQ30": 1, "DQ60": 2, "DQ90plus": 3, "Default": 4, "Prepaid": -1, "PaidOff": -1}
#: Bands in their order, their upper edges and sentinels; code maps (fixed values).
CREDIT_BANDS = ["<580", "580-619", "620-659", "660-699", "700-739", "740-779", "780+"]
LTV_BANDS = ["<=60", "60-70", "70-80", "80-90", "90-95", ">95"]
DTI_BANDS = ["<=20", "20-30", "30-36", "36-43", ">43"]
LOSS_BANDS = ["0-10", "10-25", "25-40", "40-60", "60+"]
CREDIT_EDGES, LTV_EDGES, DTI_EDGES, LOSS_EDGES = [580, 620, 660, 700, 740, 780], [60.001, 70, 80, 90, 95], [20.001, 30, 36, 43], [10, 25, 40, 60]
CREDIT_SENTINELS, LTV_SENTINELS, DTI_SENTINELS = (9999.0,), (999.0,), (999.0,)
OCCUPANCY = {"P": "primary", "S": "second_home", "I": "investment"}
PURPOSE = {"P": "purchase", "N": "rate_term_refi", "C": "cash_out_refi"}
PROPERTY = {"SF": "single_family", "PU": "pud", "CO": "condo", "MH": "manufactured", "CP": "condo"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(c: Column | str, edges: list[float], labels: list[str], closed: str = "right", sentinels: tuple = ()) -> Column:
    """The label of the interval that holds c: len(edges) + 1 labels; null and sentinels have none."""
    c = col(c)
    inside = (lambda e: c <= e) if closed == "right" else (lambda e: c < e)
    steps = reduce(lambda w, x: w.when(inside(x[0]), x[1]), zip(edges[1:], labels[1:]), F.when(inside(edges[0]), labels[0]))
    missing = c.isNull() | c.isin(*sentinels) if sentinels else c.isNull()
    return F.when(missing, F.lit(None).cast("string")).otherwise(steps.otherwise(labels[-1]))


def credit_band(c: Column | str) -> Column:
    return band(c, CREDIT_EDGES, CREDIT_BANDS, "left", CREDIT_SENTINELS)


def ltv_band(c: Column | str) -> Column:
    return band(c, LTV_EDGES, LTV_BANDS, "right", LTV_SENTINELS)


def dti_band(c: Column | str) -> Column:
    return band(c, DTI_EDGES, DTI_BANDS, "right", DTI_SENTINELS)


def loss_band(c: Column | str) -> Column:
    return band(c, LOSS_EDGES, LOSS_BANDS, "left")


def map_codes(c: Column | str, mapping: dict, default=None) -> Column:
    """Look c up in a short table; what is not in it gets the default."""
    c, items = col(c), list(mapping.items())
    steps = reduce(lambda w, x: w.when(c == x[0], F.lit(x[1])), items[1:], F.when(c == items[0][0], F.lit(items[0][1])))
    return steps.otherwise(F.lit(default))


def property_type(code: Column | str, units: Column | str) -> Column:
    """Property by its code (single family if unknown), but by the number of units where there are two or more; unknown units are one."""
    return F.when(F.coalesce(col(units).try_cast("int"), F.lit(1)) >= 2, F.lit("2-4_unit")).otherwise(map_codes(code, PROPERTY, "single_family"))


def ordinal(c: Column | str, categories: list[str]) -> Column:
    """Position in an ordered list; unknown and null have none."""
    return map_codes(c, {v: float(i) for i, v in enumerate(categories)})


def flag(predicate: Column) -> Column:
    """1 where the predicate holds, 0 where it does not or is unknown."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def positive_or_null(c: Column | str) -> Column:
    """c without zero, as a denominator."""
    return F.nullif(col(c), F.lit(0.0))


def bucket(c: Column | str, edges: list[float]) -> Column:
    """Right-closed bucket number from 0; outside the edges null."""
    c = col(c)
    steps = F.when(c <= edges[0], F.lit(None).cast("int"))
    for i, e in enumerate(edges[1:]):
        steps = steps.when(c <= e, i)
    return steps


def annuity(principal: Column, monthly_rate: Column, n: Column) -> Column:
    """Level payment; null where the rate or the growth makes it undefined."""
    n = F.greatest(n, F.lit(1))
    growth = F.pow(1 + monthly_rate, n)
    return F.when(growth != 1, principal * monthly_rate * growth / (growth - 1))


def shift_month(c: Column | str, n: int) -> Column:
    """First of the month n months on."""
    return F.add_months(F.trunc(col(c), "month"), n)


def month_number(c: Column | str) -> Column:
    return F.year(col(c)) * 12 + F.month(col(c)) - 1


def masked_id(c: Column | str, prefix: str = "LN-", n: int = 10) -> Column:
    """Stable pseudonym: the first characters of the SHA-256 hash."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(col(c).cast("string"), 256), 1, n)))
