"""Exact quantiles of many groups and columns at once, without a sort and without keeping a column's values in one place.

A double becomes an integer of the same order (its sign, exponent and fraction). The values at the wanted ranks are then found digit by digit: counts by leading digits say in which
bracket each rank lies, and only the brackets' rows are counted by further digits, until brackets hold few distinct values. So each round is an ordinary aggregation with partial
counts in the tasks; nothing holds more than a table of counts by digits, and the result does not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources.session import saved

#: Rows that a bracket may hold and still be counted by value in one go; digits (in bits) that each round leaves open.
FEW_ROWS = 1 << 20
OPEN_BITS = (44, 28, 12)
_FRACTION = 1 << 52


def ordered_long(x: Column, guess: Column | None = None) -> Column:
    """A long that orders as the double does, NaN last; exact for every double, with the two zeros alike. guess: the exponent, floor(log2(abs(x)))."""
    a = F.abs(x)
    guess = F.floor(F.log2(a)) if guess is None else guess
    one = F.lit(_FRACTION)
    scaled = a * F.pow(F.lit(2.0), -guess)
    fraction = lambda y: ((y - 1) * float(_FRACTION)).cast("long")
    # The logarithm may be off by one next to a power of two.
    rest = F.when(scaled >= 2, fraction(scaled / 2) + one).when(scaled < 1, fraction(scaled * 2) - one).otherwise(fraction(scaled))
    tiny = (a * float(2**537) * float(2**537)).cast("long")
    size = F.when(a == 0, F.lit(0).cast("long")).when(a < 2.0**-1022, tiny).when(a == float("inf"), F.lit(2047 * _FRACTION)).otherwise((guess.cast("long") + 1023) * one + rest)
    return F.when(F.isnan(x), F.lit(2047 * _FRACTION + 1)).when(x < 0, -size).otherwise(size)


def _double(k: Column) -> Column:
    """The double of an ordered long."""
    a = F.abs(k)
    exponent, fraction = F.shiftright(a, 52) - 1023, a.bitwiseAND(F.lit(_FRACTION - 1)).cast("double") / float(_FRACTION)
    # In two factors, since one power of two would be out of range at either end.
    half = F.floor(exponent / 2)
    normal = (1 + fraction) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)
    size = F.when(a > 2047 * _FRACTION, float("nan")).when(a == 2047 * _FRACTION, float("inf")).when(a < _FRACTION, a.cast("double") / float(2**537) / float(2**537)).otherwise(normal)
    return F.when(k < 0, -size).otherwise(size)


def same(left: str, right: str, keys: list[str], prefix: str) -> Column:
    """left.k and right.prefix+k alike for all keys, nulls too."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{prefix}{k}")) for k in keys], F.lit(True))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_r_{k}" for k in keys})


def exact_quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, n (weight of known values), q: array of the quantiles at `shares`, between neighbouring values by linear interpolation.

    One row for each group with a known value; null groups form one. Nulls are left out, and rows of no weight; `weight` counts a row so many times (whole numbers).
    """
    by = list(by)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    known = rows.select(*by, F.col(value).cast("double").alias("_x"), w.alias("_w")).filter("_x IS NOT NULL AND _w > 0")
    guessed = known.withColumn("_e", F.floor(F.log2(F.abs("_x"))))
    keyed = saved(guessed.select(*by, ordered_long(F.col("_x"), F.col("_e")).alias("_k"), "_w"), "ordered")

    def located(wanted: DataFrame | None, parent: int, bits: int) -> DataFrame:
        """by, n, _i, _rank, _at (leading digits of the value at the rank), _under (weight below that bracket), _rows (in it)."""
        up, digits = (F.shiftright("_k", parent) if parent < 64 else F.lit(0).cast("long")), F.shiftright("_k", bits) if bits else F.col("_k")
        some = keyed.select(*by, up.alias("_up"), digits.alias("_d"), "_w")
        if wanted is not None:
            brackets = _renamed(wanted.select(*by, F.col("_at").alias("_up")).distinct(), [*by, "_up"])
            some = some.alias("l").join(brackets.alias("r"), same("l", "r", [*by, "_up"], "_r_"), "left_semi")
        cells = some.groupBy(*by, "_up", "_d").agg(F.sum("_w").alias("_w"), F.count("*").alias("_rows"))
        if wanted is None:
            cells = saved(cells, "digits")  # totals and places both come from it
            totals = cells.groupBy(*by).agg(F.sum("_w").alias("n"))
            ranks = F.array(*[F.struct(F.lit(2 * i + up).alias("_i"), (F.ceil if up else F.floor)(F.lit(float(s)) * (F.col("n") - 1)).cast("long").alias("_rank")) for i, s in enumerate(shares) for up in (0, 1)])
            wanted = totals.select(*by, "n", F.explode(ranks).alias("_r")).select(*by, "n", "_r.*", F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_under"))
        upto = F.sum("_w").over(Window.partitionBy(*by, "_up").orderBy("_d"))
        cells = _renamed(cells.withColumn("_end", upto).select(*by, "_up", "_d", "_w", "_end", F.col("_rows").alias("_in")), [*by, "_up"])
        start = F.col("_under") + F.col("_end") - F.col("_w")
        inside = (F.col("_rank") >= start) & (F.col("_rank") < F.col("_under") + F.col("_end"))
        here = wanted.select(*by, "n", "_i", "_rank", F.col("_at").alias("_up"), "_under").alias("l").join(cells.alias("r"), same("l", "r", [*by, "_up"], "_r_") & inside)
        return here.select(*[f"l.{c}" for c in by], "n", "_i", "_rank", F.col("_d").alias("_at"), start.alias("_under"), F.col("_in").alias("_rows"))

    wanted, parent = None, 64
    for bits in OPEN_BITS:
        wanted, parent = saved(located(wanted, parent, bits), "brackets"), bits
        if (wanted.agg(F.max("_rows")).first()[0] or 0) <= FEW_ROWS:
            break
    found = located(wanted, parent, 0).withColumn("_v", _double(F.col("_at")))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("_v")))

    def between(i: int, share: float) -> Column:
        position = F.lit(float(share)) * (F.col("n") - 1)
        low, high, part = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}"), position - F.floor(position)
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    wide = found.groupBy(*by).agg(F.max("n").alias("n"), *[at(i).alias(f"_v{i}") for i in range(2 * len(shares))])
    return wide.select(*by, "n", F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """column, n, q of each of the columns, which are read once."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "_value")
    return exact_quantiles(long, "_value", shares, ["column"])


def in_one_row(quantiles: DataFrame, columns: list[str], prefix: str, place: int = 0) -> DataFrame:
    """One row with prefix+column for each column: its quantile at a place; null for a column without known values."""
    return quantiles.agg(*[F.max(F.when(F.col("column") == c, F.col("q")[place])).alias(f"{prefix}{c}") for c in columns])
