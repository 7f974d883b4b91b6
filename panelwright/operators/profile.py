"""Profiles, dependencies and drift, each computed for all columns in one or two passes."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.prefix import running_totals
from panelwright.operators.quantiles import exact_quantiles
from panelwright.sources.session import saved


def _long(df: DataFrame, columns: list[str], kind: str, keep: list[str] = ()) -> DataFrame:
    """One row for each value of each column: keep, column, value."""
    typed = df.select(*keep, *[F.col(c).cast(kind).alias(c) for c in columns])
    return typed.unpivot(list(keep), columns, "column", "value")


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts, moments, quantiles, bias-corrected skew, and values beyond three interquartile ranges."""
    long = saved(_long(df, columns, "double"), "values")
    n = F.count("value")
    stats = long.groupBy("column").agg(
        F.count("*").alias("n"),
        (F.count("*") - n).alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.when(n > 2, F.skewness("value") * F.sqrt((n * (n - 1)).cast("double")) / (n - 2)).alias("skew"),
        F.count_if(F.col("value") == 0).alias("zeros"),
        F.count_if(F.col("value") < 0).alias("negatives"),
        F.count_distinct("value").alias("distinct"),
    )
    stats = stats.join(exact_quantiles(long, "value", [0.01, 0.25, 0.5, 0.75, 0.99], ["column"]).select("column", "q"), "column", "left")
    q = F.col("q")
    wide = 3 * (q[3] - q[1])
    far = long.join(stats.select("column", (q[1] - wide).alias("lo"), (q[3] + wide).alias("hi")), "column")
    outliers = far.groupBy("column").agg(F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("outliers"))
    named = stats.select("*", *[q[i].alias(f"p{p}") for i, p in enumerate(("01", "25", "50", "75", "99"))]).drop("q")
    return named.join(outliers, "column")


def profile_categorical(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """Missing, distinct, mode and its share, entropy relative to the largest, and the k most frequent values; ties by value."""
    counts = _long(df, columns, "string").groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column")
    known = counts.filter("value is not null")
    ranked = known.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "value")))
    share = F.col("n") / F.col("total")
    label = F.when(F.col("rank") <= k, F.concat("value", F.lit("="), F.format_number(share, 3)))
    rows = counts.groupBy("column").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"))
    out = ranked.groupBy("column").agg(
        F.count("*").alias("distinct"),
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("mode"),
        F.max(F.when(F.col("rank") == 1, share)).alias("mode_share"),
        (-F.sum(share * F.log(share)) / F.when(F.count("*") > 1, F.log(F.count("*").cast("double")))).alias("entropy"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(label.isNotNull(), F.struct("rank", label.alias("l"))))), lambda x: x["l"]), "; ").alias("top"),
    )
    return rows.join(out, "column", "left")


def co_missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of the missing indicators of each pair of columns; 0 where one never varies."""
    ind = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    row = ind.agg(*[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    split = F.split("pair", r"\|")
    return row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr").select(split[0].alias("a"), split[1].alias("b"), "corr")


def missing_by(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Missing rate of each column in each group."""
    return df.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    n = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.count_if(n > 0).alias("rows_with_missing"), (F.avg(n) / len(columns)).alias("mean_missing"))


def _pairs(df: DataFrame, pairs: list[tuple[str, str]], kind: str) -> DataFrame:
    """_p (number of the pair), x, y: a row for each row of df and pair that has both values, in one pass over df."""
    columns = dict.fromkeys(c for pair in pairs for c in pair)
    typed = df.select(*[F.col(c).cast(kind).alias(f"_{i}") for i, c in enumerate(columns)])
    at = {c: f"_{i}" for i, c in enumerate(columns)}
    each = F.array(*[F.struct(F.lit(k).alias("_p"), F.col(at[a]).alias("x"), F.col(at[b]).alias("y")) for k, (a, b) in enumerate(pairs)])
    return typed.select(F.explode(each).alias("v")).select("v.*").filter("x IS NOT NULL AND y IS NOT NULL")


def _named(df: DataFrame, pairs: list[tuple[str, str]], a: str = "a", b: str = "b") -> DataFrame:
    """df with the columns' names in front, in place of _p."""
    names = [F.element_at(F.array(*[F.lit(pair[i]) for pair in pairs]), F.col("_p") + 1).alias(n) for i, n in enumerate((a, b))]
    return df.select(*names, *[c for c in df.columns if c != "_p"])


def contingencies(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """_p, chi2 (with continuity correction for 2 x 2), n, r, c of the two-way table of each pair; nulls left out.

    All tables are counted in one aggregation, and cells that do not occur are never made: what is expected of them is what the others leave.
    """
    cells = saved(_pairs(df, pairs, "string").groupBy("_p", "x", "y").agg(F.count("*").alias("o")), "cells")
    margin = lambda c: cells.groupBy("_p", c).agg(F.sum("o").alias(f"n{c}"))
    sides = [margin(c).groupBy("_p").agg(F.count("*").alias(k), F.sum(1 / F.col(f"n{c}")).alias(f"i{c}"), *([F.sum("nx").alias("n")] if c == "x" else [])) for c, k in (("x", "r"), ("y", "c"))]
    sizes = sides[0].join(sides[1], "_p")
    e = F.col("nx") * F.col("ny") / F.col("n")
    both = cells.join(margin("x"), ["_p", "x"]).join(margin("y"), ["_p", "y"]).join(sizes, "_p").select("_p", "o", "n", "r", "c", "ix", "iy", e.alias("e"))
    gap = F.abs(F.col("o") - F.col("e"))
    sums = both.groupBy("_p", "n", "r", "c", "ix", "iy").agg(F.sum(gap * gap / F.col("e")).alias("q"), F.sum("e").alias("e"), F.max(gap).alias("gap"))
    # The four cells of a 2 x 2 table are equally far from what is expected.
    less = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    yates = less * less * F.col("n") * F.col("ix") * F.col("iy")
    return sums.select("_p", "n", "r", "c", F.when((F.col("r") == 2) & (F.col("c") == 2), yates).otherwise(F.col("q") + F.col("n") - F.col("e")).alias("chi2"))


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution with a whole number of degrees of freedom, as a column: what one step of two degrees adds, from one or two degrees on.

    With two degrees the tail is exp(-x / 2); with one it is that of a normal variable, by its series up to 2.5 and by a continued fraction beyond. Null where df is under 1.
    """
    h = x / 2
    z = F.sqrt(h)
    odd = df % 2 == 1
    down = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda t, k: k / 2 / (z + t))
    step = lambda t, n: F.struct((t["s"] + t["v"] * 2 * h / (2 * n + 1)).alias("s"), (t["v"] * 2 * h / (2 * n + 1)).alias("v"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("s"), z.alias("v")), step, lambda t: t["s"])
    half = 2 / math.sqrt(math.pi) * F.exp(-h)
    one = F.when(z < 2.5, 1 - half * series).otherwise(half / 2 / (z + down))
    a = F.when(odd, 0.5).otherwise(1.0)
    # Terms h ** a * exp(-h) / gamma(a + 1), in logarithms, since either factor may leave the range of a double.
    first = F.when(odd, F.log(h) / 2 - h - math.log(math.sqrt(math.pi) / 2)).otherwise(F.log(h) - h)
    more = F.floor((df + 1) / 2).cast("int") - 1
    add = lambda t, k: F.struct((t["s"] + F.exp(t["l"])).alias("s"), (t["l"] + F.log(h) - F.log(a + k + 1)).alias("l"))
    rest = F.when(more > 0, F.aggregate(F.sequence(F.lit(0), more - 1), F.struct(F.lit(0.0).alias("s"), first.alias("l")), add, lambda t: t["s"])).otherwise(0.0)
    tail = F.least(F.when(odd, one).otherwise(F.exp(-h)) + rest, F.lit(1.0))
    return F.when((df >= 1) & (x <= 0), 1.0).when(df >= 1, tail)


def missingness_tests(df: DataFrame, pairs: list[tuple[str, str]], level: float = 0.01) -> DataFrame:
    """Whether a column's being missing depends on the group, for each (by, column): n, chi2, degrees of freedom, p, Cramer's V and the verdict; all in one pass. Rows without a group are left out."""
    flags = {c: f"_missing_{i}" for i, c in enumerate(dict.fromkeys(c for _, c in pairs))}
    marked = df.select(*dict.fromkeys(b for b, _ in pairs), *[F.col(c).isNull().cast("string").alias(f) for c, f in flags.items()])
    out = contingencies(marked, [(b, flags[c]) for b, c in pairs])
    v = F.sqrt(F.col("chi2") / (F.col("n") * F.nullif(F.least("r", "c") - 1, F.lit(0))))
    tested = out.select("_p", "n", "chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), v.alias("cramers_v")).withColumn("p", chi2_tail(F.col("chi2"), F.col("df")))
    verdict = F.when(F.col("p") < level, "depends on group").when(F.col("p").isNotNull(), "at random").otherwise("does not vary")
    return _named(tested.withColumn("verdict", verdict), pairs, "by", "column")


def cramers_v(df: DataFrame, columns: list[str], max_distinct: int = 40, min_rows: int = 500) -> DataFrame:
    """Bias-corrected association of each pair of short columns; null where degenerate."""
    distinct = {r["column"]: r["k"] for r in _long(df, columns, "string").filter("value IS NOT NULL").groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(F.count("*").alias("k")).collect()}
    pairs = list(combinations([c for c in columns if distinct.get(c, 0) < max_distinct], 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, v double")
    n, r, c = F.col("n"), F.col("r"), F.col("c")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (r - 1) * (c - 1) / (n - 1))
    small = F.least(r - (r - 1) * (r - 1) / (n - 1), c - (c - 1) * (c - 1) / (n - 1)) - 1
    return _named(contingencies(df, pairs).filter(n >= min_rows).select("_p", "n", F.when(small > 0, F.sqrt(phi / small)).alias("v")), pairs)


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of each pair, over rows that have both, with average ranks: counts of pairs of values, ranks by running totals, all pairs together."""
    pairs = list(combinations(columns, 2))
    cells = saved(_pairs(df, pairs, "double").groupBy("_p", "x", "y").agg(F.count("*").alias("o")), "cells")
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("_s"), F.col(c).alias("z")) for c in ("x", "y")])).alias("v")
    counts = cells.select("_p", "o", sides).groupBy("_p", "v._s", "v.z").agg(F.sum("o").alias("k"))
    upto = running_totals(counts, "z", {"cum": "k"}, ["_p", "_s"])
    ranks = upto.select("_p", "_s", "z", (F.col("cum") - F.col("k") + (F.col("k") + 1) / 2).alias("rank"))
    rank = lambda c: ranks.filter(F.col("_s") == c).select("_p", F.col("z").alias(c), F.col("rank").alias(f"r{c}"))
    # The mean of average ranks is known, so the sums can be centred at once.
    size = cells.groupBy("_p").agg(((F.sum("o") + 1) / 2).alias("m"))
    both = cells.join(rank("x"), ["_p", "x"]).join(rank("y"), ["_p", "y"]).join(size, "_p")
    u, w = F.col("rx") - F.col("m"), F.col("ry") - F.col("m")
    sums = both.groupBy("_p").agg(*[F.sum(F.col("o") * p).alias(n) for n, p in (("uw", u * w), ("uu", u * u), ("ww", w * w))])
    return _named(sums.select("_p", (F.col("uw") / F.nullif(F.sqrt(F.col("uu") * F.col("ww")), F.lit(0.0))).alias("rho")), pairs)


def functional_dependencies(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each determinant and dependent: groups with a known dependent, those with several values, whether it holds, and the rate of violations; all in one pass."""
    groups = _pairs(df, pairs, "string").groupBy("_p", "x").agg((F.min("y") != F.max("y")).alias("several"))
    out = groups.groupBy("_p").agg(F.count("*").alias("groups"), F.count_if("several").alias("violations"))
    out = out.select("_p", "groups", "violations", (F.col("violations") == 0).alias("holds"), (F.col("violations") / F.col("groups")).alias("rate"))
    return _named(out, pairs, "determinant", "dependent")


def _side(df: DataFrame, column: str, side: str) -> DataFrame:
    """value, e (expected side) for the known values."""
    return df.select(F.col(column).alias("value"), F.col(side).alias("e")).dropna()


def _psi(shares: DataFrame) -> DataFrame:
    """Sum over the cells of (a - e) ln(a / e), with shares floored; null with under 50 rows on a side."""
    floor = lambda c: F.greatest(c, F.lit(1e-6))
    e, a = floor(F.col("ce") / F.col("ne")), floor(F.col("ca") / F.col("na"))
    return shares.agg(F.when(F.min("ne") >= 50, F.when(F.min("na") >= 50, F.sum((a - e) * F.log(a / e)))).alias("psi"))


def _sizes(known: DataFrame) -> DataFrame:
    return known.agg(F.count_if(F.col("e")).alias("ne"), F.count_if(~F.col("e")).alias("na"))


def psi_numeric(df: DataFrame, column: str, side: str, bins: int = 10) -> DataFrame:
    """Population stability by the expected side's quantile bins: left-closed, the last closed on both sides; values outside drop out."""
    known = _side(df, column, side).withColumn("value", F.col("value").cast("double"))
    edges = exact_quantiles(known.filter("e"), "value", [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("edges"))
    # The bin is the number of edges that are not above the value; the last edge belongs to the last bin.
    at = F.size(F.filter("edges", lambda x: x <= F.col("value")))
    k = F.least(at, F.size("edges") - 1)
    inside = (F.col("value") >= F.col("edges")[0]) & (F.col("value") <= F.element_at("edges", -1))
    cells = known.join(F.broadcast(edges)).filter(inside).groupBy(k.alias("bin")).agg(F.count_if(F.col("e")).alias("ce"), F.count_if(~F.col("e")).alias("ca"))
    every = edges.select(F.explode(F.sequence(F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1)))).alias("bin"), F.size("edges").alias("k"))
    full = every.join(cells, "bin", "left").select("k", F.coalesce("ce", F.lit(0)).alias("ce"), F.coalesce("ca", F.lit(0)).alias("ca")).join(F.broadcast(_sizes(known)))
    few = full.agg(F.min("k").alias("k"))
    return _psi(full).join(F.broadcast(few)).select(F.lit(column).alias("column"), F.when(F.col("k") < 3, F.when(F.col("psi").isNotNull(), 0.0)).otherwise(F.col("psi")).alias("psi"))


def psi_categorical(df: DataFrame, column: str, side: str) -> DataFrame:
    """Population stability over the expected side's categories; others of the actual side are ignored."""
    known = _side(df, column, side)
    cells = known.groupBy("value").agg(F.count_if(F.col("e")).alias("ce"), F.count_if(~F.col("e")).alias("ca")).filter("ce > 0")
    return _psi(cells.join(F.broadcast(_sizes(known)))).select(F.lit(column).alias("column"), "psi")


def ks_two_sample(df: DataFrame, column: str, side: str) -> DataFrame:
    """Greatest gap of the two sides' distribution functions; null with 50 rows or fewer on a side."""
    known = _side(df, column, side)
    counts = known.groupBy("value").agg(F.sum(F.col("e").cast("int")).alias("e"), F.sum((~F.col("e")).cast("int")).alias("a"))
    steps = running_totals(counts, "value", {"ce": "e", "ca": "a"}).join(F.broadcast(_sizes(known)))
    gap = F.max(F.abs(F.col("ce") / F.col("ne") - F.col("ca") / F.col("na")))
    return steps.agg(F.when((F.min("ne") > 50) & (F.min("na") > 50), gap).alias("ks")).select(F.lit(column).alias("column"), "ks")


def drift(df: DataFrame, side: str, numeric: list[str], categorical: list[str], keys: list[str] = (), bins: int = 10) -> DataFrame:
    """keys, column, psi, ks, missing_before, missing_after for each column, between rows where `side` is true (expected) and false; keys are few groups.

    As psi_numeric, psi_categorical and ks_two_sample, for all columns and keys together: two aggregations, to counts of (keys, column, value), and
    the rest from those counts. Null groups and sides are left out.
    """
    group, out = [*keys, "column"], None
    known = df.dropna(subset=[side, *keys])
    for columns, kind in ((numeric, "double"), (categorical, "string")):
        if not columns:
            continue
        long = _long(known.withColumn("_e", F.col(side)), columns, kind, [*keys, "_e"])
        counts = saved(long.groupBy(*group, "value").agg(F.count_if(F.col("_e")).alias("ce"), F.count_if(~F.col("_e")).alias("ca")), "counts")
        real = counts.filter("value is not null")
        sizes = counts.groupBy(*group).agg(*[F.sum(F.when(F.col("value").isNotNull(), F.col(c)).otherwise(0)).alias(n) for c, n in (("ce", "ne"), ("ca", "na"))], F.sum("ce").alias("te"), F.sum("ca").alias("ta"))
        if kind == "double":
            edges = exact_quantiles(real, "value", [i / bins for i in range(bins + 1)], group, "ce").select(*group, F.array_distinct("q").alias("edges"))
            at = F.least(F.size(F.filter("edges", lambda x: x <= F.col("value"))), F.size("edges") - 1)
            inside = (F.col("value") >= F.col("edges")[0]) & (F.col("value") <= F.element_at("edges", -1))
            binned = real.join(F.broadcast(edges), group).filter(inside).groupBy(*group, at.alias("bin")).agg(F.sum("ce").alias("ce"), F.sum("ca").alias("ca"))
            every = edges.select(*group, F.explode(F.sequence(F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1)))).alias("bin"), F.size("edges").alias("k"))
            cells = every.join(binned, [*group, "bin"], "left").na.fill(0, ["ce", "ca"])
            steps = running_totals(real, "value", {"se": "ce", "sa": "ca"}, group).join(F.broadcast(sizes), group)
            gap = F.max(F.abs(F.col("se") / F.col("ne") - F.col("sa") / F.col("na")))
            ks = steps.groupBy(*group).agg(F.when((F.min("ne") > 50) & (F.min("na") > 50), gap).alias("ks"))
        else:
            cells = real.filter("ce > 0").withColumn("k", F.lit(3))
            ks = sizes.select(*group, F.lit(None).cast("double").alias("ks"))
        floor = lambda c: F.greatest(c, F.lit(1e-6))
        e, a = floor(F.col("ce") / F.col("ne")), floor(F.col("ca") / F.col("na"))
        enough = (F.min("ne") >= 50) & (F.min("na") >= 50)
        psi = cells.join(F.broadcast(sizes), group).groupBy(*group).agg(F.when(enough & (F.min("k") < 3), 0.0).when(enough, F.sum((a - e) * F.log(a / e))).alias("psi"))
        rows = sizes.select(*group, (1 - F.col("ne") / F.nullif("te", F.lit(0))).alias("missing_before"), (1 - F.col("na") / F.nullif("ta", F.lit(0))).alias("missing_after"))
        one = rows.join(psi, group, "left").join(ks, group, "left").select(*group, "psi", "ks", "missing_before", "missing_after")
        out = one if out is None else out.unionByName(one)
    severity = F.when(F.col("psi") >= 0.25, "major").when(F.col("psi") >= 0.1, "moderate").otherwise("stable")
    return out.withColumn("severity", severity)


def drift_report(df: DataFrame, period: str, boundary: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """PSI, KS and missing rates of each column up to a month and after it; a null PSI counts as stable."""
    return drift(df.withColumn("_before", F.col(period) <= boundary), "_before", numeric, categorical)


def drift_by_target(df: DataFrame, splits: dict[str, str], numeric: list[str], categorical: list[str]) -> DataFrame:
    """As drift_report, between the training and the test rows of each target; splits has the split column of each target."""
    side = lambda c: F.when(F.col(c) == "train", True).when(F.col(c) == "test", False)
    sides = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), side(c).alias("_train")) for t, c in splits.items()]))
    return drift(df.select(*numeric, *categorical, sides.alias("s")).select(*numeric, *categorical, "s.*"), "_train", numeric, categorical, ["target"])


def target_stability(df: DataFrame, target: str, period: str) -> DataFrame:
    """Overall rate, range and spread of the monthly rates, and rows without a label."""
    monthly = df.filter(F.col(target).isNotNull()).groupBy(period).agg(F.avg(target).alias("rate"))
    spread = monthly.agg(F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"), F.stddev_samp("rate").alias("std_rate"))
    return df.agg(F.avg(target).alias("rate"), F.count_if(F.col(target).isNull()).alias("censored")).join(F.broadcast(spread)).select(F.lit(target).alias("target"), "*")


def resample_months(series: DataFrame, date: str, value: str, lag: int = 12) -> DataFrame:
    """Monthly means over an unbroken calendar, forward filled, and the ratio to `lag` months before less one."""
    monthly = series.groupBy(F.trunc(date, "month").alias("month")).agg(F.avg(value).alias("v"))
    spine = monthly.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    w = Window.orderBy("month")
    filled = spine.join(monthly, "month", "left").withColumn("value", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.select("month", F.round("value", 4).alias("value"), F.round(F.col("value") / F.lag("value", lag).over(w) - 1, 5).alias("yoy"))


def calibration_facts(macro: DataFrame, column: str, on: str = "pno", lag: int = 12, skip: tuple[int, int] | None = None) -> DataFrame:
    """Largest and smallest `lag`-row change, extremes and last value; months to skip are cut out before differencing."""
    used = macro.filter(~F.col(on).between(*skip)) if skip else macro
    d = used.withColumn("_d", F.col(column) - F.lag(column, lag).over(Window.orderBy(on)))
    return d.agg(F.max("_d").alias("max_change"), F.min("_d").alias("min_change"), F.max(column).alias("max"), F.min(column).alias("min"), F.max_by(column, on).alias("last")).select(F.lit(column).alias("column"), "*")
