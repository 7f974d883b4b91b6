"""Quality rules: fixed limits on a text's statistics, then robust multivariate outliers among those that pass. DataFrame functions only.

Documents that pass the limits become vectors of `DIMENSIONS` transformed statistics: the mean word length and the shares of symbols, repeated lines and repeated words, each damped by
`DAMPING` ordinary words, so that short texts scatter no more than long ones, and in logarithms. For each language and source, location and scatter of the vectors are the minimum
covariance determinant estimates: of all subsets of a `SHARE` of the vectors, the one whose covariance has the least determinant. It is sought from three deterministic starts (scales
alone, spatial signs, squashed products) by concentration steps, each of which takes the vectors nearest to the last estimate; after `TRIALS` steps the start with the least
determinant goes on until nothing changes, at most `STEPS` times. The estimate is then reweighted, as usual, and documents whose squared Mahalanobis distance exceeds the chi-square quantile `CERTAIN` are rejected.

The scatter has a floor (`FLOORS`), since a statistic that is nought for most texts has no variance of its own, and since small groups say little: a group of one or two is kept.

Vectors are counted on a grid of 1/1024, so a group is a bounded table of grid points with counts, however many documents it has, and all sums are exact integers: the verdict does not
depend on the order of rows. A step's nearest share is cut at a bucket of distances (1/16 of an octave), so it holds that share and what else is in the last bucket.

Null lang or source is a value of its own; null text has no words. Repeated rows are judged each for itself and weigh as often as they occur; an empty table gives no rows. A text is handled within its row.
Only doc_id, lang, source, text are read. Counts in a text compare 64-bit hashes of its three-word windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import saved

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, MOST_REPEATED = 50, 50
DIMENSIONS, UNIT, DAMPING, USUAL_LENGTH = 4, 1024, 200, 5
FLOORS = (0.03, 0.35, 0.35, 0.6)
SHARE, CERTAIN, REWEIGHTED, TRIALS, STEPS = 0.75, 0.99999, 0.975, 2, 12
_J = range(DIMENSIONS)
_PAIRS = [(j, k) for j in _J for k in range(j + 1)]


def _chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf(middle, k) < p else (low, middle)
    return high


def _consistency(share: float) -> float:
    """What the covariance of the nearest share of normal vectors is to be multiplied with."""
    return share / _chi2_cdf(_chi2_quantile(share, DIMENSIONS), DIMENSIONS + 2)


def _repeated_words(grams: Column) -> Column:
    """Words in three-word windows that occur twice or more, from the windows' hashes in order."""
    order = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    n = F.size(grams)
    # Neighbours in the sorted order that are equal stand in two places each.
    pairs = F.filter(F.arrays_zip(F.slice(order, 1, n - 1).alias("a"), F.slice(order, 2, n - 1).alias("b")), lambda z: z["a"]["g"] == z["b"]["g"])
    places = F.array_sort(F.array_distinct(F.concat(F.transform(pairs, lambda z: z["a"]["i"]), F.transform(pairs, lambda z: z["b"]["i"]))))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    step = lambda acc, at: F.struct((acc["words"] + at + 3 - F.greatest(at, acc["end"])).alias("words"), (at + 3).alias("end"))
    return F.aggregate(places, start, step, lambda acc: acc["words"])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed: a row for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", "lang", "source", text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    n = F.size("words")
    windows = F.greatest(n - 2, F.lit(0))
    zipped = F.arrays_zip(*[F.slice("words", k + 1, windows).alias(f"w{k}") for k in range(3)])
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"), lines.alias("lines"), F.transform(zipped, lambda w: F.xxhash64(w["w0"], w["w1"], w["w2"])).alias("grams"),
    )
    alike = F.size(F.array_distinct("grams")) < F.size("grams")
    out = counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(alike, _repeated_words(F.col("grams"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _grid(stats: DataFrame) -> DataFrame:
    """stats with g (language and source) and z0, z1, ...: the transformed statistics in 1/1024."""
    named = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    all_words = F.col("n_words") + DAMPING
    share = lambda c: F.log1p(100 * F.col(c) / all_words)
    z = [F.log((F.col("word_chars") + USUAL_LENGTH * DAMPING) / all_words), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]
    return stats.select("*", F.concat(named("lang"), named("source")).alias("g"), *[F.round(x * UNIT).cast("long").alias(f"z{j}") for j, x in enumerate(z)])


def _middle(values: DataFrame, share: float = 0.5) -> DataFrame:
    """g, j, v: the least v that has `share` of the weight w at or below it; as many rows in a window as there are values on the grid."""
    counts = values.groupBy("g", "j", "v").agg(F.sum("w").alias("w"))
    group = Window.partitionBy("g", "j")
    upto = counts.withColumn("below", F.sum("w").over(group.orderBy("v"))).withColumn("all", F.sum("w").over(group))
    return upto.filter(F.col("below") >= share * F.col("all")).groupBy("g", "j").agg(F.min("v").alias("v"))


def _as_columns(middles: DataFrame, name: str) -> DataFrame:
    return middles.groupBy("g").agg(*[F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"{name}{j}") for j in _J])


def _factored(shapes: DataFrame) -> DataFrame:
    """g, start, n, m0.. (location), l00, l10.. (Cholesky factor of the scatter c00, c10..), logdet."""
    for j, k in _PAIRS:
        rest = F.col(f"c{j}{k}")
        for i in range(k):
            rest = rest - F.col(f"l{j}{i}") * F.col(f"l{k}{i}")
        shapes = shapes.withColumn(f"l{j}{k}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if j == k else rest / F.col(f"l{k}{k}"))
    logdet = sum((2 * F.log(F.col(f"l{j}{j}")) for j in _J), F.lit(0.0))
    return shapes.select("g", "start", "n", *[f"m{j}" for j in _J], *[f"l{j}{k}" for j, k in _PAIRS], logdet.alias("logdet"))


def _estimated(near: DataFrame, factor: float) -> DataFrame:
    """Location and scatter of the weighted grid points of each g and start."""
    sums = [F.sum(F.col("w") * F.col(f"z{j}")).alias(f"s{j}") for j in _J]
    products = [F.sum(F.col("w") * F.col(f"z{j}") * F.col(f"z{k}")).alias(f"q{j}{k}") for j, k in _PAIRS]
    n = F.col("n")
    cov = lambda j, k: factor * (F.col(f"q{j}{k}") / n - F.col(f"s{j}") / n * (F.col(f"s{k}") / n)) / UNIT**2 + (FLOORS[j] ** 2 if j == k else 0.0)
    known = near.groupBy("g", "start").agg(F.sum("w").alias("n"), *sums, *products)
    return _factored(known.select("g", "start", "n", *[(F.col(f"s{j}") / n / UNIT).alias(f"m{j}") for j in _J], *[cov(j, k).alias(f"c{j}{k}") for j, k in _PAIRS]))


def _distance() -> Column:
    """Squared Mahalanobis distance of z from m under l."""
    solved: list[Column] = []
    for j in _J:
        rest = F.col(f"z{j}") / UNIT - F.col(f"m{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * solved[k]
        solved.append(rest / F.col(f"l{j}{j}"))
    return sum((y * y for y in solved), F.lit(0.0))


def _concentrated(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """The estimates from the share of points nearest to each of `shapes`."""
    far = points.join(shapes.drop("n"), "g").withColumn("b", F.floor(16 * F.log2(_distance() + 2.0**-30)))
    each = Window.partitionBy("g", "start")
    buckets = far.groupBy("g", "start", "b").agg(F.sum("w").alias("k"))
    upto = buckets.withColumn("below", F.sum("k").over(each.orderBy("b"))).withColumn("all", F.sum("k").over(each))
    # Written before the join: Spark then knows how small it is, and if it is not, both sides are shuffled by it and a hot group is split between tasks.
    cut = saved(upto.filter(F.col("below") >= F.ceil(SHARE * F.col("all"))).groupBy("g", "start").agg(F.min("b").alias("cut")), "cuts")
    return _estimated(far.join(cut, ["g", "start"]).filter("b <= cut"), _consistency(SHARE))


def _starts(points: DataFrame) -> DataFrame:
    """Three first estimates of each group around its medians: scales alone; spatial signs; products squashed by tanh."""
    long = points.select("g", "w", F.posexplode(F.array(*[f"z{j}" for j in _J])).alias("j", "v"))
    medians = saved(_middle(long), "medians")
    spread = _middle(long.join(medians.withColumnRenamed("v", "m"), ["g", "j"]).select("g", "j", "w", F.abs(F.col("v") - F.col("m")).alias("v")))
    known = saved(_as_columns(medians, "a").join(_as_columns(spread, "b"), "g"), "spreads")
    scale = lambda j: F.greatest(1.4826 * F.col(f"b{j}") / UNIT, F.lit(FLOORS[j]))
    u = [(F.col(f"z{j}") - F.col(f"a{j}")) / UNIT / scale(j) for j in _J]
    units = points.join(known, "g").select("g", "w", *[x.alias(f"u{j}") for j, x in enumerate(u)])
    square = sum((F.col(f"u{j}") * F.col(f"u{j}") for j in _J), F.lit(0.0))
    sign = lambda j, k: F.when(square > 0, F.col(f"u{j}") * F.col(f"u{k}") / square).otherwise(0.0)
    squashed = lambda j, k: F.tanh(f"u{j}") * F.tanh(f"u{k}")
    whole = lambda x: F.sum(F.col("w") * F.round(UNIT * x).cast("long"))
    sums = units.groupBy("g").agg(F.sum("w").alias("n"), *[whole(f(j, k)).alias(f"{name}{j}{k}") for name, f in (("p", sign), ("t", squashed)) for j, k in _PAIRS]).join(known, "g")
    mean = lambda name, times: lambda j, k: times * F.col(f"{name}{j}{k}") / F.col("n") / UNIT
    out = None
    for start, shape in enumerate((lambda j, k: F.lit(1.0 if j == k else 0.0), mean("p", DIMENSIONS), mean("t", 1))):
        cov = lambda j, k: scale(j) * scale(k) * shape(j, k) + (FLOORS[j] ** 2 if j == k else 0.0)  # noqa: B023, E731
        one = sums.select("g", F.lit(start).alias("start"), "n", *[(F.col(f"a{j}") / UNIT).alias(f"m{j}") for j in _J], *[cov(j, k).alias(f"c{j}{k}") for j, k in _PAIRS])
        out = one if out is None else out.union(one)
    return _factored(out)


def robust_estimates(points: DataFrame) -> DataFrame:
    """g, n, m0.., l00..: minimum-covariance-determinant estimates, reweighted, from grid points (g, z0.., w: how many)."""
    shapes = saved(_starts(points), "starts")
    for _ in range(TRIALS):
        shapes = saved(_concentrated(points, shapes), "trials")
    best = shapes.groupBy("g").agg(F.min(F.struct("logdet", "start", *[c for c in shapes.columns if c not in ("g", "start", "logdet")])).alias("best"))
    shapes = best.select("g", "best.*").select(*shapes.columns)
    for _ in range(STEPS):
        shapes = saved(shapes, "best")
        new = saved(_concentrated(points, shapes), "steps")
        same = new.join(shapes.select("g", F.col("n").alias("n0"), F.col("logdet").alias("d0")), "g").filter((F.col("n") != F.col("n0")) | (F.col("logdet") != F.col("d0")))
        shapes = new
        if same.isEmpty():
            break
    near = points.join(shapes.drop("n"), "g").filter(_distance() <= _chi2_quantile(REWEIGHTED, DIMENSIONS))
    return saved(_estimated(near, _consistency(REWEIGHTED)).drop("start", "logdet"), "estimates")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """text_statistics and distance (squared; null where base_failed) and kept."""
    stats = saved(_grid(text_statistics(docs)), "statistics")
    grid = [f"z{j}" for j in _J]
    points = saved(stats.filter("NOT base_failed").groupBy("g", *grid).agg(F.count("*").alias("w")), "points")
    judged = stats.join(robust_estimates(points).drop("n"), "g", "left")
    distance = F.when(~F.col("base_failed"), _distance())
    columns = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*columns, distance.alias("distance")).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= _chi2_quantile(CERTAIN, DIMENSIONS), F.lit(True)))
