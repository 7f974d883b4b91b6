"""Evaluation as aggregations over (label, score): everything starts from counts of distinct scores, summed up in sorted parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.prefix import running_totals
from panelwright.operators.quantiles import exact_quantiles


def _counts(df: DataFrame, y: str, p: str) -> DataFrame:
    known = df.select(F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p")).dropna()
    return known.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def pr_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """threshold, tp, fp, positives, precision, recall: one point for each distinct score."""
    c = running_totals(_counts(df, y, p), "p", {"tp": "pos", "fp": "neg"}, descending=True)
    totals = F.broadcast(c.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")))
    points = c.select(F.col("p").alias("threshold"), "pos", "neg", "tp", "fp").join(totals)
    return points.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.nullif(F.col("positives"), F.lit(0))})


def recall_at_precision(df: DataFrame, target: float, y: str = "y", p: str = "p") -> DataFrame:
    """The greatest recall with that precision and its lowest threshold; 0 and none if no point has it."""
    ok = F.col("precision") >= target
    best = F.max(F.when(ok, F.struct("recall", (-F.col("threshold")).alias("t"))))
    return pr_curve(df, y, p).agg(best.alias("b"), F.max("precision").alias("best_precision")).select(F.lit(target).alias("target"), F.coalesce("b.recall", F.lit(0.0)).alias("recall"), (-F.col("b.t")).alias("threshold"), "best_precision")


def best_f1(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    best = F.max(F.struct(F.coalesce(f1, F.lit(0.0)).alias("f1"), (-F.col("threshold")).alias("t")))
    return pr_curve(df, y, p).agg(best.alias("b")).select("b.f1", (-F.col("b.t")).alias("threshold"))


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """n, rate, roc_auc, average_precision, lift, ks, brier, log_loss in one row; rank measures are null with one class."""
    known = df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).dropna()
    clipped = F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -(F.col("y") * F.log(clipped) + (1 - F.col("y")) * F.log(1 - clipped))
    plain = known.agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg(loss).alias("log_loss"))
    below = F.col("negatives") - F.col("fp")
    curve = pr_curve(known).agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("u"), F.sum(F.col("pos") / F.nullif(F.col("positives"), F.lit(0)) * F.col("precision")).alias("average_precision"),
        F.max(F.abs(F.col("tp") / F.nullif(F.col("positives"), F.lit(0)) - F.col("fp") / F.nullif(F.col("negatives"), F.lit(0)))).alias("ks"), F.max("positives").alias("a"), F.max("negatives").alias("b"),
    )
    out = plain.join(F.broadcast(curve))
    return out.select("n", "rate", (F.col("u") / F.nullif(F.col("a") * F.col("b"), F.lit(0))).alias("roc_auc"), "average_precision", (F.col("average_precision") / F.nullif(F.col("rate"), F.lit(0.0))).alias("lift"), "ks", "brier", "log_loss")


def lift_at_k(df: DataFrame, share: float, ties: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Rate of the int(n * share) highest scores relative to all: whole scores above the cut, then by the tie columns."""
    c = _counts(df, y, p).withColumn("n", F.col("pos") + F.col("neg"))
    c = running_totals(c, "p", {"cum": "n"}, descending=True)
    cut = c.join(F.broadcast(c.agg(F.floor(F.sum("n") * share).alias("k"))))
    above = cut.filter("cum <= k").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    edge = cut.filter("cum > k").agg(F.max("p").alias("edge"), F.max("k").alias("k"))
    at = edge.join(above.select(F.col("n").alias("an"))).first()
    tied = df.filter(F.col(p) == F.lit(at["edge"])) if at["edge"] is not None else df.limit(0)
    taken = tied.orderBy(*ties).limit(int((at["k"] or 0) - at["an"]) if at["edge"] is not None else 0).agg(F.coalesce(F.sum(y), F.lit(0)).alias("tpos"))
    base = df.agg(F.avg(y).alias("base"), F.floor(F.count("*") * share).alias("rows"))
    rate = (F.col("pos") + F.col("tpos")) / F.col("rows")
    return base.join(above).join(taken).select(F.lit(share).alias("share"), "rows", "base", rate.alias("rate"), (rate / F.col("base")).alias("lift"))


def per_class(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """support, precision, recall, f1 of each class, 0 where undefined."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("h")).agg(F.count("*").alias("n"))
    true = cells.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("h"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("h").alias("class")).agg(F.sum("n").alias("said"))
    out = true.join(said, "class", "full").na.fill(0)
    precision, recall = (F.coalesce(F.col("hit") / F.nullif(F.col(c), F.lit(0)), F.lit(0.0)) for c in ("said", "support"))
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return out.select("class", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def one_vs_rest(df: DataFrame, y: str, scores: str, classes: list[str]) -> DataFrame:
    """class, n (rows of it), roc_auc of its score against all other rows: counts of (class, score) and their running totals, all classes together; null for a class that all rows or none have."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(scores)[k].cast("double").alias("p"), (F.col(y) == c).cast("int").alias("hit")) for k, c in enumerate(classes)]))
    counts = df.dropna(subset=[y]).select(each.alias("v")).select("v.*").dropna().groupBy("class", "p").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    above = running_totals(counts, "p", {"fp": "neg"}, ["class"], descending=True)
    # Each row of the class beats the others below its score, and half of those at it.
    sums = above.groupBy("class").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"), F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("lost"))
    return sums.select("class", F.col("a").alias("n"), (1 - F.col("lost") / F.nullif(F.col("a") * F.col("b"), F.lit(0))).alias("roc_auc"))


def multiclass_metrics(df: DataFrame, y: str, yhat: str, scores: str | None = None, classes: list[str] = ()) -> DataFrame:
    """accuracy, macro_f1, weighted_f1; with an array of scores for the classes also log_loss (over rows of these classes) and macro_roc_auc (mean over classes that have one)."""
    c = per_class(df, y, yhat)
    n = F.sum("support")
    plain = c.agg((F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"))
    if scores is None:
        return plain
    own = F.col(scores)[F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(y)).cast("int") - 1]
    loss = df.filter(F.col(y).isin(list(classes))).agg(F.avg(-F.log(F.least(F.greatest(own, F.lit(2.0**-52)), F.lit(1 - 2.0**-52)))).alias("log_loss"))
    area = one_vs_rest(df, y, scores, classes).agg(F.avg("roc_auc").alias("macro_roc_auc"))
    return plain.join(F.broadcast(loss)).join(F.broadcast(area))


def calibration_table(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Quantile bins of the score, right-closed with the lowest included: n, mean score, observed rate, gap."""
    edges = exact_quantiles(df, p, [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("edges"))
    k = F.greatest(F.lit(1), F.size(F.filter("edges", lambda x: x < F.col(p))))
    return df.join(F.broadcast(edges)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(y).alias("observed")).withColumn("gap", F.col("observed") - F.col("mean_score"))


def expected_calibration_error(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    t = calibration_table(df, bins, y, p)
    return t.agg((F.sum(F.abs("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def agreement(df: DataFrame, top: float, y: str = "y", score: str = "p") -> DataFrame:
    """Rows at or over the score's (1 - top) quantile against the labels."""
    cut = exact_quantiles(df, score, [1 - top]).select(F.col("q")[0].alias("cut"))
    out = df.join(F.broadcast(cut)).withColumn("f", (F.col(score) >= F.col("cut")).cast("int"))
    hit = F.sum(F.col("f") * F.col(y))
    return out.agg(F.max("cut").alias("cut"), F.avg("f").alias("flagged"), (hit / F.sum("f")).alias("precision"), (hit / F.sum(y)).alias("recall"), F.avg(y).alias("base"), (hit / F.sum("f") / F.avg(y)).alias("lift"))


def error_by_segment(df: DataFrame, segment: str, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    said = (F.col(p) >= threshold).cast("int")
    return df.dropna(subset=[segment]).groupBy(segment).agg(F.count("*").alias("n"), F.avg(y).alias("actual"), F.avg(p).alias("predicted"), F.avg((said == 1).cast("int") * (1 - F.col(y))).alias("false_positive"), F.avg((said == 0).cast("int") * F.col(y)).alias("false_negative")).withColumn("gap", F.col("predicted") - F.col("actual"))


def error_profile(df: DataFrame, columns: list[str], threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """Mean of each column among the hits and misses."""
    said = F.col(p) >= threshold
    kind = F.when(said & (F.col(y) == 0), "false_positive").when(~said & (F.col(y) == 1), "false_negative").when(said, "true_positive").otherwise("true_negative")
    means = df.groupBy(kind.alias("kind")).agg(*[F.avg(c).alias(c) for c in columns])
    return means.unpivot("kind", columns, "column", "mean")


def compare_models(metrics: DataFrame, models: list[str], value: str, by: str = "target") -> DataFrame:
    """One row for each target, a column for each model, and the gain of the last over the first."""
    wide = metrics.groupBy(by).pivot("model", models).agg(F.first(value))
    return wide.withColumn("gain", F.col(models[-1]) - F.col(models[0]))
