"""What people look at: anomaly scores and their drivers, attributions, actions, and the review queue."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.quantiles import column_quantiles, exact_quantiles, in_one_row
from panelwright.sources.session import saved


def rescale(df: DataFrame, raw: str, out: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """raw scaled to 0..1 between two percentiles; those of a fit, where given, make batches comparable."""
    if bounds is None:
        q = exact_quantiles(df, raw, [0.005, 0.995]).select(F.col("q").alias("_q"))
        return df.join(F.broadcast(q)).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(raw) - F.col("_q")[0]) / F.nullif(F.col("_q")[1] - F.col("_q")[0], F.lit(0.0))))).drop("_q")
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(raw) - bounds[0]) / (bounds[1] - bounds[0]))))


def robust_drivers(df: DataFrame, columns: list[str], k: int = 3, fit_on: str = "true", rows: DataFrame | None = None) -> DataFrame:
    """drivers: the k columns farthest from their median in units of the scaled median deviation, in one array; ties by name.

    Medians and deviations come from the rows where fit_on holds (training rows); without a deviation the sample deviation is the unit, without that 1.
    rows: those to be described, if not all of df; of df the rows to fit on alone are then kept.
    """
    df = saved(df if rows is None else df.filter(fit_on), "driven")
    med = saved(in_one_row(column_quantiles(df.filter(fit_on), columns, [0.5]), columns, "m_"), "medians")
    with_med = df.join(F.broadcast(med))
    away = with_med.filter(fit_on).select(*[F.abs(F.col(c) - F.col(f"m_{c}")).alias(c) for c in columns])
    middle = in_one_row(column_quantiles(away, columns, [0.5]), columns, "d_")
    spread = df.filter(fit_on).agg(*[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).join(F.broadcast(middle))

    def z(c: str) -> Column:
        unit = F.when(F.col(f"d_{c}") > 0, 1.4826 * F.col(f"d_{c}")).when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
        return F.coalesce(F.abs(F.col(c) - F.col(f"m_{c}")) / unit, F.lit(0.0))

    ranked = F.array_sort(F.array(*[F.struct((-z(c)).alias("z"), F.lit(c).alias("c")) for c in columns]))
    told = with_med if rows is None else rows.join(F.broadcast(med))
    out = told.join(F.broadcast(spread)).withColumn("drivers", F.transform(F.slice(ranked, 1, k), lambda x: x["c"]))
    return out.drop(*[f"{p}_{c}" for p in "mds" for c in columns])


def review_queue(df: DataFrame, n: int, key: str = "seq") -> DataFrame:
    """The n rows of the highest priority and, of each predicted type, max(3, n // 7) more."""
    scored = df.withColumn("priority", 0.6 * F.col("probability") + 0.4 * F.col("score"))
    top = scored.orderBy(F.desc("priority"), key).limit(n)
    w = Window.partitionBy("predicted_type").orderBy(F.desc("priority"), key)
    each = scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(3, n // 7)).drop("_n")
    return top.unionByName(each).dropDuplicates([key])


def anomaly_by(df: DataFrame, by: str, score: str = "score") -> DataFrame:
    cut = exact_quantiles(df, score, [0.9]).select(F.col("q")[0].alias("_cut"))
    return df.join(F.broadcast(cut)).groupBy(by).agg(F.count("*").alias("rows"), F.avg(score).alias("mean_score"), F.avg((F.col(score) > F.col("_cut")).cast("int")).alias("share_high"), F.avg("probability").alias("mean_probability"))


def gate_type(kind: str, probability: str, threshold: float = 0.5) -> Column:
    return F.when(F.col(probability) < threshold, "none").otherwise(F.col(kind))


def driver_frequency(df: DataFrame, k: int = 10) -> DataFrame:
    counts = df.select(F.col("drivers")[0].alias("driver")).groupBy("driver").agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1)))).orderBy(F.desc("rows"), "driver").limit(k)


def linear_attributions(df: DataFrame, coefficients: dict[str, float], keys: list[str]) -> DataFrame:
    """keys, feature, value, contribution: coefficient times the distance from the mean, one row for each feature."""
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in coefficients])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.coalesce(b * (F.col(c) - F.col(f"_{c}")), F.lit(0.0)).alias("contribution")) for c, b in coefficients.items()]))
    return df.join(F.broadcast(means)).select(*keys, parts.alias("a")).select(*keys, "a.*")


def global_importance(attr: DataFrame) -> DataFrame:
    out = attr.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean_signed"), F.corr("value", "contribution").alias("corr"))
    share = F.col("mean_abs") / F.sum("mean_abs").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("share", share).withColumn("direction", F.when(F.col("corr") > 0.05, "up").when(F.col("corr") < -0.05, "down").otherwise("mixed"))


def driver_strings(attr: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """`name (+0.12) | ...` of the k largest contributions of each row; digits are not grouped: (+1234.50)."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.abs("contribution")).alias("z"), "feature", "contribution")))
    return attr.groupBy(*keys).agg(ranked.alias("r")).select(*keys, driver_text("r", k).alias("drivers"))


def driver_text(ranked: str, k: int = 3) -> Column:
    """The first k of an array of feature and contribution, the largest first, as driver_strings has them."""
    sign = lambda x: F.when(x["contribution"] >= 0, "+").otherwise("-")
    return F.array_join(F.transform(F.slice(ranked, 1, k), lambda x: F.concat(friendly(x["feature"]), F.lit(" ("), sign(x), F.replace(F.format_number(F.abs(x["contribution"]), 2), F.lit(","), F.lit("")), F.lit(")"))), " | ")


def local_explanations(attr: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """The k largest contributions of the n rows with the highest total."""
    top = attr.groupBy(key).agg(F.sum("contribution").alias("total")).orderBy(F.desc("total"), key).limit(n)
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "feature")
    return attr.join(F.broadcast(top), key).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "rank", "feature", "contribution", "total")


#: Names of features as people say them (our own words); others are shown with spaces for underscores.
LABELS = {
    "amortisation_residual": "balance off its schedule", "dpd_status_residual": "days past due against status", "balance_change_1": "balance change in a month", "balance_change_3": "balance change in three months",
    "growth_positive": "balance growth", "balance_gap_rel": "balance gap to the feed", "dpd_gap": "days past due gap to the feed", "lag_days": "reporting lag", "missing_count": "missing fields",
    "doc_problem": "document problem", "manual_source": "manual upload", "payment_ratio": "payment to balance", "dpd_repaired": "repaired days past due", "rate_repaired": "repaired rate",
    "balance_repaired": "repaired balance", "age_repaired": "repaired age", "svc_present": "record in the feed", "status_ord": "current status", "credit_ord": "credit band", "ltv_ord": "loan to value band",
    "late_count_6": "late months in six", "dpd_max_3": "worst days past due in three months", "clean_streak": "months since late",
}


def friendly(c: Column | str, labels: dict[str, str] = LABELS) -> Column:
    """The label of a feature's name; without one, the name with spaces for underscores."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.when(c == name, label) for name, label in labels.items()], F.replace(c, F.lit("_"), F.lit(" ")))


def confidence_band(p: str, spread: str) -> Column:
    x = F.least(F.col(p), 1 - F.col(p)) + 3 * F.col(spread)
    return F.when(x < 0.10, "high").when(x < 0.25, "medium").otherwise("low")


#: Action, score column, least score (fixed values); the first that holds is taken.
ACTIONS = [
    ("raise_exception_for_review", "exception_probability", 0.50), ("escalate_loss_mitigation", "prob_default_12m", 0.35), ("early_stage_collections_outreach", "prob_delinquency_3m", 0.30),
    ("watchlist_monitor", "prob_delinquency_6m", 0.25), ("retention_review", "prob_prepayment_12m", 0.45),
]


def action_rules(rules=ACTIONS) -> Column:
    return F.coalesce(*[F.when(F.col(c) >= t, name) for name, c, t in rules], F.lit("monitor_no_action"))


#: Why an action is taken (our own words); none is a decision.
REASONS = {
    "raise_exception_for_review": "The record itself looks wrong.", "escalate_loss_mitigation": "Default within a year is likely.", "early_stage_collections_outreach": "Delinquency within three months is likely.",
    "watchlist_monitor": "Delinquency within six months is possible.", "retention_review": "Prepayment within a year is likely.",
}


def action_reasons(rules=ACTIONS) -> Column:
    return F.coalesce(*[F.when(F.col(c) >= t, REASONS[name]) for name, c, t in rules], F.lit("No score reaches a threshold."))


def check_contract(df: DataFrame, key: str, probabilities: list[str], vocabulary: dict[str, list[str]], gated: dict[str, tuple[str, float, str]] | None = None, present: list[str] = (), true: list[str] = ()) -> DataFrame:
    """Violations: repeated keys, values outside 0..1, words outside the vocabulary; for `gated` (column: probability, threshold, word) other words where the probability is under the
    threshold; nulls in `present`; rows where a flag of `true` doesn't hold."""
    checks = {f"range_{c}": F.count_if(~F.col(c).between(0, 1) | F.col(c).isNull()) for c in probabilities} | {f"words_{c}": F.count_if(~F.col(c).isin(v)) for c, v in vocabulary.items()}
    checks |= {f"gate_{c}": F.count_if((F.col(p) < limit) & (F.coalesce(c, F.lit("")) != word)) for c, (p, limit, word) in (gated or {}).items()}
    checks |= {f"null_{c}": F.count_if(F.col(c).isNull()) for c in present} | {f"untrue_{c}": F.count_if(~F.coalesce(c, F.lit(False))) for c in true}
    row = df.agg((F.count("*") - F.count_distinct(key)).alias("repeated_keys"), *[v.alias(k) for k, v in checks.items()])
    return row.unpivot([], ["repeated_keys", *checks], "check", "violations")


def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_forest(df: DataFrame, columns: list[str], key: str, trees: int = 50, sample: int = 256, seed: int = 5, fit_on: str = "true") -> DataFrame:
    """key, raw anomaly score: isolation trees are grown one a group on hashed samples of bounded size, then sent to all rows.

    Trees and medians come from the rows where fit_on holds; all rows are scored. Missing values take the column's median. The trees hold at most trees * 2 * sample nodes.
    """
    lacking = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    lacking, med = [c for c in columns if lacking[c]], {}
    if lacking:  # other columns need no median
        med = in_one_row(column_quantiles(df.filter(fit_on), lacking, [0.5]), lacking, "").first().asDict()
    filled = df.select(key, F.expr(fit_on).alias("_fit"), *[F.coalesce(F.col(c).cast("double"), F.lit(float(med.get(c) or 0.0))).alias(c) for c in columns])
    n = filled.filter("_fit").count()
    limit = min(1_000_000, int(1_000_000 * 1.5 * sample / max(1, n)) + 1)
    # A key a tree, of which all but the drawn are gone before anything is stored; about 1.5 * sample keys a tree are left, and their rows are fetched.
    dealt = filled.filter("_fit").select(F.col(key).alias("_key"), F.explode(F.array(*[F.lit(k) for k in range(trees)])).alias("tree"))
    drawn = dealt.withColumn("d", F.pmod(F.xxhash64(F.col("_key"), F.lit(seed) + F.col("tree")), F.lit(1_000_000))).filter(F.col("d") < limit)
    picked = filled.filter("_fit").join(F.broadcast(drawn), F.col(key).eqNullSafe(F.col("_key"))).select(*columns, "d", "tree")
    names = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["d", *names]).head(sample)[names].to_numpy()
        rng = np.random.default_rng(int(pdf["tree"].iloc[0]))
        deepest, nodes, todo = int(np.ceil(np.log2(max(2, len(x))))), [], [(np.arange(len(x)), 0, 0)]
        nodes.append(None)
        while todo:
            rows, depth, at = todo.pop()
            part = x[rows]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 and depth < deepest else []
            if len(spread) == 0:
                nodes[at] = (-1, 0.0, 0, 0, depth + _path_length(len(rows)))
                continue
            f = int(rng.choice(spread))
            cut = rng.uniform(part[:, f].min(), part[:, f].max())
            left, right = len(nodes), len(nodes) + 1
            nodes += [None, None]
            nodes[at] = (f, cut, left, right, 0.0)
            todo += [(rows[part[:, f] <= cut], depth + 1, left), (rows[part[:, f] > cut], depth + 1, right)]
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        return out.assign(tree=int(pdf["tree"].iloc[0]), node=np.arange(len(out)), size=len(x))

    schema = "feature int, cut double, left int, right int, depth double, tree int, node int, size int"
    forest = picked.groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values(["tree", "node"])
    # A leaf is its own child, so that all rows take as many steps as the tree is deep.
    grown = []
    for _, g in forest.groupby("tree"):
        node, inner = g["node"].to_numpy(), g["feature"].to_numpy() >= 0
        child = np.column_stack([np.where(inner, g["right"], node), np.where(inner, g["left"], node)]).ravel()
        steps = int(np.ceil(np.log2(max(2, g["size"].iloc[0]))))
        grown.append((np.maximum(g["feature"].to_numpy(), 0), g["cut"].to_numpy(), child, g["depth"].to_numpy() / max(1e-9, _path_length(g["size"].iloc[0])), steps))
    kind = df.schema[key].dataType.simpleString()

    def score(batches):
        for pdf in batches:
            x, total = np.ascontiguousarray(pdf[names].to_numpy()), np.zeros(len(pdf))
            values, first = x.ravel(), np.arange(len(x)) * len(names)
            for feature, cut, child, depth, steps in grown:
                at = np.zeros(len(x), dtype=int)
                for _ in range(steps):
                    at = child.take(2 * at + (values.take(first + feature.take(at)) <= cut.take(at)))
                total += depth.take(at)
            yield pd.DataFrame({key: pdf[key], "raw": 2.0 ** -(total / max(1, len(grown)))})

    return filled.drop("_fit").mapInPandas(score, f"{key} {kind}, raw double")
