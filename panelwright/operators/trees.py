"""What boosted trees did for each row: Shapley values of its features, how predictions settle over the rounds, and which round was the best."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.prefix import running_totals
from panelwright.sources.session import new_path, saved


def node_table(spark, model: GBTClassificationModel) -> list[dict[str, np.ndarray]]:
    """For each tree its nodes as arrays, as the saved model lists them; bounded by rounds and depth. Values are in log odds."""
    path = new_path(spark, "trees")
    model.write().save(path)
    split = F.col("nodeData.split")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        split["featureIndex"].alias("feature"), split["leftCategoriesOrThreshold"].alias("cut"), split["numCategories"].alias("kinds"),
    ).orderBy("treeID", "id").toPandas()
    out = []
    for tree, own in rows.groupby("treeID"):
        scale = 2.0 * model.treeWeights[int(tree)]  # the probability is the logistic of twice the sum
        value, inner = own["prediction"].to_numpy() * scale, own["left"].to_numpy() >= 0
        # A node's value is the mean of the leaves below it, so that contributions along a path add up to its leaf.
        count = own["rawCount"].to_numpy().astype(float)
        for i in range(len(own) - 1, -1, -1):
            if inner[i]:
                a, b = int(own["left"].iloc[i]), int(own["right"].iloc[i])
                value[i] = (value[a] * count[a] + value[b] * count[b]) / max(1e-12, count[a] + count[b])
                count[i] = count[a] + count[b]
        most = max(1, int(own["kinds"].max()))
        goes_left = np.zeros((len(own), most), dtype=bool)
        cut = np.zeros(len(own))
        for i, (k, c) in enumerate(zip(own["kinds"], own["cut"])):
            if inner[i] and k >= 0:
                goes_left[i, np.array(c, dtype=int)] = True
            elif inner[i]:
                cut[i] = c[0]
        out.append({"value": value, "left": own["left"].to_numpy(), "right": own["right"].to_numpy(), "feature": own["feature"].to_numpy(), "cut": cut, "categorical": own["kinds"].to_numpy() >= 0, "goes_left": goes_left, "count": count})
    return out


class _Paths:
    """The paths to the leaves of all trees that test a given number of features, as arrays (path, feature on it)."""

    def __init__(self, trees: list[dict[str, np.ndarray]]):
        found: dict[int, list] = {}
        for k, t in enumerate(trees):
            # Node, and by feature the tests on the way (node, whether to the left) and the share of rows that pass them all.
            open_ = [(0, {})]
            while open_:
                at, seen = open_.pop()
                if t["left"][at] < 0:
                    if seen:
                        found.setdefault(len(seen), []).append((k, t["value"][at], list(seen.items())))
                    continue
                f = int(t["feature"][at])
                for child, left in ((t["left"][at], True), (t["right"][at], False)):
                    tests, share = seen.get(f, ((), 1.0))
                    open_.append((int(child), seen | {f: ((*tests, (at, left)), share * t["count"][child] / max(1e-12, t["count"][at]))}))
        self.groups = found

    def values(self, x: np.ndarray, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
        """Shapley value of each feature for the rows of x: for a path, each feature's passing against its share of rows, weighed over all subsets of the other features on it."""
        out = np.zeros(x.shape)
        lefts = [_goes_left(x, t) for t in trees]
        for d, paths in self.groups.items():
            orders = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
            for k, value, features in paths:
                passed = [np.logical_and.reduce([lefts[k][:, node] == left for node, left in tests]).astype(float) for _, (tests, _) in features]
                shares = [share for _, (_, share) in features]
                for i, (f, _) in enumerate(features):
                    # Coefficient j: sum over subsets of j of the other features, of whether these are passed, times the shares of those left out.
                    poly = [np.ones(len(x))]
                    for j in range(d):
                        if j != i:
                            poly = [(poly[n] * shares[j] if n < len(poly) else 0.0) + (poly[n - 1] * passed[j] if n else 0.0) for n in range(len(poly) + 1)]
                    out[:, f] += value * (passed[i] - shares[i]) * sum(w * c for w, c in zip(orders, poly))
        return out


def _goes_left(x: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """For each row and node whether the row would go left there."""
    out = np.zeros((len(x), len(t["left"])), dtype=bool)
    for node in np.flatnonzero(t["left"] >= 0):
        v = x[:, t["feature"][node]]
        out[:, node] = t["goes_left"][node, np.clip(v, 0, t["goes_left"].shape[1] - 1).astype(int)] if t["categorical"][node] else v <= t["cut"][node]
    return out


def _leaves(x: np.ndarray, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Each tree's leaf value for the rows of x."""
    leaves = np.zeros((len(x), len(trees)))
    for k, t in enumerate(trees):
        at = np.zeros(len(x), dtype=int)
        while True:
            rows = np.flatnonzero(t["left"][at] >= 0)
            if not len(rows):
                break
            here, f = at[rows], t["feature"][at[rows]]
            v = x[rows, f]
            code = np.clip(v, 0, t["goes_left"].shape[1] - 1).astype(int)
            left = np.where(t["categorical"][here], t["goes_left"][here, code], v <= t["cut"][here])
            at[rows] = np.where(left, t["left"][here], t["right"][here])
        leaves[:, k] = t["value"][at]
    return leaves


def tree_contributions(shaped: DataFrame, model: GBTClassificationModel, names: list[str], keys: list[str], features: str = "features") -> tuple[DataFrame, float]:
    """keys, given and _x (arrays over the features: Shapley values in log odds, and values), one row for each row; and the expected value."""
    trees = node_table(shaped.sparkSession, model)
    paths = _Paths(trees)
    expected = float(sum(t["value"][0] for t in trees))

    def explain(batches):
        for pdf in batches:
            x = np.stack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, len(names)))
            yield pdf[keys].assign(given=list(paths.values(x, trees)), _x=list(x))

    kinds = ", ".join(f"{k} {shaped.schema[k].dataType.simpleString()}" for k in keys)
    return shaped.select(*keys, vector_to_array(features).alias("_x")).mapInPandas(explain, f"{kinds}, given array<double>, _x array<double>"), expected


def tree_attributions(shaped: DataFrame, model: GBTClassificationModel, names: list[str], keys: list[str], features: str = "features") -> DataFrame:
    """keys, feature, value, contribution for every row: Shapley values in log odds, one row for each feature.

    They are exact for the game in which a feature that is left out sends a row down both branches, in proportion to the training rows that went there. A row's contributions
    and the expected value (column expected: the mean of the roots) add up to its log odds.
    """
    rows, expected = tree_contributions(shaped, model, names, keys, features)
    parts = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("_x").alias("value"), F.col("given").alias("contribution")))
    return rows.select(*keys, parts.alias("a")).select(*keys, F.col("a.feature"), F.col("a.value"), F.col("a.contribution"), F.lit(expected).alias("expected"))


def staged_spread(shaped: DataFrame, model: GBTClassificationModel, keys: list[str], stages: int = 12, features: str = "features") -> DataFrame:
    """keys, staged_mean, staged_std (of the population), staged_p10, staged_p90 of the probability after `stages` even prefixes of the rounds."""
    trees = node_table(shaped.sparkSession, model)
    cuts = np.unique(np.linspace(1, len(trees), min(stages, len(trees))).round().astype(int)) - 1

    def settle(batches):
        for pdf in batches:
            x = np.stack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            p = 1 / (1 + np.exp(-np.cumsum(_leaves(x, trees), axis=1)[:, cuts]))
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "staged_mean": p.mean(axis=1), "staged_std": p.std(axis=1), "staged_p10": np.quantile(p, 0.1, axis=1), "staged_p90": np.quantile(p, 0.9, axis=1)})

    kinds = ", ".join(f"{k} {shaped.schema[k].dataType.simpleString()}" for k in keys)
    return shaped.select(*keys, vector_to_array(features).alias("_x")).mapInPandas(settle, f"{kinds}, staged_mean double, staged_std double, staged_p10 double, staged_p90 double")


def staged_precision(shaped: DataFrame, model: GBTClassificationModel, y: str, features: str = "features") -> DataFrame:
    """round (from 1), average_precision of the model's first so many rounds on the rows of shaped, for all rounds in one pass: margins of all prefixes, counted by (round, margin)."""
    trees = node_table(shaped.sparkSession, model)

    def margins(batches):
        for pdf in batches:
            x = np.stack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            yield pd.DataFrame({"y": pdf["y"], "m": list(np.cumsum(_leaves(x, trees), axis=1))})

    rows = shaped.select(F.col(y).cast("int").alias("y"), vector_to_array(features).alias("_x")).dropna(subset=["y"]).mapInPandas(margins, "y int, m array<double>")
    counts = rows.select("y", F.posexplode("m").alias("k", "m")).groupBy("k", "m").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    curve = running_totals(counts, "m", {"tp": "pos", "fp": "neg"}, ["k"], descending=True)
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.sum("pos"), F.lit(0))
    return curve.groupBy((F.col("k") + 1).alias("round")).agg(gain.alias("average_precision"))


def best_round(precisions: list[float | None], patience: int) -> int:
    """The round (from 1) of the best value before the first stretch of `patience` rounds without a better one; of equal values the first; 1 if none is known."""
    best, at = None, 0
    for k, value in enumerate(precisions):
        if value is not None and (best is None or value > best):
            best, at = value, k
        elif k - at >= patience:
            break
    return at + 1
