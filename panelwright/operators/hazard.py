"""Proportional hazards with late entry: Newton steps over sums by age, robust errors from score residuals, concordance of training and test rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.concordance import concordance
from panelwright.sources.session import saved


class _Ages:
    """The risk sums at each age with an event: rows that entered before it and have not gone before it. Ages are months or half of one, so they are few."""

    def __init__(self, rows: DataFrame, beta: np.ndarray):
        k = len(beta)
        terms = [(i, j) for i in range(k) for j in range(i, k)]
        w = F.exp(sum((F.col(f"x{i}") * float(beta[i]) for i in range(k)), F.lit(0.0)))
        sums = {"s": w} | {f"s{i}": w * F.col(f"x{i}") for i in range(k)} | {f"s{i}_{j}": w * F.col(f"x{i}") * F.col(f"x{j}") for i, j in terms}
        deaths = {"d": F.col("d").cast("double")} | {f"d{i}": F.col("d") * F.col(f"x{i}") for i in range(k)}
        part = lambda age, sign, n: F.struct(F.col(age).alias("age"), F.lit(sign).alias("goes"), *[v.alias(c) for c, v in sums.items()], *[(v * n).alias(c) for c, v in deaths.items()])
        both = rows.select(F.explode(F.array(part("exit", 1, 1), part("entry", 0, 0))).alias("v")).select("v.*")
        table = both.groupBy("age", "goes").agg(*[F.sum(c).alias(c) for c in (*sums, *deaths)]).toPandas().sort_values("age")
        out, came = table[table.goes == 1], table[table.goes == 0]
        upto = lambda t, ages, side: np.vstack([np.zeros(len(sums)), np.cumsum(t[list(sums)].to_numpy(float), axis=0)])[np.searchsorted(t["age"].to_numpy(), ages, side)]
        out = out[out["d"] > 0]
        self.age, self.d, self.dx = out["age"].to_numpy(), out["d"].to_numpy(), out[[f"d{i}" for i in range(k)]].to_numpy(float).reshape(-1, k)
        at = upto(came, self.age, "left") - upto(table[table.goes == 1], self.age, "left")
        self.s = at[:, 0]
        self.mean = at[:, 1 : k + 1] / self.s[:, None]
        self.second = np.zeros((len(at), k, k))
        for c, (i, j) in enumerate(terms):
            self.second[:, i, j] = self.second[:, j, i] = at[:, k + 1 + c] / self.s

    def newton(self, beta: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and information of the penalised partial likelihood."""
        gradient = (self.dx - self.d[:, None] * self.mean).sum(axis=0) - penalty * beta
        information = (self.d[:, None, None] * (self.second - self.mean[:, :, None] * self.mean[:, None, :])).sum(axis=0) + penalty * np.eye(len(beta))
        return gradient, information


def _shaped(v: DataFrame, covariates: list[str], event: str, keep: list[str], stats) -> tuple[DataFrame, list[str]]:
    """entry, exit, d and the standardised covariates x0.. that vary; missing values are the mean."""
    used = [c for c in covariates if (stats[f"s_{c}"] or 0) > 0]
    x = [((F.coalesce(F.col(c).cast("double"), F.lit(stats[f"m_{c}"])) - stats[f"m_{c}"]) / stats[f"s_{c}"]) for c in used]
    return v.select(*keep, F.col("entry_age").cast("double").alias("entry"), F.col("exit_age").cast("double").alias("exit"), F.col(event).cast("int").alias("d"), *[e.alias(f"x{i}") for i, e in enumerate(x)]), used


def _moments(v: DataFrame, covariates: list[str]):
    return v.agg(*[F.avg(c).alias(f"m_{c}") for c in covariates], *[F.stddev_pop(c).alias(f"s_{c}") for c in covariates]).first()


def _solved(rows: DataFrame, k: int, ridge: float, steps: int) -> tuple[np.ndarray, _Ages, np.ndarray]:
    beta, penalty = np.zeros(k), ridge * rows.select("exit").distinct().count()
    for _ in range(steps):
        ages = _Ages(rows, beta)
        gradient, information = ages.newton(beta, penalty)
        step = np.linalg.solve(information, gradient)
        beta = beta + step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    ages = _Ages(rows, beta)
    return beta, ages, information


def fit_cox(v: DataFrame, covariates: list[str], event: str = "event_default", ridge: float = 0.08, steps: int = 12) -> dict[str, float]:
    """Log hazard ratios of standardised covariates, with late entry, Breslow ties and a ridge penalty (times the number of exit ages)."""
    rows, used = _shaped(v, covariates, event, [], _moments(v, covariates))
    return dict(zip(used, map(float, _solved(saved(rows, "hazard"), len(used), ridge, steps)[0])))


def score_residuals(rows: DataFrame, beta: np.ndarray, ages: _Ages) -> DataFrame:
    """rows' entity and u: what each row adds to the gradient, its event's part less what the hazard between its entry and its exit expects."""
    hazard = np.concatenate([[0.0], np.cumsum(ages.d / ages.s)])
    means = np.vstack([np.zeros(len(beta)), np.cumsum((ages.d / ages.s)[:, None] * ages.mean, axis=0)])
    at, mean, k = ages.age, ages.mean, len(beta)

    def residuals(batches):
        for pdf in batches:
            x = pdf[[f"x{i}" for i in range(k)]].to_numpy(float).reshape(-1, k)
            a, b = np.searchsorted(at, pdf["entry"], "right"), np.searchsorted(at, pdf["exit"], "right")
            own = np.where(pdf["d"].to_numpy()[:, None] > 0, x - mean[np.maximum(b - 1, 0)], 0.0) if len(at) else np.zeros_like(x)
            seen = x * (hazard[b] - hazard[a])[:, None] - (means[b] - means[a])
            yield pd.DataFrame({"entity": pdf["entity"], "u": list(own - np.exp(x @ beta)[:, None] * seen)})

    kind = rows.schema["entity"].dataType.simpleString()
    return rows.mapInPandas(residuals, f"entity {kind}, u array<double>")


def cox_report(v: DataFrame, covariates: list[str], event: str = "event_default", entity: str = "entity_id", fit_on: str = "true", ridge: float = 0.08, steps: int = 12) -> DataFrame:
    """For each covariate that varies: coef (log hazard ratio of one unit), hazard_ratio, se (robust, residuals summed by entity), p; and of the whole fit n_train, events_train, n_test, events_test, concordance_train, concordance_test.

    The fit is on the rows where fit_on holds, the test rows are the others. Concordance is that of exit ages with the fitted risk; null with under five events.
    """
    both = saved(v.withColumn("_train", F.expr(f"coalesce({fit_on}, false)")), "hazard")
    stats = _moments(both.filter("_train"), covariates)
    rows, used = _shaped(both, covariates, event, [F.col(entity).alias("entity"), "_train"], stats)
    rows, k = saved(rows, "shaped"), len(used)
    train = rows.filter("_train")
    beta, ages, information = _solved(train, k, ridge, steps)
    sums = score_residuals(train, beta, ages).groupBy("entity").agg(*[F.sum(F.col("u")[i]).alias(f"u{i}") for i in range(k)])
    meat = sums.agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    bread = np.linalg.inv(information)
    meat = np.array([[meat[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]).reshape(k, k)
    se = np.sqrt(np.diag(bread @ meat @ bread))
    risk = sum((F.col(f"x{i}") * float(beta[i]) for i in range(k)), F.lit(0.0))
    facts = {}
    for name, part in (("train", train), ("test", rows.filter("NOT _train"))):
        n, events = part.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
        found = concordance(part.withColumn("risk", risk), "exit", "d", "risk").first()["concordance"] if events >= 5 else None
        facts |= {f"n_{name}": n, f"events_{name}": events, f"concordance_{name}": found}
    out = []
    for c, b, e in zip(used, beta, se):
        scale = stats[f"s_{c}"]
        out.append((c, float(b / scale), float(math.exp(b / scale)), float(e / scale), math.erfc(abs(b / e) / math.sqrt(2)) if e > 0 else None, *(facts[x] for x in ("n_train", "events_train", "n_test", "events_test", "concordance_train", "concordance_test"))))
    return v.sparkSession.createDataFrame(out, "covariate string, coef double, hazard_ratio double, se double, p double, n_train long, events_train long, n_test long, events_test long, concordance_train double, concordance_test double")
