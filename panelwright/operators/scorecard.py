"""One row for each record to be acted on: all scores, what drives them, how sure they are, and what to do."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import models as M
from panelwright.operators import review as R
from panelwright.operators.joins import attach_scores
from panelwright.operators.trees import staged_spread, tree_contributions

FACTS = ["entity_id", "reporting_month", "servicer_name", "current_status"]


def class_scores(model: PipelineModel, df: DataFrame, columns: list[str], out: str, sure: str) -> DataFrame:
    """df with the likeliest class under its name, and its probability."""
    labels = next(s for s in model.stages if hasattr(s, "labels")).labels
    p = vector_to_array("probability")
    # The label indexer is left out: rows to score have no label yet.
    scored = PipelineModel(stages=model.stages[1:]).transform(df.withColumns({c: F.col(c).cast("double") for c in columns}))
    return scored.select(*df.columns, F.array(*[F.lit(x) for x in labels])[F.col("prediction").cast("int")].alias(out), F.round(F.array_max(p), 6).alias(sure))


def scorecard(rows: DataFrame, binary: dict[str, tuple[PipelineModel, list[str], list[str]]], next_state: PipelineModel, kinds: PipelineModel, columns: list[str], anomalies: DataFrame, main: str = "prob_default_12m", key: str = "seq", gate: float = 0.5) -> DataFrame:
    """key, facts, the probabilities of `binary` (name: model, numeric, categorical), next state, exception type, anomaly, drivers, confidence, action; likeliest `main` first.

    anomalies has key, anomaly_score and drivers of all rows. `main` has to be a model of boosted trees; its paths give the drivers and its rounds the spread.
    """
    # One model after the other on the same rows: nothing is joined. The models' types and fillings don't touch the facts.
    out = rows.withColumn("_facts", F.struct(*FACTS))
    for name, (model, numeric, categorical) in binary.items():
        out = M.score(model, out, name, numeric, categorical).withColumn(name, F.round(name, 6))
    out = class_scores(next_state, out, columns, "predicted_next_state", "next_state_confidence")
    out = class_scores(kinds, out, columns, "_kind", "exception_type_confidence")
    out = out.select(key, "_facts.*", *binary, "predicted_next_state", "next_state_confidence", "_kind", "exception_type_confidence")
    out = attach_scores(out, anomalies.select(key, F.round("anomaly_score", 6).alias("anomaly_score"), F.col("drivers")[0].alias("top_anomaly_driver")), [key])
    out = out.withColumn("predicted_exception_type", R.gate_type("_kind", "exception_probability", gate)).drop("_kind")
    model, numeric, categorical = binary[main]
    shaped, trees = model.stages[0].transform(M.typed(rows, numeric, categorical)), model.stages[-1]
    names = [*numeric, *categorical]
    given = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("given").alias("contribution"))
    ranked = F.array_sort(F.transform(given, lambda x: F.struct((-F.abs(x["contribution"])).alias("z"), x["feature"].alias("feature"), x["contribution"].alias("contribution"))))
    told = tree_contributions(shaped, trees, names, [key])[0].select(key, ranked.alias("r"))
    out = attach_scores(out, told.select(key, R.driver_text("r").alias("top_drivers")), [key])
    out = attach_scores(out, staged_spread(shaped, trees, [key]).select(key, F.round("staged_std", 6).alias("prediction_spread")), [key])
    out = out.withColumn("confidence", R.confidence_band(main, "prediction_spread")).withColumns({"recommended_action": R.action_rules(), "action_reason": R.action_reasons(), "is_recommendation": F.lit(True)})
    return out.orderBy(F.desc(main), key)
