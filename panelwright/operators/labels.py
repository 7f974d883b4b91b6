"""Forward labels with censoring, and splits in time that keep their windows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY, MONTH = "entity_id", "month_index"
ENDED = ("Prepaid", "Default", "PaidOff")


def status_next(df: DataFrame, exits: dict[str, str]) -> DataFrame:
    """The status one row on; on the entity's last row the state that its exit code stands for, or null."""
    w = Window.partitionBy(ENTITY).orderBy(MONTH)
    code = F.coalesce(*[F.when(F.col("exit_code") == k, v) for k, v in exits.items()])
    return df.withColumn("next_state", F.coalesce(F.lead("current_status").over(w), F.when(F.lead(MONTH).over(w).isNull(), code)))


def forward_any(flag: Column, horizon: int, last_index: Column, closed: Column) -> Column:
    """1 if the flag is set in the next `horizon` rows, this one included; 0 if it is not and the window is complete or the entity has ended; else null."""
    w = Window.partitionBy(ENTITY).orderBy(MONTH).rowsBetween(0, horizon - 1)
    hit, seen = F.max(flag).over(w), F.count("*").over(w)
    complete = (seen >= horizon) & (last_index - F.col(MONTH) >= horizon)
    return F.when(hit > 0, 1.0).when(closed | complete, 0.0)


def last_month(df: DataFrame) -> DataFrame:
    """One row, _last: the last month of df."""
    return df.agg(F.max(MONTH).alias("_last"))


def attach_targets(df: DataFrame, exits: dict[str, str], default_states=("DQ90plus", "Default"), last: DataFrame | None = None) -> DataFrame:
    """Delinquency within 3 and 6 rows, default and prepayment within 12, all of the next state. last: last_month of df from a cheaper source, so that df is not computed for it too."""
    out = status_next(df, exits).join(F.broadcast(last_month(df) if last is None else last))
    closed = F.max(F.col("next_state").isin(*ENDED).cast("int")).over(Window.partitionBy(ENTITY)) == 1
    is_ = lambda *states: F.coalesce(F.col("next_state").isin(*states).cast("int"), F.lit(0))
    late = is_("DQ30", "DQ60", "DQ90plus", "Default")
    end = F.col("_last")
    return out.withColumn("_closed", closed).withColumns(
        {
            "next_3m_delinquency_flag": forward_any(late, 3, end, F.col("_closed")),
            "next_6m_delinquency_flag": forward_any(late, 6, end, F.col("_closed")),
            "next_12m_default_flag": forward_any(is_(*default_states), 12, end, F.col("_closed")),
            "next_12m_prepayment_flag": forward_any(is_("Prepaid"), 12, end, F.col("_closed")),
        }
    ).drop("_last", "_closed")


def purged_split(df: DataFrame, target: str, horizon: int, n_test: int = 6, n_valid: int = 6, train_end: int | None = None, last: DataFrame | None = None) -> DataFrame:
    """split: the last observable months test, `horizon` months of embargo before them, then validation, then training; unlabelled or later rows excluded.

    With `train_end`, training ends there if that is earlier, never later; validation goes on from there to its old end, and the test window stays. last: as of attach_targets.
    """
    top = last_month(df) if last is None else last
    test_from = F.col("_last") - horizon - n_test + 1
    valid_to = test_from - horizon - 1
    train_to = valid_to - n_valid
    if train_end is not None:
        train_to = F.least(train_to, F.lit(train_end))
    m = F.col(MONTH)
    split = (
        F.when(F.col(target).isNull() | (m > F.col("_last") - horizon), "excluded")
        .when(m >= test_from, "test")
        .when(m <= train_to, "train")
        .when(m <= valid_to, "valid")
        .otherwise("embargo")
    )
    return df.join(F.broadcast(top)).withColumn("split", split).drop("_last")


def share_of(key: Column, seed: int) -> Column:
    """A number in 0..1 from a portable hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def entity_disjoint_split(df: DataFrame, target: str, horizon: int, share: float = 0.35, seed: int = 11) -> DataFrame:
    """The purged split with held-out entities in test only, and all others never there."""
    held = share_of(F.col(ENTITY), seed) < share
    split = F.when((F.col("split") == "test") & ~held, "excluded").when(F.col("split").isin("train", "valid") & held, "excluded").otherwise(F.col("split"))
    return purged_split(df, target, horizon).withColumn("split", split)


def random_split(df: DataFrame, target: str, key: str = "seq", seed: int = 13) -> DataFrame:
    """70/15/15 of the labelled rows: the unsound control."""
    x = share_of(F.col(key), seed)
    return df.withColumn("split", F.when(F.col(target).isNull(), "excluded").when(x < 0.7, "train").when(x < 0.85, "valid").otherwise("test"))


def expanding_folds(df: DataFrame, target: str, horizon: int, n: int = 3, step: int = 6) -> list[DataFrame]:
    """Splits whose training ends `step` months earlier each; all have one test window, and validation up to one month."""
    last = df.agg(F.max(MONTH)).first()[0]
    end = last - horizon - 6 - horizon - 6
    return [purged_split(df, target, horizon, train_end=end - step * k) for k in range(n)]


def split_summary(split: DataFrame, target: str) -> DataFrame:
    """Rows, positive rate, entities and month range of each part, and how many of its entities training has too."""
    own = split.groupBy(ENTITY, "split").agg(F.count("*").alias("n"), F.sum(target).alias("s"), F.count(target).alias("k"), F.min(MONTH).alias("a"), F.max(MONTH).alias("b"))
    # As many rows in a window as an entity has splits.
    trained = F.max(F.col("split") == "train").over(Window.partitionBy(ENTITY)) & F.col(ENTITY).isNotNull()
    return own.withColumn("_t", trained).groupBy("split").agg(
        F.sum("n").alias("rows"), (F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("rate"), F.count(ENTITY).alias("entities"), F.min("a").alias("first_month"), F.max("b").alias("last_month"),
        F.count_if("_t").alias("shared_with_train"),
    )
