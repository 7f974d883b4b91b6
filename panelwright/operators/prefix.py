"""Running totals and last known values along a sorted column without one window over all rows: range-sorted parts, and what each part takes over from those before it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources.session import saved

#: Rows that one window may hold, and rows of a part beyond that.
SMALL, PART = 200_000, 250_000


def _parts(rows: DataFrame, keys: list[Column], parts: int) -> DataFrame:
    """rows dealt to parts by range of the keys, with the part's number in _part; rows of one key are in one part."""
    return saved(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "parts")


def _enough(rows: DataFrame, n: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PART))


def running_totals(df: DataFrame, order: str, sums: dict[str, str], within: list[str] = (), descending: bool = False, parts: int | None = None) -> DataFrame:
    """df with a column for each of `sums` (new name: column) that adds it up to this row, this one included, within groups of `within`.

    `order` is known and distinct within a group; groups are few, such as columns; null groups form one. Up to `SMALL` rows are one window for each group; more are dealt to range-sorted
    parts, as many as their number asks for, each summed by itself, and the totals of a group's parts before it are added.
    """
    rows = saved(df, "ordered")
    n = rows.count() if parts is None else 0
    way = F.desc if descending else F.asc
    if parts is None and n <= SMALL:
        own = Window.partitionBy(*within).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: F.sum(c).over(own) for name, c in sums.items()}).select(*df.columns, *sums)
    dealt = _parts(rows, [*[F.col(k) for k in within], way(order)], parts or _enough(rows, n))
    # As many rows as parts and groups.
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*within, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = totals.select(*within, F.col("_part").alias("_q"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    own = Window.partitionBy(*within, "_part").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_s_{n}": F.sum(c).over(own) for n, c in sums.items()})
    on = F.col("_part") == F.col("_q")
    right = offsets
    for k in within:
        right = right.withColumnRenamed(k, f"_g_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    joined = summed.join(F.broadcast(right), on)
    return joined.select(*df.columns, *[(F.col(f"_s_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def last_known(df: DataFrame, order: str, then: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """df with each of `columns` replaced by its last known value up to this row, in the order of (order, then).

    Up to `SMALL` rows are one window. More are dealt to parts by range of `order`; a part's rows without a value before them take the last one of the parts before, of which there are
    as many rows as parts.
    """
    rows = saved(df, "ordered")
    n = rows.count() if parts is None else 0
    upto = lambda w: {c: F.last(c, ignorenulls=True).over(w.orderBy(order, then).rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
    if parts is None and n <= SMALL:
        return rows.withColumns(upto(Window.partitionBy()))
    dealt = _parts(rows, [F.col(order)], parts or _enough(rows, n))
    last = dealt.groupBy("_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, then))).alias(c) for c in columns])
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("_part").alias("_q"), *[F.last(c, ignorenulls=True).over(before).alias(f"_c_{c}") for c in columns])
    filled = dealt.withColumns(upto(Window.partitionBy("_part"))).join(F.broadcast(carried), F.col("_part") == F.col("_q"))
    return filled.withColumns({c: F.coalesce(c, f"_c_{c}") for c in columns}).select(*df.columns)
