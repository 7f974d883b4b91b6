"""Concordance of a risk score with times to event, without pairs: dominance counts by blocks.

A pair is an event and a row that outlasts it (a later time, or the same time without the event). It counts as right where the outlasting row has the lower risk, half where the risks are equal.
Rows become counts of distinct (time, risk), which are cut into blocks of time and blocks of risk; a value that is a cut is a block of its own. Then an event's outlasting rows are
those of later blocks of time and lower blocks of risk (a table of block counts), those of its own block of time, those of later blocks of time in its own block of risk (each
such block is one task's work, sorted and merged), and those of its own time (sums along the risk).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.prefix import running_totals
from panelwright.sources.session import saved, ship_package

#: Rows of a block, about, and cuts of an axis at most; so the table of blocks has at most (2 * MOST_CUTS + 1) ** 2 cells, and beyond 10**8 rows blocks grow.
BLOCK_ROWS, MOST_CUTS = 100_000, 1_000


def right_pairs(t: np.ndarray, x: np.ndarray, n: np.ndarray, d: np.ndarray) -> float:
    """Sum over rows of d times the n of strictly later rows that have a lower x, and half of those of equal x.

    By bits of the rank of t: a later row shares the leading bits and then has a 1 where the earlier has a 0. Within rows of shared leading bits, sorted by x, running sums count.
    """
    rank = np.unique(t, return_inverse=True)[1]
    at = np.argsort(x, kind="stable")
    rank, x, n, d = rank[at], x[at], n[at].astype(float), d[at].astype(float)
    total = 0.0
    for level in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        group, one = rank >> (level + 1), (rank >> level) & 1
        upto = np.cumsum(n * one)
        before = np.concatenate([[0.0], upto])
        changed = group[1:] != group[:-1]
        starts = np.flatnonzero(np.concatenate([[True], changed]))
        run = np.flatnonzero(np.concatenate([[True], changed | (x[1:] != x[:-1])]))
        sizes = np.diff(np.append(run, len(x)))
        base = np.repeat(before[starts], np.diff(np.append(starts, len(x))))
        low, high = np.repeat(before[run], sizes) - base, np.repeat(before[run + sizes], sizes) - base
        total += float((d * (1 - one) * (low + high)).sum()) / 2
        at = np.argsort(rank >> level, kind="stable")
        rank, x, n, d = rank[at], x[at], n[at], d[at]
    return total


def _cuts(counts: DataFrame, column: str, k: int) -> np.ndarray:
    shares = F.array(*[F.lit(i / (k + 1)) for i in range(1, k + 1)])
    found = counts.agg(F.percentile_approx(column, shares, 10_000)).first()[0] if k else []
    return np.unique(np.array(found or [], dtype=float))


def concordance(v: DataFrame, time: str, event: str, risk: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pairs, concordance (null without pairs) of one row; rows with a null time, event or risk are left out."""
    ship_package(v.sparkSession)
    known = v.select(F.col(time).cast("double").alias("t"), F.col(risk).cast("double").alias("x"), F.col(event).cast("long").alias("e")).dropna()
    counts = saved(known.groupBy("t", "x").agg(F.count("*").alias("n"), F.sum("e").alias("d")), "counts")
    k = min(MOST_CUTS, math.ceil(counts.count() / block_rows) - 1)
    times, risks = _cuts(counts, "t", k), _cuts(counts, "x", k)

    def placed(batches):
        for batch in batches:
            columns = [batch[c] for c in ("t", "x", "n", "d")]
            for values, cuts in ((batch["t"], times), (batch["x"], risks)):
                z = values.to_numpy()
                columns.append(pa.array((np.searchsorted(cuts, z, "left") + np.searchsorted(cuts, z, "right")).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=["t", "x", "n", "d", "a", "b"])

    blocks = saved(counts.mapInArrow(placed, "t double, x double, n long, d long, a int, b int"), "blocks")
    cells = blocks.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).toArrow()
    n, d = (np.zeros((2 * len(times) + 1, 2 * len(risks) + 1)) for _ in range(2))
    for grid, name in ((n, "n"), (d, "d")):
        grid[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells[name].to_numpy()
    later = np.vstack([np.cumsum(n[::-1], axis=0)[::-1][1:], np.zeros((1, n.shape[1]))])
    lower = np.hstack([np.zeros((len(n), 1)), np.cumsum(later, axis=1)[:, :-1]])
    far = float((d * lower).sum())

    def merged(t: str):
        def add(rows: pa.Table) -> pa.Table:
            return pa.table({"right": [right_pairs(*(rows[c].to_numpy() for c in (t, "x", "n", "d")))]})

        return add

    # A block that is a single time has no strictly later row within it.
    own_time = blocks.filter("a % 2 = 0").groupBy("a").applyInArrow(merged("t"), "right double")
    own_risk = blocks.groupBy("b", "x", "a").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).groupBy("b").applyInArrow(merged("a"), "right double")
    others = F.col("n") - F.col("d")
    below = Window.partitionBy("t", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("t", "b").agg(F.sum(others).alias("o"))
    offset = sums.select("t", "b", F.coalesce(F.sum("o").over(Window.partitionBy("t").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    at_once = blocks.filter("d > 0 OR n > d").withColumn("under", F.coalesce(F.sum(others).over(below), F.lit(0))).join(offset, ["t", "b"])
    same_time = at_once.filter("d > 0").select((F.col("d") * (F.col("under") + F.col("o") + others / 2)).alias("right"))
    right = own_time.union(own_risk).union(same_time).agg((F.coalesce(F.sum("right"), F.lit(0.0)) + far).alias("right"))
    by_time = counts.groupBy("t").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    upto = running_totals(by_time, "t", {"rest": "n"}, descending=True)
    pairs = upto.agg(F.coalesce(F.sum(F.col("d") * (F.col("rest") - F.col("d"))), F.lit(0)).alias("pairs"))
    return pairs.join(F.broadcast(right)).select("pairs", (F.col("right") / F.nullif("pairs", F.lit(0))).alias("concordance"))
