"""Folding of micro-batches: newest records, window scores with late rows, replays, and how much is stored."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from panelwright.streaming import feed


def stored(path, name):
    return sum(1 for folder, _, files in os.walk(path) for f in files if f.endswith(".parquet") and name in folder)


def test_newest_records_over_fifty_batches(spark, tmp_path):
    rng, path, latest = np.random.default_rng(0), str(tmp_path / "latest"), {}
    size = []
    for number in range(50):
        rows = [(int(k), int(t), f"{number}-{k}") for k, t in zip(rng.integers(0, 40, 25), rng.integers(0, 1000, 25))]
        rows += [(int(rng.integers(0, 40)), None, f"{number}-null")] if number == 30 else []
        batch = spark.createDataFrame(rows, "k int, t int, v string").coalesce(1)
        feed.merge_batch(batch, number, ["k"], ["t", "v"], path)
        if number % 11 == 3:
            feed.merge_batch(batch, number, ["k"], ["t", "v"], path)  # a batch run again
        for k, t, v in rows:
            latest[k] = max(latest.get(k, ((False, -1, ""),)), ((t is None, -1 if t is None else t, v),))
        size.append(sum(spark.read.parquet(f"{path}/{name}").count() for name in os.listdir(path)))
    got = {r.k: r.v for r in feed.read_latest(spark, path, ["k"], ["t", "v"]).collect()}
    assert got == {k: v[0][2] for k, v in latest.items()}
    # Two bases and deltas of half a base: a few records for each of 40 keys, whatever the number of batches.
    assert max(size) <= 4 * 40
    before = sorted(os.listdir(path))
    feed.merge_batch(spark.createDataFrame([(1, 99999, "old")], "k int, t int, v string"), 5, ["k"], ["t", "v"], path)
    assert sorted(os.listdir(path)) == before and {r.k: r.v for r in feed.read_latest(spark, path, ["k"], ["t", "v"]).collect()} == got


def test_late_rows_equal_a_replay_in_arrival_order(spark, tmp_path):
    rng, path = np.random.default_rng(1), str(tmp_path / "scores")
    epoch, expected, latest = dt.datetime(1970, 1, 1), {}, None
    for number in range(12):
        days = number * 20 + rng.integers(-40, 20, 30)
        rows = [(epoch + dt.timedelta(days=int(max(0, d))), int(d) % 3 == 0) for d in days] + [(None, True)]
        batch = spark.createDataFrame(rows, "ts timestamp, bad boolean")
        for _ in range(2 if number % 4 == 2 else 1):
            feed.score_batch(batch, number, "ts", "bad", path)
        for ts, bad in rows[:-1]:
            start = epoch + dt.timedelta(days=(ts - epoch).days // 30 * 30)
            late = latest is not None and start + dt.timedelta(days=30) <= latest - dt.timedelta(days=10)
            one = expected.setdefault(start, [0, 0, 0])
            one[0] += not late
            one[1] += bad and not late
            one[2] += late
        latest = max([latest or epoch, *[ts for ts, _ in rows if ts]])
    got = {r.start: [r["rows"], r.violations, r.late] for r in feed.read_scores(spark, path).select(F.col("start"), "rows", "violations", "late").collect()}
    assert got == expected
    assert sum(v[2] for v in got.values()) > 20
    assert len(os.listdir(path)) <= 3
