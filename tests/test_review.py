"""Texts and sums that must not depend on size or order."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import review, scenarios


def test_driver_strings_do_not_group_digits(spark):
    rows = spark.createDataFrame([(1, "a_b", 1234567.891), (1, "c", -0.5), (2, "c", -1000.0), (3, "c", 0.125)], "seq int, feature string, contribution double")
    got = {r.seq: r.drivers for r in review.driver_strings(rows, ["seq"]).collect()}
    assert got == {1: "a b (+1234567.89) | c (-0.50)", 2: "c (-1000.00)", 3: "c (+0.12)"}


@pytest.mark.parametrize("turn", range(4))
def test_mean_incentive_does_not_depend_on_the_order_of_rows(spark, turn):
    # 32 values whose mean is -0.55325 exactly: half a unit of the fourth digit.
    values = [0.1, -0.3, 0.7, -2.9, 0.2, -1.1, 0.3, -3.1, 1.7, -0.6, 0.9, -2.2, -0.4, -1.3, 0.8, -0.7, 1.9, -2.8, 0.6, -1.7, 0.3, -0.2, 1.1, -3.3, 0.4, -0.9, 0.5, -1.6, -0.1]
    values += [0.001, 0.003, -17.704 - round(sum(values), 4) - 0.004]
    values = [round(x, 4) for x in (sorted(values), sorted(values, reverse=True), sorted(values, key=abs), values)[turn]]
    rows = spark.createDataFrame([("DQ60", 1, "DQ30", x) for x in [*values, None]], "current_status string, pno int, next_state string, rate_incentive double").coalesce(1)
    got = scenarios.monthly_rates(rows).select("n", "rate_incentive", F.round("rate_incentive", 4).alias("r")).first()
    assert (got.n, got.rate_incentive, got.r) == (33, -0.55325, -0.5533)
