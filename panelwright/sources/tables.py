"""The given tables seen as a panel, its second feed and a monthly macro series.

The statements are plain SQL that Spark and DuckDB read alike: here `{orders}` and so on are DataFrames, in a check they are table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PNO = "(year(o_orderdate) * 12 + month(o_orderdate) - 1)"
_BORN = "(23940 - 1 - CAST(o_custkey % 48 AS INT))"
_BY_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN {0} WHEN '2-HIGH' THEN {1} WHEN '3-MEDIUM' THEN {2} ELSE {3} END"

PANEL = f"""
SELECT o_custkey AS entity_id, o_orderkey AS seq, {_PNO} - 23940 AS month_index,
  concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS reporting_month,
  last_day(o_orderdate) AS period_end, {_PNO} AS pno,
  CASE WHEN o_orderkey % 113 = 0 THEN {_PNO} + 3 ELSE {_BORN} END AS orig_pno,
  {_PNO} - {_BORN} + CASE WHEN o_orderkey % 53 = 0 THEN 5 ELSE 0 END AS loan_age_months,
  360 - ({_PNO} - {_BORN}) - CASE WHEN o_orderkey % 41 = 0 THEN 7 ELSE 0 END AS remaining_term_months,
  max(o_totalprice) OVER (PARTITION BY o_custkey) AS original_balance,
  CASE WHEN o_orderkey % 97 = 0 THEN -o_totalprice WHEN o_orderkey % 101 = 0 THEN o_totalprice * 40 ELSE o_totalprice END AS current_balance,
  CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 79 = 0 THEN 99.99e0 ELSE 3e0 + (o_custkey % 40) / 10e0 END AS interest_rate,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN c_acctbal < 0 THEN '<580' WHEN c_acctbal < 2500 THEN '620-659' WHEN c_acctbal < 5000 THEN '660-699' WHEN c_acctbal < 7500 THEN '700-739' ELSE '780+' END AS credit_score_band,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_totalprice < 100000 THEN '<=60' WHEN o_totalprice < 200000 THEN '60-70' WHEN o_totalprice < 300000 THEN '70-80' ELSE '>95' END AS ltv_band,
  CASE WHEN o_orderkey % 11 = 0 AND r_name IN ('ASIA', 'AFRICA') THEN NULL WHEN o_custkey % 3 = 0 THEN '<=20' WHEN o_custkey % 3 = 1 THEN '20-30' ELSE '>43' END AS dti_band,
  n_name AS servicer_name, r_name AS state, c_mktsegment AS loan_purpose,
  CASE WHEN o_orderkey % 107 = 0 THEN 'Default' WHEN o_orderkey % 211 = 0 THEN 'PaidOff' ELSE {_BY_PRIORITY.format("'DQ90plus'", "'DQ60'", "'DQ30'", "'Current'")} END AS current_status,
  CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_custkey % 10 = 0 THEN 'investment' WHEN o_custkey % 10 = 1 THEN 'second_home' ELSE 'primary' END AS occupancy_type,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_custkey % 4 = 0 THEN 'condo' WHEN o_custkey % 4 = 1 THEN 'pud' ELSE 'single_family' END AS property_type,
  CASE WHEN o_orderkey % 83 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 9999e0 WHEN o_orderkey % 67 = 0 THEN 120e0 WHEN o_orderkey % 107 = 0 THEN 180e0 WHEN o_orderkey % 211 = 0 THEN 0e0 ELSE {_BY_PRIORITY.format("90e0", "60e0", "30e0", "0e0")} END AS days_past_due,
  CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS modification_flag,
  CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN '01' WHEN o_orderstatus = 'P' AND o_custkey % 5 = 0 THEN '02' ELSE '' END AS exit_code,
  last_day(o_orderdate) + CAST(o_orderkey % 120 - 10 AS INT) AS last_updated_at,
  CASE WHEN o_orderkey % 10 = 0 THEN 'manual_upload' WHEN o_orderkey % 10 IN (1, 2) THEN 'investor_feed' ELSE 'core_servicing' END AS source_system,
  CASE WHEN o_orderkey % 20 = 0 THEN 'missing' WHEN o_orderkey % 20 = 1 THEN 'exception' WHEN o_orderkey % 20 = 2 THEN 'pending' ELSE 'complete' END AS document_status
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""

FEED = f"""
SELECT o_custkey AS entity_id, {_PNO} - 23940 + CASE WHEN l_partkey % 250 = 0 THEN 600 ELSE 0 END AS month_index,
  CASE WHEN l_partkey % 20 = 0 THEN NULL WHEN l_partkey % 12 = 0 THEN o_totalprice * (1 + l_discount) ELSE o_totalprice END AS reported_balance,
  CASE WHEN l_suppkey % 20 = 0 THEN 'DQ30' ELSE {_BY_PRIORITY.format("'DQ90plus'", "'DQ60'", "'DQ30'", "'Current'")} END AS reported_status,
  CASE WHEN l_suppkey % 25 = 0 THEN 45e0 ELSE 0e0 END AS reported_dpd,
  l_shipdate AS received_at, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
"""

MACRO = f"""
SELECT {_PNO} AS pno, concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS reporting_month,
  round(100 * avg(l_discount), 4) AS market_mortgage_rate, round(100 * avg(l_tax), 4) AS unemployment_rate, round(avg(l_quantity) / 50 - 0.5e0, 5) AS hpi_yoy_growth
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY 1, 2
"""

PAIRS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  round(least(0.99e0, l_quantity / 100 + CASE WHEN l_returnflag = 'R' THEN 0.2e0 ELSE 0e0 END + l_discount), 3) AS p
FROM {lineitem}
"""

#: Order of feed records that arrive at one time; the longest list has no ties.
FEED_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


class Tables:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, statement: str, *names: str) -> DataFrame:
        return self.spark.sql(statement, **{n: self.raw(n) for n in names})

    def panel(self) -> DataFrame:
        return self._view(PANEL, "orders", "customer", "nation", "region")

    def feed(self) -> DataFrame:
        return self._view(FEED, "lineitem", "orders")

    def macro(self) -> DataFrame:
        return self._view(MACRO, "lineitem", "orders")

    def pairs(self) -> DataFrame:
        return self._view(PAIRS, "lineitem")
