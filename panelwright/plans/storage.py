"""Queries that write files derived from the given tables to the shared folder and read them back, whole or as streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import columns as C
from panelwright.operators import joins
from panelwright.plans.oracle import select
from panelwright.plans.quality import KEYS, deduped, latest_feed, rounded
from panelwright.sources import files
from panelwright.sources.session import new_path, saved
from panelwright.sources.tables import FEED_TIES, Tables
from panelwright.streaming import feed as W

LAYOUT = ["okey", "ckey", "status", "price", "day", "priority"]


def _orders(t: Tables):
    """Orders as lines of six fields; some prices are blank or words, and each 50th line has a field too many."""
    price = F.when(F.col("o_orderkey") % 40 == 0, "").when(F.col("o_orderkey") % 41 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(20,2)").cast("string"))
    extra = F.when(F.col("o_orderkey") % 50 == 0, "|more").otherwise("")
    return t.raw("orders").select(F.year("o_orderdate").alias("y"), F.concat(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", price, F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority"), extra).alias("value"))


def _lines(t: Tables) -> str:
    """A folder with one file for each year of orders, named by it."""
    path = new_path(t.spark, "lines")
    rows, years = _orders(t), sorted(r.y for r in _orders(t).select("y").distinct().collect())
    for y in years:  # as many files as years, whatever the number of rows in each
        files.write_table(rows.filter(F.col("y") == y).select("value"), f"{path}/year={y}", "text")
    return path


def _positional(t):
    path = _lines(t)
    kinds = {"okey": "long", "ckey": "long", "price": "double", "day": "date", "priority": "string"}
    out = files.read_positional(t.spark, f"{path}/*", LAYOUT, kinds, {"price": 0.0})
    return out.select("okey", "ckey", "price", F.col("day").cast("string").alias("day"), "priority")


def _audit(t):
    path = _lines(t)
    return files.audit_layout(t.spark, f"{path}/*", 6).agg(F.sum("lines").alias("lines"), F.sum("bad_lines").alias("bad_lines"))


def _vintages(t):
    return files.scan_vintages(t.spark, _lines(t), LAYOUT, {"okey": "long", "ckey": "long"}, entity="ckey", vintage="year")


def _csv(t, df, name):
    path = new_path(t.spark, name)
    files.write_table(df, path, "csv")
    return path


def _panel_file(t):
    rows = deduped(t).select("seq", "reporting_month", "current_balance", "days_past_due", "current_status")
    out = files.read_panel(t.spark, _csv(t, rows, "panel"), "seq long, reporting_month string, current_balance double, days_past_due double, current_status string")
    return rounded(out.withColumn("period_end", F.col("period_end").cast("string")), "current_balance")


def _feed_file(t):
    rows = latest_feed(t).select(*KEYS, "reported_balance", "reported_status", F.col("received_at").cast("string").alias("received_at"))
    out = files.read_table(t.spark, _csv(t, rows, "feed"), "entity_id long, month_index int, reported_balance double, reported_status string, received_at date")
    return rounded(out.withColumn("received_at", F.col("received_at").cast("string")), "reported_balance")


def _series_file(t):
    rows = t.macro().select(F.concat("reporting_month", F.lit("-01")).alias("observation_date"), F.when(F.col("pno") % 7 == 0, ".").otherwise(F.col("unemployment_rate").cast("string")).alias("value"))
    return files.read_series(t.spark, _csv(t, rows, "series")).withColumn("observation_date", F.col("observation_date").cast("string"))


def _parquet(t):
    rows = deduped(t).select("seq", "entity_id", "current_status")
    path = new_path(t.spark, "partitioned")
    files.write_table(rows, path, "parquet", ["current_status"])
    return files.materialise(t.spark.read.schema(rows.schema).parquet(path), new_path(t.spark, "again")).groupBy("current_status").agg(F.count("*").alias("rows"), F.count_distinct("entity_id").alias("entities"))


def _recon(t):
    out = joins.attach_recon(deduped(t), latest_feed(t))
    return rounded(out.select("seq", "recon_reported_balance", "recon_reported_status", "recon_reported_dpd", F.col("recon_received_at").cast("date").cast("string").alias("recon_received_at"), "recon_record_present"), "recon_reported_balance")


def _credit_bands(t):
    o, d = F.col("o_orderkey"), t.raw("orders")
    score = F.when(o % 17 == 0, 9999).otherwise(500 + o % 331).cast("double")
    ltv, dti = F.when(o % 19 == 0, 999).otherwise(o % 110).cast("double"), F.when(o % 23 == 0, 999).otherwise(o % 60).cast("double")
    letter = F.when(o % 3 == 0, "P").when(o % 3 == 1, "S").otherwise("I")
    return d.select(
        o, C.credit_band(score).alias("credit"), C.ltv_band(ltv).alias("ltv"), C.dti_band(dti).alias("dti"), C.loss_band((o % 80).cast("double")).alias("loss"), C.map_codes(letter, C.OCCUPANCY).alias("occupancy"),
        C.map_codes(F.when(o % 2 == 0, "C").otherwise("X"), C.PURPOSE).alias("purpose"), C.map_codes(F.when(o % 2 == 0, "PU").otherwise("SF"), C.PROPERTY).alias("property"),
        C.property_type(F.when(o % 2 == 0, "PU").otherwise("??"), F.when(o % 13 == 0, "").otherwise((o % 5).cast("string"))).alias("by_units"),
    )


def _stream(t: Tables):
    """The feed as a stream of files."""
    rows = t.feed().withColumn("received_at", F.col("received_at").cast("timestamp"))
    path = new_path(t.spark, "arriving")
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _latest_stream(t):
    path = new_path(t.spark, "latest")
    order = ["received_at", *FEED_TIES]
    W.latest_records(_stream(t), KEYS, order, path, new_path(t.spark, "progress")).awaitTermination()
    return W.read_latest(t.spark, path, KEYS, order).select(*KEYS, "reported_status", "l_orderkey", "l_linenumber")


def _flag_stream(t):
    """Row-wise rules on the stream, its output summed up."""
    path = new_path(t.spark, "flagged")
    rules = {"no_balance": F.col("reported_balance").isNull(), "late": F.col("reported_dpd") > 30}
    flagged = W.flagged(_stream(t), rules).select("month_index", *rules)
    flagged.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(t.spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(flagged.schema).parquet(path).groupBy("month_index").agg(F.count("*").alias("rows"), *[F.sum(n).alias(n) for n in rules])


def _window_stream(t):
    """Rows and violations by windows of 30 days of event time; the watermark is wider than the data, so nothing comes late."""
    path = new_path(t.spark, "windows")
    rows = W.flagged(_stream(t), {"no_balance": F.col("reported_balance").isNull()})

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    scores = W.window_scores(rows, "received_at", "no_balance", "30 days", "20000 days")
    scores.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_path(t.spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.parquet(path)
    # The last state of each window is its result.
    return out.groupBy(F.col("window.start").cast("date").cast("string").alias("start")).agg(F.max_by("rows", "batch").alias("rows"), F.max_by("violations", "batch").alias("violations"))


def _late_stream(t):
    """Feed records that arrive up to 45 days after their time, a file for each 300 days, under a watermark of 10 days: what was on time and what late, by windows of 30 days."""
    rows = t.feed().withColumn("received_at", F.col("received_at").cast("timestamp")).withColumn("slot", F.floor((F.date_diff("received_at", F.lit("1992-01-01")) + F.col("l_orderkey") % 45) / 300))
    rows = saved(rows.select("received_at", "reported_balance", "slot"), "arrivals")
    arriving, path = new_path(t.spark, "arriving"), new_path(t.spark, "scores")
    for k in sorted(r.slot for r in rows.select("slot").distinct().collect()):  # as many files as slots, one after another, since the source reads them by age
        rows.filter(F.col("slot") == k).drop("slot").coalesce(1).write.mode("append").parquet(arriving)
    stream = t.spark.readStream.schema(rows.drop("slot").schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    W.scored_windows(W.flagged(stream, {"no_balance": F.col("reported_balance").isNull()}), "received_at", "no_balance", path, new_path(t.spark, "progress")).awaitTermination()
    return W.read_scores(t.spark, path).select(F.col("start").cast("date").cast("string").alias("start"), "rows", "violations", "late")


QUERIES = {
    "a1_read_positional": _positional,
    "a3_audit_layout": _audit,
    "a4_scan_vintages": _vintages,
    "a6_read_panel": _panel_file,
    "a7_read_feed": _feed_file,
    "a9_read_series": _series_file,
    "a10_write_and_materialise": _parquet,
    "b2_credit_bands": _credit_bands,
    "c5_attach_recon": _recon,
    "s7_shuffle_rows": lambda t: t.raw("customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("h")).orderBy("h", "c_custkey"),
    "s8_head_sample": lambda t: t.raw("orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(25),
    "w1_latest_records": _latest_stream,
    "w2_flag_stream": _flag_stream,
    "w3_window_scores": _window_stream,
    "w3_late_records": _late_stream,
}

_PRICE = "CASE WHEN o_orderkey % 40 = 0 OR o_orderkey % 41 = 0 THEN 0e0 ELSE CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) END"


def _cases(x: str, edges: list, labels: list[str], sign: str, missing: str = "false") -> str:
    return f"CASE WHEN {missing} THEN NULL " + " ".join(f"WHEN {x} {sign} {e}e0 THEN '{label}'" for e, label in zip(edges, labels)) + f" ELSE '{labels[-1]}' END"


ORACLES = {
    "a1_read_positional": f"SELECT o_orderkey AS okey, o_custkey AS ckey, {_PRICE} AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderpriority AS priority FROM orders",
    "a3_audit_layout": "SELECT count(*) AS lines, sum(CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS bad_lines FROM orders",
    "a4_scan_vintages": "SELECT CAST(year(o_orderdate) AS VARCHAR) AS vintage, count(*) AS rows, count(DISTINCT o_custkey) AS entities FROM orders GROUP BY 1",
    "a6_read_panel": select("SELECT seq, reporting_month, round(current_balance, 6) AS current_balance, days_past_due, current_status, CAST(CAST(period_end AS DATE) AS VARCHAR) AS period_end FROM one"),
    "a7_read_feed": select("SELECT entity_id, month_index, round(reported_balance, 6) AS reported_balance, reported_status, CAST(CAST(received_at AS DATE) AS VARCHAR) AS received_at FROM latest"),
    "a9_read_series": select("SELECT concat(reporting_month, '-01') AS observation_date, unemployment_rate AS value FROM macro WHERE pno % 7 <> 0"),
    "a10_write_and_materialise": select("SELECT current_status, count(*) AS rows, count(DISTINCT entity_id) AS entities FROM one GROUP BY 1"),
    "b2_credit_bands": "SELECT o_orderkey, " + _cases("(500 + o_orderkey % 331)", C.CREDIT_EDGES, C.CREDIT_BANDS, "<", "o_orderkey % 17 = 0") + " AS credit, " + _cases("(o_orderkey % 110)", C.LTV_EDGES, C.LTV_BANDS, "<=", "o_orderkey % 19 = 0") + " AS ltv, " + _cases("(o_orderkey % 60)", C.DTI_EDGES, C.DTI_BANDS, "<=", "o_orderkey % 23 = 0") + " AS dti, " + _cases("(o_orderkey % 80)", C.LOSS_EDGES, C.LOSS_BANDS, "<") + " AS loss, CASE o_orderkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'second_home' ELSE 'investment' END AS occupancy, CASE WHEN o_orderkey % 2 = 0 THEN 'cash_out_refi' END AS purpose, CASE WHEN o_orderkey % 2 = 0 THEN 'pud' ELSE 'single_family' END AS property, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 5 >= 2 THEN '2-4_unit' WHEN o_orderkey % 2 = 0 THEN 'pud' ELSE 'single_family' END AS by_units FROM orders",
    "c5_attach_recon": select("SELECT seq, round(f.reported_balance, 6) AS recon_reported_balance, f.reported_status AS recon_reported_status, f.reported_dpd AS recon_reported_dpd, CAST(CAST(f.received_at AS DATE) AS VARCHAR) AS recon_received_at, CASE WHEN f.reported_balance IS NULL THEN 0 ELSE 1 END AS recon_record_present FROM one LEFT JOIN latest f USING (entity_id, month_index)"),
    "s7_shuffle_rows": "SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer",
    "s8_head_sample": "SELECT o_orderkey, o_custkey FROM orders ORDER BY 1 LIMIT 25",
    "w1_latest_records": select("SELECT entity_id, month_index, reported_status, l_orderkey, l_linenumber FROM latest"),
    "w2_flag_stream": select("SELECT month_index, count(*) AS rows, sum(CASE WHEN reported_balance IS NULL THEN 1 ELSE 0 END) AS no_balance, sum(CASE WHEN reported_dpd > 30 THEN 1 ELSE 0 END) AS late FROM feed GROUP BY 1"),
    "w3_late_records": select(""", arrived AS (SELECT CAST(received_at AS DATE) AS day, reported_balance, (date_diff('day', DATE '1992-01-01', CAST(received_at AS DATE)) + l_orderkey % 45) // 300 AS slot FROM feed),
seen AS (SELECT slot, max(max(day)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM arrived GROUP BY slot),
placed AS (SELECT a.*, DATE '1970-01-01' + CAST(30 * (date_diff('day', DATE '1970-01-01', day) // 30) AS INT) AS start, latest FROM arrived a JOIN seen USING (slot)),
judged AS (SELECT *, coalesce(start + 30 <= latest - 10, false) AS late FROM placed)
SELECT CAST(CAST(start AS DATE) AS VARCHAR) AS start, count(*) FILTER (WHERE NOT late) AS rows, count(*) FILTER (WHERE NOT late AND reported_balance IS NULL) AS violations, count(*) FILTER (WHERE late) AS late FROM judged GROUP BY 1"""),
    "w3_window_scores": select("SELECT CAST(DATE '1970-01-01' + CAST(30 * (date_diff('day', DATE '1970-01-01', CAST(received_at AS DATE)) // 30) AS INT) AS VARCHAR) AS start, count(*) AS rows, sum(CASE WHEN reported_balance IS NULL THEN 1 ELSE 0 END) AS violations FROM feed GROUP BY 1"),
}
