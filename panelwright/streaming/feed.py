"""The second feed as a stream: latest records, stateless rules, and batch scores by event time with an account of what came late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.sources.session import saved


class Generations:
    """Numbered folders of a table that is folded batch by batch, complete ones only. `<kind>=<n>` holds what batches up to n (or n alone) came to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self, kind: str) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{kind}=") and self._fs.exists(self._folder(f"{x}/_SUCCESS")))

    def read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}={number}")

    def write(self, df: DataFrame, kind: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}={number}")

    def drop(self, kind: str, before: int) -> None:
        for n in self.numbers(kind):
            if n < before:
                self._fs.delete(self._folder(f"{kind}={n}"), True)


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_first(order[0]), *[F.desc(c) for c in order[1:]])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _live(table: Generations, upto: int | None = None) -> list[tuple[str, int]]:
    """The newest base, and the deltas after it."""
    known = [n for n in table.numbers("base") if upto is None or n <= upto]
    base = known[-1] if known else -1
    deltas = [n for n in table.numbers("delta") if n > base and (upto is None or n <= upto)]
    return [("base", base)] * bool(known) + [("delta", n) for n in deltas]


def merge_batch(batch: DataFrame, number: int, keys: list[str], order: list[str], path: str, share: float = 0.5) -> None:
    """Fold one micro-batch into the table of newest records under `path`.

    A batch becomes a delta of one record a key. When the deltas have more than `share` of the base's rows, base and deltas are folded into a new base, and
    what it replaces goes, but for the base before it, which readers may still hold. So the folder holds at most a few records a key, and each record is
    rewritten only as often as the base grows or turns over. A batch that the base has already changes nothing; one that it has not replaces itself.
    """
    table = Generations(batch.sparkSession, path)
    bases = table.numbers("base")
    if bases and bases[-1] >= number:
        return
    table.write(newest(batch, keys, order), "delta", number)
    live = _live(table, number)
    rows = {kind: sum(table.read(k, n).count() for k, n in live if k == kind) for kind in ("base", "delta")}
    if rows["delta"] > share * rows["base"]:
        table.write(newest(_union(table, live), keys, order), "base", number)
        before = bases[-1] if bases else -1
        table.drop("base", before)
        table.drop("delta", number + 1)


def _union(table: Generations, live: list[tuple[str, int]]) -> DataFrame:
    parts = [table.read(kind, n) for kind, n in live]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def latest_records(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, share: float = 0.5):
    """A started query that keeps the newest record of each key in the table under `path`; see merge_batch, and read_latest for its content."""

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, keys, order, path, share)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """One record a key: the base and what came after it."""
    table = Generations(spark, path)
    return newest(_union(table, _live(table)), keys, order)


def flagged(stream: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Row-wise rules on a stream: no state is needed."""
    return stream.withColumns({name: F.coalesce(p, F.lit(False)).cast("int") for name, p in rules.items()})


def window_scores(stream: DataFrame, ts: str, flag: str, width: str = "30 days", late: str = "10 days") -> DataFrame:
    """Rows and violations of each event-time window; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("rows"), F.sum(flag).alias("violations"))


def score_batch(batch: DataFrame, number: int, ts: str, flag: str, path: str, width: str = "30 days", late: str = "10 days") -> None:
    """Fold one micro-batch into the window scores under `path`: rows and violations on time, rows late, by window, and the latest time seen.

    As a stream's watermark has it, a row is late if its window ended at or before the latest time that earlier batches saw, less `late`. The table has a row a window and is written
    anew by each batch, which reads the one before it; the last two are kept, so a batch that is run again finds what it found the first time. Rows without a time are in no window and left out.
    """
    table = Generations(batch.sparkSession, path)
    done = [n for n in table.numbers("scores") if n < number]
    before = table.read("scores", done[-1]) if done else None
    seen = before.agg(F.max("seen") - F.expr(f"INTERVAL {late}")).first()[0] if before is not None else None
    w = F.window(ts, width)
    windows = batch.select(F.col(ts).alias("_ts"), F.col(flag).cast("long").alias("_flag"), w.alias("_w"))
    behind = F.coalesce(F.col("_w.end") <= F.lit(seen), F.lit(False)) if seen is not None else F.lit(False)
    on_time = (~behind).cast("long")
    one = windows.groupBy(F.col("_w.start").alias("start"), F.col("_w.end").alias("end")).agg(
        F.sum(on_time).alias("rows"), F.coalesce(F.sum(F.col("_flag") * on_time), F.lit(0)).alias("violations"), F.sum(behind.cast("long")).alias("late"), F.max("_ts").alias("seen")
    )
    both = one if before is None else before.unionByName(one)
    folded = both.groupBy("start", "end").agg(*[F.sum(c).alias(c) for c in ("rows", "violations", "late")], F.max("seen").alias("seen"))
    table.write(saved(folded, "scores"), "scores", number)
    table.drop("scores", done[-1] if done else number)


def scored_windows(stream: DataFrame, ts: str, flag: str, path: str, checkpoint: str, width: str = "30 days", late: str = "10 days"):
    """A started query that keeps the window scores under `path`, late rows counted; see score_batch, and read_scores for its content."""

    def fold(batch: DataFrame, number: int) -> None:
        score_batch(batch, number, ts, flag, path, width, late)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    table = Generations(spark, path)
    return table.read("scores", table.numbers("scores")[-1])
