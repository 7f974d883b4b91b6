"""Readers of delimited and positional files with fixed schemas, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_positional(spark: SparkSession, path: str, layout: list[str], types: dict[str, str], defaults: dict[str, object] = {}, sep: str = "|") -> DataFrame:
    """Headerless delimited text: named by position, the wanted columns cast (bad values become null), blanks replaced by defaults."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in layout])
    raw = spark.read.csv(path, sep=sep, schema=schema, quote="")
    out = []
    for c, kind in types.items():
        value = F.nullif(F.trim(c), F.lit("")).try_cast(kind)
        out.append((F.coalesce(value, F.lit(defaults[c]).cast(kind)) if c in defaults else value).alias(c))
    return raw.select(*out, F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).alias("vintage"))


def scan_vintages(spark: SparkSession, path: str, layout: list[str], types: dict[str, str], entity: str, vintage: str = "vintage", sep: str = "|") -> DataFrame:
    """vintage, rows, entities over a folder with one folder of positional files for each vintage, `<name>=<vintage>`."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in layout])
    raw = spark.read.csv(f"{path}/*", sep=sep, schema=schema, quote="")
    named = raw.withColumn("vintage", F.regexp_extract(F.col("_metadata.file_path"), rf"{vintage}=([^/]+)/", 1))
    return named.groupBy("vintage").agg(F.count("*").alias("rows"), F.count_distinct(F.nullif(F.trim(entity), F.lit("")).try_cast(types[entity])).alias("entities"))


def audit_layout(spark: SparkSession, path: str, expected: int, sep: str = "|") -> DataFrame:
    """file, lines, bad_lines: lines whose number of fields is not the expected one, over all lines."""
    fields = F.size(F.split("value", f"\\{sep}"))
    return spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("lines"), F.count_if(fields != expected).alias("bad_lines"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header under a given schema; values that do not fit become null."""
    wanted = T.StructType.fromDDL(schema)
    raw = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(f.name, T.StringType()) for f in wanted]))
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def read_panel(spark: SparkSession, path: str, schema: str, month: str = "reporting_month") -> DataFrame:
    """read_table with the month's last day."""
    return read_table(spark, path, schema).withColumn("period_end", F.last_day(F.to_date(F.concat(month, F.lit("-01")))))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """A two-column series; rows without a number are dropped."""
    return read_table(spark, path, "observation_date date, value double").dropna()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").format(fmt).option("header", True).partitionBy(*partition_by).save(path)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
