"""Stores of factor values: a narrow store by factor and month, and wide panels by quarter, both hive-partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

NARROW = "factor string, date date, symbol string, value double, written timestamp"


def append_narrow(rows: DataFrame, path: str, factor: str) -> None:
    """Appends (date, symbol, value) rows of a factor; a later row of a key stands for the earlier ones."""
    made = rows.select(F.lit(factor).alias("factor"), F.to_date("date").alias("date"), F.col("symbol").cast("string").alias("symbol"), F.col("value").cast("double").alias("value"), F.current_timestamp().alias("written"))
    made.withColumn("month", F.date_format("date", "yyyy-MM")).write.mode("append").partitionBy("factor", "month").parquet(path)


def query_narrow(spark: SparkSession, path: str, factors: list[str] | None = None, start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """factor, date, symbol, value of the last write of each key; partitions of other factors and months aren't read."""
    d = spark.read.schema(NARROW + ", month string").parquet(path)
    if factors:
        d = d.where(F.col("factor").isin(factors))
    if start:
        d = d.where((F.col("month") >= start[:7]) & (F.col("date") >= F.lit(start).cast("date")))
    if end:
        d = d.where((F.col("month") <= end[:7]) & (F.col("date") <= F.lit(end).cast("date")))
    if symbols:
        d = d.where(F.col("symbol").isin(symbols))
    key = ["factor", "date", "symbol"]
    return d.groupBy(*key).agg(F.max_by("value", "written").alias("value"))


def query_panel(spark: SparkSession, path: str, factor: str, symbols: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """date with a column for each of the symbols asked for."""
    return query_narrow(spark, path, [factor], start, end, symbols).groupBy("date").pivot("symbol", symbols).agg(F.max("value"))


def write_quarters(panel: DataFrame, path: str, date: str = "date") -> None:
    """Writes a wide panel by quarter; quarters that the panel has are replaced, others stay."""
    q = F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
    made = panel.withColumn("quarter", q).repartition("quarter")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("quarter").parquet(path)


def read_quarters(spark: SparkSession, path: str, columns: list[str], start: str, end: str, date: str = "date") -> DataFrame:
    """The columns of the dates from start to end; only the quarters between are read."""
    at = lambda d: f"{d[:4]}Q{(int(d[5:7]) + 2) // 3}"
    d = spark.read.parquet(path).where(F.col("quarter").between(at(start), at(end)))
    return d.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(*columns)


def latest_versions(records: DataFrame, key: list[str], version: str, earliest: bool = False) -> DataFrame:
    """One record a key: the last version, or the first."""
    order = F.col(version).asc() if earliest else F.col(version).desc()
    return records.withColumn("_n", F.row_number().over(W.Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def missing_keys(wanted: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of wanted that have lacks."""
    return wanted.select(*key).distinct().exceptAll(have.select(*key).distinct())
