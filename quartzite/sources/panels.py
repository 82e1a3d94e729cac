"""Panels bound to the driver's tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sf_dir: str, text: str, tables: list[str]) -> DataFrame:
    """SQL text over the given tables of sf_dir."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables}) if "{" in text else _viewed(spark, sf_dir, text, tables)


def _viewed(spark: SparkSession, sf_dir: str, text: str, tables: list[str]) -> DataFrame:
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


#: Weekly panel of suppliers: bars, active buying and selling, order-size buckets.
WEEKLY = """
(select symbol, td, open, high, low, close, volume, amount, round(amount / nullif(volume, 0), 6) as vwap, buy_volume, sell_volume, buy_amount, sell_amount, buy_count, sell_count, trades,
  small_amount, mid_amount, large_amount, super_amount, small_buy, small_sell, mid_buy, mid_sell, large_buy, large_sell, super_buy, super_sell, bid_cancel, ask_cancel, turnover
 from (select cast(l_suppkey as int) as symbol, cast(floor(datediff(l_shipdate, timestamp '1995-01-01 00:00:00') / 7) as int) as td,
  min_by(px, struct(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) as open, max(px) as high, min(px) as low,
  max_by(px, struct(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) as close,
  round(sum(l_quantity), 2) as volume, round(sum(l_extendedprice), 2) as amount,
  round(sum(case when l_returnflag <> 'R' then l_quantity else 0 end), 2) as buy_volume, round(sum(case when l_returnflag = 'R' then l_quantity else 0 end), 2) as sell_volume,
  round(sum(case when l_returnflag <> 'R' then l_extendedprice else 0 end), 2) as buy_amount, round(sum(case when l_returnflag = 'R' then l_extendedprice else 0 end), 2) as sell_amount,
  sum(case when l_returnflag <> 'R' then 1.0 else 0.0 end) as buy_count, sum(case when l_returnflag = 'R' then 1.0 else 0.0 end) as sell_count, cast(count(*) as double) as trades,
  round(sum(case when l_extendedprice <= 20000 then l_extendedprice else 0 end), 2) as small_amount,
  round(sum(case when l_extendedprice > 20000 and l_extendedprice <= 40000 then l_extendedprice else 0 end), 2) as mid_amount,
  round(sum(case when l_extendedprice > 40000 and l_extendedprice <= 60000 then l_extendedprice else 0 end), 2) as large_amount,
  round(sum(case when l_extendedprice > 60000 then l_extendedprice else 0 end), 2) as super_amount,
  round(sum(case when l_extendedprice <= 20000 and l_returnflag <> 'R' then l_extendedprice else 0 end), 2) as small_buy,
  round(sum(case when l_extendedprice <= 20000 and l_returnflag = 'R' then l_extendedprice else 0 end), 2) as small_sell,
  round(sum(case when l_extendedprice > 20000 and l_extendedprice <= 40000 and l_returnflag <> 'R' then l_extendedprice else 0 end), 2) as mid_buy,
  round(sum(case when l_extendedprice > 20000 and l_extendedprice <= 40000 and l_returnflag = 'R' then l_extendedprice else 0 end), 2) as mid_sell,
  round(sum(case when l_extendedprice > 40000 and l_extendedprice <= 60000 and l_returnflag <> 'R' then l_extendedprice else 0 end), 2) as large_buy,
  round(sum(case when l_extendedprice > 40000 and l_extendedprice <= 60000 and l_returnflag = 'R' then l_extendedprice else 0 end), 2) as large_sell,
  round(sum(case when l_extendedprice > 60000 and l_returnflag <> 'R' then l_extendedprice else 0 end), 2) as super_buy,
  round(sum(case when l_extendedprice > 60000 and l_returnflag = 'R' then l_extendedprice else 0 end), 2) as super_sell,
  round(sum(case when l_discount >= 0.05 then l_quantity else 0 end), 2) as bid_cancel, round(sum(case when l_tax >= 0.04 then l_quantity else 0 end), 2) as ask_cancel,
  round(sum(l_quantity) / 1000, 6) as turnover
 from (select *, l_extendedprice / nullif(l_quantity, 0) as px from lineitem where l_shipdate >= timestamp '1995-01-01 00:00:00') l
 group by 1, 2) b)
"""


def weekly_sql(dialect: str) -> str:
    """The weekly panel; dialect is spark or check."""
    if dialect == "spark":
        return WEEKLY
    return WEEKLY.replace("struct(", "row(").replace("datediff(l_shipdate, timestamp '1995-01-01 00:00:00')", "datediff('day', timestamp '1995-01-01 00:00:00', l_shipdate)")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(spark, sf_dir, f"select * from {WEEKLY}", ["lineitem"])


def weekly_by_symbol(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Columns of the weekly panel, in partitions of whole symbols by symbol and date.

    The lines go to their symbols as they are: there are hardly more of them than weeks, and a week's partial sums and extremes are wider than its lines.
    """
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '1995-01-01 00:00:00'")
    held = lines.withColumn("l_suppkey", lines["l_suppkey"].cast("int")).repartition("l_suppkey")
    panel = spark.sql(f"select * from {WEEKLY.replace('from lineitem', 'from {lineitem}')}", lineitem=held)
    return panel.select("symbol", "td", *columns).sortWithinPartitions("symbol", "td")


#: Half-hour bars of event types.
BARS = """
(select symbol, day, slot, min_by(price, struct(ts, event_id)) as open, max(price) as high, min(price) as low, max_by(price, struct(ts, event_id)) as close,
  cast(sum(size) as double) as volume, round(sum(price * size), 2) as amount,
  round(sum(case when buy then price * size else 0 end), 2) as buy_amount, round(sum(case when buy then 0 else price * size end), 2) as sell_amount,
  sum(case when buy then 1e0 else 0e0 end) as buy_count, sum(case when buy then 0e0 else 1e0 end) as sell_count,
  round(sum(case when buy and size >= 7 then price * size else 0 end), 2) as large_buy, round(sum(case when not buy and size >= 7 then price * size else 0 end), 2) as large_sell
 from (select event_type as symbol, cast(cast(ts as date) as string) as day, cast(hour(ts) * 2 + floor(minute(ts) / 30) as int) as slot, ts, event_id, 100 + value as price, 1 + user_id % 10 as size, user_id % 2 = 0 as buy from events) e
 group by symbol, day, slot)
"""


def bars_sql(dialect: str) -> str:
    return BARS if dialect == "spark" else BARS.replace("struct(", "row(")
