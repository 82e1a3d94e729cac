"""Cancelled orders by symbol and day, from order, trade and cancel messages.

Messages have symbol, day, at, seq, kind (order, cancel or trade), order_no, side (1 buys, -1 sells), price and
volume. A cancel is valued at its order's price; one whose order has no price (a market order) at the last
trade of its symbol and day before it. Only cancels and trades within `window` count; orders count whenever placed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof


def cancelled_orders(messages: DataFrame, window: Column) -> DataFrame:
    """One row per cancelled order: symbol, day, order_no, side, price (0: none), known (its order was seen), volume, events, first_at."""
    order, cancel = F.col("kind") == "order", (F.col("kind") == "cancel") & window
    d = messages.where(order | cancel).groupBy("symbol", "day", "order_no").agg(
        F.coalesce(F.max(F.when(order, F.col("price"))), F.lit(0.0)).alias("price"),
        (F.count_if(order) > 0).alias("known"),
        F.coalesce(F.sum(F.when(cancel, F.col("volume"))), F.lit(0.0)).alias("volume"),
        F.count_if(cancel).alias("events"),
        F.min(F.when(cancel, F.col("at"))).alias("first_at"),
        F.max(F.when(cancel, F.col("side"))).alias("side"),
    )
    return d.where("events > 0")


def priced(cancelled: DataFrame, messages: DataFrame, window: Column) -> DataFrame:
    """cancelled with value: volume at the order's price, or at the last trade before it; filled tells which orders got a trade's price."""
    trades = messages.where((F.col("kind") == "trade") & window & (F.col("price") > 0)).select(F.struct("symbol", "day").alias("_key"), F.col("at").alias("_traded"), "seq", F.col("price").alias("fill"))
    market = asof(cancelled.where("price = 0").withColumn("_key", F.struct("symbol", "day")), trades, "_key", "first_at", "_traded", ["fill"], tie=["seq"]).drop("_key")
    limit = cancelled.where("price > 0").withColumn("fill", F.lit(None).cast("double"))
    both = limit.unionByName(market)
    return both.withColumns({"value": F.col("volume") * F.when(F.col("price") > 0, F.col("price")).otherwise(F.coalesce("fill", F.lit(0.0))), "filled": F.col("fill").isNotNull()})


def by_symbol_day(messages: DataFrame, window: Column, shock: float = 2.0) -> DataFrame:
    """By symbol and day: value, volume, events and orders cancelled on each side, trade totals, and how the values were found.

    Ratios: intensity (cancelled over traded value) of each side and their imbalance. coverage: share of events whose order is known.
    failures: orders without a known order or price. shock: whether the day's cancelled value is above `shock` times its
    mean over the symbol's 20 days before.
    """
    from pyspark.sql import window as W

    c = priced(cancelled_orders(messages, window), messages, window)
    on = lambda s, v: F.coalesce(F.sum(F.when(F.col("side") == s, v)), F.lit(0.0))
    sides = [m for name, s in (("buy", 1), ("sell", -1)) for m in (on(s, F.col("value")).alias(f"{name}_value"), on(s, F.col("volume")).alias(f"{name}_volume"), on(s, F.col("events")).cast("long").alias(f"{name}_events"), F.count_if(F.col("side") == s).alias(f"{name}_orders"))]
    made = c.groupBy("symbol", "day").agg(
        *sides,
        F.sum("events").alias("events"),
        (F.sum(F.when(F.col("known"), F.col("events")).otherwise(0)) / F.sum("events")).alias("coverage"),
        F.sum(F.when(F.col("price") == 0, F.col("events")).otherwise(0)).alias("unpriced_events"),
        F.count_if(F.col("filled")).alias("filled_orders"),
        (F.count_if(~F.col("known")) + F.count_if((F.col("price") == 0) & ~F.col("filled"))).alias("failures"),
    )
    t = messages.where((F.col("kind") == "trade") & window).groupBy("symbol", "day").agg(F.sum(F.col("price") * F.col("volume")).alias("trade_value"), F.sum("volume").alias("trade_volume"), F.count(F.lit(1)).alias("trades"))
    d = made.join(t, ["symbol", "day"], "left").fillna(0, ["trade_value", "trade_volume", "trades"])
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    past = W.Window.partitionBy("symbol").orderBy("day").rowsBetween(-20, -1)
    both = F.col("buy_value") + F.col("sell_value")
    d = d.withColumns({"buy_intensity": over(F.col("buy_value"), F.col("trade_value")), "sell_intensity": over(F.col("sell_value"), F.col("trade_value")), "imbalance": over(F.col("buy_value") - F.col("sell_value"), both)})
    return d.withColumn("shock", F.coalesce(both > shock * F.avg(both).over(past), F.lit(False)))
