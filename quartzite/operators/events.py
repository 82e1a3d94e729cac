"""Events and disclosures: which record holds on a date, surprises against the past or a consensus, and order lives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def surprise_of_changes(reports: DataFrame, history: int = 8, least: int = 4) -> DataFrame:
    """symbol, period, known, surprise: the change from the same period a year before over the deviation (ddof 1) of the last changes.

    reports: symbol, period (a number of quarters), known, value, one row a period. With fewer than
    `least` changes before, or a deviation near 0, the scale is the absolute value a year before, 1 at least.
    """
    old = reports.select("symbol", (F.col("period") + 4).alias("period"), F.col("value").alias("old"))
    d = reports.join(old, ["symbol", "period"]).withColumn("change", F.col("value") - F.col("old"))
    past = W.Window.partitionBy("symbol").orderBy("known", "period").rowsBetween(-history, -1)
    every = W.Window.partitionBy("symbol").orderBy("known", "period").rowsBetween(W.Window.unboundedPreceding, -1)
    sd = F.when(F.count("change").over(every) >= least, F.stddev_samp("change").over(past))
    scale = F.when(sd >= 1e-6, sd).otherwise(F.greatest(F.abs("old"), F.lit(1.0)))
    return d.select("symbol", "period", "known", (F.col("change") / scale).alias("surprise"))


def latest_before(reports: DataFrame, estimates: DataFrame, by: list[str], known: str, at: str, value: str) -> DataFrame:
    """reports with the value of the last estimate of their key strictly before they were known."""
    from .joins import asof

    key = F.concat_ws("|", *[F.col(c).cast("string") for c in by])
    left = reports.withColumn("_key", key)
    right = estimates.withColumn("_key", key).select("_key", at, value)
    return asof(left, right, "_key", known, at, [value], strict=True, tie=[value]).drop("_key")


def consensus_surprise(reports: DataFrame, estimates: DataFrame) -> DataFrame:
    """Actual less the last consensus before it was known, over the absolute consensus."""
    d = latest_before(reports, estimates, ["symbol", "period"], "known", "at", "estimate")
    return d.where("abs(estimate) >= 1e-6").select("symbol", "period", "known", ((F.col("value") - F.col("estimate")) / F.abs("estimate")).alias("surprise"))


def trailing_year(reports: DataFrame) -> DataFrame:
    """reports with ttm: the sum of four quarters that follow each other; null if one is missing."""
    w = W.Window.partitionBy("symbol").orderBy("period").rangeBetween(-3, 0)
    return reports.withColumn("ttm", F.when(F.count("value").over(w) == 4, F.sum("value").over(w)))


def as_known(panel: DataFrame, reports: DataFrame, at: str, known: str, values: list[str]) -> DataFrame:
    """panel with the values of the symbol's last report known on its date or before; of several known at once the latest period."""
    from .joins import asof

    return asof(panel, reports, "symbol", at, known, values, tie=["period"])


def order_lives(ticks: DataFrame) -> DataFrame:
    """symbol, order_no, side, added, size, cancelled_at, cancelled, cancels: one row for each order that was added.

    ticks: symbol, order_no, side, kind ("A" added, "D" deleted), at, qty. Orders without an addition are left out.
    """
    a, d = F.col("kind") == "A", F.col("kind") == "D"
    lives = ticks.groupBy("symbol", "order_no", "side").agg(
        F.min(F.when(a, F.col("at"))).alias("added"),
        F.min_by(F.when(a, F.col("qty")), F.when(a, F.struct("at", "qty"))).alias("size"),
        F.min(F.when(d, F.col("at"))).alias("cancelled_at"),
        F.sum(F.when(d, F.col("qty"))).alias("cancelled"),
        F.sum(d.cast("long")).alias("cancels"),
    )
    return lives.where("added is not null")


def lifetime_summary(lives: DataFrame) -> DataFrame:
    """By symbol: counts of orders, of cancelled and of partly filled ones, exact quantiles of the seconds from addition to cancellation."""
    age = F.when(F.col("cancels") > 0, F.unix_timestamp("cancelled_at") - F.unix_timestamp("added")).cast("long")
    d = lives.withColumn("age", age)
    rank = F.row_number().over(W.Window.partitionBy("symbol").orderBy(F.col("age").asc_nulls_last(), "order_no"))
    d = d.withColumns({"_rank": rank, "_n": F.count("age").over(W.Window.partitionBy("symbol"))})
    at = lambda p: F.max(F.when(F.col("_rank") == F.least(F.floor(F.col("_n") * p) + 1, F.col("_n")), F.col("age")))
    return d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum((F.col("cancels") > 0).cast("long")).alias("cancelled_orders"),
        F.sum(((F.col("cancels") > 0) & (F.col("cancelled") + 1e-6 < F.col("size"))).cast("long")).alias("partly_filled"),
        at(0.25).alias("age_p25"),
        at(0.5).alias("age_median"),
        at(0.75).alias("age_p75"),
        F.sum(F.coalesce((F.col("age") < 0).cast("long"), F.lit(0))).alias("negative"),
    )


def refill(bars: DataFrame, window: int) -> DataFrame:
    """symbol, day, refill: by how much the buying volume after bars of heavy selling makes up for it.

    A heavy bar sells more than the day's mean; the refill of a day is the sum of buying over the next
    `window` bars over the sum of selling in heavy bars. Bars of the next day don't count.
    """
    order = W.Window.partitionBy("symbol", "day").orderBy("slot")
    d = bars.withColumns({"_next": F.sum("buy_amount").over(order.rowsBetween(1, window)), "_mean": F.avg("sell_amount").over(W.Window.partitionBy("symbol", "day"))})
    heavy = F.col("sell_amount") > F.col("_mean")
    return d.groupBy("symbol", "day").agg((F.sum(F.when(heavy, F.coalesce("_next", F.lit(0.0)))) / F.nullif(F.sum(F.when(heavy, F.col("sell_amount"))), F.lit(0.0))).alias("refill"))


def by_name(made: dict[str, Column], prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{n}") for n, c in made.items()]
