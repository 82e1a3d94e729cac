"""Returns: matrices by convention, compound returns ahead, and returns ahead of intraday bars with their grouped evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0)) - 1


def with_returns(bars: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """bars (symbol, td, open, close, vwap, preclose, factor) with c2c, o2o and v2v.

    c2c is close over the quoted previous close; the others compare adjusted prices of the date before,
    and are null where that date has no row. index (td, index_return) is taken off all three.
    """
    order = W.Window.partitionBy("symbol").orderBy("td")
    next_to = F.lag("td").over(order) == F.col("td") - 1
    adjusted = lambda c: F.col(c) * F.col("factor")
    made = {"c2c": _ratio(F.col("close"), F.col("preclose"))}
    made |= {n: F.when(next_to, _ratio(adjusted(c), F.lag(adjusted(c)).over(order))) for n, c in (("o2o", "open"), ("v2v", "vwap"))}
    d = bars.withColumns(made)
    if index is None:
        return d
    d = d.join(index.select("td", "index_return"), "td", "left")
    return d.withColumns({n: F.col(n) - F.col("index_return") for n in made}).drop("index_return")


def compound_ahead(ret: str, periods: int, start_lag: int = 0) -> Column:
    """Compound return of the dates td + start_lag .. td + start_lag + periods - 1; null unless all are there and above -1."""
    frame = W.Window.partitionBy("symbol").orderBy("td").rangeBetween(start_lag, start_lag + periods - 1)
    good = F.when(F.col(ret) > -1, F.log1p(ret))
    return F.when(F.count(good).over(frame) == periods, F.expm1(F.sum(good).over(frame)))


def bar_returns_ahead(bars: DataFrame, horizons: list[int], span: int = 5, close_slot: int | None = None) -> DataFrame:
    """bars (symbol, day, slot, volume, amount, factor) with ret_H for each horizon in bars, and ret_eod.

    The trade price of a bar is the adjusted volume-weighted price of the next `span` bars of the symbol,
    over the ends of days; ret_H compares the trade price H bars later with it. ret_eod compares the
    trade price of the bar at close_slot on the same day with it.
    """
    order = W.Window.partitionBy("symbol").orderBy("day", "slot")
    back = order.rowsBetween(1 - span, 0)
    d = bars.withColumn("_price", F.sum("amount").over(back) / F.nullif(F.sum("volume").over(back), F.lit(0.0)) * F.col("factor"))
    d = d.withColumn("_trade", F.lead("_price", span).over(order))
    made = {f"ret_{h}": _ratio(F.lead("_trade", h).over(order), F.col("_trade")) for h in horizons}
    if close_slot is not None:
        at_close = F.max(F.when(F.col("slot") == close_slot, F.col("_trade"))).over(W.Window.partitionBy("symbol", "day"))
        made["ret_eod"] = _ratio(at_close, F.col("_trade"))
    return d.select("*", *[c.alias(n) for n, c in made.items()]).drop("_price", "_trade")


def slot_groups(signals: DataFrame, n: int, by: list[str]) -> DataFrame:
    """signals (symbol, value, by) with group 0 (lowest) to n - 1 of each time, by floor((rank - 1) * n / count); ties by symbol."""
    w = W.Window.partitionBy(*by)
    d = signals.where("value is not null")
    rank = F.row_number().over(w.orderBy("value", "symbol"))
    return d.withColumn("grp", F.floor((rank - 1) * n / F.count(F.lit(1)).over(w)).cast("int"))


def grouped_bar_returns(signals: DataFrame, returns: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """day, slot, horizon, grp, mean_return: the mean return of each group and time; grp -1 is the highest less the lowest."""
    met = slot_groups(signals, n, ["day", "slot"]).join(returns, ["symbol", "day", "slot"])
    long = met.select("day", "slot", "grp", F.explode(F.array(*[F.struct(F.lit(c).alias("horizon"), F.col(c).alias("r")) for c in columns])).alias("x")).select("day", "slot", "grp", "x.*")
    one = long.groupBy("day", "slot", "horizon", "grp").agg(F.avg("r").alias("mean_return"))
    ends = one.where(F.col("grp").isin(0, n - 1)).groupBy("day", "slot", "horizon").agg(F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("grp") == n - 1, F.col("mean_return"))).alias("h"), F.max(F.when(F.col("grp") == 0, F.col("mean_return"))).alias("l"))
    return one.unionByName(ends.where("k = 2").select("day", "slot", "horizon", F.lit(-1).alias("grp"), (F.col("h") - F.col("l")).alias("mean_return")))


def group_statistics(grouped: DataFrame, year: int = 252) -> DataFrame:
    """slot, horizon, grp with mean, deviation and annual Sharpe ratio over days."""
    sd = F.stddev_samp("mean_return")
    return grouped.groupBy("slot", "horizon", "grp").agg(F.avg("mean_return").alias("mean"), sd.alias("std"), (F.avg("mean_return") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(year)))).alias("sharpe"))


def bar_rank_ic(signals: DataFrame, returns: DataFrame, columns: list[str]) -> DataFrame:
    """day, slot, horizon, ic: Spearman correlation over the symbols that have both."""
    met = signals.join(returns, ["symbol", "day", "slot"])
    long = met.select("day", "slot", "value", F.explode(F.array(*[F.struct(F.lit(c).alias("horizon"), F.col(c).alias("r")) for c in columns])).alias("x")).select("day", "slot", "value", "x.*").where("value is not null and r is not null")
    key = ["day", "slot", "horizon"]
    rank = lambda c: F.rank().over(W.Window.partitionBy(*key).orderBy(c)) + (F.count(c).over(W.Window.partitionBy(*key, c)) - 1) / F.lit(2.0)
    ranked = long.withColumns({"rv": rank("value"), "rr": rank("r")})
    return ranked.groupBy(*key).agg((F.covar_pop("rv", "rr") / F.nullif(F.stddev_pop("rv") * F.stddev_pop("rr"), F.lit(0.0))).alias("ic"))


def ic_summary(ics: DataFrame, by: list[str]) -> DataFrame:
    """by with mean, deviation and their ratio of ic over days."""
    sd = F.stddev_samp("ic")
    return ics.groupBy(*by).agg(F.count("ic").alias("n"), F.avg("ic").alias("ic_mean"), sd.alias("ic_std"), (F.avg("ic") / F.nullif(sd, F.lit(0.0))).alias("ic_ratio"))


def ic_decay(panel: DataFrame, ret: str, horizons: list[int]) -> DataFrame:
    """horizon, dates, ic, ir: mean rank correlation of the signal with the compound return of the next h dates, and its ratio to the deviation (ddof 0), over every h-th date so that none overlap."""
    made = panel.select("symbol", "td", "signal", *[compound_ahead(ret, h, 1).alias(f"_r{h}") for h in horizons])
    long = made.select("td", "signal", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("r")) for h in horizons])).alias("x")).select("td", "signal", "x.*").where("signal is not null and r is not null and td % horizon = 0")
    key = ["td", "horizon"]
    rank = lambda c: F.rank().over(W.Window.partitionBy(*key).orderBy(c)) + (F.count(c).over(W.Window.partitionBy(*key, c)) - 1) / F.lit(2.0)
    ics = long.withColumns({"rv": rank("signal"), "rr": rank("r")}).groupBy(*key).agg((F.covar_pop("rv", "rr") / F.nullif(F.stddev_pop("rv") * F.stddev_pop("rr"), F.lit(0.0))).alias("ic"))
    return ics.groupBy("horizon").agg(F.count("ic").alias("dates"), F.avg("ic").alias("ic"), (F.avg("ic") / F.nullif(F.stddev_pop("ic"), F.lit(0.0))).alias("ir"))
