"""Who trades actively within the day: pressure, concentration by trade size, late strength, timing of ups and downs.

Bars have symbol, td, slot, amount, buy_amount, sell_amount and the columns that a function names. Each family is one
aggregation by symbol and day; what looks over days are windows of numbered dates by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .cross_pass import Pass, crossed

DAY = ["symbol", "td"]


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _dates(w: int, after: int = 0) -> W.WindowSpec:
    return W.Window.partitionBy("symbol").orderBy("td").rangeBetween(1 - w - after, -after)


def bar_pressure() -> Column:
    """(buys - sells) / (buys + sells) of a bar; null without either."""
    return _over(F.col("buy_amount") - F.col("sell_amount"), F.col("buy_amount") + F.col("sell_amount"))


def daily_pressure(bars: DataFrame, session_weight: Column, size_mult: float = 1.5, lookback: int = 20, least_days: int = 10, least_bars: int = 3) -> DataFrame:
    """By symbol and td: pressure (mean of the bars), session_pressure and smart_pressure.

    session_pressure weighs bars by amount and session_weight. smart_pressure keeps bars whose mean buy (avg_buy) is above
    size_mult times its mean over the daily means of the `lookback` days before, of which least_days must be there, and
    weighs them by amount. Each needs least_bars bars.
    """
    d = bars.withColumns({"_p": bar_pressure(), "_w": session_weight * F.col("amount")})
    sizes = d.groupBy(*DAY).agg(F.avg("avg_buy").alias("_day"))
    past = _dates(lookback, 1)
    sizes = sizes.withColumn("_usual", F.when(F.count("_day").over(past) >= least_days, F.avg("_day").over(past)))
    d = d.join(sizes.select(*DAY, "_usual"), DAY)
    there = F.col("_p").isNotNull()
    smart = there & (F.col("avg_buy") > F.col("_usual") * size_mult)
    weighted = lambda w, on: _over(F.sum(F.when(on, w * F.col("_p"))), F.sum(F.when(on, w)))
    enough = lambda on, v: F.when(F.count_if(on) >= least_bars, v)
    return d.groupBy(*DAY).agg(
        enough(there, F.avg("_p")).alias("pressure"),
        enough(there, weighted(F.col("_w"), there)).alias("session_pressure"),
        enough(smart, weighted(F.col("amount"), smart)).alias("smart_pressure"),
        F.count_if(smart).alias("smart_bars"),
    )


def pressure_change(daily: DataFrame, x: str, out: str, lag: int = 5) -> DataFrame:
    """daily with x less x of `lag` dates before."""
    return daily.withColumn(out, F.col(x) - F.max(x).over(_dates(1, lag)))


def size_concentration(bars: DataFrame, share: float = 0.2) -> DataFrame:
    """By symbol and td: the share of active buying in bars whose mean buy is in the day's top share by the interpolated quantile."""
    valid = (F.col("buy_amount") > 0) & (F.col("avg_buy") > 0)
    d = bars.where(valid)
    bound = F.percentile("avg_buy", F.lit(1 - share)).over(W.Window.partitionBy(*DAY))
    d = d.withColumn("_big", F.col("avg_buy") >= bound)
    made = d.groupBy(*DAY).agg((F.sum(F.when(F.col("_big"), F.col("buy_amount")).otherwise(0.0)) / F.sum("buy_amount")).alias("concentration"), F.count_if(F.col("_big")).alias("big_bars"))
    return bars.select(*DAY).distinct().join(made, DAY, "left")


def late_strength(bars: DataFrame, late: Column, stamp: int) -> DataFrame:
    """symbol, td, slot, value: active buying over all active trading in a day's late bars, stamped at a slot of the symbol's next date.

    Only the day before is looked at, so the value may be used from its stamp on.
    """
    late_buys, both = F.sum(F.when(late, F.col("buy_amount"))), F.sum(F.when(late, F.col("buy_amount") + F.col("sell_amount")))
    days = bars.groupBy(*DAY).agg(_over(late_buys, both).alias("value"))
    return stamped(days, "value", stamp)


def stamped(daily: DataFrame, x: str, slot: int, sign: float = 1.0) -> DataFrame:
    """symbol, td, slot, value: a daily panel shifted by one date of its symbol and stamped at a slot of the day."""
    before = F.lag(x).over(W.Window.partitionBy("symbol").orderBy("td"))
    return daily.select("symbol", "td", F.lit(slot).alias("slot"), (before * sign).alias("value"))


def timing_centres(bars: DataFrame, ret: str) -> DataFrame:
    """By symbol and td: the mean slot of rises (up) and of falls (down), weighed by their size."""
    r = F.col(ret)
    rise, fall = F.greatest(r, F.lit(0.0)), F.greatest(-r, F.lit(0.0))
    centre = lambda w: _over(F.sum(F.col("slot") * w), F.sum(w))
    return bars.groupBy(*DAY).agg(centre(rise).alias("up"), centre(fall).alias("down"))


def timing_innovation(centres: DataFrame, controls: list[str], window: int = 20, least: int = 8) -> DataFrame:
    """symbol, td, innovation, timing: what the centre of falls says beyond that of rises.

    Both centres' residuals on the controls, date by date; the residual of the falls' on the rises'; its mean over the last
    `window` dates, all of which must be there.
    """
    first = crossed(centres, Pass(residuals={"_u": ("up", controls), "_d": ("down", controls)}, least=least))
    second = crossed(first, Pass(residuals={"innovation": ("_d", ["_u"])}, least=least))
    w = _dates(window)
    return second.withColumn("timing", F.when(F.count("innovation").over(w) >= window, F.avg("innovation").over(w)))


def session_t(panel: DataFrame, window: int = 20, least: int = 10) -> DataFrame:
    """panel (symbol, td, r_on, r_pm, index_on, index_day) with delta and t.

    delta: the overnight return beyond the index's less the afternoon return beyond the index's day; t: its mean over the
    last `window` dates over the standard error of that mean.
    """
    d = panel.withColumn("delta", (F.col("r_on") - F.col("index_on")) - (F.col("r_pm") - F.col("index_day")))
    w = _dates(window)
    sd, n = F.stddev_samp("delta").over(w), F.count("delta").over(w)
    return d.withColumn("t", F.when((n >= least) & (sd > 1e-12), F.avg("delta").over(w) / (sd / F.sqrt(n))))
