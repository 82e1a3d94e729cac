"""Groups, portfolios and their evaluation, on (symbol, td, signal, forward return) panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

def day() -> W.WindowSpec:
    return W.Window.partitionBy("td")


def groups(signal: Column, n: int) -> Column:
    """Group 1 (lowest) to n by rank among the present values of a date; ties by symbol."""
    rank = F.row_number().over(day().orderBy(signal.asc_nulls_last(), "symbol"))
    m = F.count(signal).over(day())
    return F.when(signal.isNotNull(), F.when(m == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(((rank - 1) * n + m - 2) / (m - 1)))).cast("int"))


def group_weights(panel: DataFrame, n: int) -> DataFrame:
    """symbol, td, grp, weight: equal weights within the groups of a date."""
    g = panel.where("signal is not null").withColumn("grp", groups(F.col("signal"), n))
    return g.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(W.Window.partitionBy("td", "grp")))


def group_test(panel: DataFrame, n: int, fee: float, turning_fee: bool = True) -> DataFrame:
    """Return, L1 turnover and net return of each group and date, and of the spread (group 0): top less bottom.

    A missing return counts 0. Turnover is the sum of absolute changes of weights from the date
    before; names that leave count on the date after their last. With turning_fee, the fee is added
    instead of taken off in a group whose returns sum to 0 or less, so that a group to be sold short
    is charged too. A group has a row on the dates of the panel on which it has names or names
    leave it. The spread is that of the net returns, its turnover the sum of both.
    """
    own = W.Window.partitionBy("symbol").orderBy("td")
    w = group_weights(panel, n).select("symbol", "td", "grp", "weight", "fwd")
    w = w.select("*", *[f("td").over(own).alias(f"{k}_td") for k, f in (("last", F.lag), ("next", F.lead))], *[f("grp").over(own).alias(f"{k}_grp") for k, f in (("last", F.lag), ("next", F.lead))], F.lag("weight").over(own).alias("old"))
    stays = F.coalesce((F.col("last_td") == F.col("td") - 1) & (F.col("last_grp") == F.col("grp")), F.lit(False))
    leaves = ~F.coalesce((F.col("next_td") == F.col("td") + 1) & (F.col("next_grp") == F.col("grp")), F.lit(False))
    here = F.struct(F.col("td"), F.lit(1).alias("names"), (F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("gross"), F.when(stays, F.abs(F.col("weight") - F.col("old"))).otherwise(F.col("weight")).alias("turnover"))
    after = F.struct((F.col("td") + 1).alias("td"), F.lit(0).alias("names"), F.lit(0.0).alias("gross"), F.col("weight").alias("turnover"))
    moves = w.select("grp", F.explode(F.when(leaves, F.array(here, after)).otherwise(F.array(here))).alias("m")).select("grp", "m.*")
    one = moves.groupBy("td", "grp").agg(*[F.sum(c).alias(c) for c in ("names", "gross", "turnover")])
    one = one.join(panel.select("td").distinct(), "td", "left_semi")
    sign = F.when(F.sum("gross").over(W.Window.partitionBy("grp")) > 0, 1.0).otherwise(-1.0 if turning_fee else 1.0)
    one = one.withColumn("net", F.col("gross") - F.lit(fee) * F.col("turnover") * sign)
    side = lambda c: F.sum(F.when(F.col("grp") == n, F.col(c)).otherwise(-F.col(c)))
    # Each row is its group's, and those of the two ends count in the spread too.
    both = one.withColumn("to", F.explode(F.when(F.col("grp").isin(1, n), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    made = both.groupBy("td", F.when(F.col("to"), 0).otherwise(F.col("grp")).alias("grp_")).agg(
        F.sum("names").alias("names"),
        F.when(F.col("grp_") == 0, side("gross")).otherwise(F.sum("gross")).alias("gross"),
        F.sum("turnover").alias("turnover"),
        F.when(F.col("grp_") == 0, side("net")).otherwise(F.sum("net")).alias("net"),
        F.count(F.lit(1)).alias("k"),
    )
    return made.where("grp_ > 0 or k = 2").select("td", F.col("grp_").alias("grp"), "names", "gross", "turnover", "net")


def average_rank(x: Column, by: str = "td") -> Column:
    """Ranks with ties averaged, among the rows of `by`; nulls come last."""
    return F.rank().over(W.Window.partitionBy(by).orderBy(x.asc_nulls_last())) + (F.count(x).over(W.Window.partitionBy(by, x)) - 1) / F.lit(2.0)


def rank_ic(panel: DataFrame) -> DataFrame:
    """Spearman correlation of signal and forward return by date, over rows that have both."""
    both = panel.where("signal is not null and fwd is not null")
    ranked = both.withColumn("rs", average_rank(F.col("signal"))).withColumn("rf", average_rank(F.col("fwd")))
    return ranked.groupBy("td").agg(F.corr("rs", "rf").alias("ic"), F.count(F.lit(1)).alias("names"))


def performance(returns: DataFrame, by: str, value: str, year: int = 250) -> DataFrame:
    """Mean, Sharpe ratio, largest drawdown with its dates, and hit rate of series of returns.

    Wealth begins at 1, which is the first peak; peak_td is null where that is the peak. A return of
    -1 or less is a total loss: wealth is 0 from that date on and the drawdown 1.
    """
    order = W.Window.partitionBy(by).orderBy("td").rowsBetween(W.Window.unboundedPreceding, 0)
    lost = F.max((F.col(value) <= -1).cast("int")).over(order) == 1
    curve = returns.where(F.col(value).isNotNull()).withColumn("wealth", F.when(lost, 0.0).otherwise(F.exp(F.sum(F.when(F.col(value) > -1, F.log1p(F.col(value)))).over(order))))
    curve = curve.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(order)))
    curve = curve.withColumn("_top", F.last(F.when(F.col("wealth") == F.col("peak"), F.col("td")), ignorenulls=True).over(order))
    curve = curve.withColumn("_fall", 1 - F.col("wealth") / F.col("peak"))
    return curve.groupBy(by).agg(
        F.max_by("_top", F.struct("_fall", -F.col("td"))).alias("peak_td"),
        F.max_by("td", F.struct("_fall", -F.col("td"))).alias("trough_td"),
        F.count(value).alias("days"),
        (F.avg(value) * year).alias("annual_return"),
        (F.avg(value) / F.nullif(F.stddev_samp(value), F.lit(0.0)) * F.sqrt(F.lit(float(year)))).alias("sharpe"),
        F.max("_fall").alias("max_drawdown"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )


def rebalanced(panel: DataFrame, every: int) -> DataFrame:
    """The signal of the last date that is a multiple of `every`, carried to the dates after it."""
    held = panel.where(F.col("td") % every == 0).select("symbol", F.col("td").alias("_formed"), F.col("signal").alias("_held"))
    d = panel.withColumn("_formed", F.col("td") - F.col("td") % every)
    return d.join(held, ["symbol", "_formed"], "left").withColumn("signal", F.col("_held")).drop("_held", "_formed")


def fridays(panel: DataFrame, date: str) -> DataFrame:
    """The signal of the last Friday, or before the first of them that of the first date, carried to the dates after it.

    A symbol without a row on the date of formation has a null signal.
    """
    days = panel.select("td", F.col(date).alias("_date")).distinct()
    order = W.Window.partitionBy(F.lit(0)).orderBy("td").rowsBetween(W.Window.unboundedPreceding, 0)  # the calendar: a row a date
    formed = F.last(F.when((F.weekday("_date") == 4) | (F.row_number().over(order.rowsBetween(W.Window.unboundedPreceding, 0)) == 1), F.col("td")), ignorenulls=True).over(order)
    held = panel.select("symbol", F.col("td").alias("_formed"), F.col("signal").alias("_held"))
    d = panel.join(days.select("td", formed.alias("_formed")), "td")
    return d.join(held, ["symbol", "_formed"], "left").withColumn("signal", F.col("_held")).drop("_held", "_formed")


def hysteresis(panel: DataFrame, enter: float = 0.1, leave: float = 0.2) -> DataFrame:
    """symbol, td, pct, long, short: membership that begins in the outer share `enter` of the ranks and lasts within `leave`.

    A date without a rank, or without a row, ends it.
    """
    if not 0 < enter < leave <= 0.5:
        raise ValueError("0 < enter < leave <= 0.5 is needed")
    pct = F.when(F.col("signal").isNotNull(), average_rank(F.col("signal")) / F.count("signal").over(day()))
    d = panel.select("symbol", "td", "signal").withColumn("pct", pct)
    rows = W.Window.partitionBy("symbol").orderBy("td")
    d = d.withColumn("_new", F.when(F.lag("td").over(rows) == F.col("td") - 1, 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(rows.rowsBetween(W.Window.unboundedPreceding, 0)))
    run = W.Window.partitionBy("symbol", "_run").orderBy("td").rowsBetween(W.Window.unboundedPreceding, 0)

    def member(begins: Column, ends: Column) -> Column:
        state = F.when(begins, 1).when(F.col("pct").isNull() | ends, 0)
        return F.coalesce(F.last(state, ignorenulls=True).over(run), F.lit(0))

    p = F.col("pct")
    d = d.withColumns({"long": member(p >= 1 - enter, p < 1 - leave), "short": member(p <= enter, p > leave)})
    return d.select("symbol", "td", "pct", "long", "short")


def minimum_holding(membership: DataFrame, days: int) -> DataFrame:
    """long and short membership kept for `days` rows of the symbol at least once begun, long before short: a counter a symbol."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("td")
        held, out = [0, 0], []
        for wants in zip(pdf["long"].to_numpy() > 0, pdf["short"].to_numpy() > 0, strict=True):
            is_long = wants[0] or 0 < held[0] < days
            is_short = (wants[1] or 0 < held[1] < days) and not is_long
            held = [held[0] + 1 if is_long else 0, held[1] + 1 if is_short else 0]
            out.append(held)
        made = np.array(out, np.int64).reshape(-1, 2)
        return pdf[["symbol", "td"]].assign(held_long=made[:, 0], held_short=made[:, 1])

    return membership.select("symbol", "td", "long", "short").groupBy("symbol").applyInPandas(run, "symbol int, td int, held_long long, held_short long")


def book_weights(panel: DataFrame, method: str) -> DataFrame:
    """symbol, td, w_long, w_short from rows (symbol, td, signal, long, short): equal ("ew"), by rank ("rank") or by z-score ("zscore"), of sum 1 a book."""
    pct = average_rank(F.col("signal")) / F.count("signal").over(day())
    z = (F.col("signal") - F.avg("signal").over(day())) / F.nullif(F.stddev_samp("signal").over(day()), F.lit(0.0))
    high, low = {"ew": (F.lit(1.0), F.lit(1.0)), "rank": (pct, 1 - pct), "zscore": (F.greatest(z, F.lit(0.0)), F.greatest(-z, F.lit(0.0)))}[method]
    d = panel.where("signal is not null").select("symbol", "td", F.when(F.col("long") == 1, high).alias("l"), F.when(F.col("short") == 1, low).alias("s"))
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(day()), F.lit(0.0)), F.lit(0.0))
    return d.select("symbol", "td", share("l").alias("w_long"), share("s").alias("w_short"))


def drifted(weights: DataFrame) -> DataFrame:
    """Weights (symbol, td, block, w0, ret) drifting with returns within a block between rebalances: w0 * growth / their sum."""
    order = W.Window.partitionBy("symbol", "block").orderBy("td").rowsBetween(W.Window.unboundedPreceding, -1)
    grown = weights.withColumn("value", F.col("w0") * F.exp(F.coalesce(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(order), F.lit(0.0))))
    return grown.withColumn("weight", F.col("value") / F.sum("value").over(day()))


def overlapped(weights: DataFrame, hold: int) -> DataFrame:
    """The mean of the last `hold` formations' weights (0 where a symbol was out)."""
    out = weights.withColumn("td", F.explode(F.sequence(F.col("td"), F.col("td") + hold - 1)))
    return out.groupBy("symbol", "td").agg((F.sum("weight") / hold).alias("weight"))


def newey_west(series: DataFrame, by: str, value: str, lags: int) -> DataFrame:
    """Mean of a series by key with its t-value under Bartlett-weighted autocovariances."""
    order = W.Window.partitionBy(by).orderBy("td")
    d = series.where(F.col(value).isNotNull()).withColumn("_dev", F.col(value) - F.avg(value).over(W.Window.partitionBy(by)))
    for k in range(1, lags + 1):
        d = d.withColumn(f"_lag{k}", F.lag("_dev", k).over(order))
    n = F.count(F.lit(1))
    var = F.sum(F.col("_dev") * F.col("_dev"))
    for k in range(1, lags + 1):
        var = var + F.lit(2 * (1 - k / (lags + 1))) * F.coalesce(F.sum(F.col("_dev") * F.col(f"_lag{k}")), F.lit(0.0))
    return d.groupBy(by).agg(n.alias("days"), F.avg(value).alias("mean"), (F.avg(value) / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))) / n, F.lit(0.0))).alias("t_value"))


def pca_scores(panel: DataFrame, columns: list[str], count: int) -> DataFrame:
    """Scores of each date's first components of the standardised columns; the sign makes the largest loading positive."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        x = pdf[columns].to_numpy(float)
        sd = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
        _, vectors = np.linalg.eigh(z.T @ z / max(len(z), 1))
        v = vectors[:, ::-1][:, :count]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        out = pdf[["symbol", "td"]].copy()
        for k in range(count):
            out[f"pc{k + 1}"] = z @ v[:, k]
        return out

    clean = panel.select("symbol", "td", *columns).dropna()
    return clean.groupBy("td").applyInPandas(one, "symbol int, td int, " + ", ".join(f"pc{k + 1} double" for k in range(count)))
