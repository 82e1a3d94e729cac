"""Bins, masks and selections by rank within a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .evaluation import average_rank, day


def top_first_groups(signal: Column, n: int) -> Column:
    """Group 1 (highest) to n by descending rank; ties by symbol."""
    rank = F.row_number().over(day().orderBy(signal.desc_nulls_last(), "symbol"))
    m = F.count(signal).over(day())
    return F.when(signal.isNotNull(), F.when(m == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(((rank - 1) * n + m - 2) / (m - 1)))).cast("int"))


def tied_groups(signal: Column, n: int) -> Column:
    """Group 1 (lowest) to n by average rank, so that equal values share a group whatever their symbols."""
    pct = average_rank(signal) / F.count(signal).over(day())
    return F.when(signal.isNotNull(), F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(pct * n - 1e-9))).cast("int"))


def fraction_mask(signal: Column, share: float, top: bool = True, ties: str = "first", closed: bool = True) -> Column:
    """1 in the top (or bottom) share of a date by percentile rank, else 0; null where the signal is.

    ties: "first" (by symbol) or "average". closed: whether the bound belongs to it.
    """
    n = F.count(signal).over(day())
    rank = F.row_number().over(day().orderBy(signal.asc_nulls_last(), "symbol")) if ties == "first" else average_rank(signal)
    pct = rank / n
    if top:
        hit = pct >= 1 - share if closed else pct > 1 - share
    else:
        hit = pct <= share if closed else pct < share
    return F.when(signal.isNotNull(), hit.cast("int"))


def extremes(panel: DataFrame, value: str, k: int) -> DataFrame:
    """symbol, td, value, side: the k highest ("top") and k lowest ("bottom") of each date; ties by symbol. A name may be both on short dates."""
    d = panel.where(F.col(value).isNotNull()).select("symbol", "td", F.col(value).alias("value"))
    up, down = F.row_number().over(day().orderBy(F.desc("value"), "symbol")), F.row_number().over(day().orderBy("value", "symbol"))
    d = d.withColumns({"_u": up, "_d": down})
    sides = F.array_compact(F.array(F.when(F.col("_u") <= k, F.lit("top")), F.when(F.col("_d") <= k, F.lit("bottom"))))
    return d.select("symbol", "td", "value", F.explode(sides).alias("side"))


def until_volume(bars: DataFrame, score: str, volume: str, by: list[str], share: float) -> DataFrame:
    """The bars of each group from the highest score on until their volume reaches the share of the group's; the bar that crosses it is in."""
    w = W.Window.partitionBy(*by)
    order = w.orderBy(F.desc(score), F.desc(volume), *[c for c in ("day", "slot") if c in bars.columns]).rowsBetween(W.Window.unboundedPreceding, -1)
    d = bars.where(F.col(score).isNotNull() & (F.col(volume) > 0))
    d = d.withColumns({"_before": F.coalesce(F.sum(volume).over(order), F.lit(0.0)), "_all": F.sum(volume).over(w)})
    return d.where(F.col("_before") < F.col("_all") * share).drop("_before", "_all")


def sampled_dates(panel: DataFrame, stride: int) -> DataFrame:
    """Every stride-th date of the calendar."""
    return panel.where(F.col("td") % stride == 0)


def sampled_symbols(panel: DataFrame, count: int, seed: str) -> DataFrame:
    """The rows of the `count` symbols that come first by the hash of seed and symbol."""
    turn = F.sha2(F.concat(F.lit(seed), F.col("symbol").cast("string")), 256)
    chosen = panel.select("symbol").distinct().orderBy(turn, "symbol").limit(count)
    return panel.join(chosen, "symbol", "left_semi")


def set_agreement(chosen: DataFrame, of: str, item: str) -> DataFrame:
    """a, b, jaccard for each pair of sets (rows of: item), and how many items they share."""
    d = chosen.select(F.col(of).alias("set"), F.col(item).alias("item")).distinct()
    size = d.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    both = d.alias("x").join(d.alias("y"), "item").where("x.set < y.set").groupBy(F.col("x.set").alias("a"), F.col("y.set").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    j = both.join(size.select(F.col("set").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("set").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))
