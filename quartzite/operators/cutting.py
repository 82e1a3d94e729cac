"""Cuts: an object is split by a knife, each part is aggregated, and the parts are contrasted.

Windows of dates hold at most `window` values a symbol, gathered as one bounded array a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _ordered(obj: str, knife: str, window: int) -> Column:
    """The window's objects in order of the knife, ties in order of dates; nulls of either left out."""
    frame = W.Window.partitionBy("symbol").orderBy("td").rangeBetween(1 - window, 0)
    both = F.when(F.col(obj).isNotNull() & F.col(knife).isNotNull(), F.struct(F.col(knife).alias("k"), F.col("td"), F.col(obj).alias("o")))
    return F.transform(F.array_sort(F.collect_list(both).over(frame)), lambda x: x["o"])


def _folded(a: Column, how: str) -> Column:
    if how == "compound":
        return F.aggregate(a, F.lit(1.0), lambda s, x: s * (1 + x)) - 1
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return total if how == "sum" else total / F.size(a)


def rank_split(df: DataFrame, obj: str, knife: str, window: int, high: int, low: int, how: str = "sum", full: bool = True) -> DataFrame:
    """df with high_leg, low_leg and cut: object over the `high` dates of highest knife, over the `low` of lowest, and their difference.

    how: sum, mean or compound. full: every date of the window must have both; otherwise high + low must.
    """
    d = df.withColumn("_o", _ordered(obj, knife, window))
    n = F.size("_o")
    d = d.withColumn("_ok", (n >= (window if full else high + low)) & (n >= high + low))
    hi = F.when(F.col("_ok"), _folded(F.slice("_o", F.greatest(n - high + 1, F.lit(1)), F.lit(high)), how))
    lo = F.when(F.col("_ok"), _folded(F.slice("_o", F.lit(1), F.lit(low)), how))
    return d.withColumns({"high_leg": hi, "low_leg": lo}).withColumn("cut", F.col("high_leg") - F.col("low_leg")).drop("_o", "_ok")


def quantile_split(df: DataFrame, obj: str, knife: str, window: int, share: float, least: int) -> DataFrame:
    """df with high_leg, low_leg and cut: means over the dates in the top and bottom share of the knife, at least one each and never more than half."""
    d = df.withColumn("_o", _ordered(obj, knife, window))
    n = F.size("_o")
    k = F.greatest(F.lit(1), F.floor(n * share))
    d = d.withColumn("_k", F.when(2 * k > n, F.greatest(F.lit(1), F.floor(n / 2))).otherwise(k).cast("int"))
    ok = n >= least
    hi = F.when(ok, _folded(F.slice("_o", F.greatest(n - F.col("_k") + 1, F.lit(1)), F.col("_k")), "mean"))
    lo = F.when(ok, _folded(F.slice("_o", F.lit(1), F.col("_k")), "mean"))
    return d.withColumns({"high_leg": hi, "low_leg": lo}).withColumn("cut", F.col("high_leg") - F.col("low_leg")).drop("_o", "_k")


#: Knives by name, over the columns of a bar.
KNIVES = {
    "ats_trade_count": lambda: F.col("amount") / F.nullif(F.col("trades"), F.lit(0.0)),
    "ats_volume": lambda: F.col("amount") / F.nullif(F.col("volume"), F.lit(0.0)),
    "amount": lambda: F.col("amount"),
    "volume": lambda: F.col("volume"),
    "trade_count": lambda: F.col("trades"),
    "turnover": lambda: F.col("turnover"),
    "amihud": lambda: F.abs("ret") / F.nullif(F.col("amount"), F.lit(0.0)),
    "abs_return": lambda: F.abs("ret"),
}


def knife_table(df: DataFrame, knife: str, ahead: str, n: int) -> DataFrame:
    """bin, rows, mean of `ahead` over n bins of the knife within each date."""
    w = W.Window.partitionBy("td")
    d = df.where(F.col(knife).isNotNull() & F.col(ahead).isNotNull())
    bin_ = F.floor((F.row_number().over(w.orderBy(knife, "symbol")) - 1) * n / F.count(F.lit(1)).over(w)).cast("int") + 1
    return d.select(bin_.alias("bin"), F.col(ahead).alias("r")).groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.avg("r").alias("mean"))


# Masks within a day, aggregates and contrasts ------------------------------------------------------


def within(x: str, by: list[str]) -> tuple[Column, W.WindowSpec]:
    return F.col(x), W.Window.partitionBy(*by)


def high_state(x: str, by: list[str], high: bool = True) -> Column:
    """Whether x is above (or at most) its median of the day; false where x is null."""
    v, w = within(x, by)
    m = F.percentile(v, F.lit(0.5)).over(w)
    return F.coalesce(v > m if high else v <= m, F.lit(False))


def top_event(x: str, by: list[str], q: float = 0.2, top: bool = True) -> Column:
    """Whether x is in the day's top (or bottom) share by the interpolated quantile."""
    v, w = within(x, by)
    bound = F.percentile(v, F.lit(1 - q if top else q)).over(w)
    return F.coalesce(v >= bound if top else v <= bound, F.lit(False))


def extreme_event(x: str, by: list[str], most: float = 2.0) -> Column:
    """Whether |x - mean| is beyond `most` deviations (ddof 1) of a day with three values at least."""
    v, w = within(x, by)
    sd = F.stddev_samp(v).over(w)
    return F.coalesce((F.count(v).over(w) >= 3) & (sd > 1e-12) & (F.abs(v - F.avg(v).over(w)) > most * sd), F.lit(False))


def aggregates(x: str, slot: str, mask: Column) -> dict[str, Column]:
    """Aggregates of x over the rows where mask holds, by name; slot numbers the rows of a day."""
    v = F.when(mask, F.col(x))
    t = F.when(v.isNotNull(), F.col(slot).cast("double"))
    total = F.sum(F.abs(v))
    centre = F.sum(t * F.abs(v)) / F.nullif(total, F.lit(0.0))
    spread = F.sum(t * t * F.abs(v)) / F.nullif(total, F.lit(0.0)) - centre * centre
    varies = F.var_pop(t)
    return {
        "mean": F.avg(v),
        "sum": F.sum(v),
        "std": F.stddev_samp(v),
        "median": F.percentile(v, F.lit(0.5)),
        "last": F.max_by(v, t),
        "max": F.max(v),
        "min": F.min(v),
        "slope": (F.avg(t * v) - F.avg(t) * F.avg(v)) / F.when(varies > 1e-9, varies),
        "event_share": F.sum(F.when(mask, 1.0).otherwise(0.0)) / F.count(F.lit(1)),
        "centre": centre,
        "dispersion": F.when(spread > 1e-9 * (1 + centre * centre), F.sqrt(spread)).otherwise(F.when(spread.isNotNull(), 0.0)),  # below that it is rounding
    }


def contrasts(a: str, b: str, near: float = 1e-12) -> dict[str, Column]:
    """Contrasts of two aggregates by name; null where either is, or a denominator vanishes."""
    x, y = F.col(a), F.col(b)
    return {
        "diff": x - y,
        "ratio": F.when(F.abs(y) > near, x / (F.abs(y) + near)),
        "normalised_diff": F.when(F.abs(x) + F.abs(y) > near, (x - y) / (F.abs(x) + F.abs(y) + near)),
        "acceleration": y - x,
        "reversal": F.when(x != 0, -F.signum(x) * y),
    }


def relative_to_median(x: str, by: list[str]) -> Column:
    """x over the absolute median of its group."""
    m = F.abs(F.percentile(F.col(x), F.lit(0.5)).over(W.Window.partitionBy(*by)))
    return F.col(x) / F.when(m > 1e-12, m)


def smart_money(bars: DataFrame, days: int, share: float, least: int) -> DataFrame:
    """symbol, td, q: price of the smart bars over that of all, pooled over the last `days` numbered days.

    bars: symbol, td, slot, close, volume, amount. A bar's score is |return| / sqrt(volume); the pool's
    bars come by descending score until their volume reaches the share (the bar that crosses it is in).
    A pool needs `least` bars. Each bar goes to the `days` pools that it is in, so no window is unbounded.
    """
    order = W.Window.partitionBy("symbol", "td").orderBy("slot")
    d = bars.withColumn("_r", F.col("close") / F.nullif(F.lag("close").over(order), F.lit(0.0)) - 1)
    d = d.where("volume > 0 and amount > 0").withColumn("_score", F.abs("_r") / F.sqrt("volume")).where("_score is not null")
    pools = bars.select("symbol", F.col("td").alias("pool")).distinct()
    d = d.withColumn("pool", F.explode(F.sequence(F.col("td"), F.col("td") + days - 1))).join(pools, ["symbol", "pool"], "left_semi")
    pool = W.Window.partitionBy("symbol", "pool")
    before = F.sum("volume").over(pool.orderBy(F.desc("_score"), F.desc("volume"), "td", "slot").rowsBetween(W.Window.unboundedPreceding, -1))
    d = d.withColumn("_in", F.coalesce(before, F.lit(0.0)) < F.sum("volume").over(pool) * share)
    v, a = F.sum(F.when(F.col("_in"), F.col("volume"))), F.sum(F.when(F.col("_in"), F.col("amount")))
    q = (a / v) / (F.sum("amount") / F.sum("volume"))
    return d.groupBy("symbol", F.col("pool").alias("td")).agg(F.when(F.count(F.lit(1)) >= least, q).alias("q"))
