"""Share of a day's traded amount in bands of trade size, the bands scaled by the symbol's own past.

Four kinds of bands, all open below and closed above: fixed amounts (A0), basis points of the lagged
mean daily amount (A1), multiples of the lagged median trade (A2), and the same day's own quantiles (A3).
Scales look at the `window` calendar days before the day, all of which must have trades.
Trades are symbol, td (number of the calendar's day) and amount. Null, NaN and zero amounts are no
trades; negative and infinite ones raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Lower and upper ends of the bands: basis points of the mean daily amount, multiples of the median trade (fixed values).
ADV_LOWER, ADV_UPPER = (0.5, 1.0, 2.0), (5.0, 10.0, 20.0)
ATS_LOWER, ATS_UPPER = (0.25, 0.5, 0.75), (1.5, 2.0, 3.0)
FIXED = (40_000.0, 200_000.0)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bins: int = 16) -> DataFrame:
    """One row per key with the interpolated quantiles of positive values, by refining counts.

    Values are counted in `bins` bins an octave; the bins that hold a quantile's two ranks are counted
    by value. Both counts combine within tasks, so neither a key nor a value that a large part
    of the rows have is gathered anywhere, and no rows are sorted.
    """
    bin_of = F.floor(F.log2(value) * bins).alias("_bin")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, bin_of).agg(F.count(F.lit(1)).alias("_n"))
    by_bin = W.Window.partitionBy(*keys).orderBy("_bin")
    counts = counts.withColumns({"_upto": F.sum("_n").over(by_bin.rowsBetween(W.Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(W.Window.partitionBy(*keys))})
    counts = counts.withColumn("_base", F.col("_upto") - F.col("_n"))
    low = lambda p: F.floor(F.lit(p) * (F.col("_all") - 1))
    high = lambda p: F.least(low(p) + 1, F.col("_all") - 1)
    needed = None
    for p in probs.values():
        here = ((low(p) >= F.col("_base")) & (low(p) < F.col("_upto"))) | ((high(p) >= F.col("_base")) & (high(p) < F.col("_upto")))
        needed = here if needed is None else needed | here
    some = counts.where(needed).select(*keys, "_bin", "_base", "_all")
    inside = df.where(F.col(value).isNotNull()).withColumn("_bin", F.floor(F.log2(value) * bins)).join(some, [*keys, "_bin"])
    values = inside.groupBy(*keys, "_bin", "_base", "_all", F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    values = values.withColumn("_upto", F.col("_base") + F.sum("_n").over(W.Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.Window.unboundedPreceding, 0)))
    at = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), F.col("_v")))
    made = values.groupBy(*keys).agg(F.max("_all").alias("_all"), *[c for name, p in probs.items() for c in (at(low(p)).alias(f"_{name}_low"), at(high(p)).alias(f"_{name}_high"))])
    part = lambda p: F.lit(p) * (F.col("_all") - 1) - low(p)
    return made.select(*keys, *[(F.col(f"_{n}_low") + part(p) * (F.col(f"_{n}_high") - F.col(f"_{n}_low"))).alias(n) for n, p in probs.items()])


def checked(trades: DataFrame) -> DataFrame:
    """trades with amounts that are positive; an amount that is negative or infinite raises."""
    a = F.col("amount").cast("double")
    wrong = (a < 0) | (a == float("inf"))
    kept = F.when(wrong, F.raise_error(F.lit("a trade's amount is negative or infinite")).cast("double")).when((a > 0) & ~F.isnan(a), a)
    return trades.withColumn("amount", kept).where("amount is not null")


def daily_scales(trades: DataFrame, window: int = 20) -> DataFrame:
    """By symbol and td: total, count, q20, median and q80 of the trades, and the scales of the window before.

    adv, adv_median: mean and median of the daily totals; ats: median of the daily medians; history: days of the window with trades; latest: the last of them.
    """
    day = ["symbol", "td"]
    totals = trades.groupBy(*day).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("trades"))
    d = totals.join(exact_quantiles(trades, day, "amount", {"q20": 0.2, "median": 0.5, "q80": 0.8}), day)
    past = W.Window.partitionBy("symbol").orderBy("td").rangeBetween(-window, -1)
    history = F.count("total").over(past)
    held = lambda c: F.array_sort(F.collect_list(c).over(past))  # noqa: E731  `window` values at most
    middle = lambda a: (F.get(a, F.lit((window - 1) // 2)) + F.get(a, F.lit(window // 2))) / 2
    full = lambda c: F.when(history == window, c)
    return d.withColumns({"adv": full(F.avg("total").over(past)), "adv_median": full(middle(held("total"))), "ats": full(middle(held("median"))), "history": history, "latest": F.max("td").over(past)})


def bands(adv_lower=ADV_LOWER, adv_upper=ADV_UPPER, ats_lower=ATS_LOWER, ats_upper=ATS_UPPER, fixed=FIXED) -> dict[str, tuple[Column, Column]]:
    """Names of the bands with their ends, as Columns of daily_scales."""
    name = lambda x: f"{x:g}".replace(".", "p")
    made = {"a0": (F.lit(float(fixed[0])), F.lit(float(fixed[1])))}
    for prefix, scale, unit, lower, upper in (("a1", "adv", 1e-4, adv_lower, adv_upper), ("a2", "ats", 1.0, ats_lower, ats_upper)):
        for a in lower:
            for b in upper:
                if not 0 <= a < b:
                    raise ValueError("a band's lower end must be below its upper end")
                made[f"{prefix}_{name(a)}_{name(b)}"] = (F.col(scale) * F.lit(a * unit), F.col(scale) * F.lit(b * unit))
    return made | {"a3": (F.col("q20"), F.col("q80"))}


def amount_shares(trades: DataFrame, scales: DataFrame, intervals: dict[str, tuple[Column, Column]]) -> DataFrame:
    """scales with, for each interval, the share of the day's amount in trades above its lower end and up to its upper end."""
    day = ["symbol", "td"]
    ends = scales.select(*day, *[c for n, (a, b) in intervals.items() for c in (a.alias(f"_{n}_low"), b.alias(f"_{n}_high"))])
    held = lambda n: F.sum(F.when((F.col("amount") > F.col(f"_{n}_low")) & (F.col("amount") <= F.col(f"_{n}_high")), F.col("amount")).otherwise(0.0))
    known = lambda n: F.max(F.col(f"_{n}_low").isNotNull() & F.col(f"_{n}_high").isNotNull())
    sums = trades.join(ends, day).groupBy(*day).agg(*[F.when(known(n), held(n)).alias(n) for n in intervals])
    return scales.join(sums, day).withColumns({n: F.col(n) / F.col("total") for n in intervals})
