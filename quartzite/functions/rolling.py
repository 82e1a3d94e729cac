"""Windows on a panel (symbol, td) as Columns: trends, weighted means, decays, limited fills, runs of consecutive rows.

Range frames count dates, so a missing date takes a place in the window and adds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def dates(w: int, ahead: int = 0) -> W.WindowSpec:
    """The w dates up to the current one and `ahead`."""
    return W.Window.partitionBy("symbol").orderBy("td").rangeBetween(1 - w + ahead, ahead)


def trend(x: str, w: int, least: int = 2) -> Column:
    """Slope of x on the date over the window."""
    f = dates(w)
    t = F.when(F.col(x).isNotNull(), F.col("td").cast("double"))
    n = F.count(x).over(f)
    spread = F.avg(t * t).over(f) - F.avg(t).over(f) ** 2
    slope = (F.avg(t * F.col(x)).over(f) - F.avg(t).over(f) * F.avg(x).over(f)) / F.when(spread > 1e-9, spread)
    return F.when(n >= least, slope)


def with_market_residual(df: DataFrame, ret: str, market: str, w: int, out: str, least: int = 20) -> DataFrame:
    """df with ret less alpha and beta of the market over the window, both from the rows that have both returns."""
    f = dates(w)
    both = F.col(ret).isNotNull() & F.col(market).isNotNull()
    y, x = F.when(both, F.col(ret)), F.when(both, F.col(market))
    d = df.withColumns({"_my": F.avg(y).over(f), "_mx": F.avg(x).over(f), "_mxy": F.avg(x * y).over(f), "_mxx": F.avg(x * x).over(f), "_n": F.count(y).over(f)})
    var = F.col("_mxx") - F.col("_mx") ** 2
    beta = (F.col("_mxy") - F.col("_mx") * F.col("_my")) / F.when(var > 1e-18, var)
    residual = F.col(ret) - F.col("_my") - beta * (F.col(market) - F.col("_mx"))
    return d.withColumn(out, F.when(F.col("_n") >= least, residual)).drop("_my", "_mx", "_mxy", "_mxx", "_n")


def decay_mean(x: str, w: int) -> Column:
    """Mean of the window's dates weighted w (the current one) down to 1 (the oldest), over those present."""
    f = dates(w)
    # the weight of date s seen from t is w - t + s: sums of x and of s * x do, and t is the row's own
    s, v = F.col("td").cast("double"), F.col(x)
    there = F.when(v.isNotNull(), s)
    top = F.sum(s * v).over(f) + (F.lit(float(w)) - F.col("td")) * F.sum(v).over(f)
    return top / F.nullif(F.sum(there).over(f) + (F.lit(float(w)) - F.col("td")) * F.count(v).over(f), F.lit(0.0))


def with_recurrences(df: DataFrame, steps: dict[str, tuple[Column, Column]], by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("td",), block: int = 32) -> DataFrame:
    """df with y = a * (y of the row before) + b for each name and its (a, b), exactly; before a key's first row y is 0.

    A scan over blocks of rows: a row composes the maps of its block up to itself, blocks are composed to one pair
    (product, sum) each, and what a block starts from is carried over the pairs before it. No row looks back further than
    a block, and a key's pairs are one in `block` of its rows. Keys must not be null.
    """
    rows = W.Window.partitionBy(*by).orderBy(*order)
    d = df.withColumns({"_n": F.row_number().over(rows) - 1, **{f"_{k}_{n}": c for n, pair in steps.items() for k, c in zip("ab", pair, strict=True)}})
    d = d.withColumn("_block", F.floor(F.col("_n") / block))
    upto = W.Window.partitionBy(*by, "_block").orderBy("_n").rowsBetween(W.Window.unboundedPreceding, 0)
    nothing = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"))
    composed = lambda n: F.aggregate(F.collect_list(F.struct(F.col(f"_a_{n}").alias("a"), F.col(f"_b_{n}").alias("b"))).over(upto), nothing, lambda m, x: F.struct((m["p"] * x["a"]).alias("p"), (m["s"] * x["a"] + x["b"]).alias("s")))
    d = d.withColumns({f"_m_{n}": composed(n) for n in steps})
    pairs = d.groupBy(*by, "_block").agg(*[F.max_by(f"_m_{n}", "_n").alias(f"_t_{n}") for n in steps])
    before = W.Window.partitionBy(*by).orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = pairs.select(*by, "_block", *[F.aggregate(F.collect_list(f"_t_{n}").over(before), F.lit(0.0), lambda y, m: m["p"] * y + m["s"]).alias(f"_c_{n}") for n in steps])
    d = d.join(carried, [*by, "_block"]).withColumns({n: F.col(f"_m_{n}.p") * F.col(f"_c_{n}") + F.col(f"_m_{n}.s") for n in steps})
    return d.drop("_n", "_block", *[f"_{k}_{n}" for n in steps for k in "abmc"])


def with_smoothed(df: DataFrame, x: str, span: float, out: str, adjust: bool = True, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("td",)) -> DataFrame:
    """df with the exponentially weighted mean of x over all rows up to each, alpha being 2 / (span + 1).

    Weights age by rows, those without x too, which repeat the mean. adjust: weights (1 - alpha)**age over their sum.
    Otherwise the first value starts, and each next one has alpha against what is left of 1 since the last value.
    """
    alpha = 2.0 / (span + 1)
    q = F.lit(1 - alpha)
    rows = W.Window.partitionBy(*by).orderBy(*order)
    there = F.col(x).isNotNull()
    if adjust:
        d = with_recurrences(df, {"_top": (q, F.coalesce(F.col(x).cast("double"), F.lit(0.0))), "_weight": (q, there.cast("double"))}, by, order)
        return d.withColumn(out, F.col("_top") / F.nullif(F.col("_weight"), F.lit(0.0))).drop("_top", "_weight")
    d = df.withColumn("_row", F.row_number().over(rows))
    d = d.withColumn("_last", F.last(F.when(there, F.col("_row")), ignorenulls=True).over(rows.rowsBetween(W.Window.unboundedPreceding, -1)))
    left = F.pow(q, F.col("_row") - F.col("_last"))
    keep = F.when(~there, 1.0).when(F.col("_last").isNull(), 0.0).otherwise(left / (left + alpha))
    add = F.when(~there, 0.0).when(F.col("_last").isNull(), F.col(x)).otherwise(F.lit(alpha) / (left + alpha) * F.col(x))
    d = with_recurrences(d, {"_mean": (keep, add)}, by, order)
    return d.withColumn(out, F.when(there | F.col("_last").isNotNull(), F.col("_mean"))).drop("_mean", "_row", "_last")


def weighted_skew(x: str, half_life: float, w: int, least: int) -> Column:
    """Skewness over the last w rows, all of which must be there, under weights that halve every half_life rows; rows without x age too."""
    order = W.Window.partitionBy("symbol").orderBy("td").rowsBetween(1 - w, 0)
    held = F.reverse(F.collect_list(F.struct(F.col(x).alias("v"))).over(order))
    pairs = F.filter(F.transform(held, lambda r, age: F.struct(F.pow(F.lit(0.5), age / F.lit(float(half_life))).alias("w"), r["v"].alias("v"))), lambda p: p["v"].isNotNull())
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"])
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * p["v"]) / total
    moment = lambda k: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * F.pow(p["v"] - mean, F.lit(k))) / total
    m2 = moment(2)
    return F.when((F.size(held) == w) & (F.size(pairs) >= least) & (m2 > 1e-14), moment(3) / F.pow(m2, F.lit(1.5)))


def filled(x: str, limit: int) -> Column:
    """x, or its last value of the `limit` dates before."""
    return F.last(x, ignorenulls=True).over(dates(limit + 1))


def decayed(x: str, half_life: int, horizon: int) -> Column:
    """The last value of the `horizon` dates before, halved for every half_life dates since."""
    f = dates(horizon + 1)
    since = F.col("td") - F.last(F.when(F.col(x).isNotNull(), F.col("td")), ignorenulls=True).over(f)
    return F.last(x, ignorenulls=True).over(f) * F.exp(-since * F.lit(math.log(2.0) / half_life))


def ahead_mean(x: str, w: int, least: int) -> Column:
    """Mean of the current and the next w - 1 dates."""
    f = dates(w, w - 1)
    return F.when(F.count(x).over(f) >= least, F.avg(x).over(f))


def with_runs(df: DataFrame) -> DataFrame:
    """df with run (number of the symbol's stretch of consecutive dates, from 1) and in_run (place in it, from 1)."""
    rows = W.Window.partitionBy("symbol").orderBy("td")
    d = df.withColumn("_new", F.when(F.lag("td").over(rows) == F.col("td") - 1, 0).otherwise(1))
    d = d.withColumn("run", F.sum("_new").over(rows.rowsBetween(W.Window.unboundedPreceding, 0)))
    return d.withColumn("in_run", F.row_number().over(W.Window.partitionBy("symbol", "run").orderBy("td"))).drop("_new")
