"""What a signal earns: long-short books with costs, excess over a universe, monotonicity, regimes and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .evaluation import day
from .ranking import fraction_mask


def long_short(panel: DataFrame, share: float, cost: float) -> DataFrame:
    """td, gross, turnover, net: equal-weight top share less bottom share by rank (ties by symbol), L1 turnover from the date before, cost on it.

    panel: symbol, td, signal, fwd. Names without a signal have no weight; a missing return counts 0.
    """
    d = panel.select("symbol", "td", "signal", "fwd").where("signal is not null")
    d = d.withColumns({"t": fraction_mask(F.col("signal"), share), "b": fraction_mask(F.col("signal"), share, False)})
    one = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(day()), F.lit(0)), F.lit(0.0))
    w = d.select("symbol", "td", "fwd", (one("t") - one("b")).alias("w")).where("w <> 0")
    own = W.Window.partitionBy("symbol").orderBy("td")
    w = w.select("*", F.lag("td").over(own).alias("_last"), F.lag("w").over(own).alias("_old"), F.lead("td").over(own).alias("_next"))
    here = F.struct("td", (F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("gross"), F.abs(F.col("w") - F.when(F.col("_last") == F.col("td") - 1, F.col("_old")).otherwise(F.lit(0.0))).alias("turnover"))
    after = F.struct((F.col("td") + 1).alias("td"), F.lit(0.0).alias("gross"), F.abs("w").alias("turnover"))
    leaves = ~F.coalesce(F.col("_next") == F.col("td") + 1, F.lit(False))
    moves = w.select(F.explode(F.when(leaves, F.array(here, after)).otherwise(F.array(here))).alias("m")).select("m.*")
    out = moves.groupBy("td").agg(F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover")).join(panel.select("td").distinct(), "td", "left_semi")
    return out.withColumn("net", F.col("gross") - F.lit(cost) * F.col("turnover"))


def excess_of_top(panel: DataFrame, share: float = 0.1) -> DataFrame:
    """td, chosen, universe, excess: mean return of the names ranked above 1 - share less that of all names with signal and return."""
    d = panel.where("signal is not null").withColumn("_top", fraction_mask(F.col("signal"), share, closed=False))
    d = d.where("fwd is not null")
    return d.groupBy("td").agg(F.sum("_top").alias("chosen"), F.count(F.lit(1)).alias("universe"), (F.avg(F.when(F.col("_top") == 1, F.col("fwd"))) - F.avg("fwd")).alias("excess"))


def monotonicity(groups: DataFrame) -> DataFrame:
    """spearman of group and mean return, and the share of neighbouring groups that rise; groups: grp, mean, a row a group."""
    w = W.Window.partitionBy(F.lit(0))
    d = groups.withColumns({"_a": F.rank().over(w.orderBy("grp")), "_b": F.rank().over(w.orderBy("mean")), "_up": F.col("mean") > F.lag("mean").over(w.orderBy("grp"))})
    return d.agg((F.covar_pop("_a", "_b") / F.nullif(F.stddev_pop("_a") * F.stddev_pop("_b"), F.lit(0.0))).alias("spearman"), F.avg(F.col("_up").cast("double")).alias("rising"))


def by_period(series: DataFrame, value: str, period: Column, year: int = 250) -> DataFrame:
    """period, days, total, sharpe of a daily series: roll-ups by month, quarter or year."""
    sd = F.stddev_samp(value)
    return series.groupBy(period.alias("period")).agg(F.count(value).alias("days"), F.sum(value).alias("total"), (F.avg(value) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(year)))).alias("sharpe"))


def by_regime(series: DataFrame, value: str, market: DataFrame, window: int) -> DataFrame:
    """regime, days, mean: the series where the market's mean of the last `window` dates was positive ("up") or not ("down"); market: td, ret."""
    w = W.Window.partitionBy(F.lit(0)).orderBy("td").rowsBetween(-window, -1)  # a row a date
    m = market.select("td", F.when(F.avg("ret").over(w) > 0, "up").otherwise("down").alias("regime"))
    return series.join(m, "td").groupBy("regime").agg(F.count(value).alias("days"), F.avg(value).alias("mean"))


def sign_consistency(ics: DataFrame, period: Column) -> DataFrame:
    """periods, share: of the periods' mean ic, how many have the sign of the whole mean."""
    p = ics.groupBy(period.alias("p")).agg(F.avg("ic").alias("m"), F.count("ic").alias("n"), F.sum("ic").alias("s")).where("n > 0")
    whole = F.sum("s").over(W.Window.partitionBy(F.lit(0)))  # a row a period
    return p.withColumn("same", (F.signum("m") == F.signum(whole)).cast("double")).agg(F.count(F.lit(1)).alias("periods"), F.avg("same").alias("share"))


def verdicts(metrics: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """metrics with pass_NAME for each gate (column, least value) and pass_all; a null value fails."""
    made = {f"pass_{n}": F.coalesce(F.col(c) > least, F.lit(False)) for n, (c, least) in gates.items()}
    d = metrics.withColumns(made)
    every = F.lit(True)
    for n in made:
        every = every & F.col(n)
    return d.withColumn("pass_all", every)


def conditional_ic(panel: DataFrame, anchor: str, n: int = 3) -> DataFrame:
    """bin, dates, ic: mean rank correlation of signal and return within the anchor's n bins of each date."""
    d = panel.where(f"signal is not null and fwd is not null and {anchor} is not null")
    d = d.withColumn("bin", F.floor((F.row_number().over(day().orderBy(anchor, "symbol")) - 1) * n / F.count(F.lit(1)).over(day())).cast("int") + 1)
    key = ["td", "bin"]
    rank = lambda c: F.rank().over(W.Window.partitionBy(*key).orderBy(c)) + (F.count(c).over(W.Window.partitionBy(*key, c)) - 1) / F.lit(2.0)
    ics = d.withColumns({"_a": rank("signal"), "_b": rank("fwd")}).groupBy(*key).agg((F.covar_pop("_a", "_b") / F.nullif(F.stddev_pop("_a") * F.stddev_pop("_b"), F.lit(0.0))).alias("ic"))
    return ics.groupBy("bin").agg(F.count("ic").alias("dates"), F.avg("ic").alias("ic"))
