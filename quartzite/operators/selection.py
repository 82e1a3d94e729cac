"""Choosing features: association tests, false discovery rate, correlations and pruning, walk-forward windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def long_form(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, x, y rows of those that have both."""
    made = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")
    return df.select(F.col(target).cast("double").alias("y"), made).select("f.*", "y").where("x is not null and y is not null")


def count_bounds(d: DataFrame, key: str, x: str, bins: int, cuts: int = 64) -> DataFrame:
    """One row per key: lows, the least value of each bin from the second on, so that bins hold equal counts and equal values share one.

    The bin of a value is floor((rank - 1) * bins / n). Values are counted first; ranks add up over `cuts` ranges of
    a key's values and then within each, so that no task holds all values of a key.
    """
    values = d.groupBy(key, x).agg(F.count(F.lit(1)).alias("_n"))
    ends = values.groupBy(key).agg(F.percentile_approx(x, F.array(*[F.lit(k / cuts) for k in range(1, cuts)]), F.lit(10 * cuts)).alias("_ends"))
    placed = values.join(F.broadcast(ends), key).withColumn("_range", F.size(F.filter("_ends", lambda e: e < F.col(x)))).drop("_ends")  # a row a key
    ranges = placed.groupBy(key, "_range").agg(F.sum("_n").alias("_held"))
    before = W.Window.partitionBy(key).orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    ranges = ranges.select(key, "_range", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_base"), F.sum("_held").over(W.Window.partitionBy(key)).alias("_all"))
    within = W.Window.partitionBy(key, "_range").orderBy(x).rowsBetween(W.Window.unboundedPreceding, -1)
    less = F.col("_base") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    bin_of = F.floor(less * bins / F.col("_all"))
    lows = placed.join(F.broadcast(ranges), [key, "_range"]).select(key, x, bin_of.alias("_bin")).groupBy(key, "_bin").agg(F.min(x).alias("_low"))
    return lows.where("_bin > 0").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_bin", "_low"))).alias("lows"))


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int) -> DataFrame:
    """feature, mi: mutual information (nats) of the equal-count bins of feature and target; equal values share a bin."""
    d = long_form(df, features, target)
    bounds = count_bounds(d, "feature", "x", bins).withColumnRenamed("lows", "_xs").join(count_bounds(d, "feature", "y", bins).withColumnRenamed("lows", "_ys"), "feature", "full")
    bin_of = lambda v, lows: F.coalesce(F.array_max(F.transform(F.filter(lows, lambda e: e["_low"] <= F.col(v)), lambda e: e["_bin"])), F.lit(0))
    cells = d.join(F.broadcast(bounds), "feature", "left").select("feature", bin_of("x", "_xs").alias("i"), bin_of("y", "_ys").alias("j")).groupBy("feature", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *by: F.sum("n").over(W.Window.partitionBy("feature", *by))
    part = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))
    return cells.withColumns({"t": total(), "a": total("i"), "b": total("j")}).groupBy("feature").agg(F.sum(part).alias("mi"))


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 5000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _f_tail(f: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if v != v or k < 3 else incomplete_beta((k - 2) / (k - 2 + v), (k - 2) / 2, 0.5) for v, k in zip(f.astype(float), n, strict=True)], dtype="float64")


def association(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, n, f, p: F statistic of the regression of target on the feature, and the tail of the F distribution with 1 and n - 2 degrees of freedom."""
    g = long_form(df, features, target).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r2 = F.pow(F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0)), F.lit(2))
    d = g.withColumn("f", r2 / (1 - r2) * (F.col("n") - 2))
    return d.select("feature", "n", "f", F.pandas_udf(_f_tail, "double")("f", "n").alias("p"))  # a row a feature


def false_discovery(tests: DataFrame, level: float) -> DataFrame:
    """tests (feature, p) with q, the Benjamini-Hochberg adjusted p-value, and chosen (q <= level)."""
    every = W.Window.partitionBy(F.lit(0))  # a row a feature
    rank, n = F.row_number().over(every.orderBy("p", "feature")), F.count(F.lit(1)).over(every)
    d = tests.where("p is not null").withColumn("_raw", F.col("p") * n / rank)
    q = F.least(F.lit(1.0), F.min("_raw").over(every.orderBy(F.desc("p"), F.desc("feature")).rowsBetween(W.Window.unboundedPreceding, 0)))
    return d.withColumn("q", q).withColumn("chosen", F.col("q") <= level).drop("_raw")


def correlations(df: DataFrame, features: list[str], by: str | None = None) -> DataFrame:
    """a, b, r for each pair of features: Pearson over all rows that have both, or with `by` the mean of each date's Spearman."""
    if by is None:
        made = [F.covar_pop(*both).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i < j for both in [_both(a, b)]]
        made += [F.stddev_pop(c).alias(f"{n}{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i < j for n, c in zip("ab", _both(a, b), strict=True)]
        one = df.agg(*made)
        pairs = [F.struct(F.lit(features[i]).alias("a"), F.lit(features[j]).alias("b"), (F.col(f"c{i}_{j}") / F.nullif(F.col(f"a{i}_{j}") * F.col(f"b{i}_{j}"), F.lit(0.0))).alias("r")) for i in range(len(features)) for j in range(i + 1, len(features))]
        return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    w = W.Window.partitionBy(by)
    ranked = df.where(" and ".join(f"{f} is not null" for f in features)).select(by, *[(F.rank().over(w.orderBy(f)) + (F.count(f).over(W.Window.partitionBy(by, f)) - 1) / F.lit(2.0)).alias(f) for f in features])
    made = [(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))).alias(f"r{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i < j]
    each = ranked.groupBy(by).agg(*made)
    pairs = [F.struct(F.lit(features[i]).alias("a"), F.lit(features[j]).alias("b"), F.col(f"r{i}_{j}").alias("r")) for i in range(len(features)) for j in range(i + 1, len(features))]
    return each.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("a", "b").agg(F.avg("r").alias("r"))


def _both(a: str, b: str) -> tuple:
    there = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(there, F.col(a)), F.when(there, F.col(b))


def pruned(scores: dict[str, float], pairs: list[tuple[str, str, float]], most: float) -> list[str]:
    """Names by falling score, each kept if its correlation with all kept before is at most `most`; a handful of names, so on the driver."""
    near = {frozenset((a, b)): abs(r) for a, b, r in pairs if r is not None}
    kept: list[str] = []
    for name in sorted(scores, key=lambda k: (-scores[k], k)):
        if all(near.get(frozenset((name, k)), 0.0) <= most for k in kept):
            kept.append(name)
    return kept


@dataclass(frozen=True)
class Fold:
    train_from: int
    train_to: int
    test_from: int
    test_to: int


def walk_forward(dates: list[int], train: int, test: int, purge: int = 0, embargo: int = 0) -> Iterator[Fold]:
    """Windows over numbered dates: `train` dates, `purge` left out, `test` dates; each next one begins `test` + `embargo` later."""
    at = 0
    while at + train + purge + test <= len(dates):
        end = at + train + purge
        yield Fold(dates[at], dates[at + train - 1], dates[end], dates[end + test - 1])
        at += test + embargo
