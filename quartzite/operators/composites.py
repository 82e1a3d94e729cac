"""Factors put together and put to the test: rolling weights, regressions date by date, orthogonal drivers, clusters.

Also intervals as panels, and quantiles with a stated error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .cross_pass import Pass, average_ranks, crossed, residual


def daily_ics(panel: DataFrame, features: list[str], ret: str, least: int = 5) -> DataFrame:
    """td, feature, ic: rank correlation of each feature with ret over the rows that have both, one Arrow group a date."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf[ret].to_numpy(float, na_value=np.nan)
        rows = []
        for f in features:
            x = pdf[f].to_numpy(float, na_value=np.nan)
            use = ~np.isnan(x) & ~np.isnan(r)
            a, b = average_ranks(x[use]), average_ranks(r[use])
            varies = use.sum() >= least and a.std() > 0 and b.std() > 0
            rows.append((pdf["td"].iloc[0], f, float(np.corrcoef(a, b)[0, 1]) if varies else None))
        return pd.DataFrame(rows, columns=["td", "feature", "ic"])

    return panel.select(F.col("td").cast("long").alias("td"), *[F.col(c).cast("double").alias(c) for c in [*features, ret]]).groupBy("td").applyInPandas(one, "td long, feature string, ic double")


def rolling_weights(ics: DataFrame, window: int, least: int) -> DataFrame:
    """td, feature, icir, weight: each date's weights from the rank correlations of the `window` dates before it.

    icir: mean over deviation (ddof 0) of those present, `least` of which must be. Weights are the positive icirs over their sum, equal ones where there is none.
    """
    dates = ics.select("td").distinct().withColumn("_n", F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy("td")))  # a row a date
    past = W.Window.partitionBy("feature").orderBy("_n").rangeBetween(-window, -1)
    d = ics.join(dates, "td")
    sd = F.stddev_pop("ic").over(past)
    d = d.withColumn("icir", F.when((F.count("ic").over(past) >= least) & (sd > 1e-12), F.avg("ic").over(past) / sd))
    plus = F.greatest(F.coalesce("icir", F.lit(0.0)), F.lit(0.0))
    date = W.Window.partitionBy("td")
    total = F.sum(plus).over(date)
    return d.select("td", "feature", "icir", F.when(total > 0, plus / total).otherwise(1.0 / F.count(F.lit(1)).over(date)).alias("weight"))


def composite(panel: DataFrame, features: list[str], weights: DataFrame) -> DataFrame:
    """symbol, td, score: the weighted mean of the features' ranks of the date, over the features that the row has."""
    ranked = crossed(panel, Pass(ranks={f"_r_{f}": f for f in features}))
    wide = weights.groupBy("td").pivot("feature", features).agg(F.max("weight")).select("td", *[F.col(f).alias(f"_w_{f}") for f in features])
    d = ranked.join(wide, "td")
    part = lambda f, x: F.when(F.col(f"_r_{f}").isNotNull(), x).otherwise(0.0)
    top = sum((part(f, F.col(f"_w_{f}") * F.col(f"_r_{f}")) for f in features), F.lit(0.0))
    weight = sum((part(f, F.col(f"_w_{f}")) for f in features), F.lit(0.0))
    return d.select("symbol", "td", (top / F.nullif(weight, F.lit(0.0))).alias("score"))


def fama_macbeth(panel: DataFrame, y: str, xs: list[str], lags: int, least: int = 10) -> DataFrame:
    """variable, days, mean, t: coefficients of the cross-sectional regressions of rank z-scores, averaged over dates, with Newey-West t-values.

    A date needs max(least, len(xs) + 5) whole rows. One Arrow group a date.
    """
    names = ["intercept", *xs]
    nothing = pd.DataFrame({"td": pd.Series([], dtype="int64"), "variable": pd.Series([], dtype=object), "v": pd.Series([], dtype=float)})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[[y, *xs]].to_numpy(float, na_value=np.nan)
        a = a[~np.isnan(a).any(axis=1)]
        if len(a) < max(least, len(xs) + 5):
            return nothing
        z = np.column_stack([average_ranks(c) for c in a.T])
        sd = z.std(axis=0, ddof=1)
        if (sd <= 0).any():
            return nothing
        z = (z - z.mean(axis=0)) / sd
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z[:, 1:]]), z[:, 0], rcond=None)[0]
        return pd.DataFrame({"td": pdf["td"].iloc[0], "variable": pd.Series(names, dtype=object), "v": beta})

    rows = panel.select(F.col("td").cast("long").alias("td"), *[F.col(c).cast("double").alias(c) for c in [y, *xs]])
    daily = rows.groupBy("td").applyInPandas(one, "td long, variable string, v double")
    order = W.Window.partitionBy("variable").orderBy("td")
    every = W.Window.partitionBy("variable")  # a row a date
    d = daily.withColumn("_e", F.col("v") - F.avg("v").over(every))
    d = d.withColumns({f"_l{k}": F.lag("_e", k).over(order) for k in range(1, lags + 1)})
    variance = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0))
    n = F.count("v")
    error = F.sqrt(F.when(variance > 1e-18, variance)) / n
    return d.groupBy("variable").agg(n.alias("days"), F.avg("v").alias("mean"), F.when(n >= max(10, lags + 2), F.avg("v") / error).alias("t"))


def residual_ics(panel: DataFrame, feature: str, controls: list[str], ret: str, least: int, least_ic: int = 5) -> DataFrame:
    """td, ic: rank correlation with ret of what the controls leave of the feature; residual and ranks are one Arrow group a date."""

    def one(group: pa.Table) -> pa.Table:
        x = {c: group[c].to_numpy() for c in [feature, ret, *controls]}  # nulls become nan
        left, r = residual(x[feature], [x[c] for c in controls], least), x[ret]
        use = ~np.isnan(left) & ~np.isnan(r)
        a, b = average_ranks(left[use]), average_ranks(r[use])
        varies = use.sum() >= least_ic and a.std() > 0 and b.std() > 0
        return pa.table({"td": group["td"].slice(0, 1), "ic": pa.array([float(np.corrcoef(a, b)[0, 1]) if varies else None], pa.float64())})

    return panel.select(F.col("td").cast("long").alias("td"), feature, ret, *controls).groupBy("td").applyInArrow(one, "td long, ic double")


def orthogonal_drivers(panel: DataFrame, features: list[str], ret: str, least_ic: float, cut: Callable[[DataFrame], DataFrame], least: int = 8) -> list[tuple[str, float, float, bool]]:
    """(feature, ic, ic left, accepted) by falling size of ic: a feature is a driver if its residual on the drivers before it keeps an |ic| of least_ic.

    The ics of all features come from one pass; each candidate's residual from one pass over the panel, which `cut` keeps. Features are a handful.
    """
    held = cut(panel.select("symbol", "td", *[F.col(c).cast("double").alias(c) for c in [ret, *features]]))
    mean = lambda df, fs: {r["feature"]: r["ic"] for r in daily_ics(df, fs, ret).groupBy("feature").agg(F.avg("ic").alias("ic")).collect()}
    raw = mean(held, features)
    accepted: list[str] = []
    out = []
    for f in sorted(features, key=lambda n: (-abs(raw[n] or 0.0), n)):
        left = raw[f]
        if accepted:
            left = residual_ics(held, f, accepted, ret, least).agg(F.avg("ic")).first()[0]
        driver = left is not None and abs(left) >= least_ic
        out.append((f, raw[f], left, driver))
        if driver:
            accepted.append(f)
    return out


def correlation_clusters(pairs: list[tuple[str, str, float | None]], names: list[str], most: float) -> dict[str, str]:
    """For each name the first name of its cluster: names whose |correlation| reaches `most` are linked. Names are a handful, pairs their number squared."""
    up = {n: n for n in names}

    def root(n: str) -> str:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b, r in pairs:
        if r is not None and abs(r) >= most:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {n: root(n) for n in names}


def pivoted_cholesky(gram: np.ndarray, least: float) -> tuple[list[int], np.ndarray]:
    """Columns in the order in which each adds most to those before it, down to `least` of the largest, and the triangular factor of their order."""
    left = gram.astype(float).copy()
    diagonal = np.diag(left).copy()
    order, rows = [], []
    first = diagonal.max(initial=0.0)
    while len(order) < len(gram):
        k = int(np.argmax(np.where(np.isin(np.arange(len(gram)), order), -np.inf, diagonal)))
        if diagonal[k] <= least * first or diagonal[k] <= 0:
            break
        row = (left[k] - sum((r[k] * r for r in rows), np.zeros(len(gram)))) / math.sqrt(diagonal[k])
        rows.append(row)
        order.append(k)
        diagonal = np.maximum(diagonal - row * row, 0.0)
    return order, np.array(rows).reshape(len(order), len(gram))


def variance_order(panel: DataFrame, features: list[str], least: float = 0.05) -> list[tuple[str, float]]:
    """(feature, share of its variance that those before it don't explain) by greedy choice, from one Gram matrix of all whole rows."""
    from .linear_models import date_grams

    whole = panel.dropna(subset=features)
    means = whole.agg(*[F.avg(f) for f in features]).first()
    shifts = [float(m or 0.0) for m in means]
    sums = date_grams(whole.withColumn("_day", F.lit(0)), features[:-1], features[-1], "_day", shifts).groupBy("i").agg(F.sum("v").alias("v")).collect()
    k = len(features) + 1
    g = np.zeros((k, k))
    upper = np.triu_indices(k)
    for r in sums:
        g[upper[0][r["i"]], upper[1][r["i"]]] = r["v"]
    g = g + np.triu(g, 1).T
    n = max(g[0, 0], 1.0)
    c = g[1:, 1:] / n - np.outer(g[0, 1:] / n, g[0, 1:] / n)
    sd = np.sqrt(np.maximum(np.diag(c), 0.0))
    corr = np.divide(c, np.outer(sd, sd), out=np.zeros_like(c), where=np.outer(sd, sd) > 0)
    order, rows = pivoted_cholesky(corr, least)
    return [(features[i], float(rows[j][i] ** 2)) for j, i in enumerate(order)]


def interval_panel(intervals: DataFrame, days: DataFrame, value: str) -> DataFrame:
    """symbol, td, value: on each day what the interval says that holds it (both ends included; an open end is null).

    Of intervals with one start the one with the latest end stays (an open end counts as latest, then the largest value); where intervals of a symbol overlap, the latest start wins.
    days: td, numbered. Each interval is a row a day that it holds, at most the panel's days.
    """
    last = F.row_number().over(W.Window.partitionBy("symbol", "start").orderBy(F.desc_nulls_first("end"), F.desc(value)))
    one = intervals.withColumn("_r", last).where("_r = 1")
    final = days.agg(F.max("td")).first()[0] or 0
    open_ = one.withColumn("_to", F.least(F.coalesce("end", F.lit(final)), F.lit(final))).where("start <= _to").select("symbol", "start", "_to", value)
    spread = open_.withColumn("td", F.explode(F.sequence("start", "_to"))).groupBy("symbol", "td").agg(F.max_by(value, "start").alias(value))
    return spread.join(F.broadcast(days.select("td").distinct()), "td", "left_semi").select("symbol", "td", value)


def approximate_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 1000) -> DataFrame:
    """One row per key with quantiles as values of the data whose ranks are off by at most 1 / accuracy of the key's rows; bounded memory a key."""
    found = F.percentile_approx(value, F.array(*[F.lit(p) for p in probs]), F.lit(accuracy))
    return df.groupBy(*keys).agg(found.alias("quantiles"), F.count(value).alias("n"))


def quality(reports: DataFrame, days: DataFrame, window: int = 8, least: int = 4) -> DataFrame:
    """days (symbol, td) with roe, roe_stability, gross_profitability, cfo_quality and composite, from the last reports known by each day.

    reports: symbol, known (the day of announcement), period, profit, equity, gross, assets, cash. A report counts from its announcement
    on; of reports of one period the last announced counts. roe_stability: minus the deviation of roe over the last `window` periods.
    composite: the mean of the date's ranks of those that the row has.
    """
    from .joins import asof

    over = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    r = reports.withColumns({"roe": over("profit", "equity"), "gross_profitability": over("gross", "assets"), "cfo_quality": (F.col("cash") - F.col("profit")) / F.when(F.col("assets") > 0, F.col("assets"))})
    last = F.row_number().over(W.Window.partitionBy("symbol", "period").orderBy(F.desc("known")))
    r = r.withColumn("_r", last).where("_r = 1").drop("_r")
    past = W.Window.partitionBy("symbol").orderBy("period").rowsBetween(1 - window, 0)
    r = r.withColumn("roe_stability", F.when(F.count("roe").over(past) >= least, -F.stddev_samp("roe").over(past)))
    made = ["roe", "roe_stability", "gross_profitability", "cfo_quality"]
    known = asof(days, r.select(F.col("symbol"), "known", "period", *made), "symbol", "td", "known", [*made, "period"], tie=["period"])
    ranked = crossed(known, Pass(ranks={f"_r_{m}": m for m in made}))
    d = known.join(ranked, ["symbol", "td"])
    total = sum((F.coalesce(f"_r_{m}", F.lit(0.0)) for m in made), F.lit(0.0))
    count = sum((F.col(f"_r_{m}").isNotNull().cast("int") for m in made), F.lit(0))
    return d.withColumn("composite", total / F.nullif(count.cast("double"), F.lit(0.0))).drop(*[f"_r_{m}" for m in made])

