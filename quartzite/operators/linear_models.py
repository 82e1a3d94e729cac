"""Linear models over walk-forward folds, from one pass over the rows.

Each date's rows are summed to one Gram matrix of (1, features, target); the matrices are additive, so
those of a fold are the difference of two running sums over dates, and no fold reads rows again. A fold's
coefficients are solved from its matrix, a fold a group: ridge directly, elastic net by coordinate descent.
Values are shifted by the features' means before they are multiplied, which changes no coefficient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .joins import asof


def folds(dates: DataFrame, window: int, least: int, slack: int) -> DataFrame:
    """One row per period: anchor, train_from, train_to, dates, label_end, status.

    dates: td, period, label_end (the last date that the label of td looks at). The anchor is the period's last date;
    training ends at the last date whose label ends before the anchor, and begins at the first date at most `window`
    before that. status: OK, NO_PURGED_DATES, or INSUFFICIENT_HISTORY if fewer than `least` dates are there or
    the first is over `slack` later than the window begins.
    """
    every = F.lit(0).alias("_all")
    d = dates.select("td", "label_end", "period", every, F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy("td")).alias("_i"))
    anchors = d.groupBy("period", "_all").agg(F.max("td").alias("anchor"))
    last = d.where("label_end is not null").select("_all", "label_end", F.col("td").alias("train_to"), F.col("label_end").alias("_ends"), F.col("_i").alias("_to"))
    a = asof(anchors, last.withColumn("_at", F.col("label_end")), "_all", "anchor", "_at", ["train_to", "label_end", "_to"], strict=True, tie=["train_to"])
    a = a.withColumn("_want", F.lit(window) - F.col("train_to"))
    back = d.select("_all", (-F.col("td")).alias("_at"), F.col("td").alias("train_from"), F.col("_i").alias("_from"))
    a = asof(a, back, "_all", "_want", "_at", ["train_from", "_from"])
    n = F.coalesce(F.col("_to") - F.col("_from") + 1, F.lit(0))
    short = (n < least) | (F.col("train_from") > F.col("train_to") - window + slack)
    status = F.when(F.col("train_to").isNull(), "NO_PURGED_DATES").when(short, "INSUFFICIENT_HISTORY").otherwise("OK")
    return a.select("period", "anchor", "train_from", "train_to", n.alias("dates"), "label_end", status.alias("status"))


def checked_folds(made: DataFrame) -> DataFrame:
    """folds, raising where a label of the training dates reaches the anchor."""
    return made.withColumn("label_end", F.when(F.col("label_end") >= F.col("anchor"), F.raise_error(F.lit("a training label overlaps its test period")).cast("int")).otherwise(F.col("label_end")))


def date_grams(df: DataFrame, features: list[str], target: str, date: str, shifts: list[float]) -> DataFrame:
    """Rows (td, i, v): entry i of the upper triangle of the date's Gram matrix of (1, features, target) less the shifts.

    Rows with a null anywhere are left out. A task adds up its rows of a date by one matrix product a batch.
    """
    k = len(features) + 2
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            td = b.column(0).to_numpy()
            z = np.column_stack([np.ones(len(td)), *[b.column(j + 1).to_numpy() - s for j, s in enumerate(shifts)]])
            order = np.argsort(td, kind="stable")
            td, z = td[order], z[order]
            edge = np.flatnonzero(np.append(True, td[1:] != td[:-1])) if len(td) else []
            for s, e in zip(edge, [*edge[1:], len(td)], strict=True):
                held[int(td[s])] = held.get(int(td[s]), 0.0) + z[s:e].T @ z[s:e]
        for t, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), t)), pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(g[upper])], ["td", "i", "v"])

    columns = [F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate([*features, target])]
    rows = df.select(F.col(date).cast("long").alias("td"), *columns).dropna()
    return rows.mapInArrow(run, "td long, i int, v double").groupBy("td", "i").agg(F.sum("v").alias("v"))


def fold_grams(grams: DataFrame, made: DataFrame) -> DataFrame:
    """Rows (period, i, v) for the folds that are OK: running sums of each entry over the dates, at the fold's end less before its start."""
    run = W.Window.partitionBy("i").orderBy("td").rowsBetween(W.Window.unboundedPreceding, 0)
    sums = grams.withColumn("upto", F.sum("v").over(run)).select("td", "i", "upto", (F.col("upto") - F.col("v")).alias("before"))
    ok = made.where("status = 'OK'").select("period", F.col("train_from").cast("long").alias("low"), F.col("train_to").cast("long").alias("high"))
    # the first and the last date with rows within the fold
    days = grams.select("td").distinct().withColumn("_all", F.lit(0))
    ok = asof(ok.withColumn("_all", F.lit(0)), days.withColumn("last", F.col("td")), "_all", "high", "td", ["last"])
    ok = asof(ok.withColumn("_low", -F.col("low")), days.select("_all", (-F.col("td")).alias("_td"), F.col("td").alias("first")), "_all", "_low", "_td", ["first"])
    ok = ok.where("first <= last")
    end = ok.join(sums, F.col("last") == F.col("td")).select("period", "i", "upto")
    start = ok.join(sums, F.col("first") == F.col("td")).select("period", "i", "before")
    return end.join(start, ["period", "i"]).select("period", "i", (F.col("upto") - F.col("before")).alias("v"))


def ridge(sxx: np.ndarray, sxy: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """Least squares plus alpha times the squared coefficients."""
    return np.linalg.solve(sxx + alpha * np.eye(len(sxx)), sxy) if len(sxx) else np.zeros(0)


def elastic_net(sxx: np.ndarray, sxy: np.ndarray, n: float, alpha: float, l1_ratio: float, most: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Half the mean squared error plus alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w**2), by coordinate descent on the Gram matrix."""
    g, c = sxx / n, sxy / n
    w = np.zeros(len(c))
    grad = c.copy()  # c - g w
    scale = max(float(np.abs(c).max(initial=0.0)), 1e-300)
    for _ in range(most):
        moved = 0.0
        for j in range(len(w)):
            size = g[j, j] + alpha * (1 - l1_ratio)
            if size <= 0:
                continue
            pull = grad[j] + g[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha * l1_ratio, 0.0) / size
            if new != w[j]:
                grad -= g[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * size)
                w[j] = new
        if moved <= tol * scale:
            break
    return w


def fitted(df: DataFrame, features: list[str], target: str, date: str, made: DataFrame, alpha: float, l1_ratio: float | None = None) -> DataFrame:
    """One row per OK fold: period, n, intercept, coefficients (in the order of the features); ridge without l1_ratio, else elastic net."""
    both = [*features, target]
    means = df.select(*[F.col(c).cast("double") for c in both]).dropna().agg(*[F.avg(c) for c in both]).first()
    shifts = [float(m or 0.0) for m in means]
    k = len(features) + 2
    upper = np.triu_indices(k)

    def solve(group: pa.Table) -> pa.Table:
        g = np.zeros((k, k))
        at = group["i"].to_numpy()
        g[upper[0][at], upper[1][at]] = group["v"].to_numpy()
        g = g + np.triu(g, 1).T
        n = g[0, 0]
        mean = g[0, 1:] / n
        s = g[1:, 1:] - n * np.outer(mean, mean)
        sxx, sxy = s[:-1, :-1], s[:-1, -1]
        w = ridge(sxx, sxy, n, alpha) if l1_ratio is None else elastic_net(sxx, sxy, n, alpha, l1_ratio)
        centre = mean + np.array(shifts)
        return pa.table({"period": group["period"].slice(0, 1), "n": pa.array([round(n)], pa.int64()), "intercept": pa.array([float(centre[-1] - w @ centre[:-1])]), "coefficients": pa.array([w.tolist()], pa.list_(pa.float64()))})

    grams = fold_grams(date_grams(df, features, target, date, shifts), made)
    kind = made.schema["period"].dataType.simpleString()
    return grams.groupBy("period").applyInArrow(solve, f"period {kind}, n long, intercept double, coefficients array<double>")


def predicted(df: DataFrame, features: list[str], models: DataFrame, made: DataFrame, date: str) -> DataFrame:
    """Rows of df from an OK fold's anchor on, up to before the next fold's anchor, with period and prediction."""
    spans = made.select("period", "anchor", "status").withColumn("_until", F.lead("anchor").over(W.Window.partitionBy(F.lit(0)).orderBy("anchor")))
    dated = df.select(date).distinct().withColumn("_all", F.lit(0))
    of = asof(dated, spans.withColumn("_all", F.lit(0)), "_all", date, "anchor", ["period", "status"]).where("status = 'OK'").select(date, "period")
    named = of.join(models, "period")  # a row a date
    w = F.col("coefficients")
    value = F.col("intercept")
    for j, f in enumerate(features):
        value = value + w[j] * F.col(f)
    return df.join(named, date).withColumn("prediction", value).drop("intercept", "coefficients", "n")
