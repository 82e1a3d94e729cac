"""Cross-sections: winsorising, standardising and neutralising the values of each date.

Functions on Columns take `by`, the columns that name a cross-section (a date, or a date and an
industry). Nulls stay null and count nowhere; NaN must be null before. Regressions on up to two
controls are sums over windows; on more, one small least-squares fit a date in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .cross_pass import average_ranks
from .evaluation import average_rank

By = str | list[str]
#: Ratio of the standard deviation to the median absolute deviation, and the steepness that keeps two thirds of the width fixed (fixed values).
MAD_SCALE, TANH = 1.4826, 1.212


def _over(by: By) -> W.WindowSpec:
    return W.Window.partitionBy(*([by] if isinstance(by, str) else by))


def median(x: Column, by: By = "td") -> Column:
    return F.percentile(x, F.lit(0.5)).over(_over(by))


def with_mad(df: DataFrame, x: str, out: str, by: By = "td", width: float = 3.0, soft: bool = True) -> DataFrame:
    """df with x drawn in around its median: by tanh, or (soft false) cut at width scaled median absolute deviations; as it is where that deviation is 0."""
    d = df.withColumn("_median", median(F.col(x), by))
    d = d.withColumn("_width", median(F.abs(F.col(x) - F.col("_median")), by) * MAD_SCALE * width)
    m, w = F.col("_median"), F.col("_width")
    drawn = F.tanh((F.col(x) - m) / F.nullif(w, F.lit(0.0)) * TANH) * w + m if soft else F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), m - w), m + w))
    return d.withColumn(out, F.when(w > 0, drawn).otherwise(F.col(x))).drop("_median", "_width")


def with_squeeze(df: DataFrame, x: str, out: str, by: By = "td", width: float = 5.0) -> DataFrame:
    """df with what lies beyond the median and `width` mean absolute deviations squeezed to a thousandth of its excess over that bound."""
    d = df.withColumn("_mid", median(F.col(x), by)).withColumn("_mean", F.avg(x).over(_over(by)))
    d = d.withColumn("_dev", F.avg(F.abs(F.col(x) - F.col("_mean"))).over(_over(by)) * width)
    up, low, v = F.col("_mid") + F.col("_dev"), F.col("_mid") - F.col("_dev"), F.col(x)
    return d.withColumn(out, F.when(v > up, (v + 999 * up) / 1000).when(v < low, (v + 999 * low) / 1000).otherwise(v)).drop("_mid", "_mean", "_dev")


def z_score(x: Column, by: By = "td", ddof: int = 1, constant: float | None = None) -> Column:
    """(x - mean) / deviation; `constant` (null if None) where the deviation is 0."""
    sd = (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(_over(by))
    z = (x - F.avg(x).over(_over(by))) / F.when(sd > 1e-12, sd)
    return z if constant is None else F.when(x.isNotNull(), F.coalesce(z, F.lit(constant)))


def with_rank_z(df: DataFrame, x: str, out: str, by: str = "td") -> DataFrame:
    """df with the z-score (ddof 0) of x's percentile rank."""
    rank = F.when(F.col(x).isNotNull(), average_rank(F.col(x), by) / F.count(x).over(_over(by)))
    d = df.withColumn("_rank", rank)
    return d.withColumn(out, z_score(F.col("_rank"), by, 0)).drop("_rank")


def demeaned(x: Column, by: list[str], least: int = 1) -> Column:
    """x less the mean of its group; null in groups with fewer than `least` values."""
    over = _over(by)
    return F.when(F.count(x).over(over) >= least, x - F.avg(x).over(over))


def with_industry_size_residual(df: DataFrame, y: str, size: str, industry: str, out: str, by: str = "td", least: int = 10) -> DataFrame:
    """df with the residual of y on industry dummies and size, date by date.

    Both are demeaned within industries; what is left has one slope (Frisch, Waugh, Lovell). Rows that
    lack y, size or industry, and dates with fewer than `least` whole rows, get null.
    """
    use = F.col(y).isNotNull() & F.col(size).isNotNull() & F.col(industry).isNotNull()
    d = df.withColumns({"_y": F.when(use, F.col(y)), "_s": F.when(use, F.col(size))})
    group = _over([by, industry])
    d = d.withColumns({"_yd": F.col("_y") - F.avg("_y").over(group), "_sd": F.col("_s") - F.avg("_s").over(group)})
    date = _over(by)
    square = F.sum(F.col("_sd") * F.col("_sd")).over(date)
    slope = F.sum(F.col("_yd") * F.col("_sd")).over(date) / F.when(square > 1e-18, square)
    enough = F.count("_y").over(date) >= least
    return d.withColumn(out, F.when(enough, F.col("_yd") - F.coalesce(slope, F.lit(0.0)) * F.col("_sd"))).drop("_y", "_s", "_yd", "_sd")


def residual_of(y: np.ndarray, xs: list[np.ndarray], need: int) -> np.ndarray:
    """y less its fit of least norm on an intercept and xs; nan where one is missing, and throughout where fewer than `need` rows are whole."""
    a = np.column_stack([y, *xs])
    full = np.isfinite(a).all(axis=1)
    out = np.full(len(a), np.nan)
    if full.sum() >= need:
        x = np.column_stack([np.ones(full.sum()), a[full][:, 1:]])
        out[full] = a[full][:, 0] - x @ np.linalg.lstsq(x, a[full][:, 0], rcond=None)[0]
    return out


def with_residual(df: DataFrame, y: str, xs: list[str], out: str, by: str = "td", least: int = 30) -> DataFrame:
    """df with the residual of y on an intercept and xs, date by date; the fit of least norm where xs are collinear.

    A date needs max(least, len(xs) + 5) rows without nulls. A cross-section, one row a symbol, is one
    Arrow group.
    """
    need = max(least, len(xs) + 5)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[[y, *xs]].to_numpy(float, na_value=np.nan)
        return pdf.assign(**{out: residual_of(a[:, 0], list(a[:, 1:].T), need)})

    df = df.drop(out)
    done = df.groupBy(by).applyInPandas(one, T.StructType([*df.drop(out).schema.fields, T.StructField(out, T.DoubleType())]))
    return done.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def processed(df: DataFrame, x: str, size: str, industry: str, out: str, by: str = "td", least: int = 10) -> DataFrame:
    """The usual chain: draw in by MAD, fill nulls by the industry's mean, residual on industry and size, z-score."""
    d = with_mad(df, x, "_drawn", by)
    d = d.withColumn("_filled", F.coalesce("_drawn", F.avg("_drawn").over(_over([by, industry]))))
    d = with_industry_size_residual(d, "_filled", size, industry, "_residual", by, least)
    return d.withColumn(out, z_score(F.col("_residual"), by)).drop("_drawn", "_filled", "_residual")


def neutral_chain(df: DataFrame, y: str, controls: list[str], ret: str, by: str = "td", least: int = 10) -> DataFrame:
    """Mean rank correlation with ret of y (step 0) and of its residuals on the first 1, 2, ... controls: step, dates, ic.

    A date is one Arrow group of y, ret and the controls.
    """
    names = ["_y", "_ret", *[f"_c{k}" for k in range(len(controls))]]

    def one(group: pa.Table) -> pa.Table:
        v, r, *cs = (group[n].to_numpy() for n in names)  # nulls become nan
        ics = []
        for k in range(len(controls) + 1):
            left = residual_of(v, cs[:k], max(least, k + 5)) if k else v
            use = ~np.isnan(left) & ~np.isnan(r)
            a, b = average_ranks(left[use]), average_ranks(r[use])
            ics.append(np.corrcoef(a, b)[0, 1] if use.any() and a.std() > 0 and b.std() > 0 else np.nan)
        return pa.table({"step": pa.array(range(len(ics)), pa.int32()), "ic": pa.array(np.array(ics), mask=np.isnan(ics))})

    rows = df.select(by, *[F.col(c).cast("double").alias(n) for n, c in zip(names, [y, ret, *controls], strict=True)])  # no other column travels
    ic = rows.groupBy(by).applyInArrow(one, "step int, ic double")
    found = ic.groupBy("step").agg(F.count("ic").alias("dates"), F.avg("ic").alias("ic"))
    every = df.sparkSession.range(len(controls) + 1).select(F.col("id").cast("int").alias("step"))
    return every.join(found, "step", "left").select("step", F.coalesce("dates", F.lit(0)).alias("dates"), "ic")


def tradable(limit_up: Column, limit_down: Column, close: Column, suspended: Column, special: Column, age: Column, least_age: int) -> Column:
    """Whether a name can be traded: close strictly inside the band, not suspended, not under special treatment, listed long enough."""
    inside = (close > limit_down) & (close < limit_up)
    return F.coalesce(inside, F.lit(False)) & ~F.coalesce(suspended, F.lit(False)) & ~F.coalesce(special, F.lit(False)) & (age >= least_age)
