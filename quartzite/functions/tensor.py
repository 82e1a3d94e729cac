"""Operators over windows of a (symbol, td) series, evaluated at the ends of strided windows.

A window holds d dates without a gap; the windows of a symbol end at its dates number d, d + stride, ...
of each stretch. What is not defined is 0, as the operators' users expect: a deviation below 1e-8 counts as none.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .rolling import with_runs

SMALL = 1e-8


def _or_zero(x: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))


def features(panel: DataFrame, columns: list[str], d: int, stride: int) -> DataFrame:
    """One row for each window: symbol, td (its end), and op_column (op_a_b for pairs) for all ten operators."""
    rows = with_runs(panel.select("symbol", "td", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns]))
    order = W.Window.partitionBy("symbol", "run").orderBy("td")
    w = order.rowsBetween(1 - d, 0)
    place = F.row_number().over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    out: dict[str, Column] = {}
    for c in columns:
        x, sd = F.col(c), F.stddev_pop(c).over(w)
        first = F.first(c).over(w)
        out |= {
            f"mean_{c}": F.avg(x).over(w),
            f"std_{c}": sd,
            f"sum_{c}": F.sum(x).over(w),
            f"max_{c}": F.max(x).over(w),
            f"min_{c}": F.min(x).over(w),
            f"zscore_{c}": _or_zero(F.when(sd >= SMALL, (x - F.avg(x).over(w)) / sd)),
            f"return_{c}": _or_zero(F.when(F.abs(first) >= SMALL, x / first - 1)),
            # weights 1..d: place - (in_run - d) of each row, by sums of x and of in_run * x
            f"decay_{c}": (F.sum(F.col("in_run") * x).over(w) - (F.col("in_run") - d) * F.sum(x).over(w)) / (d * (d + 1) / 2),
        }
    for a, b in itertools.combinations(columns, 2):
        cov = F.avg(F.col(a) * F.col(b)).over(w) - F.avg(a).over(w) * F.avg(b).over(w)
        sa, sb = F.stddev_pop(a).over(w), F.stddev_pop(b).over(w)
        out |= {f"cov_{a}_{b}": cov, f"corr_{a}_{b}": _or_zero(F.when((sa >= SMALL) & (sb >= SMALL), cov / (sa * sb)))}
    made = rows.select("symbol", "td", place.alias("_place"), *[c.alias(n) for n, c in out.items()])
    return made.where((F.col("_place") >= d) & ((F.col("_place") - d) % stride == 0)).drop("_place")


def pooled(windows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Mean, max and min of each column over the last `size` windows of the symbol."""
    w = W.Window.partitionBy("symbol").orderBy("td").rowsBetween(1 - size, 0)
    return windows.select("symbol", "td", *[f(c).over(w).alias(f"{n}_{c}") for c in columns for n, f in (("poolmean", F.avg), ("poolmax", F.max), ("poolmin", F.min))])
