"""Conditions on rows: limits, suspension, special treatment, sessions, and guards that raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Names of companies under special treatment, or about to be delisted (fixed value).
SPECIAL = r"ST|\*|退"


def limit_status(close: Column, up: Column, down: Column, near: float = 1e-4) -> Column:
    """1 at the upper limit, -1 at the lower, else 0; null where a price is."""
    return F.when(close.isNull() | up.isNull() | down.isNull(), F.lit(None).cast("int")).when(F.abs(close - up) < near, 1).when(F.abs(close - down) < near, -1).otherwise(0)


def inside_limits(close: Column, up: Column, down: Column) -> Column:
    """1 where close is strictly inside the band, else null."""
    return F.when((close < up) & (close > down), F.lit(1))


def suspended(status: Column, word: str) -> Column:
    """Whether the status is the word for suspension, or empty, or missing."""
    return F.coalesce((status == word) | (F.trim(status) == ""), F.lit(True))


def sane_value(x: Column, most: float) -> Column:
    """x where 0 < x <= most, else null."""
    return F.when((x > 0) & (x <= most), x)


def under_names(days: DataFrame, names: DataFrame, pattern: str = SPECIAL, width: int = 26) -> DataFrame:
    """days (symbol, td) with special: whether a name that matches the pattern held on that date.

    names: symbol, name, start, end (null: still). Interval join by buckets, then a semi-join's flag.
    """
    from .joins import within

    marked = names.where(F.col("name").rlike(pattern)).select("symbol", "start", "end")
    hit = within(days.select("symbol", "td"), marked, "symbol", "td", "start", "end", width).select("symbol", "td").distinct().withColumn("special", F.lit(True))
    return days.join(hit, ["symbol", "td"], "left").withColumn("special", F.coalesce("special", F.lit(False)))


def age(td: str = "td") -> Column:
    """Number of the symbol's rows so far, this one included."""
    return F.row_number().over(W.Window.partitionBy("symbol").orderBy(td))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(ts: Column) -> Column:
    """Whether the time lies in 09:30 to 11:30 or 13:00 to 15:00, ends included."""
    m = minute_of_day(ts) * 60 + F.second(ts)
    return m.between(570 * 60, 690 * 60) | m.between(780 * 60, 900 * 60)


def trading_minute(ts: Column) -> Column:
    """0 to 239: minutes of trading since 09:30 without the pause at noon; the ends 11:30 and 15:00 belong to the minutes before; null outside."""
    m = minute_of_day(ts)
    return F.when(m.between(570, 689), m - 570).when(m == 690, 119).when(m.between(780, 899), m - 660).when(m == 900, 239)


def guarded(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, whose reading raises with a rule's name on the first row that breaks it; a condition that is null is kept to."""
    out = df
    for name, rule in rules.items():
        out = out.where(F.when(F.coalesce(rule, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit(f"a row breaks the rule {name}")).cast("boolean")))
    return out
