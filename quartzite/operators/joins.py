"""Joins of panels with events, intervals and calendars.

None needs a cross join: as-of joins are one sort by (key, time), interval joins meet in buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], strict: bool = False, most: Column | None = None, tie: list[str] | None = None, part: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or (strict) before its time.

    Both sides are put in one order of time, right rows before left ones at equal times (after them
    if strict), and the last right row is carried forward. Among right rows of one time the last by
    the columns of `tie` counts, in their own order, nulls first. Right rows older than `most` (an interval as a Column) give nulls. Null times match
    nothing. With `part`, which gives a time's stretch (its day, say; later times must not be in earlier stretches), a key is
    ordered stretch by stretch, and the last right row of the stretches before is carried into each: a hot key is many tasks.
    """
    names = [f"_right_{v}" for v in values]
    l = left.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(left_time).alias("_at"), F.lit(0 if strict else 1).alias("_side"))  # noqa: E741
    picked = F.struct(F.col(right_time).alias("_time"), *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)])
    tie_key = F.struct(*[F.col(t) for t in tie or []], F.lit(0).alias("_none"))
    r = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("_key"), F.col(right_time).alias("_at"), F.lit(1 if strict else 0).alias("_side"), tie_key.alias("_tie"), picked.alias("_hit"))
    both = l.unionByName(r, allowMissingColumns=True)
    by = ["_key"]
    if part is not None:
        both, by = both.withColumn("_part", part(F.col("_at"))), ["_key", "_part"]
    order = W.Window.partitionBy(*by).orderBy(F.col("_at").asc_nulls_first(), "_side", "_tie").rowsBetween(W.Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_hit", ignorenulls=True).over(order)).where(F.col("_row").isNotNull())
    if part is not None:
        ends = both.groupBy(*by).agg(F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.struct("_at", "_tie"))).alias("_end"))
        before = W.Window.partitionBy("_key").orderBy(F.col("_part").asc_nulls_first()).rowsBetween(W.Window.unboundedPreceding, -1)
        carried = ends.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), F.last("_end", ignorenulls=True).over(before).alias("_carry"))
        out = out.join(carried, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_part").eqNullSafe(F.col("_p")), "left").withColumn("_last", F.coalesce("_last", "_carry"))
    fresh = F.col("_last").isNotNull() & F.col("_at").isNotNull()
    if most is not None:
        fresh = fresh & (F.col("_last._time") >= F.col("_at") - most)
    return out.select("_row.*", *[F.when(fresh, F.col(f"_last.{n}")).alias(v) for v, n in zip(values, names, strict=True)])


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined to the intervals of their key that hold them (both ends included); whole numbers.

    Intervals are listed in every bucket of `width` that they touch, points in their own, so the join
    is an equi-join whose candidates are near. An open end is null and is taken as the largest point.
    """
    last = points.agg(F.max(at)).first()[0] or 0
    iv = intervals.withColumn("_end", F.least(F.coalesce(end, F.lit(last)), F.lit(last)))
    iv = iv.where(F.col(start) <= F.col("_end")).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col("_end") / width))))
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return p.join(iv, [key, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col("_end"))).drop("_bucket", "_end")


def first_on_or_after(events: DataFrame, calendar: DataFrame, at: str, day: str, strict: bool = False) -> DataFrame:
    """Events with `_day`, the first day of the calendar at or (strict) after them; null after its last day.

    The calendar, one row a trading day, is bounded; its gaps are filled once and joined by date. A
    year's first day takes up from the last day of the years before; events before all days get the first.
    """
    days = calendar.select(F.to_date(day).alias("_d")).where("_d is not null").distinct()
    years = days.groupBy(F.year("_d").alias("_year")).agg(F.min("_d").alias("_opens"), F.max("_d").alias("_closes"))
    years = years.withColumn("_prev_year", F.lag("_closes").over(W.Window.partitionBy(F.lit(0)).orderBy("_year"))).drop("_closes")
    before = F.lag("_d").over(W.Window.partitionBy("_year").orderBy("_d"))
    spans = days.withColumn("_year", F.year("_d")).join(F.broadcast(years), "_year")
    spans = spans.withColumn("_prev", F.coalesce(before, "_prev_year", F.date_sub("_d", 1)))
    filled = spans.withColumn("_date", F.explode(F.sequence(F.date_add("_prev", 1), F.col("_d")))).select("_date", F.col("_d").alias("_day"))
    wanted = F.date_add(F.to_date(at), 1) if strict else F.to_date(at)
    first = years.agg(F.min("_opens").alias("_first"))
    dated = events.withColumn("_date", wanted).crossJoin(F.broadcast(first)).withColumn("_date", F.when(F.col("_date") < F.col("_first"), F.col("_first")).otherwise(F.col("_date")))
    return dated.join(filled, "_date", "left").drop("_date", "_first")


def keep(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order."""
    return df.withColumn("_n", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def checked_many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that fails if a key is on the right more than once."""
    twice = F.count(F.lit(1)).over(W.Window.partitionBy(*on)) > 1
    guarded = right.withColumn("_ok", F.when(twice, F.raise_error(F.lit("a key of the right side is not unique")).cast("int")).otherwise(F.lit(1)))
    joined = left.join(guarded, on, how)
    return joined.where("_ok is null or _ok = 1").drop("_ok")


def renamed(df: DataFrame, renames: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Old codes replaced by new ones."""
    r = renames.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(r, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
