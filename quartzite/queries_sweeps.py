"""Queries of trades against books, with SQL written apart from the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import sweeps
from .queries_panel import _add
from .sources import panels

#: A day: the events are sparser than books of an exchange.
_STALE = 86_400_000


def ladders(s: SparkSession, d: str) -> DataFrame:
    """Every third event as a book of its user's group: five steps of a half around a price."""
    e = panels.table(s, d, "events").where("event_id % 3 = 0")
    at = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: 100 + F.col("event_id") % 5 + sign * i * 0.5)
    sizes = lambda k: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: 1 + (F.col("event_id") + k * i) % 4)
    return e.select((F.col("user_id") % 20).alias("symbol"), F.col("ts").alias("at"), at(1).alias("ask_price"), sizes(1).alias("ask_volume"), at(-1).alias("bid_price"), sizes(3).alias("bid_volume"))


def prints(s: SparkSession, d: str) -> DataFrame:
    """All other events as trades of their user's group."""
    e = panels.table(s, d, "events").where("event_id % 3 > 0")
    price = 100 + F.col("event_id") % 11 * 0.5
    return e.select("event_id", (F.col("user_id") % 20).alias("symbol"), F.col("ts").alias("at"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"), price.alias("price"), (1 + F.col("event_id") % 7).alias("volume"), (price * (1 + F.col("event_id") % 7)).alias("amount"))


_MARKED = f"""(with b as (select user_id % 20 as symbol, ts as book_at, list_transform(range(1, 6), lambda i: 100 + event_id % 5 + i * 0.5e0) as ap, list_transform(range(1, 6), lambda i: 1 + (event_id + i) % 4) as av, list_transform(range(1, 6), lambda i: 100 + event_id % 5 - i * 0.5e0) as bp, list_transform(range(1, 6), lambda i: 1 + (event_id + 3 * i) % 4) as bv from events where event_id % 3 = 0),
 t as (select event_id, user_id % 20 as symbol, ts, event_id % 2 = 0 as buys, 100 + event_id % 11 * 0.5e0 as price, 1 + event_id % 7 as volume from events where event_id % 3 > 0),
 j as (select t.*, b.* exclude (symbol), row_number() over (partition by event_id order by book_at desc nulls last, ap desc, av desc, bp desc, bv desc) as pick from t left join b on b.symbol = t.symbol and b.book_at < t.ts),
 m as (select *, case when book_at is not null then case when buys then len(list_filter(ap, lambda p: p <= price)) else len(list_filter(bp, lambda p: p >= price)) end end as levels, volume / list_sum(case when buys then av else bv end)::double as consumed,
  case when buys then price / ap[1] - 1 else 1 - price / bp[1] end as distance, epoch_us(ts) // 1000 - epoch_us(book_at) // 1000 as lag_ms from j where pick = 1)
 select event_id, symbol, ts, buys, price * volume as amount, levels, consumed, distance, lag_ms, case when book_at is null then 'missing_reference_book' when levels = 0 then 'price_not_on_ladder' when lag_ms > {_STALE} then 'stale_alignment' else 'ok' end as flag from m)"""
_add("book_reach", lambda s, d: sweeps.against_book(prints(s, d), ladders(s, d), _STALE), _MARKED, ["event_id", "symbol", "levels", "lag_ms", "flag"], ["consumed", "distance"])
_DAYS = f"""(select symbol, cast(cast(ts as date) as varchar) as day, count(*) as events, count(*) filter (flag = 'ok') as usable, count(*) filter (flag <> 'ok') / count(*)::double as ambiguous_share, count(*) filter (flag = 'ok' and levels > 1) as sweeps,
 avg(case when levels > 1 then 1e0 else 0 end) filter (flag = 'ok') as sweep_share, sum(amount) filter (flag = 'ok' and levels > 1) / sum(amount) filter (flag = 'ok') as sweep_amount_share, avg(levels) filter (flag = 'ok') as mean_levels, avg(consumed) filter (flag = 'ok') as mean_consumed, avg(distance) filter (flag = 'ok') as mean_distance,
 avg(case when levels > 1 then 1e0 else 0 end) filter (flag = 'ok' and buys) as buy_share, avg(case when levels > 1 then 1e0 else 0 end) filter (flag = 'ok' and not buys) as sell_share,
 avg(case when levels > 1 then 1e0 else 0 end) filter (flag = 'ok' and buys) - avg(case when levels > 1 then 1e0 else 0 end) filter (flag = 'ok' and not buys) as asymmetry, quantile_cont(lag_ms, 0.5) filter (flag = 'ok') as median_lag_ms, avg(amount) filter (flag = 'ok') as mean_amount from {_MARKED} group by 1, 2)"""
_add("sweep_penetration", lambda s, d: sweeps.sweeps_by_day(sweeps.against_book(prints(s, d), ladders(s, d), _STALE)).withColumn("day", F.col("day").cast("string")), _DAYS, ["symbol", "day", "events", "usable", "sweeps"], ["ambiguous_share", "sweep_share", "sweep_amount_share", "mean_levels", "mean_consumed", "mean_distance", "buy_share", "sell_share", "asymmetry", "median_lag_ms", "mean_amount"])
