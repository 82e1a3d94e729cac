"""How order books change from one snapshot to the next, on a grid of a few seconds.

Snapshots have symbol, day (text), at, seq (order among equal times), bid_price, bid_volume, ask_price,
ask_volume (arrays, best first), acc_amount and acc_volume (the day's trading so far). All windows share
one partitioning and one order, by symbol and day, so a plan has one exchange and one sort for the grid
and one for the dynamics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Seconds of the day at which sessions begin and end.
SESSIONS = ((34_200, 41_400), (46_800, 54_000))
FACTORS = ["time_weighted_order_slope", "wavg_soir", "net_buy_quote_ratio", "level10_diff_buy", "level10_infer_price_trend"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def valid_books(books: DataFrame, levels: int = 10) -> DataFrame:
    """Books with all levels on both sides, neither crossed nor empty; null prices and volumes count 0 from here on."""
    sides = ["bid_price", "bid_volume", "ask_price", "ask_volume"]
    d = books.where(" and ".join(f"size({c}) >= {levels}" for c in sides))
    d = d.withColumns({c: F.transform(F.slice(c, 1, levels), lambda x: F.coalesce(x.cast("double"), F.lit(0.0))) for c in sides})
    best = F.get("bid_price", F.lit(0)), F.get("ask_price", F.lit(0))
    least = F.least(F.array_min("bid_volume"), F.array_min("ask_volume"))
    return d.where((best[0] > 0) & (best[1] >= best[0]) & (least >= 0) & (_sum(F.col("bid_volume")) + _sum(F.col("ask_volume")) > 0))


def on_grid(books: DataFrame, seconds: int = 3, most: int = 20, sessions: tuple[tuple[int, int], ...] = SESSIONS) -> DataFrame:
    """The last book of each slot of the sessions; a slot without one has the last before it in its session, `most` slots back at the furthest.

    Adds slot (number of the day's slot of so many seconds), session (from 0) and age (slots since the book). Books outside of sessions are left out.
    """
    second = F.hour("at") * 3600 + F.minute("at") * 60 + F.second("at")
    session, end = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (begins, ends) in enumerate(sessions):
        inside = (second >= begins) & (second < ends)
        session, end = F.when(inside, k).otherwise(session), F.when(inside, (ends - 1) // seconds).otherwise(end)
    d = books.withColumns({"_own": F.floor(second / seconds).cast("int"), "session": session, "_end": end}).where("session is not null")
    following = F.lead("_own").over(W.Window.partitionBy("symbol", "day", "session").orderBy("at", "seq"))
    d = d.withColumn("_next", following).where("_next is null or _next > _own")
    last = F.least(F.coalesce(F.col("_next") - 1, F.col("_end")), F.col("_own") + most)
    d = d.withColumn("slot", F.explode(F.sequence("_own", last)))
    return d.withColumn("age", F.col("slot") - F.col("_own")).drop("_own", "_next", "_end")


def ladder(prices: Column, volumes: Column) -> Column:
    """A map of price to volume; of a price that repeats, the first level counts."""
    levels = F.transform(prices, lambda p, i: F.struct(p.alias("p"), F.get(volumes, i).alias("v"), i.alias("i")))
    first = F.filter(levels, lambda x: F.array_position(prices, x["p"]) == x["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["p"], x["v"])))


def ladder_change(now: Column, before: Column) -> Column:
    """Two ladders merged by price: the change of the volume at each price that either has."""
    return F.map_zip_with(now, before, lambda _, a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))


def change_amount(change: Column, low: Column, high: Column) -> Column:
    """Sum of price times change over the prices from low to high."""
    held = F.map_entries(F.map_filter(change, lambda p, _: (p >= low) & (p <= high)))
    return F.aggregate(held, F.lit(0.0), lambda a, x: a + x["key"] * x["value"])


def with_dynamics(grid: DataFrame, order: tuple[str, ...] = ("slot",), near: int = 20, far: int = 60, floor: float = 1e-7) -> DataFrame:
    """grid with FACTORS, and what they are made of, at every row of a symbol's day.

    bid_change, ask_change: quoted volume that came or went at the best prices. net_buy_quote_ratio: their
    balance, weighed by the price of the trades between two rows, over the last `near` rows.
    level10_diff_buy: amount by which the bid ladder changed, price by price, above the higher of both
    lowest prices, summed over `near` rows. wavg_soir: level-weighted imbalance, standardised by the
    near - 1 rows before. time_weighted_order_slope: spread of log prices over the mean of log volume
    ratios, which counts as 0 below 1e-9. level10_infer_price_trend: mean slope of the depth-weighted price over `far` rows.
    """
    w = W.Window.partitionBy("symbol", "day").orderBy(*order)
    run = w.rowsBetween(W.Window.unboundedPreceding, 0)
    back = lambda n: w.rowsBetween(1 - n, 0)
    before = lambda c: F.lag(c).over(w)
    filled = lambda c: F.last(c, ignorenulls=True).over(run)
    zero = F.lit(0.0)
    over = lambda a, b: a / F.nullif(b, zero)

    best = {"bid1": F.get("bid_price", F.lit(0)), "ask1": F.get("ask_price", F.lit(0)), "bid_qty1": F.get("bid_volume", F.lit(0)), "ask_qty1": F.get("ask_volume", F.lit(0))}
    d = grid.withColumns(best)
    ask, bid = F.when(F.col("ask1") == 0, F.col("bid1")).otherwise(F.col("ask1")), F.when(F.col("bid1") == 0, F.col("ask1")).otherwise(F.col("bid1"))
    both = F.transform("bid_volume", lambda b, i: F.struct(b.alias("b"), F.get("ask_volume", i).alias("a"), (F.lit(10.0) - i).alias("w")))
    there = F.filter(both, lambda x: x["b"] + x["a"] > 0)
    depth = _sum(F.col("bid_volume")) + _sum(F.col("ask_volume"))
    value = _sum(F.zip_with("bid_price", "bid_volume", lambda p, v: p * v)) + _sum(F.zip_with("ask_price", "ask_volume", lambda p, v: p * v))
    d = d.withColumns({
        "_log_spread": F.when((ask > 0) & (bid > 0), F.log(ask) - F.log(bid)),
        "_log_ratio": F.when((F.col("bid_qty1") > 0) & (F.col("ask_qty1") > 0), F.log("ask_qty1") - F.log("bid_qty1")),
        "_soir_raw": over(_sum(F.transform(there, lambda x: x["w"] * (x["b"] - x["a"]) / (x["b"] + x["a"]))), _sum(F.transform(there, lambda x: x["w"]))),
        "_infer_raw": F.when((F.col("bid1") > 0) & (F.col("ask1") > 0), over(value, depth)),
        "_ladder": ladder(F.col("bid_price"), F.col("bid_volume")),
    })

    d = d.withColumns({
        "_n": F.row_number().over(w).cast("double"),
        **{f"_before_{c}": before(c) for c in ("bid1", "ask1", "bid_qty1", "ask_qty1", "acc_amount", "acc_volume", "_ladder", "bid_price")},
        "_ratio": filled("_log_ratio"),
        "soir": F.coalesce(filled("_soir_raw"), zero),
        "infer_price": filled("_infer_raw"),
    })
    b = lambda c: F.col(f"_before_{c}")
    bid_step = F.round(F.col("bid1") - b("bid1"), 2)
    ask_up = F.when(F.col("ask1") == 0, F.when(b("ask1") > 0, 1.0).otherwise(0.0)).otherwise(F.col("ask1") - b("ask1"))
    ask_down = F.when(b("ask1") == 0, F.when(F.col("ask1") > 0, -1.0).otherwise(0.0)).otherwise(F.when(F.col("ask1") > 0, F.col("ask1") - b("ask1")).otherwise(1.0))
    bid_change = F.when(bid_step > 0, F.col("bid_qty1")).when(bid_step < 0, -b("bid_qty1")).otherwise(F.col("bid_qty1") - b("bid_qty1"))
    ask_change = F.when(ask_up > 0, b("ask_qty1")).when(ask_down < 0, F.col("ask_qty1")).otherwise(F.col("ask_qty1") - b("ask_qty1"))
    empty = F.map_filter("_ladder", lambda p, v: F.lit(False))
    low = F.greatest(F.array_min("bid_price"), F.coalesce(F.array_min(b("bid_price")), zero))
    high = F.greatest(F.array_max("bid_price"), F.coalesce(F.array_max(b("bid_price")), zero))
    d = d.withColumns({
        "bid_change": bid_change,
        "ask_change": ask_change,
        "trade_price": over(F.col("acc_amount") - b("acc_amount"), F.col("acc_volume") - b("acc_volume")),
        "ladder_amount": change_amount(ladder_change(F.col("_ladder"), F.coalesce(b("_ladder"), empty)), low, high),
        "_before_soir": before("soir"),
    })
    flow = over(F.col("bid_change") - F.col("ask_change"), F.abs("bid_change") + F.abs("ask_change")) * F.col("trade_price")
    d = d.withColumn("_flow", flow)

    stat = lambda f, c, n: f(c).over(back(n))
    spread, slope_rows = stat(F.stddev_pop, "_before_soir", near - 1), stat(F.count, "infer_price", far)
    slope = over(F.covar_pop("_n", "infer_price").over(back(far)), stat(F.var_pop, "_n", far))
    d = d.withColumns({
        "_ratio_mean": F.coalesce(stat(F.avg, "_ratio", near), zero),
        "_soir_z": F.when(spread >= floor, (F.col("soir") - stat(F.avg, "_before_soir", near - 1)) / spread),
        "net_buy_quote_ratio": F.coalesce(over(stat(F.sum, "_flow", near), stat(F.sum, "trade_price", near)), zero),
        "level10_diff_buy": F.coalesce(stat(F.sum, "ladder_amount", near), zero),
        "_slope": F.when(slope_rows == far, F.coalesce(slope, zero)).otherwise(zero),
    })
    d = d.withColumns({
        "time_weighted_order_slope": F.when(F.abs("_ratio_mean") >= 1e-9, F.col("_log_spread") / F.col("_ratio_mean")),
        "wavg_soir": F.coalesce(filled("_soir_z"), zero),
        "level10_infer_price_trend": stat(F.avg, "_slope", near),
    })
    return d.drop(*[c for c in d.columns if c.startswith("_")], *best)


def by_day(series: DataFrame, bucket: Column, guard: float = 1e6) -> DataFrame:
    """By symbol and day: mean over the buckets (minutes, say) of each factor's last value in them, with counts of buckets, nulls and values beyond the guard."""
    held = series.withColumn("_bucket", bucket)
    last = held.groupBy("symbol", "day", "_bucket").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max_by(f, "slot").alias(f) for f in FACTORS],
        *[F.count_if(F.col(f).isNull()).alias(f"_{f}_null") for f in FACTORS],
        *[F.count_if(F.abs(f) > guard).alias(f"_{f}_clip") for f in FACTORS],
    )
    sums = [(f"_{f}_{k}", f"{f}_{k}s") for f in FACTORS for k in ("null", "clip")]
    return last.groupBy("symbol", "day").agg(
        F.sum("_rows").alias("snapshots"), F.count(F.lit(1)).alias("buckets"),
        *[F.avg(f).alias(f"{f}_mean") for f in FACTORS], *[F.count(f).alias(f"{f}_valid") for f in FACTORS],
        *[F.sum(c).alias(name) for c, name in sums],
    )
