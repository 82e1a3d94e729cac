"""Trades against the last book before them: how far into the ladder they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import asof


def against_book(trades: DataFrame, books: DataFrame, stale_ms: int = 5000) -> DataFrame:
    """trades with levels, consumed, distance, lag_ms and flag, taken from the last book of their symbol strictly before them.

    trades: symbol, at, side (1 buys from the asks, -1 sells to the bids), price, volume, amount. books: symbol, at, ask_price,
    ask_volume, bid_price, bid_volume (arrays, best first). Books without both best prices, or crossed, are left out; null
    volumes and prices within a ladder count 0. levels: ladder prices above 0 that the trade's price reaches; consumed: its
    volume over the side's depth; distance: how far its price lies beyond the best, relative to that.
    flag: missing_reference_book, price_not_on_ladder, stale_alignment (a lag above stale_ms) or ok; the first that holds.
    """
    filled = lambda c: F.transform(F.col(c), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    ladder = F.struct(F.col("at").alias("book_at"), *[filled(c).alias(c) for c in ("ask_price", "ask_volume", "bid_price", "bid_volume")])
    ask, bid = F.get("ask_price", F.lit(0)), F.get("bid_price", F.lit(0))
    valid = books.where((ask > 0) & (bid > 0) & (ask >= bid)).select("symbol", "at", ladder.alias("book"))
    d = asof(trades, valid, "symbol", "at", "at", ["book"], strict=True, tie=["book"], part=F.to_date)
    buys = F.col("side") == 1
    prices = F.when(buys, F.col("book.ask_price")).otherwise(F.col("book.bid_price"))
    depth = F.aggregate(F.when(buys, F.col("book.ask_volume")).otherwise(F.col("book.bid_volume")), F.lit(0.0), lambda a, x: a + x)
    best = F.get(prices, F.lit(0))
    beyond = F.col("side") * (F.col("price") - best)
    reached = F.size(F.filter(prices, lambda p: (p > 0) & (F.col("side") * (F.col("price") - p) >= 0)))
    d = d.withColumns({
        "levels": F.when(F.col("book").isNotNull(), reached),
        "consumed": F.col("volume") / F.nullif(depth, F.lit(0.0)),
        "distance": beyond / F.nullif(best, F.lit(0.0)),
        "lag_ms": F.unix_millis(F.col("at").cast("timestamp")) - F.unix_millis(F.col("book.book_at").cast("timestamp")),
    })
    flag = (
        F.when(F.col("book").isNull(), "missing_reference_book")
        .when((beyond < -1e-6) | (F.col("levels") == 0) | F.col("price").isNull(), "price_not_on_ladder")
        .when(F.col("lag_ms") > stale_ms, "stale_alignment")
        .otherwise("ok")
    )
    return d.withColumn("flag", flag).drop("book")


def sweeps_by_day(marked: DataFrame) -> DataFrame:
    """By symbol and day, from against_book: trades, usable ones (flag ok), and among these the share and amount of sweeps, which reach two levels or more.

    The asymmetry is the share of sweeps among buys less that among sells; means, shares and the exact median of the lag are of usable trades.
    """
    usable = F.col("flag") == "ok"
    sweep = usable & (F.col("levels") >= 2)
    n, ok, swept = F.count(F.lit(1)), F.count_if(usable), F.count_if(sweep)
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    of = lambda c: F.when(usable, F.col(c))
    share = lambda side: over(F.count_if(sweep & (F.col("side") == side)), F.count_if(usable & (F.col("side") == side)))
    return marked.groupBy("symbol", F.to_date("at").alias("day")).agg(
        n.alias("events"), ok.alias("usable"), (1 - ok / n).alias("ambiguous_share"), swept.alias("sweeps"), over(swept, ok).alias("sweep_share"),
        over(F.sum(F.when(sweep, F.col("amount"))), F.sum(of("amount"))).alias("sweep_amount_share"),
        F.avg(of("levels")).alias("mean_levels"), F.avg(of("consumed")).alias("mean_consumed"), F.avg(of("distance")).alias("mean_distance"),
        share(1).alias("buy_share"), share(-1).alias("sell_share"), (share(1) - share(-1)).alias("asymmetry"),
        F.median(of("lag_ms")).alias("median_lag_ms"), F.avg(of("amount")).alias("mean_amount"),
    )
