"""Order-book formulas over arrays of ten levels (bid and ask volumes and prices), as SQL text.

All are expressions over one row: arrays stay arrays and nothing is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def side_sum(volumes: Column, levels: int) -> Column:
    return F.aggregate(F.slice(volumes, 1, levels), F.lit(0.0), lambda a, x: a + x)


def imbalance(bid: Column, ask: Column, levels: int) -> Column:
    """(bid depth - ask depth) / (bid depth + ask depth) over the first levels."""
    b, a = side_sum(bid, levels), side_sum(ask, levels)
    return F.try_divide(b - a, F.nullif(b + a, F.lit(0.0)))


def weighted_imbalance(bid: Column, ask: Column) -> Column:
    """Imbalance with level k weighing 1/k."""
    w = lambda v: F.aggregate(F.transform(v, lambda x, i: x / (i + 1)), F.lit(0.0), lambda a, x: a + x)
    b, a = w(bid), w(ask)
    return F.try_divide(b - a, F.nullif(b + a, F.lit(0.0)))


def relative_spread(bid_price: Column, ask_price: Column) -> Column:
    b, a = F.element_at(bid_price, 1), F.element_at(ask_price, 1)
    return F.try_divide(a - b, F.nullif((a + b) / 2, F.lit(0.0)))


def microprice_deviation(bid: Column, ask: Column, bid_price: Column, ask_price: Column) -> Column:
    b, a, p, q = F.element_at(bid, 1), F.element_at(ask, 1), F.element_at(bid_price, 1), F.element_at(ask_price, 1)
    mid = (p + q) / 2
    return F.try_divide((p * a + q * b) / F.nullif(a + b, F.lit(0.0)) - mid, F.nullif(mid, F.lit(0.0)))


def near_far(bid: Column, ask: Column, near: int = 3) -> Column:
    """Imbalance of the near levels less that of all."""
    return imbalance(bid, ask, near) - imbalance(bid, ask, 10)


def concentration(volumes: Column) -> Column:
    """Sum of squared shares of the levels."""
    total = side_sum(volumes, 10)
    return F.try_divide(F.aggregate(volumes, F.lit(0.0), lambda a, x: a + x * x), F.nullif(total * total, F.lit(0.0)))


def depth_slope(volumes: Column) -> Column:
    """Slope of volume on level by least squares (levels 1 to 10: mean 5.5, sum of squares 82.5)."""
    return F.aggregate(F.transform(volumes, lambda x, i: x * (i + 1 - 5.5)), F.lit(0.0), lambda a, x: a + x) / 82.5


def side_vwap(volumes: Column, prices: Column) -> Column:
    value = F.aggregate(F.zip_with(volumes, prices, lambda v, p: v * p), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(value, F.nullif(side_sum(volumes, 10), F.lit(0.0)))


def log_depth(bid: Column, ask: Column) -> Column:
    return F.log1p(side_sum(bid, 10) + side_sum(ask, 10))


def entropy(volumes: Column) -> Column:
    total = side_sum(volumes, 10)
    share = F.transform(volumes, lambda x: x / F.nullif(total, F.lit(0.0)))
    return -F.aggregate(F.transform(share, lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / F.log(F.lit(10.0))


def wall(volumes: Column) -> Column:
    """Share of the largest level."""
    return F.try_divide(F.array_max(volumes), F.nullif(side_sum(volumes, 10), F.lit(0.0)))


def snapshot_metrics(bid: Column, ask: Column, bid_price: Column, ask_price: Column) -> dict[str, Column]:
    mid = (F.element_at(bid_price, 1) + F.element_at(ask_price, 1)) / 2
    return {
        **{f"obi_{k}": imbalance(bid, ask, k) for k in (1, 5, 10)},
        "weighted_obi": weighted_imbalance(bid, ask),
        "relative_spread": relative_spread(bid_price, ask_price),
        "microprice_deviation": microprice_deviation(bid, ask, bid_price, ask_price),
        "near_far_imbalance": near_far(bid, ask),
        "bid_hhi": concentration(bid),
        "ask_hhi": concentration(ask),
        "bid_slope": depth_slope(bid),
        "ask_slope": depth_slope(ask),
        "book_vwap_gap": F.try_divide(side_vwap(ask, ask_price) - side_vwap(bid, bid_price), F.nullif(mid, F.lit(0.0))),
        "log_depth": log_depth(bid, ask),
        "bid_entropy": entropy(bid),
        "bid_wall": wall(bid),
        "ask_wall": wall(ask),
    }
