"""Similarity of series by banded dynamic time warping, for the nearest neighbours of each.

Series of one length are put in blocks; each pair of blocks is a group, whose distances are an anti-diagonal dynamic
programme over the band, for a tile of pairs at a time, small enough for a core's cache. It runs in single precision first; a bound on
its rounding says which pairs may be among the k nearest, and those are worked out in double precision. (A lower bound by the
other series' envelope takes as long as that programme, and of noisy series leaves out none.)
Distances are roots of sums of squares. Every pair of series is in one group, which answers for both.
Equal series are compared once, as a class by its smallest symbol; its neighbours are given to each of its symbols.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans.lineage import stored


def standardised(x: np.ndarray) -> np.ndarray:
    """Rows less their mean over their deviation; constant rows become 0."""
    c = x - x.mean(axis=1, keepdims=True)
    sd = c.std(axis=1, keepdims=True)
    return np.divide(c, sd, out=np.zeros_like(c), where=sd > 1e-12)


def warped_squares(xt: np.ndarray, yt: np.ndarray, band: int) -> np.ndarray:
    """Squared distances along the axes after the first, which is the place in the series; xt and yt are broadcast, paths stay within `band` of the diagonal.

    Of a diagonal d the cells (i, d - i) within the band are held, from slot 1 on by i; slots beyond are infinite.
    """
    size, kind = len(xt), xt.dtype
    shape = (band + 3, *np.broadcast_shapes(xt.shape[1:], yt.shape[1:]))
    before, last, now, cost = (np.full(shape, np.inf, kind) for _ in range(4))
    before[1 + band // 2] = 0.0  # the cell (0, 0)
    for d in range(2, 2 * size + 1):
        base = -((band - d) // 2)  # i of slot 1
        low, high = max(1, d - size, base), min(size, d - 1, (d + band) // 2)
        if low <= high:
            a, b = low - base + 1, high - base + 2
            c, n = cost[a:b], now[a:b]
            np.subtract(xt[low - 1 : high], yt[d - high - 1 : d - low][::-1], out=c)
            np.multiply(c, c, out=c)
            step = (d - band) % 2  # whether slot 1 is of a larger i than on the diagonal before
            np.minimum(last[a + step : b + step], last[a - 1 + step : b - 1 + step], out=n)
            np.minimum(n, before[a:b], out=n)
            np.add(n, c, out=n)
            now[1:a] = np.inf
            now[b : band + 2] = np.inf
        else:
            now[:] = np.inf
        before, last, now = last, now, before
    return last[1 + band // 2]


def warped(x: np.ndarray, y: np.ndarray, band: int, step: int = 4096) -> np.ndarray:
    """The distance of each row of x to the same row of y; paths stay within `band` of the diagonal."""
    out = np.empty(len(x))
    for k in range(0, len(x), step):
        out[k : k + step] = warped_squares(np.ascontiguousarray(x[k : k + step].T), np.ascontiguousarray(y[k : k + step].T), band)
    return np.sqrt(out)


def all_squares(x: np.ndarray, y: np.ndarray, band: int, cells: int = 16384) -> np.ndarray:
    """Squared distances of all rows of x to all of y in single precision, by tiles of about `cells` pairs."""
    columns = -(-len(y) // -(-len(y) // 1024))
    rows = max(1, cells // columns)
    xt, out = np.ascontiguousarray(x.T, np.float32), np.empty((len(x), len(y)), np.float32)
    for c in range(0, len(y), columns):
        yt = np.ascontiguousarray(y[c : c + columns].T, np.float32)[:, None, :]
        for r in range(0, len(x), rows):
            out[r : r + rows, c : c + columns] = warped_squares(xt[:, r : r + rows, None], yt, band)
    return out


def with_slack(squares: np.ndarray, size: int, largest: float) -> np.ndarray:
    """A bound for squares in single precision below which all pairs are that may be nearer than these.

    A path has at most 2 * size cells; values of at most `largest` are rounded by a part in 2**24, and so is each step. Twice that, since both sides are rounded.
    """
    unit, cells = 2.0**-24, 2.0 * size
    off = 2.0 * unit * largest
    error = 2.0 * off * np.sqrt(cells * squares) + cells * off * off + (cells + 3.0) * unit * squares
    return squares + 2.5 * error


def envelopes(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each row within `band` of each place."""
    wide = np.pad(x, ((0, 0), (band, band)), mode="edge")
    held = np.lib.stride_tricks.sliding_window_view(wide, 2 * band + 1, axis=1)
    return held.min(axis=2), held.max(axis=2)


def lower_bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row of x and each envelope a bound that the warped distance is never below."""
    out = np.empty((len(x), len(low)))
    for k in range(len(low)):
        beyond = np.maximum(x - high[k], 0.0) + np.maximum(low[k] - x, 0.0)
        out[:, k] = np.sqrt((beyond * beyond).sum(axis=1))
    return out


def candidates(squares: np.ndarray, k: int, size: int, largest: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the pairs that may be among the k nearest of their row."""
    found = []
    for r in range(0, len(squares), step):
        some = np.ascontiguousarray(squares[r : r + step])
        bar = np.full(len(some), np.inf)
        if some.shape[1] > k:
            bar = with_slack(np.partition(some, k - 1, axis=1)[:, k - 1].astype(float), size, largest)
        i, j = np.nonzero(np.isfinite(some) & (some <= bar[:, None]))
        found.append((i + r, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def nearest_in_block(x: np.ndarray, y: np.ndarray, same: bool, band: int, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row of x its k nearest rows of y as (row, row, distance), ties by row; then of each row of y those of x, unless both are one block, where a row is not its own."""
    squares = all_squares(x, y, band)
    if same:
        np.fill_diagonal(squares, np.inf)
    largest = max(np.abs(x).max(), np.abs(y).max())
    out = []
    for a, b, held in [(x, y, squares)] if same else [(x, y, squares), (y, x, squares.T)]:
        i, j = candidates(held, k, x.shape[1], largest)
        d = np.concatenate([np.zeros(0), *[warped(a[i[c : c + 65536]], b[j[c : c + 65536]], band) for c in range(0, len(i), 65536)]])
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[first], j[first], d[first]))
    return out


def nearest(series: DataFrame, k: int, band: int, block: int = 8192) -> DataFrame:
    """src, dst, distance: the k nearest of each symbol's series by warped distance, ties by dst.

    series: symbol, values (an array without nulls; of symbols whose length is not the commonest there is none here). Values are standardised.
    Of a class of equal series the k + 1 smallest symbols are all that others, or the class itself, can ask for.
    """
    spark = series.sparkSession
    series = stored(series.select(F.col("symbol").cast("long").alias("symbol"), F.col("values").cast("array<double>").alias("values")))
    common = series.groupBy(F.size("values").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], "src long, dst long, distance double")
    rows = series.where(F.size("values") == common["n"])
    classes = stored(rows.groupBy("values").agg(F.min("symbol").alias("symbol")))
    members = stored(rows.join(classes.withColumnRenamed("symbol", "of"), "values").select("of", "symbol"))
    place = F.row_number().over(W.Window.partitionBy("of").orderBy("symbol"))
    first = members.withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("of").agg(F.array_sort(F.collect_list("symbol")).alias("first"))  # k + 1 a class
    near = nearest_classes(classes, k, band, block).select(F.col("src").alias("of"), F.col("dst").alias("near"), "distance")
    own = first.select("of", F.col("of").alias("near"), F.lit(0.0).alias("distance"))
    held = near.unionByName(own).join(first.withColumnRenamed("of", "near"), "near").select("of", "distance", F.explode("first").alias("dst"))
    found = held.groupBy("of").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "dst"))), 1, k + 1).alias("found"))  # (k + 1) squared a class at most
    others = F.slice(F.filter("found", lambda p: p["dst"] != F.col("symbol")), 1, k)
    return members.join(found, "of").select(F.col("symbol").alias("src"), F.explode(others).alias("p")).select("src", "p.dst", "p.distance")


def nearest_classes(rows: DataFrame, k: int, band: int, block: int) -> DataFrame:
    """src, dst, distance: the k nearest of each of the series, by all pairs of blocks; a group holds two blocks and a matrix of their pairs in single precision."""
    count = rows.count()
    blocks = max(1, -(-count // block), min(32, count // 512))
    own = rows.withColumn("own", F.pmod(F.xxhash64("symbol"), F.lit(blocks)))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = own.select("symbol", "values", "own", others).select("symbol", "values", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("symbol")
        ids, own = group["symbol"].to_numpy(), group["own"].to_numpy()
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        matrix = standardised(group["values"].chunk(0).flatten().to_numpy().reshape(len(ids), -1))
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        found = []
        if len(left) and len(right):
            sides = [(left, right), (right, left)]
            found = [(ids[s[i]], ids[t[j]], d) for (s, t), (i, j, d) in zip(sides, nearest_in_block(matrix[left], matrix[right], a == b, band, k), strict=False)]
        whole = [np.concatenate([np.zeros(0, kind), *[f[c] for f in found]]) for c, kind in enumerate((np.int64, np.int64, float))]
        return pa.table(whole, names=["src", "dst", "distance"])

    pairs = blocks * (blocks + 1) // 2
    local = sent.repartition(min(pairs, 4000), "a", "b").groupBy("a", "b").applyInArrow(run, "src long, dst long, distance double")  # a group is long work on few bytes: not put together by size
    place = F.row_number().over(W.Window.partitionBy("src").orderBy("distance", "dst"))
    return local.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def similarity_graph(series: DataFrame, k: int, band: int) -> DataFrame:
    """src, dst, w: the k nearest neighbours with similarity 1 / (1 + distance)."""
    return nearest(series, k, band).select("src", "dst", (1 / (1 + F.col("distance"))).alias("w"))
