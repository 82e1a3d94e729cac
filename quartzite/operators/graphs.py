"""Relation graphs: neighbours by similarity, normalised weights, ranks, and filters by time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans.lineage import cut, stored


def top_neighbours(weights: DataFrame, k: int) -> DataFrame:
    """src, dst, w: the k heaviest edges out of each node; ties by dst; loops are left out."""
    order = W.Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return weights.where("src <> dst").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges in both directions with the larger weight, each divided by the root of the product of its ends' sums."""
    both = edges.select("src", "dst", "w").union(edges.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    d = both.withColumn("_s", F.sum("w").over(W.Window.partitionBy("src"))).withColumn("_d", F.sum("w").over(W.Window.partitionBy("dst")))
    return d.select("src", "dst", (F.col("w") / F.sqrt(F.col("_s") * F.col("_d"))).alias("w"))


def page_rank(edges: DataFrame, alpha: float = 0.85, rounds: int = 30, near: float = 1e-8) -> DataFrame:
    """node, rank: edges share a node's rank by weight, nodes without edges out share theirs with all.

    Ends after `rounds`, or once the ranks change by less than `near` in sum; each round is a checkpoint.
    """
    out = cut(edges.withColumn("share", F.col("w") / F.sum("w").over(W.Window.partitionBy("src"))).select("src", "dst", "share"))
    nodes = out.select(F.col("src").alias("node")).union(out.select("dst")).distinct()
    n = max(nodes.count(), 1)
    ends = out.select(F.col("src").alias("node"), F.lit(True).alias("has")).distinct()
    state = cut(nodes.join(ends, "node", "left").select("node", F.coalesce("has", F.lit(False)).alias("has"), F.lit(1.0 / n).alias("rank"), F.lit(1.0).alias("change")))
    for _ in range(rounds):
        sums = state.agg(F.sum(F.when(~F.col("has"), F.col("rank"))).alias("lost"), F.sum("change").alias("change")).first()
        if (sums["change"] or 0.0) < near:
            break
        spread = (1 - alpha) / n + alpha * (sums["lost"] or 0.0) / n
        got = out.join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit(spread) + F.lit(alpha) * F.coalesce("got", F.lit(0.0))
        state = cut(state.join(got, "node", "left").select("node", "has", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
    return state.select("node", "rank")


def known_edges(edges: DataFrame, at: str, known: str) -> DataFrame:
    """Edges that were known on the date they are used."""
    return edges.where(F.col(known) <= F.col(at))


def check_no_future(edges: DataFrame, at: str, known: str) -> DataFrame:
    """edges, whose reading raises on one that was not known on its date."""
    return edges.where(F.when(F.col(known) <= F.col(at), F.lit(True)).otherwise(F.raise_error(F.lit("an edge lies in the future")).cast("boolean")))


def block_count(classes: int, block: int, write_all: bool) -> int:
    """Blocks of at least 1024 classes, 24 of them until they are above `block`; where all pairs are written, many tasks write those of few classes."""
    return max(1, -(-classes // block), min(24, classes // 1024), min(16, classes // 32) if write_all else 0)


def _class_pairs(panel: DataFrame, value: str, least: int, block: int, most: int | None, tile: int = 256, width: int = 2048) -> DataFrame:
    """firsts, seconds, n, w: two classes of symbols whose values are equal on equal dates, with their correlation; a class with itself too.

    Symbols of a class are ascending; a class is an array as long as it has symbols. Classes are put in blocks of rows over the
    panel's dates; each pair of blocks is one group, whose sums over common dates are matrix products (of values, squares and
    marks of presence), a tile of rows and columns at a time. A block is sent to as many groups as there are blocks: 24 at most, so that what
    is sent grows as the panel does, and more only where a block would be above `block` classes (16384 of them over 365 dates are 50 MB).
    most: a class's pairs come in both directions, only those that may be among the `most` heaviest edges out of one of its symbols to larger ones.
    """
    p = panel.where(F.col(value).isNotNull()).select(F.col("symbol").cast("long").alias("symbol"), "td", F.col(value).cast("double").alias("v"))
    series = p.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("td", "v"))).alias("s")).select("symbol", F.col("s.td").alias("days"), F.col("s.v").alias("values"))  # a row a symbol, as long as the panel
    classes = stored(series.groupBy("days", "values").agg(F.array_sort(F.collect_list("symbol")).alias("ids")))
    count = classes.count()
    blocks = block_count(count, block, most is None)
    own = classes.withColumn("own", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = own.select("ids", "days", "values", "own", others).select("ids", "days", "values", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).combine_chunks()
        ids, days = group["ids"].chunk(0), group["days"].chunk(0)
        low = np.array([v[0].as_py() for v in ids])
        last = np.array([v[-1].as_py() for v in ids])
        members = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        lengths = np.diff(days.offsets.to_numpy())
        row, day = np.repeat(np.arange(len(lengths)), lengths), days.flatten().to_numpy()
        day = day - day.min()
        v = group["values"].chunk(0).flatten().to_numpy()
        x, there = np.zeros((len(lengths), day.max() + 1)), np.zeros((len(lengths), day.max() + 1))
        x[row, day], there[row, day] = v - (np.bincount(row, v) / lengths)[row], 1.0
        own, a, b = group["own"].to_numpy(), group["a"][0].as_py(), group["b"][0].as_py()
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        sides = [(left, right)] if a == b or most is None else [(left, right), (right, left)]
        for rows, columns in sides:
            for at in range(0, len(rows), tile):
                some = rows[at : at + tile]
                t, t_there = x[some], there[some]
                tt, t_marks = t * t, t_there.astype(np.float32)
                n, w = np.empty((len(some), len(columns)), np.float32), np.empty((len(some), len(columns)))
                for c in range(0, len(columns), width):
                    y, y_there = x[columns[c : c + width]], there[columns[c : c + width]]
                    m = t_marks @ y_there.astype(np.float32).T  # counts are exact in single precision
                    sx, sy, sxx, syy, sxy = t @ y_there.T, t_there @ y.T, tt @ y_there.T, t_there @ (y * y).T, t @ y.T
                    safe = np.maximum(m, 1.0).astype(float)
                    cov, vx, vy = sxy / safe - (sx / safe) * (sy / safe), sxx / safe - (sx / safe) ** 2, syy / safe - (sy / safe) ** 2
                    size = np.sqrt(np.maximum(vx, 0.0) * np.maximum(vy, 0.0))
                    flat = size <= 1e-12 * np.sqrt(sxx * syy) / safe  # a class that doesn't vary over the common dates
                    n[:, c : c + width], w[:, c : c + width] = m, np.divide(cov, size, out=np.full_like(cov, np.nan), where=~flat)
                pair = n >= least
                if most is None and a == b:
                    pair &= low[some][:, None] <= low[columns][None, :]
                if most is not None:
                    pair &= last[columns][None, :] > low[some][:, None]
                    # classes with a symbol above all of the row's give an edge to each of them: no lighter class than the `most` heaviest of those is needed
                    sure = np.where(pair & (last[columns][None, :] > last[some][:, None]), np.nan_to_num(w, nan=-2.0), -np.inf)
                    if sure.shape[1] >= most:
                        bar = -np.partition(-sure, most - 1, axis=1)[:, most - 1]
                        pair &= np.nan_to_num(w, nan=-2.0) >= bar[:, None]
                i, j = np.nonzero(pair)
                held = np.cumsum(members[some[i]] + members[columns[j]]) // (1 << 20)  # batches of a million symbols
                ends = np.flatnonzero(np.diff(held, append=-1)) + 1
                for first, end in zip(np.concatenate([[0], ends[:-1]]).astype(int), ends, strict=True):
                    i_, j_ = i[first:end], j[first:end]
                    found = w[i_, j_]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[i_])), ids.take(pa.array(columns[j_])), pa.array(n[i_, j_].astype(np.int64)), pa.array(found, mask=np.isnan(found))], ["firsts", "seconds", "n", "w"])

    pairs = blocks * (blocks + 1) // 2
    return sent.repartition(min(pairs, 4000), "a", "b").groupBy("a", "b").applyInArrow(run, "firsts array<long>, seconds array<long>, n long, w double")


def return_correlations(panel: DataFrame, value: str, least: int, block: int = 16384) -> DataFrame:
    """src, dst, w, n: Pearson correlation of two symbols (src < dst) over the dates that both have, `least` of them at least.

    Symbols of equal values are one class: its correlations are worked out once, and the pairs of symbols come from those of classes.
    """
    pairs = _class_pairs(panel, value, least, block, None).select(F.explode("firsts").alias("a"), "seconds", "n", "w", (F.col("firsts")[0] == F.col("seconds")[0]).alias("same"))
    pairs = pairs.select("a", F.explode("seconds").alias("b"), "n", "w", "same").where("not same or a < b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "n", "w")


def heaviest_correlations(panel: DataFrame, value: str, least: int, k: int, block: int = 16384) -> DataFrame:
    """src, dst, w: top_neighbours of return_correlations, from classes alone: of a class a symbol takes its k next larger symbols."""
    pairs = _class_pairs(panel, value, least, block, k).select("firsts", "seconds", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            single = (np.diff(b.column(0).offsets.to_numpy()) == 1) & (np.diff(b.column(1).offsets.to_numpy()) == 1)
            one = b.filter(pa.array(single))
            src, dst = one.column(0).flatten().to_numpy(), one.column(1).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([one.column(0).flatten(), one.column(1).flatten(), one.column(2)], ["src", "dst", "w"]).filter(pa.array(dst > src))
            rest = b.filter(pa.array(~single))
            for a, c, w in zip(rest.column(0), rest.column(1), rest.column(2), strict=True):
                src, dst = a.values.to_numpy(), c.values.to_numpy()
                place = np.searchsorted(dst, src, "right")[:, None] + np.arange(k)
                i, j = np.nonzero(place < len(dst))
                yield pa.RecordBatch.from_arrays([pa.array(src[i]), pa.array(dst[place[i, j]]), pa.array([w.as_py()] * len(i), pa.float64())], ["src", "dst", "w"])

    return top_neighbours(pairs.mapInArrow(run, "src long, dst long, w double"), k)
