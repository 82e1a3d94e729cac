"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that the links i - j reach."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def _forest(most: int):
    """Links to a star of each component, of runs of at most `most` links of a task."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)]
        ids, at = np.unique(np.concatenate(ends), return_inverse=True)
        n = len(ends[0])
        up = roots(at[:n], at[n:], len(ids))
        low = up != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[up[low]]), pa.array(ids[low])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if held and sum(x.num_rows for x in held) + b.num_rows > most:
                yield star(held)
                held = []
            held.append(b)
        if held:
            yield star(held)

    return run


def _priority(x: str, turn: int) -> Column:
    return F.struct(F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("x"))


def _contracted(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round: (a, up) for every node, and the links between what remains."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = both.groupBy("a").agg(F.min(_priority("b", turn)).alias("least"))
    hook = hook.select("a", F.when(F.col("least") < _priority("a", turn), F.col("least.x")).otherwise(F.col("a")).alias("up"))
    up = hook
    for _ in range(2):
        further = hook.select(F.col("a").alias("at"), F.col("up").alias("next"))
        up = up.join(further, F.col("up") == F.col("at")).select("a", F.col("next").alias("up"))
    up = written(up, "component-hooks")
    ends = edges.join(up.select("a", F.col("up").alias("x")), "a").join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
    return up, ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(links: DataFrame, task_links: int = 1 << 20, most_rounds: int = 40) -> DataFrame:
    """(a, b) rows of whole numbers to (id, component), the smallest id reachable, for every id in a link.

    First each task turns its links, at most `task_links` at a time, into stars, so that a hub is
    met once a task. While more than `task_links` links are left, contraction: every node hooks to
    its neighbour of least hash, if that is less than its own, and follows three hooks; the links
    between what remains are turned into stars and go to the next round. Hashes differ from round to
    round, so hooks make short chains whatever the order of the ids, and the nodes with links fall by
    a constant factor. The last `task_links` links at most, 16 MB, are settled in one task. All
    tables stay distributed, in the shared folder; the driver sees one count a round. Null ends and
    loops are no links; repeated rows do no harm; no links give no rows.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    label = None
    for turn in range(most_rounds):
        edges = written(edges.mapInArrow(_forest(task_links), "a long, b long").distinct(), "component-links")
        left = edges.count()
        if left <= task_links:
            up = edges.coalesce(1).mapInArrow(_forest(task_links), "a long, b long").select(F.col("b").alias("a"), F.col("a").alias("up"))
            up = up.union(up.select("up", "up").distinct())
        else:
            up, edges = _contracted(edges, turn)
        if label is None:
            label = up.select(F.col("a").alias("id"), F.col("up").alias("root"))
        else:
            label = label.join(up.withColumnRenamed("a", "at"), F.col("root") == F.col("at"), "left").select("id", F.coalesce("up", "root").alias("root"))
        label = written(label, "component-roots")
        if left <= task_links:
            return label.join(label.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
