"""Boosted regression trees by histograms, for gains and predictions of many rows.

Features are cut at quantiles into at most `bins` bins. A level of a tree is one pass: each task evaluates the trees so far on its
rows, takes the residuals, and adds them up by node, feature and bin; the tasks' histograms are added up in Spark; the best
split of each node is read off the sums. Target and features are written once, before the first pass: a pass reads that table
and doesn't repeat what made it. Rows are never moved or marked, so a lost task repeats its part of a pass, and what passes through the driver is nodes x features x bins numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored


@dataclass
class Tree:
    """Nodes in levels: node k has the children 2k + 1 and 2k + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after `depth` levels, or the leaf it has reached before."""
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosted:
    features: list[str]
    base: float
    rate: float
    depth: int
    trees: list[Tree] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.value[t.nodes(x, self.depth)]
        return out


def best_split(count: np.ndarray, total: np.ndarray, least: int, ridge: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of one node from its histograms (features x bins); rows up to the bin go left.

    Ties go to the first feature, then the first bin; gain 0 is no split.
    """
    n, s = np.cumsum(count, axis=1), np.cumsum(total, axis=1)
    whole_n, whole_s = n[:, -1:], s[:, -1:]
    left, right = n, whole_n - n
    score = s * s / (left + ridge + (left == 0)) + (whole_s - s) ** 2 / (right + ridge + (right == 0)) - whole_s * whole_s / (whole_n + ridge + (whole_n == 0))
    score = np.where((left >= least) & (right >= least), score, -np.inf)
    at = int(score.argmax())
    f, b = divmod(at, score.shape[1])
    return (float(score[f, b]), f, b) if score[f, b] > 1e-12 else (0.0, -1, -1)


def _matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([c.to_numpy() for c in b.columns[1:]]), b.column(0).to_numpy()


def fit(df: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 20, ridge: float = 1.0) -> Boosted:
    """Trees fitted one after the other to what those before leave of the target; rows with a null or nan anywhere are left out."""
    y = F.col(target).cast("double").alias("_y")
    rows = stored(df.select(y, *[F.col(f).cast("double").alias(f) for f in features]).dropna())
    ends = rows.agg(F.avg("_y"), *[F.percentile_approx(f, F.array(*[F.lit(k / bins) for k in range(1, bins)]), F.lit(100 * bins)) for f in features]).first()
    if ends[0] is None:
        return Boosted(features, 0.0, rate, depth)
    cuts = [np.unique(np.array(e, float)) for e in ends[1:]]
    model = Boosted(features, float(ends[0]), rate, depth, gains=dict.fromkeys(features, 0.0))
    size = (len(features), bins)

    def histograms(tree: Tree, level: int) -> np.ndarray:
        """Counts and sums of residuals by node of the level, feature and bin."""
        first, nodes = 2**level - 1, 2**level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, nodes, *size))
            for b in batches:
                x, y = _matrix(b)
                left = y - model.predict(x)
                node = tree.nodes(x, level) - first
                here = node >= 0  # the others have reached a leaf
                for f, c in enumerate(cuts):
                    cell = node[here] * bins + np.searchsorted(c, x[here, f], "left")
                    out[0, :, f] += np.bincount(cell, minlength=nodes * bins).reshape(nodes, bins)
                    out[1, :, f] += np.bincount(cell, left[here], nodes * bins).reshape(nodes, bins)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int64)), pa.array(out.ravel())], ["i", "v"])

        total = np.zeros(2 * nodes * size[0] * size[1])
        summed = rows.mapInArrow(run, "i long, v double").where("v <> 0").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # a row a cell
        total[summed["i"].to_numpy()] = summed["v"].to_numpy()
        return total.reshape(2, nodes, *size)

    for _ in range(trees):
        count = 2 ** (depth + 1) - 1
        tree = Tree(np.full(count, -1), np.zeros(count), np.zeros(count))
        for level in range(depth + 1):
            n, s = histograms(tree, level)
            for k in range(2**level):
                node = 2**level - 1 + k
                held = n[k, 0].sum()
                if not held:
                    continue
                tree.value[node] = s[k, 0].sum() / (held + ridge)
                if level == depth:
                    continue
                gain, f, b = best_split(n[k], s[k], least, ridge)
                if f >= 0 and b < len(cuts[f]):
                    tree.feature[node], tree.cut[node] = f, cuts[f][b]
                    model.gains[features[f]] += gain
            if level < depth and (tree.feature[2**level - 1 : 2 ** (level + 1) - 1] < 0).all():
                break
        model.trees.append(tree)
    return model


def selected(model: Boosted, most: int) -> list[tuple[str, float]]:
    """(feature, share of all gains) by falling gain, of those that have any."""
    total = sum(model.gains.values()) or 1.0
    return [(f, g / total) for f, g in sorted(model.gains.items(), key=lambda p: (-p[1], p[0])) if g > 0][:most]


def predicted(df: DataFrame, model: Boosted, out: str) -> DataFrame:
    """df with the model's prediction; null where a feature is."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # trees x nodes numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            x = np.column_stack([b.column(f"_x{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(len(m.features))])
            missing = np.isnan(x).any(axis=1)
            done = pa.array(m.predict(np.nan_to_num(x)), mask=missing)
            keep = [c for c in b.schema.names if not c.startswith("_x")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], done], [*keep, out])

    from pyspark.sql import types as T

    wide = df.withColumns({f"_x{k}": F.col(f).cast("double") for k, f in enumerate(model.features)})
    return wide.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
