"""Character n-grams of texts, weighed by rarity, and their leading directions.

Terms are the `features` n-grams in most texts. A text is a sparse row of tf-idf weights of length 1. The
truncated singular value decomposition takes two passes over the rows: one multiplies a seeded random matrix by A'A, one
gathers the Gram matrix of the rows in the space found; each task adds up its rows, tasks are added up in Spark.
Nothing of the size of the texts is held: tasks and driver hold features x directions numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grams(text: str, low: int, high: int) -> Counter:
    """Counts of the n-grams of a text, white space drawn together and in lower case."""
    t = " ".join(text.lower().split())
    return Counter(t[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1))


@dataclass(frozen=True)
class Terms:
    """The terms by text, their place and idf; the number of texts."""

    place: dict[str, int]
    idf: np.ndarray
    n: int
    low: int
    high: int

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's terms; the weights' squares add up to 1."""
        found = sorted((self.place[g], c) for g, c in grams(text, self.low, self.high).items() if g in self.place)
        at = np.array([p for p, _ in found], np.int64)
        w = np.array([c for _, c in found], float) * self.idf[at]
        size = np.sqrt((w * w).sum())
        return at, w / size if size else w


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, int, list[str]]]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.column(column).slice(k, 256)
            yield b, k, [t or "" for t in part.to_pylist()]


def terms(texts: DataFrame, text: str, features: int, low: int = 2, high: int = 4, least: int = 2) -> Terms:
    """The `features` n-grams that are in most texts, in `least` at least; ties by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, some in _texts(batches, 0):
            held: Counter = Counter()
            for t in some:
                held.update(grams(t, low, high).keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])

    n = texts.count()
    counts = texts.select(F.col(text)).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "gram").limit(features).collect()  # `features` rows
    return Terms({r["gram"]: i for i, r in enumerate(top)}, np.array([np.log((1 + n) / (1 + r["n"])) + 1 for r in top]), n, low, high)


def _summed(rows: DataFrame, make, shape: tuple[int, int], spread: int = 32) -> np.ndarray:
    """The sum over tasks of the matrices that make(batches) gives, added up in two rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = make(batches)
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], ["m"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(shape[0] * shape[1])
        for b in group["m"]:
            total += np.frombuffer(b.as_py())
        return pa.table({"m": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "m binary").withColumn("turn", F.pmod(F.monotonically_increasing_id(), F.lit(spread)))
    once = parts.groupBy("turn").applyInArrow(lambda t: add(t), "m binary")
    total = np.zeros(shape[0] * shape[1])
    for r in once.collect():  # `spread` rows at most
        total += np.frombuffer(r["m"])
    return total.reshape(shape)


@dataclass(frozen=True)
class Encoder:
    """Directions (features x k) and singular values of the tf-idf rows."""

    terms: Terms
    directions: np.ndarray
    values: np.ndarray


def truncated_svd(texts: DataFrame, text: str, found: Terms, k: int, more: int = 10, passes: int = 1, seed: int = 17) -> Encoder:
    """The k leading right singular vectors by a randomised range finder; each further power pass is one more pass over the rows."""
    size = len(found.place)
    k = min(k, size)
    wide = min(size, k + more)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, wide)))[0]
    rows = texts.select(F.col(text))

    def product(q: np.ndarray):
        def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((size, wide))
            for _, _, some in _texts(batches, 0):
                for t in some:
                    at, w = found.row(t)
                    out[at] += np.outer(w, w @ q[at])
            return out

        return make

    for _ in range(passes):
        q = np.linalg.qr(_summed(rows, product(q), (size, wide)))[0]

    def gram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((wide, wide))
        for _, _, some in _texts(batches, 0):
            y = np.array([w @ q[at] for at, w in map(found.row, some)]).reshape(-1, wide)
            out += y.T @ y
        return out

    values, axes = np.linalg.eigh(_summed(rows, gram, (wide, wide)))
    order = np.argsort(-values)[:k]
    directions = q @ axes[:, order]
    sign = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(k)])  # the largest entry of a direction is positive
    return Encoder(found, directions * np.where(sign == 0, 1, sign), np.sqrt(np.maximum(values[order], 0.0)))


def encoded(texts: DataFrame, id_col: str, text: str, e: Encoder) -> DataFrame:
    """The id and code: each text's coordinates in the directions; zeros for a text without terms."""
    sent = texts.sparkSession.sparkContext.broadcast(e)  # features x k numbers
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b, at, some in _texts(batches, 1):
            codes = [(w @ held.directions[p]).tolist() for p, w in map(held.terms.row, some)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(codes, pa.list_(pa.float64()))], [id_col, "code"])

    return texts.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, code array<double>")
