"""A quality classifier learnt from positive and unlabelled texts.

Features are counts over the bytes of the whole text: shares of hashed byte pairs and of single
bytes, and measures of words and lines (lengths, repetition, capitals). A linear model minimises the
non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),   l the logistic loss,

over trusted positives and unlabelled web text, by gradient steps; where the second part is
negative the step goes against it. The class prior is the share of positives among the labelled
training rows; where only positives are labelled it is estimated from the scores of a first fit
(mean score of unlabelled over mean score of positives).

The fit takes bounded samples, `positives` and `unlabelled` ids with the smallest hash, one text of
each. Their features go to the driver as 16-bit numbers (2.6 kB a row), which fills one array with them
and works in place; every row is scored where it is read.

Defined results: a null or empty text has all features zero and gets a score like any other; null
labels are no labels; a document with contradicting labels counts as positive if any label is;
an id that repeats is one training row, of the text whose features come last as bytes;
without any positive every score is 0.5; repeated rows get a row each; an empty table gives
an empty table; other columns are ignored and never features, but one that has the name of the
score gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb

PAIRS = 1024
MEASURES = 9
WIDTH = PAIRS + 256 + MEASURES


def _shares(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of WIDTH numbers for each text; data and offsets as text_bytes gives them, of a MB or so."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    lengths = np.diff(offsets)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), lengths)
    pair = (data[:-1].astype(np.int64) * 131 + data[1:].astype(np.int64) * 17) % PAIRS
    same = doc[1:] == doc[:-1]
    out[:, :PAIRS] = _shares(np.bincount(doc[1:][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS))
    singles = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    out[:, PAIRS : PAIRS + 256] = _shares(singles)
    starts, ends, first = tb.word_bounds(data, offsets)
    words = np.diff(first)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    size = (ends - starts).astype(np.float64)
    hashes = tb.word_hashes(data, starts, ends)
    by = np.lexsort((hashes, owner))
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (owner[by][1:] != owner[by][:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(by)))
    most = np.zeros(n)
    np.maximum.at(most, owner[by][new], runs)
    repeats = np.zeros(n)
    repeats[:] = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    bytes_ = np.maximum(lengths, 1)
    upper, digit = singles[:, 65:91].sum(axis=1), singles[:, 48:58].sum(axis=1)
    letters = upper + singles[:, 97:123].sum(axis=1) + singles[:, 128:].sum(axis=1)
    columns = [
        np.log1p(words) / 5,
        np.bincount(owner, size, n) / some / 10,
        np.sqrt(np.maximum(0, np.bincount(owner, size**2, n) / some - (np.bincount(owner, size, n) / some) ** 2)) / 10,
        np.bincount(owner[by][new], minlength=n) / some,
        most / some,
        repeats / some,
        upper / np.maximum(letters, 1),
        digit / bytes_,
        1 - letters / bytes_,
    ]
    out[:, PAIRS + 256 :] = np.stack(columns, axis=1) * (words > 0)[:, None]
    return out


def all_features(column: pa.Array) -> np.ndarray:
    data, offsets = tb.text_bytes(column)
    parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tb.chunks(offsets, docs=512)]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) / self.scale) @ self.weights + self.bias).astype(np.float64)


def moments(x: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column, a block of rows at a time."""
    parts = range(0, len(x), rows)
    mean = sum(x[i : i + rows].sum(axis=0, dtype=np.float64) for i in parts) / len(x)
    var = sum(((x[i : i + rows] - mean) ** 2).sum(axis=0) for i in parts) / len(x)
    return mean, np.sqrt(var)


def standardise(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> None:
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    np.clip(x, -8, 8, out=x)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 300, rate: float = 0.03, decay: float = 2e-3) -> Model:
    """Minimises the non-negative risk with Adam; prior None: estimated from a first fit that takes unlabelled for negative.

    The arrays, of float32, are standardised in place.
    """
    mean, scale = moments(unlabelled)
    scale = np.maximum(scale, 1e-3)
    p, u = positive, unlabelled
    standardise(p, mean, scale)
    standardise(u, mean, scale)

    def descend(pi: float, corrected: bool) -> tuple[np.ndarray, float]:
        w, m, v = (np.zeros(p.shape[1] + 1) for _ in range(3))
        for t in range(1, steps + 1):
            narrow = w[:-1].astype(np.float32)
            gp, gu = _sigmoid(p @ narrow + w[-1]), _sigmoid(u @ narrow + w[-1])
            pull = lambda x, c: np.append(c.astype(np.float32) @ x, c.sum()) / len(x)
            up = pull(p, gp - 1)  # gradient of E_p[l(g)]
            if corrected:
                rest = (-np.log1p(-np.minimum(gu, 1 - 1e-9))).mean() - pi * (-np.log1p(-np.minimum(gp, 1 - 1e-9))).mean()
                down = pull(u, gu) - pi * pull(p, gp)
                grad = pi * up + down if rest >= 0 else -down
            else:
                grad = pi * up + (1 - pi) * pull(u, gu)
            grad[:-1] += decay * w[:-1]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w[:-1], float(w[-1])

    if prior is None:
        w, b = descend(0.5, False)
        prior = float(np.clip(_sigmoid(u @ w + b).mean() / max(_sigmoid(p @ w + b).mean(), 1e-6), 0.02, 0.98))
    w, b = descend(float(np.clip(prior, 0.02, 0.98)), True)
    return Model(mean, scale, w.astype(np.float32), b, prior)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = 4000, unlabelled: int = 8000) -> Model | None:
    """A model from the rows of docs and labels whose fold is not 0."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null").where(fold(F.col("id")) != 0)
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").where(fold(F.col("id")) != 0).distinct()
    marked = marked.join(ids, "id", "left_semi")
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not counts.get(1):
        return None
    prior = counts[1] / sum(counts.values()) if len(counts) > 1 else None
    turn = F.md5(F.concat(F.lit("pu:"), F.col("id").cast("string")))
    p = marked.where("label = 1").orderBy(turn, "id").limit(positives).select("id", F.lit(1).alias("positive"))
    u = ids.orderBy(F.reverse(turn), "id").limit(unlabelled).select("id", F.lit(0).alias("positive"))
    chosen = F.broadcast(p.union(u))  # at most positives + unlabelled ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x = all_features(part.column(2)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "positive", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    found = rows.select("id", "positive", "text").mapInArrow(run, T.StructType([*rows.select("id", "positive").schema.fields, T.StructField("x", T.BinaryType())]))
    x, flag = _ordered(found.groupBy("id", "positive").agg(F.max("x").alias("x")).select("positive", "x").toArrow())
    n = int((flag == 0).sum())  # the unlabelled come first
    if n in (0, len(flag)):
        return None
    return fit(x[n:], x[:n], prior)


def _ordered(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The training rows in one array, in an order that does not depend on that of their arrival."""
    flag, column = got["positive"].to_numpy(), got["x"].combine_chunks()
    packed, _ = tb.text_bytes(column)
    packed = packed.view(np.float16).reshape(-1, WIDTH)
    order = np.lexsort((packed[:, 0], packed[:, PAIRS], packed.sum(axis=1, dtype=np.float64), flag))
    x = np.empty(packed.shape, np.float32)
    for i in range(0, len(x), 1024):
        x[i : i + 1024] = packed[order[i : i + 1024]]
    return x, flag[order]


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """docs with the score, which is between 0 and 1."""
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.full(b.num_rows, 0.5)
            if model is not None:
                data, offsets = tb.text_bytes(b.column(at))
                for i, j in tb.chunks(offsets, docs=512):
                    score[i:j] = model.scores(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, score_col])
        tb.release()

    return docs.mapInArrow(run, schema)
