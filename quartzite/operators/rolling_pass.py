"""Aggregates over bounded windows of a panel (symbol, td), for staged plans by symbol.

Spark's windows go over each row's whole frame for each of its aggregates. Here the rows go to their symbols once, in order of
dates; each stage is then a projection and one Arrow pass in place, which puts some symbols at a time in a matrix of dates
and takes sums, extremes and deviations of all frames at once. Sums are of the frame's values alone, never differences of longer sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.windows import ROLLED, Rolled
from ..plans.staged import Stage


def moved(v: np.ndarray, k: int, fill: float) -> np.ndarray:
    """Each column's value k columns before."""
    out = np.full_like(v, fill)
    if abs(k) < v.shape[1]:
        if k >= 0:
            out[:, k:] = v[:, : v.shape[1] - k]
        else:
            out[:, :k] = v[:, -k:]
    return out


def folded(v: np.ndarray, first: int, last: int, how: np.ufunc, fill: float) -> np.ndarray:
    """how (add, minimum, maximum) over the columns `first` to `last` before each, from folds of widths that double."""
    out, at, width, left = None, last, 1, first - last + 1
    while left:
        if left & 1:
            part = moved(v, at, fill)
            out = part if out is None else how(out, part)
            at += width
        left >>= 1
        if left:
            v = how(v, moved(v, width, fill))
            width *= 2
    return out


def rolled(x: np.ndarray, r: Rolled, known: dict) -> np.ndarray:
    """The aggregate of each cell's frame; nan marks what is missing, in x and in the result. known: results of the same matrix by (fn, frame)."""

    def of(fn: str) -> np.ndarray:
        key = (fn, r.first, r.last)
        if key not in known:
            known[key] = made(fn)
        return known[key]

    def made(fn: str) -> np.ndarray:
        there = ~np.isnan(x)
        if fn == "count":
            return folded(there.astype(float), r.first, r.last, np.add, 0.0)
        if fn in ("min", "max"):
            end = np.inf if fn == "min" else -np.inf
            found = folded(np.where(there, x, end), r.first, r.last, np.minimum if fn == "min" else np.maximum, end)
            return np.where(of("count") > 0, found, np.nan)
        n = of("count")
        if fn == "sum":
            return np.where(n > 0, folded(np.where(there, x, 0.0), r.first, r.last, np.add, 0.0), np.nan)
        if fn == "avg":
            return of("sum") / np.maximum(n, 1.0)
        if fn == "squares":  # about the mean of the frame; of equal values exactly 0
            mean, total = of("avg"), np.zeros(x.shape)
            for k in range(r.last, r.first + 1):
                d = moved(x, k, np.nan) - mean
                total += np.where(np.isnan(d), 0.0, d * d)
            return np.where(of("min") == of("max"), 0.0, total)
        if fn == "stddev_pop":
            return np.where(n > 0, np.sqrt(of("squares") / np.maximum(n, 1.0)), np.nan)
        if fn == "stddev_samp":
            return np.where(n > 1, np.sqrt(of("squares") / np.maximum(n - 1, 1.0)), np.nan)
        share = float(fn.removeprefix("percentile "))
        held = np.sort(np.stack([moved(x, k, np.nan) for k in range(r.last, r.first + 1)], axis=2), axis=2)  # missing ones last
        place = np.maximum(n - 1, 0.0) * share
        low = np.floor(place).astype(int)
        a, b = (np.take_along_axis(held, k[:, :, None], axis=2)[:, :, 0] for k in (low, np.minimum(low + 1, np.maximum(n - 1, 0).astype(int))))
        return a + (b - a) * (place - low)

    return of(r.fn)


def with_rolled(df: DataFrame, aggregates: dict[str, Rolled], rows: int = 1 << 16, cells: int = 1 << 18) -> DataFrame:
    """df, whose partitions hold whole symbols by symbol and date (one row each), with aggregates of its columns by name (Rolled.x is a column).

    A task holds `rows` rows and a symbol, and matrices of `cells` cells or of one symbol.
    """
    inputs = df.schema
    names = [*inputs.names, *aggregates]

    def some(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        row = np.repeat(np.arange(len(starts)), ends - starts)
        held = slice(starts[0], ends[-1])
        td = t["td"].to_numpy()[held].astype(np.int64)
        places = {"range": td - td.min(), "rows": np.arange(len(td)) - (starts - starts[0])[row]}
        matrices, known, out = {}, {}, []
        for r in aggregates.values():
            key = (r.x, r.kind)
            if key not in matrices:
                m = np.full((len(starts), places[r.kind].max() + 1), np.nan)
                m[row, places[r.kind]] = t[r.x].to_numpy()[held]
                matrices[key], known[key] = m, {}
            out.append(rolled(matrices[key], r, known[key])[row, places[r.kind]])
        return out

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        symbol, td = t["symbol"].to_numpy(), t["td"].to_numpy().astype(np.int64)
        starts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        ends = np.r_[starts[1:], len(symbol)]
        group = max(1, cells // max(1, int(td.max() - td.min()) + 1))
        parts = [some(t, starts[k : k + group], ends[k : k + group]) for k in range(0, len(starts), group)]
        for name, found in zip(aggregates, zip(*parts, strict=True), strict=True):
            v = np.concatenate(found)
            t = t.append_column(name, pa.array(v, mask=np.isnan(v)))
        yield from t.select(names).to_batches(max_chunksize=10000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            waiting.append(b)
            count += b.num_rows
            if count < rows:
                continue
            t = pa.Table.from_batches(waiting)
            symbol = t["symbol"].to_numpy()
            end = int(np.searchsorted(symbol, symbol[-1]))  # the last symbol may go on
            if end:
                yield from whole(t.slice(0, end))
            waiting = t.slice(end).combine_chunks().to_batches()
            count = t.num_rows - end
        if count:
            yield from whole(pa.Table.from_batches(waiting))

    return df.mapInArrow(run, T.StructType([*inputs.fields, *[T.StructField(n, T.DoubleType()) for n in aggregates]]))


def words(texts: list[str]) -> set[str]:
    return set(re.findall(r"\w+", " ".join(texts)))


def staged_by_symbol(df: DataFrame, stages: list[Stage], keep: list[str]) -> DataFrame:
    """keep (columns of df or of stages) after stages whose windows are all bounded frames by symbol; the rows are as many as df's, each with its own (symbol, td).

    An aggregate that `functions.windows` wrote is known by its text and becomes a column of the stage's pass. Columns that no later text names are left out.
    """
    later = [words([*[t for s in stages[k:] for t in s.values()], *keep, "symbol", "td"]) for k in range(len(stages) + 1)]
    df = df.select(*[c for c in df.columns if c in later[0]]).repartition("symbol").sortWithinPartitions("symbol", "td")
    for k, stage in enumerate(stages):
        texts = {n: t for n, t in stage.items() if n in later[k + 1]}
        found: dict[str, Rolled] = {}
        inputs: dict[str, str] = {}
        for text in sorted((w for w in ROLLED if any(w in t for t in texts.values())), key=len, reverse=True):
            if not any(text in t for t in texts.values()):
                continue  # part of a longer one
            r = ROLLED[text]
            x, fn = r.x, r.fn
            if fn == "percentile":
                x, share = x.rsplit(",", 1)
                fn = f"percentile {float(share)}"
            column = inputs.setdefault("1" if x == "*" else x, f"_x{len(inputs)}")
            name = f"_r{len(found)}"
            found[name] = Rolled(fn, column, r.first, r.last, r.kind)
            texts = {n: t.replace(text, name) for n, t in texts.items()}
        if any(" over (" in t for t in texts.values()):
            raise ValueError("a window that is not a bounded frame by symbol")
        if found:
            df = with_rolled(df.selectExpr("*", *[f"cast({x} as double) as {n}" for x, n in inputs.items()]), found)
        df = df.selectExpr(*[c for c in df.columns if c in later[k + 1] and c not in texts], *[f"{t} as {n}" for n, t in texts.items()])
    return df.select("symbol", "td", *[c for c in keep if c not in ("symbol", "td")])
