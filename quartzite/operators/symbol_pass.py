"""A family of windows by symbol in one Arrow pass, for formulas written in NumPy over matrices of symbols by dates.

`staged_by_symbol` has a pass, and so a Python worker a task, for each stage, and the columns of all stages go through each.
Here the rows cross to Python once with what the formulas read and return with what they make.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matrices import Matrices
from .rolling_pass import rolled


def by_symbol(df: DataFrame, columns: list[str], make: Callable[[Matrices], dict[str, np.ndarray]], names: list[str], rows: int = 1 << 15, cells: int = 1 << 15) -> DataFrame:
    """symbol, td and names (doubles) of what `make` returns for columns, a row for each of df.

    df's partitions hold whole symbols by symbol and date, one row each. A task holds `rows` rows and a symbol, and matrices of `cells` cells or of one symbol.
    """
    schema = T.StructType([df.schema["symbol"], df.schema["td"], *[T.StructField(n, T.DoubleType()) for n in names]])

    def some(v: dict[str, np.ndarray], td: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        held = slice(starts[0], ends[-1])
        row, date = np.repeat(np.arange(len(starts)), ends - starts), td[held]
        first = date.min()
        there = np.zeros((len(starts), date.max() - first + 1), bool)
        there[row, date - first] = True
        matrices = {}
        for c in columns:
            m = np.full(there.shape, np.nan)
            m[row, date - first] = v[c][held]
            matrices[c] = m
        with np.errstate(all="ignore"):
            made = make(Matrices(matrices, there, np.arange(first, first + there.shape[1]), rolled))
        return [made[n][row, date - first] for n in names]

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        symbol, td = t["symbol"].to_numpy(), t["td"].to_numpy().astype(np.int64)
        v = {c: t[c].to_numpy() for c in columns}  # nulls become nan
        starts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        ends = np.r_[starts[1:], len(symbol)]
        group = max(1, cells // (int(td.max() - td.min()) + 1))
        for k in range(0, len(starts), group):
            found = some(v, td, starts[k : k + group], ends[k : k + group])
            keys = t.select(["symbol", "td"]).slice(starts[k], ends[min(k + group, len(ends)) - 1] - starts[k])
            yield from pa.table([*keys.columns, *[pa.array(x, mask=np.isnan(x)) for x in found]], names=schema.names).to_batches(max_chunksize=10000)

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

    return df.select("symbol", "td", *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, schema)


def by_date(df: DataFrame, columns: list[str], make: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], names: list[str], keep: list[str]) -> DataFrame:
    """symbol, td, keep and names (doubles) of what `make` returns for the columns of one date, a value a symbol; a date is a group."""
    kinds = {k: df.schema[k].dataType.simpleString() for k in ("symbol", "td")}
    read = list(dict.fromkeys([*columns, *keep]))

    def one(group: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            made = make({c: group[c].to_numpy() for c in columns})
        return pa.table({**{k: group[k] for k in ["symbol", "td", *keep]}, **{n: pa.array(made[n], mask=np.isnan(made[n])) for n in names}})

    rows = df.select("symbol", "td", *[F.col(c).cast("double").alias(c) for c in read])
    return rows.groupBy("td").applyInArrow(one, ", ".join([f"{k} {t}" for k, t in kinds.items()] + [f"{n} double" for n in [*keep, *names]]))
