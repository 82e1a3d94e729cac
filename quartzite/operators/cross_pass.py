"""All cross-sections of a panel in one pass: ranks, z-scores, means and residuals of many columns, a date a group.

Each of them alone is a window over dates, and each rank a sort of its own over the whole rows. Here the few columns that
they need go to their dates once, and one Arrow group a date (a row a symbol) does all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pass:
    """Results by name: ranks, z and means of a column; residuals of (y, controls). Dates with fewer than `least` whole rows have no residuals."""

    ranks: dict[str, str] = field(default_factory=dict)
    z: dict[str, str] = field(default_factory=dict)
    means: dict[str, str] = field(default_factory=dict)
    residuals: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    least: int = 8

    def inputs(self) -> list[str]:
        found = [*self.ranks.values(), *self.z.values(), *self.means.values(), *(c for y, xs in self.residuals.values() for c in [y, *xs])]
        return list(dict.fromkeys(found))

    def outputs(self) -> list[str]:
        return [*self.ranks, *self.z, *self.means, *self.residuals]


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks among the present values over their number, ties averaged; nan where x is."""
    out = np.full(len(x), np.nan)
    there = ~np.isnan(x)
    if there.any():
        _, where, counts = np.unique(x[there], return_inverse=True, return_counts=True)
        below = np.cumsum(counts) - counts
        out[there] = (below[where] + 1 + (counts[where] - 1) / 2.0) / there.sum()
    return out


def scores(x: np.ndarray) -> np.ndarray:
    """x less its mean over its deviation; nan throughout where it does not vary."""
    there = x[~np.isnan(x)]
    sd = there.std(ddof=1) if len(there) > 1 else 0.0
    return (x - there.mean()) / sd if sd > 1e-12 else np.full(len(x), np.nan)


def residual(y: np.ndarray, xs: list[np.ndarray], least: int) -> np.ndarray:
    """y less its fit on an intercept and xs, made orthogonal one after the other; nan throughout where one of them adds nothing."""
    out = np.full(len(y), np.nan)
    use = ~np.isnan(np.column_stack([y, *xs])).any(axis=1)
    if use.sum() < max(least, len(xs) + 5):
        return out
    left = [v[use] - v[use].mean() for v in [*xs, y]]
    while len(left) > 1:
        o, *left = left
        size = (o * o).sum()
        if size <= 1e-18:
            return out
        left = [v - o * (v * o).sum() / size for v in left]
    out[use] = left[0]
    return out


def crossed(df: DataFrame, what: Pass, keys: tuple[str, str] = ("symbol", "td"), keep: list[str] | None = None) -> DataFrame:
    """keys, columns to keep (numbers, as doubles) and the results of the pass for each row of df."""
    kept = keep or []
    names, outputs = what.inputs(), what.outputs()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in keys}

    def one(group: pa.Table) -> pa.Table:
        x = {c: group[c].to_numpy() for c in names}  # nulls become nan
        made: dict[str, np.ndarray] = {n: average_ranks(x[c]) for n, c in what.ranks.items()}
        for n, c in what.z.items():
            made[n] = scores(x[c])
        for n, c in what.means.items():
            there = x[c][~np.isnan(x[c])]
            made[n] = np.full(len(x[c]), there.mean() if len(there) else np.nan)
        for n, (y, xs) in what.residuals.items():
            made[n] = residual(x[y], [x[c] for c in xs], what.least)
        return pa.table({**{k: group[k] for k in [*keys, *(f"_k_{c}" for c in kept)]}, **{n: pa.array(made[n], mask=np.isnan(made[n])) for n in outputs}})

    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names], *[F.col(c).cast("double").alias(f"_k_{c}") for c in kept])
    found = rows.groupBy(keys[1]).applyInArrow(one, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"_k_{c} double" for c in kept] + [f"{n} double" for n in outputs]))
    return found.withColumnsRenamed({f"_k_{c}": c for c in kept})
