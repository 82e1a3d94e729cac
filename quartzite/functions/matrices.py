"""Windows of a panel as matrices, a row a symbol and a column a date, for formulas written in NumPy.

nan is what is missing. Every column that is set becomes nan on dates that a symbol does not have, so that no window counts them.
The names are those of functions/windows.py, whose texts say the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .windows import Rolled, usual


def safe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.where(b == 0, np.nan, b)


def present(v: np.ndarray) -> np.ndarray:
    return ~np.isnan(v)


class Matrices:
    """Columns by name; `td` is the number of each column's date. rolled: how an aggregate is made (operators/rolling_pass.py).

    Windows take a column's name, or an array that is then a column without a name.
    """

    def __init__(self, columns: dict[str, np.ndarray], there: np.ndarray, td: np.ndarray, rolled: Callable) -> None:
        self.there, self.td, self.rolled = there, td, rolled
        self.columns = dict(columns)
        self.known: dict[str, dict] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __setitem__(self, name: str, v: np.ndarray) -> None:
        self.columns[name] = np.where(self.there, v, np.nan)

    def agg(self, fn: str, x: str | np.ndarray, w: int, after: int = 0) -> np.ndarray:
        if isinstance(x, str):
            v, known = self.columns[x], self.known.setdefault(x, {})
        else:
            v, known = np.where(self.there, x, np.nan), {}
        return self.rolled(v, Rolled(fn, "", w - 1 + after, after), known)

    def roll(self, fn: str, x: str | np.ndarray, w: int, least: int) -> np.ndarray:
        if isinstance(x, str):
            return np.where(self.agg("count", x, w) >= least, self.agg(fn, x, w), np.nan)
        v, known = np.where(self.there, x, np.nan), {}
        return np.where(self.rolled(v, Rolled("count", "", w - 1, 0), known) >= least, self.rolled(v, Rolled(fn, "", w - 1, 0), known), np.nan)

    def mean(self, x: str | np.ndarray, w: int, least: int | None = None) -> np.ndarray:
        return self.roll("avg", x, w, usual(w) if least is None else least)

    def std(self, x: str | np.ndarray, w: int, least: int | None = None) -> np.ndarray:
        return self.roll("stddev_samp", x, w, usual(w) if least is None else least)

    def cv(self, x: str, w: int, least: int = 10) -> np.ndarray:
        return safe(self.std(x, w, least), self.mean(x, w, least))

    def shift(self, x: str, k: int = 1) -> np.ndarray:
        return self.agg("max", x, 1, k)

    def hits(self, condition: np.ndarray, w: int, least: int = 10) -> np.ndarray:
        return np.where(self.td + 1 >= least, self.agg("sum", condition.astype(float), w), np.nan)

    def share(self, condition: np.ndarray, w: int, least: int = 10) -> np.ndarray:
        return self.hits(condition, w, least) / np.minimum(w, self.td + 1)

    def corr(self, x: str, y: str, w: int, least: int) -> np.ndarray:
        both = present(self[x]) & present(self[y])
        a, b = np.where(both, self[x], np.nan), np.where(both, self[y], np.nan)
        ka, kb = {}, {}
        of = lambda fn, v, known: self.rolled(v, Rolled(fn, "", w - 1, 0), known)
        da, db = of("stddev_pop", a, ka), of("stddev_pop", b, kb)
        varies = (of("count", a, ka) >= least) & (da > 1e-12) & (db > 1e-12)
        return np.where(varies, (of("avg", a * b, {}) - of("avg", a, ka) * of("avg", b, kb)) / (da * db), np.nan)

    def skew(self, x: str, w: int, least: int) -> np.ndarray:
        v = self[x]
        if f"{x} squared" not in self.columns:
            self.columns[f"{x} squared"], self.columns[f"{x} cubed"] = v * v, v * v * v
        n, m1 = self.agg("count", x, w), self.agg("avg", x, w)
        q1, q2 = self.agg("avg", f"{x} squared", w), self.agg("avg", f"{x} cubed", w)
        m2 = q1 - m1**2
        m3 = q2 - 3 * m1 * q1 + 2 * m1**3
        fit = (n >= max(least, 3)) & (m2 > 1e-14)
        return np.where(fit, np.sqrt(n * (n - 1)) / (n - 2) * m3 / np.power(m2, 1.5), np.nan)

    def rsi(self, up: str, down: str, w: int, least: int) -> np.ndarray:
        return 100 - 100 / (1 + safe(self.mean(up, w, least), self.mean(down, w, least)))
