"""SQL text of window expressions on a long panel keyed by (symbol, td).

td numbers the dates of the calendar. Calendar windows count dates, present or not, so they are
RANGE frames over td; row windows count present rows. Cross-sections are windows over one td.
The text is plain SQL, for selectExpr.
"""

from __future__ import annotations

from dataclasses import dataclass

KEY, TIME = "symbol", "td"


def over(w: int | None, kind: str = "range", after: int = 0) -> str:
    """A frame of w dates (or rows) that ends `after` before the current one; w None: all before."""
    first = "unbounded preceding" if w is None else f"{w - 1 + after} preceding"
    last = f"{after} preceding" if after else "current row"
    return f"(partition by {KEY} order by {TIME} {kind} between {first} and {last})"


@dataclass(frozen=True)
class Rolled:
    """fn of x over the dates (or rows) `first` to `last` before the current one."""

    fn: str
    x: str
    first: int
    last: int
    kind: str = "range"


#: What each text of an aggregate over a bounded frame says, for operators/rolling_pass.py.
ROLLED: dict[str, Rolled] = {}


def agg(fn: str, x: str, w: int | None, kind: str = "range", after: int = 0) -> str:
    """fn of x over a frame of `over`."""
    text = f"{fn}({x}) over {over(w, kind, after)}"
    if w is not None:
        ROLLED[text] = Rolled(fn, x, w - 1 + after, after, kind)
    return text


def roll(fn: str, x: str, w: int | None, least: int = 1, kind: str = "range", after: int = 0) -> str:
    """fn of x over the frame where at least `least` values are present."""
    return f"case when {agg('count', x, w, kind, after)} >= {least} then {agg(fn, x, w, kind, after)} end"


def mean(x: str, w: int, least: int | None = None) -> str:
    return roll("avg", x, w, usual(w) if least is None else least)


def std(x: str, w: int, least: int | None = None) -> str:
    return roll("stddev_samp", x, w, usual(w) if least is None else least)


def usual(w: int) -> int:
    """The customary least number of values of a window."""
    return 3 if w <= 5 else 10 if w <= 20 else 20


def share(condition: str, w: int, least: int = 10) -> str:
    """Share of the dates of the window on which the condition holds; missing dates do not."""
    return f"case when td + 1 >= {least} then {agg('sum', f'case when {condition} then 1.0e0 else 0.0e0 end', w)} / least({w}, td + 1) end"


def hits(condition: str, w: int, least: int = 10) -> str:
    return f"case when td + 1 >= {least} then {agg('sum', f'case when {condition} then 1.0e0 else 0.0e0 end', w)} end"


def shift(x: str, k: int = 1) -> str:
    """x of the date k before (after, if k is negative); null if that date is missing."""
    side = f"{k} preceding" if k >= 0 else f"{-k} following"
    text = f"max({x}) over (partition by {KEY} order by {TIME} range between {side} and {side})"
    ROLLED[text] = Rolled("max", x, k, k)
    return text


def corr(x: str, y: str, w: int, least: int) -> str:
    """Correlation over the dates on which both are present, null where either does not vary."""
    both = f"case when {x} is not null and {y} is not null then"
    a, b = f"({both} {x} end)", f"({both} {y} end)"
    of = lambda fn, v: agg(fn, v, w)
    varies = f"{of('stddev_pop', a)} > 1e-12 and {of('stddev_pop', b)} > 1e-12"
    return f"case when {of('count', a)} >= {least} and {varies} then ({of('avg', f'{a} * {b}')} - {of('avg', a)} * {of('avg', b)}) / ({of('stddev_pop', a)} * {of('stddev_pop', b)}) end"


def skew(x: str, w: int, least: int) -> str:
    """Bias-corrected skewness."""
    n, m1 = f"cast({agg('count', x, w)} as double)", agg("avg", x, w)
    m2 = f"({agg('avg', f'{x} * {x}', w)} - power({m1}, 2))"
    m3 = f"({agg('avg', f'{x} * {x} * {x}', w)} - 3 * ({m1}) * {agg('avg', f'{x} * {x}', w)} + 2 * power({m1}, 3))"
    return f"case when {agg('count', x, w)} >= {max(least, 3)} and {m2} > 1e-14 then sqrt({n} * ({n} - 1)) / ({n} - 2) * {m3} / power({m2}, 1.5e0) end"


def cv(x: str, w: int, least: int = 10) -> str:
    """Standard deviation over mean."""
    return f"({std(x, w, least)}) / nullif({mean(x, w, least)}, 0)"


def cross(fn: str, x: str, by: str = "td") -> str:
    return f"{fn}({x}) over (partition by {by})"


def cross_rank(x: str, by: str = "td") -> str:
    """Average rank among the present values of a date, over their number."""
    return f"case when {x} is not null then (rank() over (partition by {by} order by {x} nulls last) + (count({x}) over (partition by {by}, {x}) - 1) / 2.0e0) / count({x}) over (partition by {by}) end"


def cross_z(x: str, by: str = "td", ddof: int = 1) -> str:
    sd = cross("stddev_samp" if ddof else "stddev_pop", x, by)
    return f"case when {sd} > 1e-12 then ({x} - {cross('avg', x, by)}) / {sd} end"


def safe(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def rsi(up: str, down: str, w: int, least: int) -> str:
    return f"100 - 100 / (1 + ({mean(up, w, least)}) / nullif({mean(down, w, least)}, 0))"


def residual(name: str, y: str, xs: list[str], least: int = 8, by: str = "td") -> list[dict[str, str]]:
    """Stages that leave in `name` the residual of y on an intercept and xs, date by date.

    Variables are made orthogonal one after the other, so any number of controls needs only sums;
    dates with fewer than `least` complete rows get none.
    """
    all_there = " and ".join(f"{v} is not null" for v in [y, *xs])
    n = f"sum(case when {all_there} then 1 else 0 end) over (partition by {by})"
    names = [f"{name}_o{k}" for k in range(len(xs))] + [f"{name}_y"]
    stages = [{f"{name}_use": f"case when {all_there} and {n} >= {max(least, len(xs) + 5)} then 1 end"}]
    stages.append({v: f"case when {name}_use = 1 then {x} - avg(case when {name}_use = 1 then {x} end) over (partition by {by}) end" for v, x in zip(names, [*xs, y], strict=True)})
    for k in range(len(xs)):
        o = names[k]
        made = {}
        for v in names[k + 1 :]:
            made[f"{v}_"] = f"{v} - {o} * sum({v} * {o}) over (partition by {by}) / nullif(case when sum({o} * {o}) over (partition by {by}) > 1e-18 then sum({o} * {o}) over (partition by {by}) end, 0)"
        stages.append(made)
        names = [v + "_" if j > k else v for j, v in enumerate(names)]
    stages.append({name: names[-1]})
    return stages
