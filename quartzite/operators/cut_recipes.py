"""Cuts by name: names are parsed to recipes, and all recipes of a panel are compiled to one aggregation.

Names: `<base>__time_<segment>__<aggregate>`, `<base>__state_<state>__<aggregate>`,
`<base>__event_<event>__<aggregate>`, and `<base>__contrast_<operator>_<left>_vs_<right>__<aggregate>`,
whose legs are segments or states. A compiled plan has one exchange, by symbol and day: the day's
medians and quantiles that masks need are windows over it, each once; each mask is one column; each
pair of base, mask and aggregate is computed once, whatever the number of recipes that use it;
contrasts are projections.

Bars have symbol, day, slot (number within the day) and value columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Segments of a day of minutes from midnight: first minute, minute after the last (fixed values).
SEGMENTS = {
    "open": (570, 600),
    "morning": (600, 690),
    "afternoon": (780, 870),
    "close": (870, 900),
    "common_close": (870, 897),
    "full": (570, 900),
    "early_close": (870, 890),
    "late_close": (890, 900),
    "close_auction": (900, 901),
}
SESSIONS = ((570, 690), (780, 900))
#: States: the column, and whether it is above its day's median (or, with zero, whether it is above or below zero).
STATES = {
    "high_vol": ("abs_return", "median", True),
    "low_vol": ("abs_return", "median", False),
    "high_spread": ("spread", "median", True),
    "low_spread": ("spread", "median", False),
    "high_depth": ("depth", "median", True),
    "low_depth": ("depth", "median", False),
    "high_trade_intensity": ("amount", "median", True),
    "low_trade_intensity": ("amount", "median", False),
    "large_order_dominated": ("large", "median", True),
    "ordinary_order_state": ("large", "median", False),
    "price_up": ("return", "zero", True),
    "price_down": ("return", "zero", False),
}
EVENTS = ("top_q", "bottom_q", "extreme", "shock", "large_trade", "liquidity_shock")
AGGREGATES = ("sum", "mean", "std", "median", "last", "max", "min", "persistence", "slope", "event_share", "temporal_center", "tc_plus", "tc_minus", "temporal_gap", "temporal_dispersion")
CONTRASTS = ("diff", "ratio", "normalised_diff", "share", "acceleration", "reversal", "persistence")
#: Aggregates that make sense for a class of values.
CLASSES = {
    "flow": AGGREGATES,
    "amount": tuple(a for a in AGGREGATES if a not in ("tc_plus", "tc_minus", "temporal_gap")),
    "level": ("mean", "std", "median", "last", "max", "min", "slope", "event_share", "persistence"),
}


@dataclass(frozen=True)
class Recipe:
    base: str
    kind: str
    cut: str
    aggregate: str
    operator: str = ""
    legs: tuple[str, str] = ("", "")

    @property
    def name(self) -> str:
        cut = f"{self.operator}_{self.legs[0]}_vs_{self.legs[1]}" if self.kind == "contrast" else self.cut
        return f"{self.base}__{self.kind}_{cut}__{self.aggregate}"


def parse(name: str) -> Recipe:
    """The recipe of a name; ValueError says what is wrong with it."""
    parts = name.split("__")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"{name}: not base__kind_cut__aggregate")
    base, cut, aggregate = parts
    if aggregate not in AGGREGATES:
        raise ValueError(f"{name}: no aggregate {aggregate}")
    kind, _, rest = cut.partition("_")
    known = {"time": SEGMENTS, "state": STATES, "event": EVENTS}
    if kind in known:
        if rest not in known[kind]:
            raise ValueError(f"{name}: no {kind} {rest}")
        return Recipe(base, kind, rest, aggregate)
    found = re.fullmatch(rf"({'|'.join(CONTRASTS)})_(.+)_vs_(.+)", rest) if kind == "contrast" else None
    if not found or any(leg not in SEGMENTS and leg not in STATES for leg in found.groups()[1:]):
        raise ValueError(f"{name}: no such cut")
    return Recipe(base, kind, "", aggregate, found[1], (found[2], found[3]))


@dataclass
class Accepted:
    recipes: list[Recipe] = field(default_factory=list)
    rejected: dict[str, str] = field(default_factory=dict)


def accept(names: Iterable[str], classes: dict[str, str], most: int = 12, pairs: set[tuple[str, str]] | None = None) -> Accepted:
    """Parses names under a budget of `most` recipes a base; what isn't taken is listed with its reason.

    classes: base to its class of values. pairs: the (base, state) that may be combined; None allows all.
    """
    out, count = Accepted(), dict.fromkeys(classes, 0)
    for name in names:
        try:
            r = parse(name)
        except ValueError as wrong:
            out.rejected[name] = str(wrong)
            continue
        states = [s for s in (r.cut, *r.legs) if s in STATES]
        if r.base not in classes:
            out.rejected[name] = "unknown base"
        elif r.aggregate not in CLASSES[classes[r.base]]:
            out.rejected[name] = f"{r.aggregate} means nothing for values of class {classes[r.base]}"
        elif pairs is not None and any((r.base, s) not in pairs for s in states):
            out.rejected[name] = "base and state may not be combined"
        elif r in out.recipes:
            out.rejected[name] = "given twice"
        elif count[r.base] >= most:
            out.rejected[name] = "over budget"
        else:
            count[r.base] += 1
            out.recipes.append(r)
    return out


class _Plan:
    """The columns that recipes need, each once, by stage: day statistics, masks, aggregates."""

    def __init__(self, segments: dict[str, tuple[int, int]], sessions: tuple[tuple[int, int], ...], q: float, z: float, least: int, history: int) -> None:
        self.segments, self.sessions, self.q, self.z, self.least, self.history = segments, sessions, q, z, least, history
        self.day = W.Window.partitionBy("symbol", "day")
        self.order = self.day.orderBy("slot")
        self.stats: dict[str, Column] = {}
        self.masks: dict[str, Column] = {}
        self.steps: dict[str, Column] = {}
        self.sums: dict[str, Column] = {}

    def stat(self, name: str, made: Callable[[], Column]) -> Column:
        if name not in self.stats:
            self.stats[name] = made()
        return F.col(name)

    def quantile(self, column: str, p: float) -> Column:
        return self.stat(f"_q_{column}_{round(100 * p)}", lambda: F.percentile(F.col(column), F.lit(p)).over(self.day))

    def above(self, column: str, p: float, over: bool, equal: bool) -> Column:
        bound, v = self.quantile(column, p), F.col(column)
        return (v >= bound if equal else v > bound) if over else v <= bound

    def mask(self, kind: str, cut: str, base: str) -> str:
        """The name of the mask's column."""
        name = f"_m_{kind}_{cut}" + (f"_{base}" if kind == "event" and cut in ("top_q", "bottom_q", "extreme", "shock") else "")
        if name in self.masks:
            return name
        if kind == "time":
            low, high = self.segments[cut]
            made = (F.col("slot") >= low) & (F.col("slot") < high)
        elif kind == "state":
            column, how, up = STATES[cut]
            v = F.col(column)
            made = (v > 0 if up else v < 0) if how == "zero" else self.above(column, 0.5, up, False)
        elif cut in ("top_q", "large_trade"):
            made = self.above(base if cut == "top_q" else "large", 1 - self.q, True, True)
        elif cut == "bottom_q":
            made = self.above(base, self.q, False, True)
        elif cut == "liquidity_shock":
            parts = [self.above("spread", 1 - self.q, True, True), self.above("depth", self.q, False, True), self.above("abs_return", 1 - self.q, True, True)]
            made = F.coalesce(parts[0], F.lit(False)) | F.coalesce(parts[1], F.lit(False)) | F.coalesce(parts[2], F.lit(False))
        elif cut == "extreme":
            v = F.col(base)
            n, mean, sd = (self.stat(f"_{k}_{base}", lambda f=f: f(base).over(self.day)) for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop)))
            made = (n >= 3) & (sd > 0) & (F.abs(v - mean) > self.z * sd)
        else:  # shock: against what the day has shown before
            past = self.order.rowsBetween(W.Window.unboundedPreceding, -1)
            n, mean, sd = (self.stat(f"_past_{k}_{base}", lambda f=f: f(base).over(past)) for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop)))
            made = (n >= self.history) & (sd > 0) & (F.col(base) > mean + self.z * sd)
        if kind != "time" or cut != "close_auction":
            low, high = self.segments["close_auction"]
            made = made & ~((F.col("slot") >= low) & (F.col("slot") < high))
        self.masks[name] = F.coalesce(made, F.lit(False))
        return name

    def step(self, mask: str, base: str) -> str:
        """Whether a row repeats the sign of the row just before it in its session, both in the mask; null if there is no such pair."""
        name = f"_s{mask}_{base}"
        if name not in self.steps:
            before = lambda c: F.lag(c).over(self.order)
            session = F.lit(None).cast("int")
            for k, (low, high) in enumerate(self.sessions):
                session = F.when((F.col("slot") >= low) & (F.col("slot") < high), k).otherwise(session)
            self.stats.setdefault("_session", session)
            pair = F.col(mask) & before(mask) & (before("slot") == F.col("slot") - 1) & (before("_session") == F.col("_session")) & (F.col(base) != 0) & (before(base) != 0)
            self.steps[name] = F.when(pair, (F.signum(base) == F.signum(before(base))).cast("double"))
        return name

    def sum(self, base: str, mask: str, aggregate: str) -> str:
        """The name of the aggregate's column."""
        name = f"_a{mask}_{base}_{aggregate}"
        if name in self.sums:
            return name
        v = F.when(F.col(mask), F.col(base))
        t = F.when(v.isNotNull(), F.col("slot").cast("double"))
        enough = lambda c, n: F.when(F.count(v) >= n, c)
        over = lambda a, b: a / F.nullif(b, F.lit(0.0))
        centre = lambda w: over(F.sum(t * w), F.sum(w))
        plus, minus, size = F.greatest(v, F.lit(0.0)), F.greatest(-v, F.lit(0.0)), F.abs(v)
        plus, minus = F.when(v.isNotNull(), plus), F.when(v.isNotNull(), minus)
        if aggregate == "persistence":
            s = F.col(self.step(mask, base))
            made = F.when(F.count(s) >= 3, F.avg(s))
        else:
            made = {
                "sum": lambda: F.sum(v),
                "mean": lambda: enough(F.avg(v), self.least),
                "std": lambda: enough(F.stddev_pop(v), self.least),
                "median": lambda: enough(F.percentile(v, F.lit(0.5)), self.least),
                "last": lambda: F.max_by(v, t),
                "max": lambda: F.max(v),
                "min": lambda: F.min(v),
                "slope": lambda: enough(F.covar_pop(t, v) / F.nullif(F.var_pop(t), F.lit(0.0)), self.least),
                "event_share": lambda: over(F.sum(F.when(F.col(mask) & F.col(base).isNotNull(), 1.0).otherwise(0.0)), F.count(base).cast("double")),
                "temporal_center": lambda: centre(size),
                "tc_plus": lambda: centre(plus),
                "tc_minus": lambda: centre(minus),
                "temporal_gap": lambda: centre(minus) - centre(plus),
                # deviations from the middle of the mask keep the difference of squares small
                "temporal_dispersion": lambda: F.sqrt(F.greatest(over(F.sum(F.pow(t - 720, F.lit(2)) * size), F.sum(size)) - F.pow(over(F.sum((t - 720) * size), F.sum(size)), F.lit(2)), F.lit(0.0))),
            }[aggregate]()
        self.sums[name] = made
        return name


def contrast(operator: str, a: Column, b: Column, near: float = 1e-12) -> Column:
    """Two aggregates by an operator; null where either is null or a denominator vanishes."""
    if operator in ("diff", "acceleration", "persistence"):
        return a - b
    if operator in ("ratio", "share"):
        return F.when(F.abs(b) > near, a / (F.abs(b) + near))
    if operator == "normalised_diff":
        return F.when(F.abs(a) + F.abs(b) > near, (a - b) / (F.abs(a) + F.abs(b) + near))
    return F.when(a != 0, -F.signum(a) * b)


def apply_recipes(bars: DataFrame, recipes: list[Recipe], segments: dict[str, tuple[int, int]] = SEGMENTS, sessions: tuple[tuple[int, int], ...] = SESSIONS, q: float = 0.2, z: float = 2.0, least: int = 3, history: int = 5) -> DataFrame:
    """One row per symbol and day with a column for each recipe."""
    plan = _Plan(segments, sessions, q, z, least, history)
    leg = lambda r, cut: plan.sum(r.base, plan.mask("time" if cut in segments else "state", cut, r.base), r.aggregate)
    made: dict[str, Column] = {}
    for r in recipes:
        if r.kind == "contrast":
            made[r.name] = contrast(r.operator, F.col(leg(r, r.legs[0])), F.col(leg(r, r.legs[1])))
        else:
            made[r.name] = F.col(plan.sum(r.base, plan.mask(r.kind, r.cut, r.base), r.aggregate))
    d = bars.withColumns(plan.stats) if plan.stats else bars
    d = d.withColumns(plan.masks)
    d = d.withColumns(plan.steps) if plan.steps else d
    return d.groupBy("symbol", "day").agg(*[c.alias(n) for n, c in plan.sums.items()]).select("symbol", "day", *[c.alias(n) for n, c in made.items()])
