"""Book dynamics, size grids, linear models, recipes and recurrences against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.functions import rolling
from quartzite.operators import book_dynamics as dyn
from quartzite.operators import cut_recipes as cr
from quartzite.operators import linear_models as lm
from quartzite.operators import selection, size_grids

BOOK = "symbol string, day string, at timestamp, seq long, bid_price array<double>, bid_volume array<double>, ask_price array<double>, ask_volume array<double>, acc_amount double, acc_volume double"


def test_ladders_merge_by_price(spark):
    rows = [([10.0, 9.5, 9.0], [1.0, 2.0, 3.0], [9.5, 9.0, 8.5], [5.0, 3.0, 7.0]), ([10.0, 10.0, 0.0], [1.0, 9.0, 2.0], [], [])]
    d = spark.createDataFrame(rows, "p array<double>, v array<double>, q array<double>, w array<double>")
    got = [r.c for r in d.select(dyn.ladder_change(dyn.ladder(F.col("p"), F.col("v")), dyn.ladder(F.col("q"), F.col("w"))).alias("c")).collect()]
    assert got == [{10.0: 1.0, 9.5: -3.0, 9.0: 0.0, 8.5: -7.0}, {10.0: 1.0, 0.0: 2.0}]
    amount = d.select(dyn.change_amount(dyn.ladder_change(dyn.ladder(F.col("p"), F.col("v")), dyn.ladder(F.col("q"), F.col("w"))), F.lit(9.0), F.lit(9.9)).alias("a")).first().a
    assert amount == 9.5 * -3.0


def book(symbol, at, seq, level=10, crossed=False):
    bid = [100.0 - 0.5 * k for k in range(level)]
    ask = [(99.0 if crossed else 100.5) + 0.5 * k for k in range(level)]
    return (symbol, str(at.date()), at, seq, bid, [float(seq % 5 + k) for k in range(level)], ask, [1.0] * level, float(seq), float(seq))


def test_grid_fills_to_its_bound_and_not_over_the_break(spark):
    at = lambda h, m, s: dt.datetime(2024, 1, 2, h, m, s)
    rows = [book("a", at(9, 30, 0), 1), book("a", at(9, 30, 1), 2), book("a", at(9, 30, 30), 3), book("a", at(11, 29, 58), 4), book("a", at(12, 0, 0), 5), book("a", at(13, 0, 9), 6), book("a", at(13, 0, 9), 7), book("a", at(9, 31, 0), 8, level=9), book("a", at(9, 32, 0), 9, crossed=True)]
    got = dyn.on_grid(dyn.valid_books(spark.createDataFrame(rows, BOOK)), 3, 4).orderBy("slot").collect()
    start, noon, one = 34_200 // 3, 41_399 // 3, 46_800 // 3
    want = [(start + k, 2, k) for k in range(5)] + [(start + 10 + k, 3, k) for k in range(5)] + [(noon, 4, 0)] + [(one + 3 + k, 7, k) for k in range(5)]
    assert [(r.slot, r.seq, r.age) for r in got] == want


def test_dynamics_of_first_row_and_empty(spark):
    d = spark.createDataFrame([book("a", dt.datetime(2024, 1, 2, 10, 0, 0), 1)], BOOK)
    one = dyn.with_dynamics(dyn.on_grid(dyn.valid_books(d), 3, 0)).collect()
    assert len(one) == 1 and one[0].bid_change is None and one[0].net_buy_quote_ratio == 0.0
    assert one[0].ladder_amount == pytest.approx(sum(p * v for p, v in zip(one[0].bid_price, one[0].bid_volume, strict=True)))
    assert dyn.with_dynamics(dyn.on_grid(dyn.valid_books(d.limit(0)))).count() == 0


def test_exact_quantiles_with_a_hot_value(spark):
    rnd = random.Random(3)
    rows = [("a", rnd.lognormvariate(8, 2)) for _ in range(500)] + [("a", 1234.5)] * 300 + [("b", 7.0)] * 9 + [("c", 1.0), ("c", 2.0), ("d", 5.0)]
    probs = {"low": 0.2, "mid": 0.5, "high": 0.8}
    got = {r.k: r for r in size_grids.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", probs).collect()}
    for k in "abcd":
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(float(np.quantile([x for s, x in rows if s == k], p)), rel=1e-12)


def test_sizes_that_raise_and_bands(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 0.0), ("a", 1, None), ("a", 1, float("nan")), ("a", 1, 15.0)], "symbol string, td int, amount double")
    assert size_grids.checked(d).count() == 2
    with pytest.raises(Exception, match="negative or infinite"):
        size_grids.checked(d.union(spark.createDataFrame([("a", 1, -1.0)], d.schema))).collect()
    with pytest.raises(ValueError, match="below"):
        size_grids.bands(adv_lower=(5.0,), adv_upper=(5.0,))
    trades = size_grids.checked(d)
    r = size_grids.amount_shares(trades, size_grids.daily_scales(trades), size_grids.bands(fixed=(5.0, 15.0))).first()
    assert r.a0 == 0.75 and r.a1_0p5_5 is None and r.history == 0 and r.a3 == 0.0


def panel(n_dates=60, n=12, seed=5):
    rnd = np.random.default_rng(seed)
    rows = []
    for t in range(n_dates):
        x = rnd.normal(size=(n, 3)) + [5.0, -2.0, 1000.0]
        y = x @ [0.5, -1.0, 0.01] + rnd.normal(size=n)
        rows += [(int(t), *map(float, x[i]), float(y[i]) if (t + i) % 17 else None) for i in range(n)]
    return rows


def test_models_equal_fits_of_the_folds_rows(spark):
    rows = panel()
    d = spark.createDataFrame(rows, "td int, a double, b double, c double, y double")
    dates = d.select("td").distinct().select("td", (F.col("td") + 3).alias("label_end"), F.floor(F.col("td") / 5).cast("int").alias("period"))
    made = lm.checked_folds(lm.folds(dates, 20, 15, 3))
    folds = {f.period: f for f in made.collect()}
    assert {f.status for f in folds.values()} == {"OK", "INSUFFICIENT_HISTORY"} and all(f.label_end is None or f.label_end < f.anchor for f in folds.values())
    assert lm.folds(dates.where("td < 3"), 20, 15, 3).first().status == "NO_PURGED_DATES"
    for l1 in (None, 0.3):
        alpha = 2.0 if l1 is None else 0.1
        models = {m.period: m for m in lm.fitted(d, ["a", "b", "c"], "y", "td", made, alpha, l1).collect()}
        assert set(models) == {p for p, f in folds.items() if f.status == "OK"}
        for p, m in models.items():
            z = np.array([r[1:] for r in rows if folds[p].train_from <= r[0] <= folds[p].train_to and r[4] is not None])
            x, y, n = z[:, :3] - z[:, :3].mean(axis=0), z[:, 3] - z[:, 3].mean(), len(z)
            w = np.array(m.coefficients)
            assert m.n == n and m.intercept == pytest.approx(z[:, 3].mean() - w @ z[:, :3].mean(axis=0), rel=1e-8)
            pull = x.T @ (y - x @ w)
            if l1 is None:
                assert np.abs(pull - alpha * w).max() < 1e-8 * np.abs(x.T @ y).max()
            else:  # the conditions of the optimum
                slope = pull / n - alpha * (1 - l1) * w
                assert all(abs(s - alpha * l1 * np.sign(v)) < 1e-9 if v else abs(s) <= alpha * l1 + 1e-9 for s, v in zip(slope, w, strict=True))
    got = lm.predicted(d, ["a", "b", "c"], lm.fitted(d, ["a", "b", "c"], "y", "td", made, 2.0), made, "td").collect()
    assert got and all(folds[r.period].anchor <= r.td and folds[r.period].train_to + 3 < r.td for r in got)


def test_overlapping_labels_raise(spark):
    d = spark.createDataFrame([(1, 5, 9), (2, 5, 4)], "period int, anchor int, label_end int")
    with pytest.raises(Exception, match="overlaps"):
        lm.checked_folds(d).collect()


def test_l1_path_drops_features():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 6))
    y = x[:, 0] * 2 - x[:, 3] + rnd.normal(size=300) * 0.1
    g, c = x.T @ x, x.T @ y
    sizes = [int((lm.elastic_net(g, c, 300, a, 1.0) != 0).sum()) for a in (1e-6, 0.3, 1.5, 10.0)]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == 0 and sizes[1] == 2
    assert np.allclose(lm.elastic_net(g, c, 300, 0.0, 0.5), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-9)


def test_names_parse_and_print():
    for name in ("flow__time_open__sum", "flow__state_high_vol__mean", "flow__event_top_q__event_share", "flow__contrast_normalised_diff_late_close_vs_high_depth__mean"):
        assert cr.parse(name).name == name
    for bad in ("flow", "flow__time_noon__sum", "flow__time_open__mode", "flow__contrast_diff_open__sum", "flow__kind_open__sum", "__time_open__sum"):
        with pytest.raises(ValueError, match=bad if bad.strip("_") else ""):
            cr.parse(bad)
    made = cr.accept(["flow__time_open__sum", "flow__time_open__sum", "x__time_open__sum", "obi__time_open__sum", "obi__state_high_vol__mean", "obi__time_open__mean", "flow__time_close__sum", "flow__time_full__sum", "nonsense"], {"flow": "flow", "obi": "level"}, 2, {("flow", "high_vol")})
    assert [r.name for r in made.recipes] == ["flow__time_open__sum", "obi__time_open__mean", "flow__time_close__sum"]
    assert {k: v.split()[0] for k, v in made.rejected.items()} == {"flow__time_open__sum": "given", "x__time_open__sum": "unknown", "obi__time_open__sum": "sum", "obi__state_high_vol__mean": "base", "flow__time_full__sum": "over", "nonsense": "nonsense:"}


def test_recipes_share_one_aggregation(spark):
    """Ten recipes over one base and mask: one exchange, and masks and sums once."""
    rows = [("a", "d", 570 + k, float(k - 20), float(k % 7)) for k in range(40)]
    d = spark.createDataFrame(rows, "symbol string, day string, slot int, flow double, spread double")
    names = [f"flow__time_open__{a}" for a in ("sum", "mean", "std", "last", "max", "min", "slope", "persistence")] + ["flow__contrast_diff_open_vs_morning__sum", "flow__state_high_spread__sum"]
    out = cr.apply_recipes(d, cr.accept(names, {"flow": "flow"}).recipes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    r = out.first()
    assert r["flow__time_open__sum"] == sum(range(-20, 10)) and r["flow__time_open__slope"] == pytest.approx(1.0) and r["flow__time_open__last"] == 9.0
    pairs = [(a, a + 1) for a in range(-20, 9) if a and a + 1]
    assert r["flow__time_open__persistence"] == pytest.approx(sum((a > 0) == (b > 0) for a, b in pairs) / len(pairs))
    assert r["flow__contrast_diff_open_vs_morning__sum"] == sum(range(-20, 10)) - sum(range(10, 20))
    assert r["flow__state_high_spread__sum"] == sum(v for *_, v, s in rows if s > float(np.median([x[4] for x in rows])))


def test_recurrences_over_many_blocks(spark):
    rnd = random.Random(7)
    rows = [(s, t, rnd.uniform(-1, 1) if rnd.random() < 0.8 else None) for s in "ab" for t in range(150)]
    d = spark.createDataFrame(rows, "symbol string, td int, x double")
    got = rolling.with_recurrences(d, {"y": (F.lit(0.9), F.coalesce("x", F.lit(0.0)))}, block=8)
    got = rolling.with_smoothed(rolling.with_smoothed(got, "x", 7, "adjusted"), "x", 7, "plain", False).collect()
    by = {(r.symbol, r.td): r for r in got}
    for s in "ab":
        y = top = weight = 0.0
        mean, kept, q = None, 1.0, 0.75
        for t in range(150):
            x = rows["ab".index(s) * 150 + t][2]
            y = 0.9 * y + (x or 0.0)
            top, weight, kept = top * q + (x or 0.0), weight * q + (x is not None), kept * q
            if x is not None:
                mean = x if mean is None else (kept * mean + 0.25 * x) / (kept + 0.25)
                kept = 1.0
            r = by[s, t]
            assert r.y == pytest.approx(y, abs=1e-12)
            assert r.adjusted == (pytest.approx(top / weight, abs=1e-12) if weight else None)
            assert r.plain == (None if mean is None else pytest.approx(mean, abs=1e-12))


def test_tails_of_the_f_distribution():
    assert selection.incomplete_beta(0.5, 2.0, 3.0) == pytest.approx(0.6875, rel=1e-14)
    for v in (1, 2, 5):  # closed forms of Student's t
        for t in (0.1, 1.0, 4.0, 30.0):
            exact = {1: 1 - 2 / math.pi * math.atan(t), 2: 1 - t / math.sqrt(2 + t * t), 5: 1 - 2 / math.pi * (math.atan(t / math.sqrt(5)) + (t / math.sqrt(5)) / (1 + t * t / 5) * (1 + 2 / (3 * (1 + t * t / 5))))}[v]
            assert selection.incomplete_beta(v / (v + t * t), v / 2, 0.5) == pytest.approx(exact, rel=1e-9, abs=1e-15)


def test_count_bounds_are_those_of_ranks(spark):
    rnd = random.Random(11)
    rows = [("a", float(rnd.randint(0, 40))) for _ in range(400)] + [("a", 13.0)] * 300 + [("b", float(k)) for k in range(100)] + [("c", 1.0)] * 5
    lows = {r.k: {e._bin: e._low for e in r.lows} for r in selection.count_bounds(spark.createDataFrame(rows, "k string, x double"), "k", "x", 8).collect()}
    for k in "abc":
        xs = sorted(x for s, x in rows if s == k)
        want: dict = {}
        for x in xs:
            b = xs.index(x) * 8 // len(xs)
            want[b] = min(want.get(b, x), x)
        want.pop(0, None)
        assert lows.get(k, {}) == want
