"""Warped series, text factors and composites against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import active_trading as act
from quartzite.operators import composites as comp
from quartzite.operators import cross_pass, series_similarity, text_factors
from quartzite.plans.lineage import cut


def plain_warp(x, y, band):
    n = len(x)
    t = np.full((n + 1, n + 1), np.inf)
    t[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(n, i + band) + 1):
            t[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
    return float(np.sqrt(t[n, n]))


def test_warped_distances_equal_the_plain_programme():
    rnd = np.random.default_rng(1)
    for size, band in ((1, 1), (2, 1), (9, 3), (30, 4), (12, 20)):
        x, y = rnd.normal(size=(40, size)), rnd.normal(size=(40, size))
        got = series_similarity.warped(x, y, band)
        assert got == pytest.approx([plain_warp(a, b, band) for a, b in zip(x, y, strict=True)], rel=1e-12)
        low, high = series_similarity.envelopes(y, band)
        assert (np.diag(series_similarity.lower_bounds(x, low, high)) <= got + 1e-9).all()


def test_nearest_by_all_pairs(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(6, 24))
    rows = [(i, (np.roll(base[i % 6], i % 3) + rnd.normal(size=24) * 0.3).tolist()) for i in range(70)] + [(100, rows_of_zero()), (101, [1.0, 2.0])]
    got: dict = {}
    for r in series_similarity.nearest(spark.createDataFrame(rows, "symbol int, values array<double>"), 4, 3, 16).collect():
        got.setdefault(r.src, []).append((r.distance, r.dst))
    ids = [i for i, v in rows if len(v) == 24]
    z = series_similarity.standardised(np.array([v for _, v in rows if len(v) == 24]))
    for a, x in zip(ids, z, strict=True):
        want = sorted((plain_warp(x, y, 3), b) for b, y in zip(ids, z, strict=True) if b != a)[:4]
        assert [b for _, b in sorted(got[a])] == [b for _, b in want]
        assert [d for d, _ in sorted(got[a])] == pytest.approx([d for d, _ in want], rel=1e-12)
    assert series_similarity.nearest(spark.createDataFrame([], "symbol int, values array<double>"), 4, 3).count() == 0

def test_equal_series_are_compared_once(spark):
    """Classes of equal series: neighbours are those of all pairs, ties by id, while each different series is compared once."""
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(7, 20)).round(2)
    rows = [(i, base[i % 7].tolist()) for i in range(60)] + [(200, (base[0] * 2).tolist()), (201, rnd.normal(size=20).tolist())]
    seen = []
    whole = series_similarity.nearest_classes

    def classes(d, *args):
        seen.append(d.count())
        return whole(d, *args)

    series_similarity.nearest_classes = classes
    try:
        d = spark.createDataFrame(rows, "symbol int, values array<double>")
        got: dict = {}
        for r in series_similarity.nearest(d, 4, 3, 16).collect():
            got.setdefault(r.src, []).append((r.distance, r.dst))
    finally:
        series_similarity.nearest_classes = whole
    z = dict(zip([i for i, _ in rows], series_similarity.standardised(np.array([v for _, v in rows])), strict=True))
    for a in z:
        want = sorted((round(plain_warp(z[a], z[b], 3), 9), b) for b in z if b != a)[:4]
        assert [(round(x, 9), b) for x, b in sorted((round(x, 9), b) for x, b in got[a])] == want
    assert seen == [9]


def rows_of_zero():
    return [0.0] * 24


def test_text_directions_are_those_of_the_matrix(spark):
    rnd = random.Random(3)
    topics = [["alpha", "beta", "gamma"], ["kilo", "lima", "mike"], ["xray", "yankee", "zulu"]]
    rows = [(i, " ".join(rnd.choice(topics[i % 3]) for _ in range(rnd.randint(3, 12)))) for i in range(90)] + [(500, None), (501, ""), (502, "?"), (503, "Alpha  BETA\n")]
    d = spark.createDataFrame(rows, "id int, text string").repartition(5)
    found = text_factors.terms(d, "text", 60)
    a = np.zeros((len(rows), len(found.place)))
    for i, (_, t) in enumerate(rows):
        at, w = found.row(t or "")
        a[i, at] = w
    assert found.row("Alpha  BETA\n")[1] @ found.row("alpha beta")[1] == pytest.approx(1.0)
    df = {g: sum(g in text_factors.grams(t or "", 2, 4) for _, t in rows) for g in found.place}
    assert all(found.idf[k] == pytest.approx(np.log((1 + len(rows)) / (1 + df[g])) + 1) for g, k in found.place.items())
    e = text_factors.truncated_svd(d, "text", found, 3, passes=3)
    _, s, vt = np.linalg.svd(a)
    assert e.values == pytest.approx(s[:3], rel=1e-6)
    assert np.abs(e.directions @ e.directions.T - vt[:3].T @ vt[:3]).max() < 1e-4
    got = {r.id: r.code for r in text_factors.encoded(d, "id", "text", e).collect()}
    assert got[500] == got[501] == [0.0] * 3 and len(got) == len(rows)
    assert np.allclose([got[i] for i, _ in rows], a @ e.directions)


def test_cross_pass_by_plain_loops(spark):
    rnd = np.random.default_rng(4)
    rows = [(int(s), int(t), float(rnd.integers(0, 6)) if rnd.random() < 0.9 else None, float(rnd.normal()), float(rnd.normal())) for t in range(5) for s in range(15 if t else 6)]
    d = spark.createDataFrame(rows, "symbol int, td int, a double, b double, c double")
    got = {(r.symbol, r.td): r for r in cross_pass.crossed(d, cross_pass.Pass({"ra": "a"}, {"zb": "b"}, {"mc": "c"}, {"res": ("b", ["a", "c"])})).collect()}
    for t in range(5):
        day = [r for r in rows if r[1] == t]
        xs = [r[2] for r in day if r[2] is not None]
        b = np.array([r[3] for r in day])
        full = [r for r in day if r[2] is not None]
        design = np.array([[1.0, r[2], r[4]] for r in full])
        fit = np.linalg.lstsq(design, np.array([r[3] for r in full]), rcond=None)[0]
        for r in day:
            g = got[r[0], t]
            assert g.ra == (None if r[2] is None else pytest.approx((sum(x < r[2] for x in xs) + (sum(x == r[2] for x in xs) + 1) / 2) / len(xs)))
            assert g.zb == pytest.approx((r[3] - b.mean()) / b.std(ddof=1)) and g.mc == pytest.approx(np.mean([x[4] for x in day]))
            assert g.res == (pytest.approx(r[3] - fit @ [1.0, r[2], r[4]], abs=1e-9) if r[2] is not None and len(full) >= 8 else None)


def test_drivers_clusters_and_variance(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for t in range(40):
        x = rnd.normal(size=(20, 2))
        y = x[:, 0] + 0.5 * x[:, 1] + rnd.normal(size=20) * 0.3
        rows += [(int(i), t, float(x[i, 0]), float(x[i, 1]), float(x[i, 0] + rnd.normal() * 1e-3), float(rnd.normal()), float(y[i])) for i in range(20)]
    d = spark.createDataFrame(rows, "symbol int, td int, a double, b double, copy double, noise double, y double")
    found = {n: (ic, left, ok) for n, ic, left, ok in comp.orthogonal_drivers(d, ["a", "b", "copy", "noise"], "y", 0.1, cut)}
    first = "a" if abs(found["a"][0]) >= abs(found["copy"][0]) else "copy"
    second = "copy" if first == "a" else "a"
    assert found[first][2] and found["b"][2] and not found["noise"][2]
    assert not found[second][2] and abs(found[second][1]) < 0.1 < abs(found[second][0])
    order = comp.variance_order(d, ["a", "b", "copy", "noise"], 0.01)
    assert len(order) == 3 and all(v > 0.8 for _, v in order)
    assert comp.correlation_clusters([("a", "b", 0.1), ("a", "c", -0.9), ("c", "d", 0.85), ("b", "d", None)], ["a", "b", "c", "d"], 0.8) == {"a": "a", "b": "b", "c": "a", "d": "a"}


def test_pivoted_cholesky_rebuilds():
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(50, 6))
    x[:, 5] = x[:, 0] + x[:, 1]
    g = x.T @ x
    order, rows = comp.pivoted_cholesky(g, 1e-10)
    assert len(order) == 5 and np.allclose(rows.T @ rows, g)
    assert comp.pivoted_cholesky(np.zeros((3, 3)), 0.0)[0] == []


def test_intervals_with_repeated_starts(spark):
    rows = [(1, 2, 5, "a"), (1, 2, 8, "b"), (1, 4, 4, "c"), (1, 7, None, "d"), (2, 3, 1, "e"), (2, 0, 2, "f")]
    days = spark.createDataFrame([(t,) for t in (0, 2, 3, 4, 5, 9)], "td int")
    got = {(r.symbol, r.td): r.v for r in comp.interval_panel(spark.createDataFrame(rows, "symbol int, start int, end int, v string"), days, "v").collect()}
    assert got == {(1, 2): "b", (1, 3): "b", (1, 4): "c", (1, 5): "b", (1, 9): "d", (2, 0): "f", (2, 2): "f"}


def test_pressure_without_trades_and_concentration_ties(spark):
    schema = "symbol int, td int, slot int, amount double, buy_amount double, sell_amount double, avg_buy double"
    rows = [(1, 1, k, 10.0, 0.0, 0.0, None) for k in range(4)] + [(2, 1, k, 10.0, 6.0, 4.0, 3.0) for k in range(4)]
    d = spark.createDataFrame(rows, schema)
    got = {r.symbol: r for r in act.daily_pressure(d, F.lit(1.0), least_bars=2).collect()}
    assert got[1].pressure is None and got[2].pressure == pytest.approx(0.2) and got[2].smart_pressure is None
    conc = {r.symbol: r.concentration for r in act.size_concentration(d).collect()}
    assert conc == {1: None, 2: 1.0}
