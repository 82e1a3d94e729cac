"""Boosted trees against a plain version, correlations by block products against pairs of lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import boosting, graphs


def rows_of(n=600, seed=3):
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.normal(size=(n, 3)), 2)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.8 * x[:, 1] * (x[:, 0] > 0.3) + rnd.normal(size=n) * 0.1
    return x, y


def plain_fit(x, y, cuts, trees, depth, rate, least, ridge):
    """The same trees, node by node over lists of rows; predictions for x."""
    pred = np.full(len(y), y.mean())
    gains = np.zeros(x.shape[1])
    for _ in range(trees):
        left = y - pred
        step = np.zeros(len(y))

        def grow(rows, level, left=left, step=step):
            value = left[rows].sum() / (len(rows) + ridge)
            best = (1e-12, None, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for c in cuts[f]:
                        a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                        if len(a) >= least and len(b) >= least:
                            gain = left[a].sum() ** 2 / (len(a) + ridge) + left[b].sum() ** 2 / (len(b) + ridge) - left[rows].sum() ** 2 / (len(rows) + ridge)
                            if gain > best[0] + 1e-9:
                                best = (gain, f, c)
            if best[1] is None:
                step[rows] = value
                return
            gains[best[1]] += best[0]
            grow(rows[x[rows, best[1]] <= best[2]], level + 1)
            grow(rows[x[rows, best[1]] > best[2]], level + 1)

        grow(np.arange(len(y)), 0)
        pred = pred + rate * step
    return pred, gains


def test_trees_equal_the_plain_version(spark):
    x, y = rows_of()
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))] + [(9001, None, 1.0, 1.0, 5.0), (9002, 1.0, float("nan"), 1.0, 5.0)]
    d = spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(4)
    model = boosting.fit(d, ["a", "b", "c"], "y", trees=4, depth=2, rate=0.3, bins=8, least=15)
    held = d.where("id < 9000")
    cuts = [np.unique(held.select(F.percentile_approx(f, F.array(*[F.lit(k / 8) for k in range(1, 8)]), F.lit(800))).first()[0]) for f in "abc"]
    pred, gains = plain_fit(x, y, cuts, 4, 2, 0.3, 15, 1.0)
    got = {r.id: r.p for r in boosting.predicted(d, model, "p").collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(pred.tolist(), abs=1e-9)
    assert got[9001] is None and got[9002] is None
    assert list(model.gains.values()) == pytest.approx(gains.tolist(), rel=1e-9)
    assert boosting.selected(model, 2)[0][0] == "a" and ((y - pred) ** 2).mean() < 0.5 * y.var()


def test_constant_target_and_no_rows(spark):
    d = spark.createDataFrame([(float(k), 2.0) for k in range(50)], "a double, y double")
    model = boosting.fit(d, ["a"], "y", trees=2, depth=2, least=5)
    assert boosting.selected(model, 3) == [] and {r.p for r in boosting.predicted(d, model, "p").collect()} == {2.0}
    assert boosting.fit(d.limit(0), ["a"], "y").trees == []


def test_correlations_over_common_dates(spark):
    rnd = np.random.default_rng(4)
    rows = [(s, t, float(rnd.normal() + 5) if s != 7 else 3.0) for s in range(30) for t in range(40) if rnd.random() < 0.7]
    d = spark.createDataFrame(rows, "symbol int, td int, v double")
    got = {(r.src, r.dst): (r.n, r.w) for r in graphs.return_correlations(d, "v", 15, block=8).collect()}
    by: dict = {}
    for s, t, v in rows:
        by.setdefault(s, {})[t] = v
    want = {}
    for a in by:
        for b in by:
            both = sorted(set(by[a]) & set(by[b]))
            if a < b and len(both) >= 15:
                x, y = np.array([by[a][t] for t in both]), np.array([by[b][t] for t in both])
                want[a, b] = (len(both), None if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1])
    assert set(got) == set(want)
    for k, (n, w) in want.items():
        assert got[k][0] == n and got[k][1] == (None if w is None else pytest.approx(w, abs=1e-12))


def test_passes_do_not_repeat_what_made_the_rows(spark):
    """Every level of every tree is a pass over the rows; what the rows are made of is worked out once."""
    x, y = rows_of(200)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    d = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").mapInArrow(count, "a double, b double, c double, y double")
    boosting.fit(d, ["a", "b", "c"], "y", trees=3, depth=2, bins=8, least=15)
    assert made.value == 200


@pytest.mark.parametrize("block", [3, 2048])
def test_equal_series_are_one_class(spark, block):
    """Copies of a symbol: its correlations are worked out once, and no pair of symbols is lost; the heaviest edges are those of all pairs."""
    rnd = np.random.default_rng(6)
    base = {s: {t: float(rnd.normal()) if s != 3 else 2.0 for t in range(30) if rnd.random() < 0.8} for s in range(8)}
    rows = [(s + 10 * copy, t, v) for copy in range(6) for s, days in base.items() for t, v in days.items()]
    d = spark.createDataFrame(rows, "symbol int, td int, v double")
    by: dict = {}
    for s, t, v in rows:
        by.setdefault(s, {})[t] = v
    want = {}
    for a in by:
        for b in by:
            both = sorted(set(by[a]) & set(by[b]))
            if a < b and len(both) >= 12:
                x, y = np.array([by[a][t] for t in both]), np.array([by[b][t] for t in both])
                want[a, b] = (len(both), None if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1])
    found = graphs.return_correlations(d, "v", 12, block).collect()
    got = {(r.src, r.dst): (r.n, r.w) for r in found}
    assert len(found) == len(got) and set(got) == set(want)
    for k, (n, w) in want.items():
        assert got[k][0] == n and got[k][1] == (None if w is None else pytest.approx(w, abs=1e-12))
    assert graphs._class_pairs(d, "v", 12, block, None).count() <= 8 * 9 // 2
    tops: dict = {}
    for a, b in sorted(want):
        tops.setdefault(a, []).append((-round(want[a, b][1], 9) if want[a, b][1] is not None else 9, b))
    heavy: dict = {}
    for r in graphs.heaviest_correlations(d, "v", 12, 3, block).collect():
        heavy.setdefault(r.src, set()).add(r.dst)
    assert heavy == {a: {b for _, b in sorted(p)[:3]} for a, p in tops.items()}


def test_what_is_sent_to_blocks_grows_as_the_classes():
    """A class is sent once a block: a number of blocks that grows with the classes makes that their square."""
    assert {graphs.block_count(n, 16384, every) for n in (60_000, 200_000, 360_000) for every in (True, False)} == {24}
    assert graphs.block_count(1_000_000, 16384, False) == 62 and graphs.block_count(20, 3, True) == 7 and graphs.block_count(0, 16384, True) == 1


def test_edges_of_single_symbols_come_in_whole_batches(spark):
    """Symbols of values of their own: no batch of Arrow an edge, and the edges are the heaviest of all pairs."""
    rnd = np.random.default_rng(12)
    rows = [(s, t, float(rnd.normal())) for s in range(40) for t in range(25)]
    d = spark.createDataFrame(rows, "symbol int, td int, v double")
    pairs = {(r.src, r.dst): r.w for r in graphs.return_correlations(d, "v", 20).collect()}
    want = {(a, b) for a in range(40) for b in sorted((b for b in range(a + 1, 40)), key=lambda b: (-pairs[a, b], b))[:3]}
    assert {(r.src, r.dst) for r in graphs.heaviest_correlations(d, "v", 20, 3).collect()} == want


def test_returns_come_from_lines_sent_once(spark):
    """Of the panel only the close, from lines that go to their symbols: no week's sums are exchanged, no table joined."""
    from comparing import DATA
    from quartzite import queries_cuts

    plan = queries_cuts._returns(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "sum(" not in plan
