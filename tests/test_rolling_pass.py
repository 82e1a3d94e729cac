"""Bounded windows by Arrow passes against plain loops; families without windows that go over each row's frame."""

import math
import random
import statistics

import pytest

from quartzite import queries
from quartzite.functions import windows
from quartzite.operators.rolling_pass import staged_by_symbol
from comparing import DATA


def plain(fn, values, share=0.9):
    there = sorted(v for v in values if v is not None)
    if fn == "count":
        return len(there)
    if not there or (fn == "stddev_samp" and len(there) < 2):
        return None
    if fn == "percentile":
        at = (len(there) - 1) * share
        low = math.floor(at)
        return there[low] + (there[min(low + 1, len(there) - 1)] - there[low]) * (at - low)
    return {"sum": math.fsum, "avg": statistics.fmean, "min": min, "max": max, "stddev_samp": statistics.stdev, "stddev_pop": statistics.pstdev}[fn](there)


def test_frames_equal_plain_loops(spark):
    rnd = random.Random(1)
    rows = [(s, t, None if rnd.random() < 0.2 else 5.0 if s == 3 else rnd.gauss(1e4, 3)) for s in range(9) for t in range(40) if rnd.random() < 0.7] + [(50, 7, 1.5)]
    d = spark.createDataFrame(rows, "symbol int, td int, x double").repartition(3)
    frames = [(1, "range", 0), (7, "range", 0), (20, "range", 1), (5, "rows", 0), (6, "rows", 1), (60, "range", 0)]
    stage, want = {}, {}
    for fn in ("count", "sum", "avg", "min", "max", "stddev_samp", "stddev_pop", "percentile"):
        for k, (w, kind, after) in enumerate(frames):
            stage[f"{fn}_{k}"] = windows.agg(fn, "x, 0.9e0" if fn == "percentile" else "x", w, kind, after)
            want[f"{fn}_{k}"] = (fn, w, kind, after)
    stage |= {"before": windows.shift("x", 3), "next": windows.shift("x", -1)}
    got = {(r.symbol, r.td): r for r in staged_by_symbol(d, [stage, {"twice": "2 * sum_1"}], [*stage, "twice"]).collect()}
    assert len(got) == len(rows)
    for s in {r[0] for r in rows}:
        own = sorted((t, x) for a, t, x in rows if a == s)
        for place, (t, _) in enumerate(own):
            r = got[s, t]
            for name, (fn, w, kind, after) in want.items():
                held = [x for u, x in own if t - w + 1 - after <= u <= t - after] if kind == "range" else [x for p, (_, x) in enumerate(own) if place - w + 1 - after <= p <= place - after]
                value = plain(fn, held)
                assert r[name] == (None if value is None else pytest.approx(value, rel=1e-11, abs=1e-11)), (name, s, t)
                if fn.startswith("stddev") and s == 3 and value is not None:
                    assert r[name] == 0.0
            assert r["before"] == dict(own).get(t - 3) and r["next"] == dict(own).get(t + 1)
            assert r["twice"] == (None if r["sum_1"] is None else 2 * r["sum_1"])


@pytest.mark.parametrize("name", ["factors_eod", "factors_broker", "factors_engine", "factors_flow_states", "factors_flow_response"])
def test_families_have_no_window_over_whole_rows(spark, name):
    """A window over a date holds and sorts its wide rows, one by symbol goes over each row's frame for each aggregate."""
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and "MapInArrow" in plan


def test_other_windows_are_refused(spark):
    d = spark.createDataFrame([(1, 1, 2.0)], "symbol int, td int, x double")
    with pytest.raises(ValueError, match="bounded frame"):
        staged_by_symbol(d, [{"y": "avg(x) over (partition by td)"}], ["y"])


def test_neutral_chain_moves_its_columns_once(spark):
    """One group a date does all steps: no window sorts a date, and the panel's other columns stay behind."""
    plan = queries.QUERIES["neutral_chain"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsIn") == 1 and "rank(" not in plan


def test_drivers_make_their_panel_once(spark, monkeypatch):
    """All passes of the drivers, and both smoothings, read a table of the few columns that they need."""
    from quartzite import queries_active, queries_more

    made = []
    for module in (queries_active, queries_more):
        whole = module.stored
        monkeypatch.setattr(module, "stored", lambda df, whole=whole: made.append(df.columns) or whole(df))
    queries_active.drivers(spark, DATA)
    queries.QUERIES["ewm_mean"](spark, DATA)
    assert [c[:3] for c in made] == [["symbol", "td", "fwd"], ["symbol", "td", "x"], ["symbol", "td", "x"]]
