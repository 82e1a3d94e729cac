"""Families as one Arrow pass: windows against plain loops, and plans whose Python passes don't grow with the stages."""

import numpy as np
import pytest

from comparing import DATA
from quartzite import queries
from quartzite.functions.matrices import Matrices
from quartzite.operators.rolling_pass import rolled
from quartzite.operators.symbol_pass import by_date, by_symbol


def plan_of(spark, name):
    return queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_engine_is_two_passes_over_one_panel(spark):
    plan = plan_of(spark, "factors_engine")
    assert plan.count("MapInArrow") == 2 and plan.count("FlatMapGroupsInArrow") == 1
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 3 and "SortMergeJoin" not in plan


def test_eod_is_one_pass_over_one_panel(spark):
    plan = plan_of(spark, "factors_eod")
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def test_broker_reads_the_lines_of_one_exchange(spark):
    query = queries.QUERIES["factors_broker"](spark, DATA)
    query.collect()
    plan = query._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 2 and "ReusedExchange" in plan and plan.count("FileScan") == 1


def some_rows():
    rnd = np.random.default_rng(3)
    return [(s, t, float(np.round(rnd.normal(), 2)) if rnd.random() < 0.9 else None, float(rnd.normal())) for s in range(25) for t in range(5, 60) if rnd.random() < 0.7]


def of_panel():
    def make(p):
        p["gain"] = np.where(p["x"] > 0, p["x"], 0.0)  # 0, not missing, where x is missing; nothing on dates that the symbol lacks
        return {
            "mean": p.mean("x", 5), "std": p.std("x", 7, 2), "lag": p.shift("x", 3), "ahead": p.shift("x", -1), "hits": p.hits(p["x"] > 0.5, 6, 9), "share": p.share(p["x"] > 0.5, 6, 9),
            "corr": p.corr("x", "y", 8, 4), "skew": p.skew("y", 9, 4), "gains": p.agg("count", "gain", 6), "unnamed": p.mean(p["x"] * p["y"], 6, 2), "y": p["y"],
        }

    return make  # workers don't have this module


def plain(rows, s, t):
    at = {u: (x, y) for r, u, x, y in rows if r == s}

    def held(w, k):
        return [at[u][k] for u in range(t - w + 1, t + 1) if u in at and at[u][k] is not None]

    def stat(v, least, fn):
        return fn(np.array(v)) if len(v) >= least else None

    pairs = [at[u] for u in range(t - 7, t + 1) if u in at and at[u][0] is not None]
    products = [x * y for u in range(t - 5, t + 1) if u in at and at[u][0] is not None for x, y in [at[u]]]
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    hits = sum(x > 0.5 for x in held(6, 0))

    def skew(v):
        n, c = len(v), v - v.mean()
        return np.sqrt(n * (n - 1)) / (n - 2) * (c**3).mean() / (c**2).mean() ** 1.5

    return {
        "mean": stat(held(5, 0), 3, np.mean), "std": stat(held(7, 0), 2, lambda v: v.std(ddof=1)), "lag": at.get(t - 3, (None,))[0], "ahead": at.get(t + 1, (None,))[0],
        "hits": float(hits) if t + 1 >= 9 else None, "share": hits / min(6, t + 1) if t + 1 >= 9 else None,
        "corr": np.corrcoef(a, b)[0, 1] if len(pairs) >= 4 and a.std() > 1e-12 and b.std() > 1e-12 else None,
        "skew": stat(held(9, 1), 4, skew), "gains": float(sum(u in at for u in range(t - 5, t + 1))), "unnamed": stat(products, 2, np.mean), "y": at[t][1],
    }


@pytest.mark.parametrize(("rows", "cells"), [(1 << 15, 1 << 15), (40, 100)])
def test_windows_equal_plain_loops(spark, rows, cells):
    held = some_rows()
    d = spark.createDataFrame(held, "symbol int, td int, x double, y double").repartition(3, "symbol").sortWithinPartitions("symbol", "td")
    names = ["mean", "std", "lag", "ahead", "hits", "share", "corr", "skew", "gains", "unnamed", "y"]
    found = by_symbol(d, ["x", "y"], of_panel(), names, rows, cells).collect()
    assert sorted((r.symbol, r.td) for r in found) == sorted((s, t) for s, t, _, _ in held)
    for r in found:
        for n, v in plain(held, r.symbol, r.td).items():
            assert r[n] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12)), (n, r)


def test_unnamed_columns_share_no_results():
    p = Matrices({"x": np.array([[1.0, 2.0, 4.0]])}, np.array([[True, True, True]]), np.arange(3), rolled)
    assert p.mean(p["x"] * 2, 2, 1).tolist() == [[2.0, 3.0, 6.0]] and p.mean(p["x"] * 3, 2, 1).tolist() == [[3.0, 4.5, 9.0]]


def test_dates_keep_columns_and_rows(spark):
    rows = [(s, t, float(s * t), None if s == 2 else float(s)) for s in range(4) for t in range(3)]
    found = by_date(spark.createDataFrame(rows, "symbol int, td int, a double, b double"), ["b"], lambda x: {"m": np.full(len(x["b"]), np.nansum(x["b"]))}, ["m"], ["a"]).collect()
    assert sorted((r.symbol, r.td, r.a, r.m) for r in found) == sorted((s, t, a, 4.0) for s, t, a, _ in rows)
