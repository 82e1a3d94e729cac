"""Warped distances by tiles: the single-precision pass loses no neighbour, a pair of blocks answers for both, ties stay few."""

import numpy as np
import pytest

from quartzite.operators import series_similarity as sim


@pytest.mark.parametrize(("size", "band"), [(1, 1), (2, 5), (7, 1), (20, 4), (13, 30)])
def test_tiles_equal_pairs(size, band):
    rnd = np.random.default_rng(size)
    x, y = rnd.normal(size=(9, size)), rnd.normal(size=(11, size))
    want = sim.warped(np.repeat(x, 11, axis=0), np.tile(y, (9, 1)), band, 7).reshape(9, 11)
    for cells in (1, 8, 4096):
        assert np.sqrt(sim.all_squares(x, y, band, cells)) == pytest.approx(want, rel=1e-5)


def nearest_of(d, k):
    return [[(float(row[j]), int(j)) for j in np.lexsort((np.arange(len(row)), row))[:k] if np.isfinite(row[j])] for row in d]


@pytest.mark.parametrize("same", [False, True])
def test_neighbours_closer_than_single_precision_tells(same):
    """Distances that differ by a part in 10**9 are one number in single precision; the order is that of double precision."""
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(3, 16))
    x = sim.standardised(np.concatenate([base[[k % 3]] + 1e-9 * rnd.normal(size=(1, 16)) + 0.1 * (k % 3 == 0) for k in range(30)]))
    y = x if same else sim.standardised(np.concatenate([base[[k % 3]] + 1e-3 * (1 + 1e-8 * k) * np.arange(16) for k in range(24)]))
    d = np.array([sim.warped(np.tile(v, (len(y), 1)), y, 3) for v in x])
    if same:
        np.fill_diagonal(d, np.inf)
    for found, whole in zip(sim.nearest_in_block(x, y, same, 3, 4), [d] if same else [d, d.T], strict=True):
        got: list = [[] for _ in whole]
        for i, j, v in zip(*found, strict=True):
            got[i].append((float(v), int(j)))
        assert got == nearest_of(whole, 4)


def test_ties_give_no_more_than_k_rows():
    x = np.zeros((40, 6))
    (i, j, d), (_, _, _) = sim.nearest_in_block(x, x.copy(), False, 2, 3)
    assert np.bincount(i).tolist() == [3] * 40 and set(j.tolist()) == {0, 1, 2} and not d.any()


def test_a_pair_of_blocks_is_one_group(spark):
    """Each of 6 blocks goes to 6 groups, not once to ask and once to be asked; neighbours are those of all pairs."""
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(60, 12))
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "symbol long, values array<double>")
    found = sim.nearest_classes(d, 3, 2, 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Union" not in plan
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.src, r.distance, r.dst)):
        got.setdefault(r.src, []).append(r.dst)
    z = sim.standardised(x)
    whole = np.array([sim.warped(np.tile(v, (60, 1)), z, 2) for v in z])
    np.fill_diagonal(whole, np.inf)
    assert got == {k: [j for _, j in v] for k, v in enumerate(nearest_of(whole, 3))}
