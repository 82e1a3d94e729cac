import comparing
import numpy as np
import pytest

from quartzite.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, component int"


def brute(vectors, most=16):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    sums = fit.astype(int).sum(axis=0).astype(object)
    deviation = [int(d) for d in ((n * x.astype(int).astype(object) - sums) ** 2).sum(axis=1)]
    return n, deviation, (x - mean) @ axes / np.sqrt(values), values / np.trace(cov)


def compare(rows, vectors, ids, most=16):
    n, deviation, white, explained = brute(vectors, most)
    k = white.shape[1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(ids) * k == len(rows)
    table = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table * sign - white).max() < 1e-8
    for i, d in zip(ids, deviation, strict=True):
        r = got[i, 1]
        assert r.n == n and r.deviation == d and r.identity_error < 1e-10
    assert np.allclose([got[ids[0], c].explained for c in range(1, k + 1)], explained, rtol=1e-9)


def test_symmetric_eigen():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64):
        a = rng.normal(size=(n, n))
        for m in (a + a.T, a @ a.T, np.diag(rng.integers(0, 3, n).astype(float)), np.ones((n, n))):
            values, axes = whitening.symmetric_eigen(m)
            assert np.abs(axes.T @ axes - np.eye(n)).max() < 1e-12
            assert np.abs(axes @ np.diag(values) @ axes.T - m).max() < 1e-11 * max(1, np.abs(m).max())
            assert (np.diff(values) <= 0).all()


def test_moments_merge_as_one_pass():
    x = np.random.default_rng(3).integers(-500, 500, (1000, 5)) + 1_000_000
    parts = []
    for k in range(0, 1000, 130):
        m = whitening.Moments(5)
        for i in range(k, min(1000, k + 130), 7):
            m.update(x[i : min(i + 7, k + 130)])
        parts.append(whitening.Moments.of(m.row()))
    total = whitening.Moments(5)
    for m in parts:
        total.merge(m)
    assert total.n == 1000 and total.sums() == x.sum(axis=0).tolist()
    assert np.allclose(total.moment / 1000, np.cov(x.T, ddof=0), rtol=1e-12)


def test_whole_table_by_brute_force(spark):
    rows = queries.op12_whitening(spark, comparing.DATA).collect()
    table = queries.table(spark, comparing.DATA, "embeddings").collect()
    compare(rows, [r.embedding for r in table], [r.vec_id for r in table])


def test_nulls_repeats_lengths_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    plain = [(i, rng.normal(size=3).astype("f4").tolist(), 0, "x", 1) for i in range(40)]
    copies = [(100 + i, plain[0][1], 0, "x", 1) for i in range(30)]
    bad = [(200, None, 0, "x", 1), (201, [1.0, None, 2.0], 0, "x", 1), (202, [1.0, float("nan"), 2.0], 0, "x", 1), (203, [float("inf"), 0.0, 2.0], 0, "x", 1), (204, [], 0, "x", 1)]
    other = [(300 + i, rng.normal(size=2).astype("f4").tolist(), 0, "x", 1) for i in range(9)]
    d = spark.createDataFrame(plain + copies + bad + other, SCHEMA).repartition(7)
    rows = whitening.whitened(d, fan=2).collect()
    three = [r for r in rows if r.vec_id < 200]
    compare(three, [p[1] for p in plain + copies], [p[0] for p in plain + copies])
    compare([r for r in rows if r.vec_id >= 300], [p[1] for p in other], [p[0] for p in other])
    assert len(rows) == 70 * 3 + 9 * 2
    assert whitening.whitened(d.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [[[0.5, 0.5]] * 4, [[0.1, 0.2], [0.3, 0.2], [0.7, 0.2]]])
def test_components_without_variance(spark, rows):
    d = spark.createDataFrame([(i, v, 0, "", 1) for i, v in enumerate(rows)], SCHEMA)
    got = whitening.whitened(d).collect()
    assert len(got) == 2 * len(rows)
    assert all(r.whitened is None for r in got if r.component == 2) and max(r.identity_error for r in got) < 1e-10


def test_large_entries(spark):
    d = spark.createDataFrame([(i, [1e12 * i, -3e30, float(i % 3)], 0, "", 1) for i in range(8)], SCHEMA)
    got = whitening.whitened(d).collect()
    assert len(got) == 24 and all(r.n == 8 for r in got) and any(r.deviation is None for r in got)
