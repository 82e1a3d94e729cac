"""The classifier: its risk against plain loops, held-out ranking, and edge cases."""

import math
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.llm import quality, queries

DATA = "/root/testdata/sf0.01"


def plain_descent(p, u, pi, steps, rate, decay):
    """Adam on the non-negative risk, a row and a weight at a time."""
    width = len(p[0])
    w, m, v = [0.0] * (width + 1), [0.0] * (width + 1), [0.0] * (width + 1)
    sig = lambda z: 1 / (1 + math.exp(-max(-40, min(40, z))))

    def mean_grad(rows, slope):
        g = [0.0] * (width + 1)
        for r in rows:
            c = slope(sum(a * b for a, b in zip(r, w, strict=False)) + w[-1])
            for j in range(width):
                g[j] += c * r[j] / len(rows)
            g[-1] += c / len(rows)
        return g

    negative = lambda rows: sum(-math.log1p(-min(sig(sum(a * b for a, b in zip(r, w, strict=False)) + w[-1]), 1 - 1e-9)) for r in rows) / len(rows)
    for t in range(1, steps + 1):
        rest = negative(u) - pi * negative(p)
        up, pn, un = mean_grad(p, lambda z: sig(z) - 1), mean_grad(p, sig), mean_grad(u, sig)
        down = [a - pi * b for a, b in zip(un, pn, strict=True)]
        grad = [pi * a + b for a, b in zip(up, down, strict=True)] if rest >= 0 else [-x for x in down]
        for j in range(width + 1):
            g = grad[j] + (decay * w[j] if j < width else 0.0)
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            w[j] -= rate * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return w


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_fit_by_plain_loops(prior):
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (12, 3)).astype(np.float32), rng.normal(0, 1, (30, 3)).astype(np.float32)
    mean, sd = u.astype(float).mean(axis=0), np.maximum(u.astype(float).std(axis=0), 1e-3)
    want = plain_descent(np.clip((p - mean) / sd, -8, 8).tolist(), np.clip((u - mean) / sd, -8, 8).tolist(), prior, 40, 0.03, 2e-3)
    model = quality.fit(p, u, prior, steps=40)
    assert np.append(model.weights, model.bias) == pytest.approx(np.array(want), abs=2e-3)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the tables of sf0.01")
def test_held_out_ranking(spark):
    got = {r.doc_id: r.score for r in queries.op7_quality(spark, DATA).collect()}
    marked = [(r.doc_id, r.quality) for r in queries.table(spark, DATA, "labels").collect() if r.doc_id in got and r.quality is not None]
    held = [(got[d], q) for d, q in marked if zlib.crc32(str(d).encode()) % 5 == 0]
    good, bad = np.array([s for s, q in held if q == 1]), np.array([s for s, q in held if q == 0])
    assert len(bad) >= 5
    assert ((good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()) >= 0.9
    assert (bad < 0.3).mean() >= 0.7 and (good >= 0.3).mean() >= 0.9


def test_edge_cases_of_the_classifier(spark):
    rows = [(i, "plain words of a text " * (1 + i % 5) if i % 2 else "x#9 &&% 0101 ZZZ " * (1 + i % 7), "a", 1) for i in range(60)]
    rows += [(60, None, None, 2), (61, "", None, 2), (None, "some text", None, 3), (1, rows[1][1], "a", 1), (62, "long text " * 40000, "b", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _score string, x int")
    labels = spark.createDataFrame([(i, i % 2, "u") for i in range(60)] + [(3, None, "u"), (None, 1, "u"), (5, 0, "u")], "doc_id long, quality int, positive string")
    model = quality.train(d, labels)
    got = quality.scored(d, model).collect()
    assert len(got) == len(rows) and all(0 <= r._score <= 1 for r in got)
    assert len({r._score for r in got if r.doc_id in (60, 61)}) == 1 and len({r._score for r in got if r.doc_id == 1}) == 1
    assert np.mean([r._score for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2]) > np.mean([r._score for r in got if r.doc_id is not None and r.doc_id < 60 and not r.doc_id % 2])
    again = quality.train(d.repartition(7), labels)
    assert np.array_equal(model.weights, again.weights)
    only = quality.train(d, labels.where("quality = 1"))
    assert only is not None and 0.02 <= only.prior <= 0.98
    assert quality.train(d, labels.where("quality = 0")) is None
    assert quality.train(d.limit(0), labels) is None
    assert {r._score for r in quality.scored(d, None).collect()} == {0.5}
    assert quality.scored(d.limit(0), model).count() == 0


def test_an_id_that_repeats_is_one_training_row(spark):
    rows = [(i, f"text of number {i} " * 3) for i in range(30)] + [(4, f"copy {j}") for j in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(30)], "doc_id long, quality int")
    seen = []
    real = quality.fit
    quality.fit = lambda p, u, prior, **kw: (seen.append((len(p), len(u))), real(p, u, prior, **kw))[1]
    try:
        assert quality.train(d, labels) is not None
    finally:
        quality.fit = real
    ids = d.where(quality.fold(F.col("doc_id")) != 0).select("doc_id").distinct().count()
    assert seen[0][1] == ids
