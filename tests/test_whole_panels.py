"""Queries of panels that must work on every date and every event."""

import comparing
import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite import queries


def test_pca_scores_of_every_date_by_brute_force(spark):
    panel = queries.signal_panel(spark, comparing.DATA).withColumn("log_amount", F.log("amount")).select("symbol", "td", "signal", "log_amount", "volume").dropna()
    dates = {}
    for r in panel.collect():
        dates.setdefault(r.td, []).append((r.symbol, r.signal, r.log_amount, float(r.volume)))
    rows = queries.QUERIES["pca_scores"](spark, comparing.DATA).collect()
    got = {(r.symbol, r.td): (abs(r.pc1), abs(r.pc2)) for r in rows}
    assert len(got) == len(rows) == sum(map(len, dates.values()))
    assert {td for _, td in got} == set(dates) and any(td % 8 for td in dates)
    for td, held in dates.items():
        x = np.array([h[1:] for h in held])
        z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        want = np.zeros((len(held), 2))
        want[:, : min(2, len(s))] = np.abs(u * s)[:, :2]
        for h, w in zip(held, want, strict=True):
            assert got[h[0], td] == pytest.approx(tuple(w), abs=1e-6)
