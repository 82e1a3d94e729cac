"""Comparison of a query's rows with those of its SQL, whatever their order."""

import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = os.environ.get("QUARTZITE_TEST_DATA", "/root/testdata/sf0.001")


def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(table, columns):
    return Counter(zip(*[[plain(x) for x in table[c].to_pylist()] for c in columns], strict=True))


def assert_same(df, sql):
    got = df.toArrow()
    want = duck().execute(sql).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    a, b = rows_of(got, columns), rows_of(want, columns)
    assert a == b, f"{sum(a.values())} rows, {sum(b.values())} wanted; for example {list((a - b).items())[:2]} and {list((b - a).items())[:2]}"
    return got.num_rows


def assert_close(df, sql, keys, rel=1e-9, near=1e-11):
    """Row by row in order of the keys, numbers within a relative or absolute distance."""
    got, want = df.toPandas(), duck().execute(sql).df()
    keys = list(keys)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    got, want = got.sort_values(keys).reset_index(drop=True), want.sort_values(keys).reset_index(drop=True)
    for c in got.columns:
        a, b = got[c], want[c]
        if c in keys or a.dtype == object:
            assert a.astype(str).tolist() == b.astype(str).tolist(), c
            continue
        a, b = a.to_numpy(float, na_value=float("nan")), b.to_numpy(float, na_value=float("nan"))
        assert ((a != a) == (b != b)).all(), f"{c}: nulls differ"
        off = abs(a - b) - rel * abs(b) - near
        assert not (off > 0).any(), f"{c}: {a[off > 0][:3]} and {b[off > 0][:3]}"
    return len(got)
