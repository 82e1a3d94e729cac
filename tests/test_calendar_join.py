import datetime as dt

import comparing

from quartzite import queries
from quartzite.operators import joins


def test_first_day_is_found_over_the_ends_of_years_and_before_the_calendar(spark):
    days = [dt.date(2020, 3, 1), dt.date(2020, 12, 30), dt.date(2021, 1, 4), dt.date(2021, 12, 1), dt.date(2024, 2, 5)]
    calendar = spark.createDataFrame([(d,) for d in [*days, days[1], None]], "d date")
    at = [dt.date(2019, 1, 1) + dt.timedelta(days=k) for k in range(0, 2000, 3)] + [d + dt.timedelta(days=k) for d in days for k in (-1, 0, 1)] + [None]
    events = spark.createDataFrame(list(enumerate(at)), "id long, at date")
    for strict in (False, True):
        got = {r.id: r._day for r in joins.first_on_or_after(events, calendar, "at", "d", strict).collect()}
        assert got == {i: min((d for d in days if a and (d > a or d == a and not strict)), default=None) for i, a in enumerate(at)}
    assert {r._day for r in joins.first_on_or_after(events, calendar.limit(0), "at", "d").collect()} == {None}


def test_first_trading_day_of_all_orders(spark):
    got = {r.o_orderkey: r.day for r in queries.QUERIES["first_trading_day"](spark, comparing.DATA).collect()}
    con = comparing.duck()
    days = sorted(str(d) for (d,) in con.execute("select distinct cast(l_shipdate as date) from lineitem where l_partkey % 50 = 0").fetchall())
    orders = con.execute("select o_orderkey, cast(cast(o_orderdate as date) as varchar) from orders").fetchall()
    assert got == {k: next((d for d in days if d >= at), None) for k, at in orders}
