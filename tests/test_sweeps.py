"""Trades against books: nulls, ties, empty sides and staleness by hand."""

from datetime import datetime, timedelta

from quartzite.operators import sweeps

T = datetime(2024, 1, 2, 10)
BOOK = "symbol int, at timestamp, ask_price array<double>, ask_volume array<double>, bid_price array<double>, bid_volume array<double>"
TRADE = "id int, symbol int, at timestamp, side int, price double, volume double, amount double"


def test_flags_and_levels(spark):
    s = lambda x: T + timedelta(seconds=x)
    books = spark.createDataFrame(
        [
            (1, s(0), [10.0, 10.5, None, 12.0], [1.0, None, 2.0, 1.0], [9.5, 9.0, 0.0], [2.0, 2.0, 0.0]),
            (1, s(2), [9.0], [1.0], [9.5], [1.0]),  # crossed
            (1, s(2), [], [], [9.5], [1.0]),
            (2, None, [1.0], [1.0], [0.5], [1.0]),
        ],
        BOOK,
    )
    rows = [
        (0, 1, s(0), 1, 10.0, 1.0, 10.0),  # at the book's time, not after it
        (1, 1, s(3), 1, 10.6, 2.0, 21.2),
        (2, 1, s(3), 1, 10.6, 2.0, 21.2),
        (3, 1, s(4), -1, 9.5, 1.0, 9.5),
        (4, 1, s(4), -1, 9.9, 1.0, 9.9),
        (5, 1, s(9), 1, 10.0, 1.0, 10.0),
        (6, 2, s(4), 1, 1.0, 1.0, 1.0),
        (7, 1, s(3), 1, None, 2.0, None),
    ]
    d = sweeps.against_book(spark.createDataFrame(rows, TRADE), books)
    got = {r.id: (r.flag, r.levels, r.consumed) for r in d.collect()}
    assert got[0] == got[6] == ("missing_reference_book", None, None)
    assert got[1] == got[2] == ("ok", 2, 0.5) and got[3] == ("ok", 1, 0.25)
    assert got[4][0] == got[7][0] == "price_not_on_ladder" and got[5][0] == "stale_alignment"
    day = {r.symbol: r for r in sweeps.sweeps_by_day(d).collect()}
    assert (day[1].events, day[1].usable, day[1].sweeps, day[1].buy_share, day[1].sell_share, day[1].asymmetry) == (7, 3, 2, 1.0, 0.0, 1.0)
    assert day[1].median_lag_ms == 3000 and day[2].usable == 0 and day[2].sweep_share is None
    assert sweeps.sweeps_by_day(sweeps.against_book(spark.createDataFrame([], TRADE), books)).count() == 0
