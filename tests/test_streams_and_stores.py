"""Streams equal batches; stores give back what was written."""

import datetime as dt

import comparing
import pytest
from pyspark.sql import functions as F

from quartzite import queries_books as qb
from quartzite.operators import graphs, joins, masks, selection
from quartzite.sources import stores
from quartzite.streaming import bars


def split_events(spark, tmp_path, parts=3):
    """The events as files in order of time, with a last event that moves the watermark past all windows."""
    e = qb.trade_events(spark, comparing.DATA)
    end = e.agg(F.max("ts")).first()[0]
    rows = sorted(e.collect(), key=lambda r: (r.ts, r.event_id))
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], e.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = [("end", -1, end + dt.timedelta(days=2), 1.0, 1, True)]
    spark.createDataFrame(last, e.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return e


PROGRESS: dict = {}


def drained(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(180)
    PROGRESS[name] = query.recentProgress
    query.stop()
    return df.sparkSession.table(name)


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_stream_bars_equal_batch(spark, tmp_path, kind):
    e = split_events(spark, tmp_path)
    make = {"tumbling": lambda d: bars.bars(d, "1 hour"), "sliding": lambda d: bars.bars(d, "1 hour", "30 minutes"), "session": lambda d: bars.sessions(d, "20 minutes")}[kind]
    got = drained(make(bars.events_stream(spark, f"{tmp_path}/in", e.schema, 1)), tmp_path, f"s_{kind}").where("symbol <> 'end'")
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, make(e).collect()))


def test_stream_day_states_equal_batch(spark, tmp_path):
    e = split_events(spark, tmp_path)
    got = drained(bars.day_states(bars.events_stream(spark, f"{tmp_path}/in", e.schema, 1)), tmp_path, "s_day").where("symbol <> 'end'")
    want = {r.event_id: r for r in bars.day_states_batch(e).collect()}
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.event_id]
        assert (r.volume, r.high, r.low) == (w.volume, w.high, w.low) and r.amount == pytest.approx(w.amount) and r.vwap == pytest.approx(w.vwap)


def state_rows(spark, name):
    """Rows of state after the last batch of the stream that drained() ran."""
    return PROGRESS[name][-1]["stateOperators"][0]["numRowsTotal"]


def test_stream_states_expire(spark, tmp_path):
    e = split_events(spark, tmp_path)
    drained(bars.day_states(bars.events_stream(spark, f"{tmp_path}/in", e.schema, 1)), tmp_path, "s_expire")
    assert state_rows(spark, "s_expire") <= 1  # that of the last event, which moves the watermark


def test_stream_holds_equal_batch_and_expire(spark, tmp_path):
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    hits = {("a", 2): 1.0, ("a", 3): 4.0, ("a", 15): -2.0, ("b", 0): 5.0, ("c", 19): 8.0}
    rows = [(s, k, day(k), hits.get((s, k))) for k in range(24) for s in "abcd" if not (s == "b" and k in (4, 5))]
    schema = "symbol string, td long, ts timestamp, value double"
    for k in range(0, len(rows), 17):
        spark.createDataFrame(rows[k : k + 17], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for k in (60, 61):
        spark.createDataFrame([("end", k, day(k), None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = bars.events_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
    got = drained(bars.holds(stream, 6, 3, "2 days"), tmp_path, "s_holds").where("symbol <> 'end'").collect()
    want = {(r.symbol, r.td): r for r in bars.holds_batch(spark.createDataFrame(rows, schema), 6, 3).collect()}
    assert len(got) == len(want) == len(rows)
    for r in got:
        w = want[r.symbol, r.td]
        assert (r.value, r.held) == (w.value, w.held) and r.decayed == (None if w.decayed is None else pytest.approx(w.decayed))
    assert want["a", 9].held == 4.0 and want["a", 10].held is None
    assert state_rows(spark, "s_holds") == 0


def test_narrow_store_and_quarters(spark, tmp_path):
    rows = [(dt.date(2024, 1 + k % 12, 1 + k % 27), f"s{k % 3}", float(k)) for k in range(60)] + [(None, "s0", 1.0), (dt.date(2024, 5, 28), "s1", None)]
    d = spark.createDataFrame(rows, "date date, symbol string, value double")
    path = f"{tmp_path}/narrow"
    stores.append_narrow(d.where("date is not null"), path, "f")
    stores.append_narrow(spark.createDataFrame([(dt.date(2024, 1, 1), "s0", 99.0)], d.schema), path, "f")
    stores.append_narrow(d.where("date is not null"), path, "g")
    got = {(r.date, r.symbol): r.value for r in stores.query_narrow(spark, path, ["f"], "2024-01-01", "2024-06-30").collect()}
    want = {(r[0], r[1]): r[2] for r in rows if r[0] and r[0] <= dt.date(2024, 6, 30)} | {(dt.date(2024, 1, 1), "s0"): 99.0}
    assert got == want
    wide = stores.query_panel(spark, path, "f", ["s0", "s1"]).collect()
    assert {r.date: (r.s0, r.s1) for r in wide}[dt.date(2024, 1, 1)][0] == 99.0
    stores.write_quarters(d.where("date is not null"), f"{tmp_path}/q")
    stores.write_quarters(d.where("date between '2024-01-01' and '2024-03-31'").withColumn("value", -F.col("value")), f"{tmp_path}/q")
    back = stores.read_quarters(spark, f"{tmp_path}/q", ["date", "symbol", "value"], "2024-02-01", "2024-04-30").collect()
    assert sorted((r.date, r.symbol, str(r.value)) for r in back) == sorted((r[0], r[1], str(-r[2] if r[0].month < 4 else r[2])) for r in rows if r[0] and 2 <= r[0].month <= 4)


def test_checks_raise(spark):
    d = spark.createDataFrame([(1, 2), (1, 3), (None, 4)], "k long, v long")
    with pytest.raises(Exception, match="not unique"):
        joins.checked_many_to_one(d, d, ["k"]).collect()
    with pytest.raises(Exception, match="breaks the rule small"):
        masks.guarded(d, {"small": F.col("v") < 4}).collect()
    assert masks.guarded(d, {"small": F.col("k") < 4}).count() == 3
    with pytest.raises(Exception, match="future"):
        graphs.check_no_future(d, "k", "v").collect()
    assert graphs.known_edges(d, "v", "k").count() == 2


def test_asof_ties_nulls_and_empty(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([(1, at(5)), (1, at(1)), (2, at(5)), (None, at(5)), (1, None)], "k long, t timestamp")
    right = spark.createDataFrame([(1, at(3), -5, "a"), (1, at(3), -40, "b"), (1, at(3), None, "c"), (1, at(5), 7, "d"), (1, None, 9, "e")], "k long, u timestamp, n int, v string")
    got = sorted((str(r.k), str(r.t), str(r.v)) for r in joins.asof(left, right, "k", "t", "u", ["v"], strict=True, tie=["n"]).collect())
    assert got == sorted([("1", str(at(5)), "a"), ("1", str(at(1)), "None"), ("2", str(at(5)), "None"), ("None", str(at(5)), "None"), ("1", "None", "None")])
    for stretch in (F.minute, lambda t: F.floor(F.minute(t) / 4)):
        parted = joins.asof(left, right, "k", "t", "u", ["v"], strict=True, tie=["n"], part=stretch)
        assert sorted((str(r.k), str(r.t), str(r.v)) for r in parted.collect()) == got
    assert joins.asof(left.limit(0), right, "k", "t", "u", ["v"]).count() == 0
    assert joins.asof(left, right.limit(0), "k", "t", "u", ["v"]).where("v is null").count() == 5


def test_walk_forward_and_pruning():
    folds = list(selection.walk_forward(list(range(20)), 6, 3, 2, 1))
    assert [(f.train_from, f.train_to, f.test_from, f.test_to) for f in folds] == [(0, 5, 8, 10), (4, 9, 12, 14), (8, 13, 16, 18)]
    assert selection.pruned({"a": 3.0, "b": 2.0, "c": 1.0}, [("a", "b", -0.9), ("a", "c", 0.1), ("b", "c", 0.95)], 0.7) == ["a", "c"]
