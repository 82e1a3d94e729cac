"""Event streams: bars over tumbling, sliding and session windows, running day states, and decaying holds.

bars(), sessions() take a stream or a table and mean the same for both. Events later than the
watermark are dropped by a stream, whose bars end once the watermark has passed them. day_states() and
holds() keep a small state for each key and give each row's state after it, in order of time
within a batch; they agree with a whole-table run (day_states_batch, holds_batch) as long as rows come in
order between batches. Their states expire by event time: a day's once the watermark has passed its end, an
event's once it has passed the event's horizon.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files under path, `files` of them a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return d.withWatermark("ts", late) if d.isStreaming else d


def bars(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """symbol, start, end, n, volume, amount, high, low, buys: events (symbol, ts, price, size, buy) by window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = _timed(events, late)
    made = d.groupBy("symbol", w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("volume"),
        F.sum(F.col("price") * F.col("size")).alias("amount"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum(F.col("buy").cast("long")).alias("buys"),
    )
    return made.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume", "amount", "high", "low", "buys")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """symbol, start, end, n, volume: runs of events with no pause of `gap` or more."""
    d = _timed(events, late)
    made = d.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))
    return made.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")


DAY = "symbol string, day string, event_id long, ts timestamp, volume double, amount double, vwap double, high double, low double"
_COLUMNS = [c.split()[0] for c in DAY.split(", ")]


def _day_run(volume: float, amount: float, high: float, low: float, pdf: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
    pdf = pdf.sort_values(["ts", "event_id"])
    v, a = volume + pdf["size"].cumsum(), amount + (pdf["price"] * pdf["size"]).cumsum()
    h, lo = pdf["price"].cummax().clip(lower=high), pdf["price"].cummin().clip(upper=low)
    out = pd.DataFrame({"event_id": pdf["event_id"], "ts": pdf["ts"], "volume": v.astype(float), "amount": a.astype(float), "vwap": a / v.where(v != 0), "high": h, "low": lo})
    return out, (float(v.iloc[-1]), float(a.iloc[-1]), float(h.iloc[-1]), float(lo.iloc[-1]))


def _expires(state: GroupState, at: pd.Timestamp) -> None:
    """The state goes once the watermark has passed `at`; at once if it has already."""
    ms = int(at.timestamp() * 1000)
    if ms <= state.getCurrentWatermarkMs():
        state.remove()
    else:
        state.setTimeoutTimestamp(ms)


def day_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event with its symbol's running volume, amount, mean price, high and low of the day so far."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (0.0, 0.0, float("-inf"), float("inf"))
        pdf = pd.concat(list(batches))
        out, held = _day_run(*held, pdf)
        state.update(held)
        _expires(state, pd.Timestamp(key[1], tz="UTC") + pd.Timedelta(days=1))
        yield out.assign(symbol=key[0], day=key[1])[_COLUMNS]

    d = _timed(events, late).select("symbol", F.to_date("ts").cast("string").alias("day"), "event_id", "ts", "price", F.col("size").cast("double").alias("size"))
    return d.groupBy("symbol", "day").applyInPandasWithState(run, DAY, "volume double, amount double, high double, low double", "append", GroupStateTimeout.EventTimeTimeout)


def day_states_batch(events: DataFrame) -> DataFrame:
    """The same of a table, by windows."""
    from pyspark.sql import window as W

    d = events.select("symbol", F.to_date("ts").cast("string").alias("day"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "price", F.col("size").cast("double").alias("size"))
    w = W.Window.partitionBy("symbol", "day").orderBy("ts", "event_id").rowsBetween(W.Window.unboundedPreceding, 0)
    v, a = F.sum("size").over(w), F.sum(F.col("price") * F.col("size")).over(w)
    return d.select("symbol", "day", "event_id", "ts", v.alias("volume"), a.alias("amount"), (a / F.nullif(v, F.lit(0.0))).alias("vwap"), F.max("price").over(w).alias("high"), F.min("price").over(w).alias("low"))


HELD = "symbol string, td long, value double, held double, decayed double"


def holds(rows: DataFrame, horizon: int, half_life: float, late: str = "1 day") -> DataFrame:
    """Each row (symbol, td, ts, value) with held, the last value of its symbol up to `horizon` days old, and decayed, the same halved every half_life days.

    ts is the time of day td; rows without an event have a null value. A symbol without an event within the horizon has no state.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, at = state.get if state.exists else (None, None)
        pdf = pd.concat(list(batches)).sort_values("td")
        there = pdf["value"].notna()
        last, since = pdf["value"].ffill(), pdf["td"].where(there).ffill()
        if value is not None:
            last, since = last.fillna(value), since.fillna(at)
        age = pdf["td"] - since
        live = age <= horizon
        yield pdf.assign(symbol=key[0], held=last.where(live), decayed=(last * 0.5 ** (age / half_life)).where(live))[[c.split()[0] for c in HELD.split(", ")]]
        if bool(live.iloc[-1]):
            state.update((float(last.iloc[-1]), int(since.iloc[-1])))
            now, left = pd.Timestamp(pdf["ts"].iloc[-1]).tz_localize("UTC"), horizon - int(age.iloc[-1])
            _expires(state, now + pd.Timedelta(days=left + 1))
        elif state.exists:
            state.remove()

    d = _timed(rows.select("symbol", F.col("td").cast("long").alias("td"), "ts", F.col("value").cast("double").alias("value")), late)
    return d.groupBy("symbol").applyInPandasWithState(run, HELD, "value double, at long", "append", GroupStateTimeout.EventTimeTimeout)


def holds_batch(rows: DataFrame, horizon: int, half_life: float) -> DataFrame:
    """The same of a table, by windows of dates."""
    from ..functions import rolling

    return rows.select("symbol", F.col("td").cast("long").alias("td"), "value", rolling.filled("value", horizon).alias("held"), rolling.decayed("value", half_life, horizon).alias("decayed"))
