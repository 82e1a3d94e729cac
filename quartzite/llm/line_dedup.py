"""Line deduplication relative to the site, by DataFrame operations alone.

For each host, the share of its pages that contain a line decides: lines on more than `ratio` of
the host's pages, and on `min_pages` of them at least (2: a line of one page repeats nowhere), are boilerplate and are dropped from every
page of that host. The boilerplate of one host is a short list: lines above the ratio number at
most (mean lines of a page) / ratio. So pages meet a list per host, and no page is taken apart and
put together again. Lines are counted by partial aggregation before they are shuffled.

Defined results: a null text has no lines and stays null; a null host is a host of its own (the
empty one); a line counts once a page; each row is a page, repeated rows too; empty lines
(after trimming spaces) are never boilerplate and are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written


def host_of(url: Column) -> Column:
    """The lower-cased authority of a URL without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def html_lines(html: Column) -> Column:
    """The text between tags, a line for each run."""
    return F.filter(F.transform(F.split(F.regexp_replace(html, "<[^>]*>", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def text_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """host, host_pages, drop (keys of its boilerplate lines) for pages of (host, lines)."""
    lines = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).where("line <> ''")
    counts = lines.select("host", _key(F.col("line")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    dropped = frequent.join(totals, "host").where(F.col("n") > F.col("host_pages") * ratio).groupBy("host").agg(F.collect_set("line").alias("drop"))
    return totals.join(dropped, "host", "left")


def without_boilerplate(pages: DataFrame, lines: Column, host: Column, ratio: float = 0.5, min_pages: int = 2) -> DataFrame:
    """pages with _host, host_pages, n_lines, n_dropped, clean (what stays, a line each)."""
    made = pages.select(F.struct("*").alias("row"), host.alias("host"), lines.alias("lines"))
    drops = written(boilerplate(made.select("host", "lines"), ratio, min_pages), "site-boilerplate", small=True)
    drop = F.coalesce("drop", F.array().cast("array<binary>"))
    kept = F.when(F.size(drop) == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: (x == "") | ~F.array_contains(drop, _key(x))))
    joined = made.join(drops, "host").withColumn("kept", kept)
    return joined.select(
        "row",
        "host",
        "host_pages",
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).alias("n_dropped"),
        F.array_join("kept", "\n").alias("clean"),
    )
