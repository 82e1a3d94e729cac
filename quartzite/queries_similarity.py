"""Queries of warped series and of text factors. SQL can't express them; tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graphs, series_similarity, text_factors
from .queries_panel import _add
from .sources import panels


def monthly_series(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' shipped amounts by month of 28 days, 0 where there is none, over all months of the table.

    Amounts are cents: their sums, rounded to cents, don't depend on the order in which tasks add.
    """
    l = panels.table(s, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 28).cast("int").alias("m"), "l_extendedprice")  # noqa: E741
    sums = l.groupBy("symbol", "m").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    low, high = l.agg(F.min("m"), F.max("m")).first()
    held = sums.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("m", "v"))).alias("by"))
    return held.select("symbol", F.transform(F.sequence(F.lit(low), F.lit(high)), lambda m: F.coalesce(F.element_at("by", m), F.lit(0.0))).alias("values"))


_add("warped_neighbours", lambda s, d: series_similarity.nearest(monthly_series(s, d), 5, 4), None, ["src", "dst"], ["distance"])
_add("warped_page_rank", lambda s, d: graphs.page_rank(graphs.symmetric(series_similarity.similarity_graph(monthly_series(s, d), 5, 4))), None, ["node"], ["rank"])


def text_codes(s: SparkSession, d: str) -> DataFrame:
    """Turns of conversations in the eight leading directions of their character n-grams."""
    texts = panels.table(s, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    found = text_factors.terms(texts, "text", 2000)
    return text_factors.encoded(texts, "id", "text", text_factors.truncated_svd(texts, "text", found, 8)).select("id", *[F.col("code")[k].alias(f"c{k}") for k in range(8)])


_add("text_factors", text_codes, None, ["id"], [f"c{k}" for k in range(8)])


def boosted_gains(s: SparkSession, d: str) -> DataFrame:
    """Features of the industry panel by their share of the gains of boosted trees on the next return."""
    from .operators import boosting
    from .queries_panel import industry_panel

    panel = industry_panel(s, d)
    model = boosting.fit(panel, ["signal", "log_amount", "size", "volume", "close"], "fwd", trees=5, depth=3)
    return s.createDataFrame(boosting.selected(model, 5), "feature string, share double")


_add("boosted_gains", boosted_gains, None, ["feature"], ["share"])
