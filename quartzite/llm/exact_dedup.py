"""Exact deduplication by DataFrame operations alone, safe against groups of copies of any size.

Stages, each of which compares whole texts (they are part of the grouping key, the digest only
comes first): Spark's partial aggregation deduplicates within each task; copies then meet in
(digest, text, salt) groups, at most one row from each task; the winners of the salts meet last.
Every group is an aggregate of two numbers, so a hot group costs no task more than its few rows.

Defined results: a null text counts as the empty text. Only A-Z are lower-cased. Repeated rows
with one id each give a row. A null id never wins against another; a group of null ids alone
has a null keep_id and keeps no row in exact_groups (deduplicated keeps one). Other columns of the input are ignored, whatever their
names. An empty table gives an empty table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .scratch import written


def normalised(text: Column | str) -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("body"))
    return text.select("id", "body", F.sha2("body", 256).alias("digest"), F.xxhash64("body").alias("check"))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct text: digest, check, body, keep_id (largest id), group_size."""
    salted = _keyed(docs, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    local = salted.groupBy("digest", "check", "body", "salt").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return local.groupBy("digest", "check", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256."""
    won = written(winners(docs, id_col, text_col, salts).drop("body"), "exact-winners")
    keys = ["digest", "check"]
    rows = _keyed(docs, id_col, text_col)
    if won.groupBy(*keys).count().where("count > 1").isEmpty():
        joined = rows.drop("body").join(won, keys)
    else:  # two texts share both digests: then the texts themselves are the key
        joined = rows.join(winners(docs, id_col, text_col, salts), [*keys, "body"])
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """docs without exact copies, with all their columns: of each group one row, of its largest id.

    Of several rows of a group that share that id, the first by the other columns that have an order
    stays; a group in which every id is null keeps one row in the same way.
    """
    key = F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull()
    won = winners(docs, id_col, text_col, salts).select("digest", "check", F.col("keep_id").alias("id"))
    won = written(won.select(F.col("digest").alias("d"), F.col("check").alias("c"), key[0].alias("k"), key[1].alias("u")), "exact-winners")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), normalised(text_col).alias("body"))
    rows = rows.select("row", F.sha2("body", 256).alias("d"), F.xxhash64("body").alias("c"), key[0].alias("k"), key[1].alias("u"))
    ordered = [F.col("row")[f.name] for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    first = F.row_number().over(W.Window.partitionBy("d", "c", "k", "u").orderBy(*ordered))
    return rows.join(won, ["d", "c", "k", "u"], "left_semi").withColumn("place", first).where("place = 1").select("row.*")
