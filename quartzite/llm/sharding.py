"""Sharding by an external shuffle of two passes.

Pass 1 scatters the records by seeded hashes: rendezvous hashing over the id picks the shard (so
that one more shard takes records only into itself), a second hash picks one of the shard's
buckets, of which there are as many as keep a bucket within a given number of bytes. Pass 2 puts
each bucket into a canonical order, applies a Fisher-Yates shuffle whose generator is seeded by
(seed, shard, bucket), and writes it. A lost task gives the same bucket when it runs again. The
bucket is a hash of the id, the text's checksum and its size, so that rows which share an id and
differ are many buckets, and buckets are dealt to as many tasks as there are buckets.

Defined results: a null text is empty and has size 1; a null id is hashed as such; rows that
repeat an id share its shard, those that repeat id and text its bucket; an empty table gives an
empty table. Columns of the input keep their names, but those that have the name of an added column
(ADDED) get underscores at the end until they differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .scratch import new_path


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest hash of (key, shard, seed)."""
    weights = F.array(*[F.xxhash64(key, F.lit(j), F.lit(seed)) for j in range(shards)])
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


#: Columns that write_shards and slots add.
ADDED = ("_id", "_size", "_crc", "_grown", "_shard", "_bucket", "_place", "_slot", "_base")


def renamed(columns: list[str]) -> dict[str, str]:
    """New names of the columns that clash with ADDED."""
    taken, out = {c.lower() for c in columns} | set(ADDED), {}
    for c in columns:
        if c.lower() in ADDED:
            new = c + "_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            out[c] = new
    return out


def _shuffle(seed: int):
    def run(group: pa.Table) -> pa.Table:
        shard, bucket = group["_shard"][0].as_py(), group["_bucket"][0].as_py()
        order = pc.sort_indices(group, sort_keys=[("_id", "ascending"), ("_crc", "ascending"), ("_size", "ascending")]).to_numpy().copy()
        np.random.default_rng([seed, shard, bucket]).shuffle(order)  # Fisher-Yates
        out = group.take(pa.array(order))
        return out.set_column(out.schema.get_field_index("_place"), "_place", pa.array(np.arange(len(order), dtype=np.int64)))

    return run


def write_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 7, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Writes the shards as Parquet under path (by default in the shared folder) and returns what was written.

    Columns: those of docs (see above for clashes), then _id, _size, _crc, _grown, _shard, _bucket, _place.
    """
    spark = docs.sparkSession
    new = renamed(docs.columns)
    docs = docs.withColumnsRenamed(new)
    id_col, text_col = new.get(id_col, id_col), new.get(text_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        "*",
        F.col(id_col).cast("string").alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        rendezvous(F.col(id_col), shards, seed).alias("_shard"),
        rendezvous(F.col(id_col), shards + 1, seed).alias("_grown"),
        F.lit(0).cast("long").alias("_place"),
    )
    total = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    scattered = keyed.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_crc", "_size", F.lit(seed + 1)), F.lit(buckets)).cast("int"))
    tasks = max(buckets * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shuffled = scattered.repartition(tasks, "_shard", "_bucket").groupBy("_shard", "_bucket").applyInArrow(_shuffle(seed), scattered.schema)
    path = path or new_path(spark, "shards")
    shuffled.write.partitionBy("_shard").parquet(path)
    schema = T.StructType([f for f in scattered.schema if f.name != "_shard"] + [T.StructField("_shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def slots(shards: DataFrame) -> DataFrame:
    """Adds _slot: the gapless place within the shard, bucket after bucket."""
    counts = shards.groupBy("_shard", "_bucket").count()
    before = W.Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    base = counts.select("_shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return shards.join(base, ["_shard", "_bucket"]).withColumn("_slot", F.col("_base") + F.col("_place")).drop("_base")
