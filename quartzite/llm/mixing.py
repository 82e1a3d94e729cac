"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: the sources share the words of the whole corpus by weight; no source is asked for more
than `most` times its words, and what is over goes to the others by weight (water filling, solved
on the table of sources with two running sums). Schedule: slot t of the mix is the point
frac((t + 1) * golden ratio), looked up in the cumulative targets, which names its source; the
slots of a source are ranked. Stream: the documents of a source in a seeded random order, round
after round, are cut into equal blocks; block r belongs to the source's slot of rank r. A source's
block is `block` words at most, and less where its target is less than four such blocks: its target
squared over 16 * `block`, one word at least. Points fall on a source by its number of blocks, so a
small source has many small slots and the others keep theirs.
mix() joins each slot to the word ranges of documents that its block is made of, so each source
gives within a few of its own blocks of its target; mixed() sums the mix by document.

Running sums over a source run in buckets of its order: sums of the buckets are added up first,
then the rows of each bucket, so that a hot source is many windows, not one.

Defined results: a null text has 0 words, a null source is a source of its own and comes last;
a source without words has target 0 and gives nothing; repeated rows count each; an empty table
gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .scratch import written
from .textblocks import count_words, text_bytes, word_bounds

GOLDEN = (math.sqrt(5.0) - 1.0) / 2.0
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count_words(b.column(2)))], ["id", "source", "size"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, source string, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row per source: source, key (never null), docs, source_size, target."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    everything = W.Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    t = total.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(W.Window.unboundedPreceding, -1), by_cap.rowsBetween(0, W.Window.unboundedFollowing)
    t = t.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("weights_left"),
        F.row_number().over(by_cap).alias("rank"),
    )
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("weights_left")  # this source and all after it stay below their caps
    t = t.withColumn("first", F.min(F.when(fits, F.col("rank"))).over(everything))
    level_left = F.max(F.when(F.col("rank") == F.col("first"), F.col("left"))).over(everything)
    level_weight = F.max(F.when(F.col("rank") == F.col("first"), F.col("weights_left"))).over(everything)
    level = (F.col("weight") * level_left).cast("double") / level_weight.cast("double")
    target = F.when(F.col("rank") < F.coalesce("first", F.lit(2**31 - 1)), F.col("cap").cast("double")).otherwise(level)
    return t.select("source", F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("unnamed"), "docs", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def with_blocks(sources: DataFrame, block: int) -> DataFrame:
    """sources with block: the words of a block of each."""
    own = F.floor(F.col("target") * F.col("target") / F.lit(16.0 * block))
    return sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), own)).cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """The slots of the mix: slot, source (key, unnamed), rank within the source.

    Spark ranks the slots of a source by the running count in ranges of slots; no task holds them all.
    """
    spark = sources.sparkSession
    sources = sources.withColumn("slots", F.col("target") / F.col("block"))
    ends = sources.withColumn("upper", F.sum("slots").over(W.Window.partitionBy(F.lit(0)).orderBy("unnamed", "key").rowsBetween(W.Window.unboundedPreceding, 0)))
    ends = ends.withColumn("lower", F.col("upper") - F.col("slots")).select("key", "unnamed", "lower", "upper")
    whole = sources.agg(F.sum("slots")).first()[0] or 0.0
    n = math.ceil(whole)
    slot = spark.range(n).withColumn("x", (F.col("id") + 1) * F.lit(GOLDEN))
    slot = slot.select(F.col("id").alias("slot"), ((F.col("x") - F.floor("x")) * F.lit(whole)).alias("point"))
    bins = 1024  # an equi-join on ranges of points, whatever the number of sources
    cut = lambda x: F.least(F.floor(x / F.lit(whole or 1.0) * bins), F.lit(bins - 1))
    ends = ends.where("upper > lower").withColumn("bin", F.explode(F.sequence(cut(F.col("lower")), cut(F.col("upper")))))
    named = slot.withColumn("bin", cut(F.col("point"))).join(ends, "bin").where("point >= lower and point < upper")
    span = 4096
    named = named.withColumn("part", F.floor(F.col("slot") / span))
    parts = named.groupBy("key", "unnamed", "part").count()
    earlier = W.Window.partitionBy("key", "unnamed").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = parts.select("key", "unnamed", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    within = W.Window.partitionBy("key", "unnamed", "part").orderBy("slot")
    return named.join(parts, ["key", "unnamed", "part"]).select("slot", "key", "unnamed", (F.col("base") + F.row_number().over(within) - 1).alias("rank"))


def placed(sized: DataFrame, sources: DataFrame, bucket_docs: int = 4096) -> DataFrame:
    """sized with key, unnamed, source_size, target and start: the words before the document in one round of its source."""
    d = sized.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull())
    d = d.join(sources.drop("source"), ["key", "unnamed"])
    d = d.withColumn("turn", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    point = F.conv(F.substring("turn", 1, 8), 16, 10).cast("long")
    d = d.withColumn("bucket", F.floor(point * F.ceil(F.col("docs") / bucket_docs) / F.lit(2**32)))
    sums = d.groupBy("key", "unnamed", "bucket").agg(F.sum("size").alias("sum"))
    earlier = W.Window.partitionBy("key", "unnamed").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select("key", "unnamed", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    within = W.Window.partitionBy("key", "unnamed", "bucket").orderBy("turn", "id", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    return d.join(sums, ["key", "unnamed", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))


def cuts(d: DataFrame) -> DataFrame:
    """The parts of the documents of placed() that the mix takes: key, unnamed, start, id, size, rank, round, from, to.

    Words from..to - 1 of the document, in that round of its source, are in the source's block `rank`.
    """
    d = d.where("size > 0 and take > start")
    d = d.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - 1 - F.col("start")) / F.col("source_size")))))
    d = d.withColumn("begin", F.col("round") * F.col("source_size") + F.col("start")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("take")))
    d = d.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block")))))
    low, high = F.greatest("begin", F.col("rank") * F.col("block")), F.least("end", (F.col("rank") + 1) * F.col("block"))
    return d.select("key", "unnamed", "start", "id", "size", "rank", "round", (low - F.col("begin")).alias("from"), (high - F.col("begin")).alias("to"))


def _scheduled(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The placed documents, and their cuts with the slots of the mix."""
    sized = written(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    sources = written(with_blocks(targets(sized, weights, most), block), "mix-targets", small=True)
    slots = written(schedule(sources), "mix-slots", small=True)
    blocks = slots.groupBy("key", "unnamed").agg((F.max("rank") + 1).alias("blocks"))
    sources = sources.join(blocks, ["key", "unnamed"], "left").withColumn("take", F.least(F.coalesce("blocks", F.lit(0)) * F.col("block"), F.col("source_size") * most)).drop("blocks")
    sources = written(sources, "mix-take", small=True)
    d = written(placed(sized, sources), "mix-placed", small=True)
    return d, cuts(d).join(slots, ["key", "unnamed", "rank"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 256) -> DataFrame:
    """The mix, one row per slot and document in it: slot, source, rank, start, round, the id, from, to.

    In order of slot, round and start the rows are the mix; each gives the words from..to - 1 of its document.
    """
    _, parts = _scheduled(docs, id_col, text_col, source_col, weights, most, block)
    source = F.when(~F.col("unnamed"), F.col("key")).alias("source")
    return parts.select("slot", source, "rank", "round", "start", F.col("id").alias(id_col), "size", "from", "to")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 256) -> DataFrame:
    """One row per document: the id, size, source_size, target, taken, starts (rounds in which its first word is taken).

    taken and starts are sums over the rows of the mix.
    """
    d, parts = _scheduled(docs, id_col, text_col, source_col, weights, most, block)
    # with words, the place in the source is a row's own, whatever ids repeat
    sums = parts.groupBy("key", "unnamed", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.sum((F.col("from") == 0).cast("long")).alias("starts"))
    counts = d.where("size > 0").join(sums, ["key", "unnamed", "start"], "left").unionByName(d.where("size = 0"), allowMissingColumns=True)
    return counts.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("starts", F.lit(0)).alias("starts"))


def first_words(rows: DataFrame, text_col: str, count_col: str) -> DataFrame:
    """rows with the text cut after so many words; what stands between them stays as it is."""

    def cut(text: str | None, n: int) -> str:
        _, ends, _ = word_bounds(*text_bytes(pa.array([text], pa.string())))
        return (text or "").encode()[: int(ends[n - 1]) if 0 < n <= len(ends) else 0 if n <= 0 else None].decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            texts = [cut(t.as_py(), n.as_py()) for t, n in zip(b.column(k), b.column(count_col), strict=True)]
            yield b.set_column(k, text_col, pa.array(texts, pa.string()))

    return rows.mapInArrow(run, rows.schema)
