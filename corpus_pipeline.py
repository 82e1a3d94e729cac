"""A corpus pipeline of five stages: quality, exact copies, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but
the last return the columns of documents. run() writes each stage's result as Parquet in the shared
folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_sampling
from quartzite.llm.queries import piece_model, table
from quartzite.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
THRESHOLD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on the labels beside them, rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model).where(F.col("_score") >= THRESHOLD).drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of equal texts."""
    return exact_dedup.deduplicated(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near copies; texts that share an id are told apart."""
    return ngram_join.deduplicated(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives a row for each document and round with the words that the mix takes: the whole text, or its beginning where the mix ends."""
    mix = mixing.mix(docs).groupBy(F.col("doc_id").alias("mixed_id"), "round").agg(F.max("to").alias("to"), F.max("size").alias("size"))
    mix = written(mix, "mix-rounds", small=True)
    join = F.col("doc_id").eqNullSafe(F.col("mixed_id"))
    whole = docs.select(*COLUMNS).join(mix.where("to >= size"), join).select(*COLUMNS)
    part = docs.select(*COLUMNS).join(F.broadcast(mix.where("to < size")), join).select(*COLUMNS, "to")  # one a source at most
    part = mixing.first_words(part, "text", "to").withColumn("n_chars", F.length("text").cast("long"))
    return whole.unionByName(part.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, with their ids."""
    return sentencepiece_sampling.segmentations(docs, piece_model(spark), k=2, with_ids="packed", batch_chars=1 << 18, lexicon_chars=1 << 19)


STAGES = [("quality", keep_quality), ("exact copies", drop_copies), ("near copies", drop_near_copies), ("mixing", mix_sources), ("encoding", encode)]

#: Training, the near-copy search over hashes and sampling have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
