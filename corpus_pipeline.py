"""A training-data pipeline of four stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again as the next stage's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import minhash, mixing, packing, toxicity
from termweave.plans.shared import cut, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; learned from the labelled rows of docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    release(spark)
    return toxicity.score(docs, model, out_col="__score").where(F.col("__score") < 0.5).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): that of the smallest id, null last."""
    del sf_dir
    kept = minhash.survivors(docs)
    release(spark)
    return kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources near their target weights, so a document may stand twice or not at all."""
    del sf_dir
    release(spark)
    taken = mixing.copied(docs, "__copies").where("__copies > 0")
    release(spark)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence of 2048 tokens and the place in it that each has."""
    import public_tokenizers

    del sf_dir
    release(spark)
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    release(spark)
    return packed


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL cannot express the learned scores, the fingerprints or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
