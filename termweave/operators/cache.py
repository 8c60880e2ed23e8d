"""Eviction analytics over an access log (term, ts[, size_bytes]): who would go next, and who has expired.

Victims are chosen among given terms; eviction takes metadata only, so evict() is an anti join on the log's terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata(log: DataFrame, now: Column | None = None) -> DataFrame:
    """(term, first_access, last_access, hits, size_bytes, age_s, idle_s); now is the log's last moment unless given."""
    size = F.max("size_bytes") if "size_bytes" in log.columns else F.lit(8)
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    meta = log.groupBy("term").agg(F.min("ts").alias("first_access"), F.max("ts").alias("last_access"), F.count("*").alias("hits"), size.cast("long").alias("size_bytes"))
    if now is None:
        now = F.lit(log.agg(F.max("ts")).first()[0])
    seconds = lambda c: (F.unix_micros(now) - F.unix_micros(c)) / 1e6
    return meta.withColumn("age_s", seconds(F.col("first_access"))).withColumn("idle_s", seconds(F.col("last_access")))


def scores(meta: DataFrame) -> DataFrame:
    """meta with a score for each policy; the largest goes first (for least-frequent use, the negative count)."""
    return (
        meta.withColumn("lru", F.col("idle_s"))
        .withColumn("lfu", -F.col("hits").cast("double"))
        .withColumn("age", F.col("age_s"))
        .withColumn("cost", F.col("age_s") * F.col("size_bytes") / (F.col("hits") + 1))
        .withColumn("pressure", F.col("size_bytes") / (F.lit(1.0) + 0.1))  # every counted access is a hit, so the rate is one
    )


def victims(meta: DataFrame, policy: str, among: DataFrame | None = None, count: int = 1) -> DataFrame:
    """(term, score) of the terms that the policy evicts first, ties by term."""
    scored = scores(meta if among is None else meta.join(among.select("term").distinct(), "term", "left_semi"))
    return scored.select("term", F.col(policy).alias("score")).orderBy(F.desc("score"), "term").limit(count)


def evict(log: DataFrame, gone: DataFrame) -> DataFrame:
    """The log without the evicted terms' accesses; their entries in the dictionary stay."""
    return log.join(gone.select("term"), "term", "left_anti")


def visible_within(terms: DataFrame, meta: DataFrame, ttl_s: float) -> DataFrame:
    """Terms that are not expired; a term that was never accessed never expires."""
    expired = meta.where(F.col("age_s") > ttl_s).select("term")
    return terms.join(expired, "term", "left_anti")


def with_default(terms: DataFrame, default) -> DataFrame:
    """Values with a default where there is none."""
    return terms.withColumn("value", F.coalesce("value", default if isinstance(default, Column) else F.lit(default)))


def cache_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("accesses"), F.countDistinct("term").alias("terms"), F.max("ts").alias("last_access"))
