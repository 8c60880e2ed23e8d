"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Sources weigh ``weights`` in turn, by code point with null last. They share ``share`` of all words; a
source's target stops at ``most`` times its size and what that leaves is shared again by weight until no
target is above. A source takes whole = floor(target / size) copies of all its documents, and for the rest
the documents whose hash lies below a threshold. The threshold comes from histograms: words are summed by
source and hash bucket, the bucket where the budget is crossed is found from running sums over buckets, and
only that bucket is split again by the next bits. Nothing is sorted but the buckets of one source.

Cases: null and empty texts have size 0 and take 0; null sources form one source, last; rows that repeat an
id share its hash and are taken or left together; a source with no words has target 0; an empty table gives
no rows; other columns play no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.plans.shared import Cut

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Bits of the hash that one histogram resolves, and histograms: together all bits that are used.
BITS, LEVELS = 10, 4


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(src, source_size, target) from (src, source_size).

    Filling to a level: with sources by rising size / weight, a source is capped if the level that would
    exhaust the budget among it and those after it lies at or above its own cap. One row a source goes
    through the windows, which is the number of sources, not of documents.
    """
    by_name = Window.orderBy(F.col("src").isNull(), "src")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").isNull(), "src")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = weighed.withColumn("level", level).withColumn("capped", F.col("w") * F.col("level") >= F.col("cap"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)  # levels fall after the first source that is not capped
    return leveled.withColumn("final", final).select("src", "source_size", F.when(F.col("capped") | F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("final"))).alias("target"))


def _thresholds(sized: DataFrame, plan: DataFrame, bits: int, levels: int) -> DataFrame:
    """(src, low, high): documents with hash below low are taken; those below high too, if high comes nearer."""
    cutoff = plan.select("src", F.col("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("done"), F.lit(False).alias("settled"))
    for level in range(levels):
        rest = bits * (levels - 1 - level)
        bucket = F.shiftright("h", rest)
        inside = sized.join(cutoff.select(F.col("src").alias("s"), "prefix"), F.col("src").eqNullSafe(F.col("s"))).where(F.shiftright("h", rest + bits) == F.col("prefix")) if level else sized
        sums = inside.groupBy("src", bucket.alias("b")).agg(F.sum("size").cast("double").alias("words"))
        running = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        walk = sums.withColumn("upto", F.sum("words").over(running))
        joined = walk.join(cutoff.select(F.col("src").alias("s"), "budget", "done"), F.col("src").eqNullSafe(F.col("s")))
        first_over = joined.where(F.col("done") + F.col("upto") > F.col("budget")).groupBy("src").agg(F.min(F.struct("b", (F.col("done") + F.col("upto") - F.col("words")).alias("d"), (F.col("done") + F.col("upto")).alias("e"))).alias("x"))
        cutoff = Cut(first_over.join(plan.select(F.col("src").alias("s"), "budget"), F.col("src").eqNullSafe(F.col("s"))).select("src", "budget", F.col("x.b").alias("prefix"), F.col("x.d").alias("done"), F.col("x.e").alias("over")), "thresholds").df
    # what is left is one value of the hash: it goes in if that comes nearer to the budget
    return cutoff.select("src", (F.col("prefix") + F.when(F.col("over") - F.col("budget") < F.col("budget") - F.col("done"), 1).otherwise(0)).alias("below"))


#: Sources whose thresholds are broadcast at most; beyond it they are joined by a shuffle.
SENT_MOST = 100_000


def _row_hash(id_col: str, salt: str) -> Column:
    """The first 40 bits of the MD5 of the salt and the id."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def mixture(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(s, source_size, target, whole, below) of each source from (src, size, h); rows are taken whole times, and once more if h < below."""
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    plan = Cut(targets(sources, weights, share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets").df
    below = _thresholds(sized, plan.where("budget > 0"), BITS, LEVELS)
    return Cut(plan.join(below.select(F.col("src").alias("s"), "below"), F.col("src").eqNullSafe(F.col("s")), "left").select(F.col("src").alias("s"), "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")), "mixture").df


def _with_mixture(rows: DataFrame, src: Column, final: DataFrame) -> DataFrame:
    small = final.limit(SENT_MOST + 1).count() <= SENT_MOST
    return rows.join(F.broadcast(final) if small else final, src.eqNullSafe(F.col("s")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, salt: str = "mix") -> DataFrame:
    """(id, src, size, source_size, target, copies) per row of docs; copies is how often the mix takes it."""
    sized = Cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), _row_hash(id_col, salt).alias("h")), "sizes").df
    joined = _with_mixture(sized, F.col("src"), mixture(sized, weights, share, most))
    return joined.select("id", "src", "size", "source_size", "target", (F.col("whole") + (F.col("h") < F.col("below")).cast("long")).alias("copies"))


def copied(docs: DataFrame, out_col: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, salt: str = "mix") -> DataFrame:
    """docs with one more column, how often the mix takes the row, from its own hash and source: rows stay where they stand."""
    sized = Cut(docs.select(F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), _row_hash(id_col, salt).alias("h")), "sizes").df
    final = mixture(sized, weights, share, most).select("s", F.col("whole").alias("w"), "below")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(source_col).alias("src"), _row_hash(id_col, salt).alias("h"))
    joined = _with_mixture(inner, F.col("src"), final)
    return joined.select("d.*", (F.col("w") + (F.col("h") < F.col("below")).cast("long")).alias(out_col))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
