"""Corpora: word counts, misspelling lists, typo generation and workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.plans.shared import Cut

LETTERS = "abcdefghijklmnopqrstuvwxyz"


#: Runs of letters of any script.
WORD = r"\p{L}+"


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text that match the pattern, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"))


def word_frequencies(texts: DataFrame, text_col: str = "text", pattern: str = WORD) -> DataFrame:
    """(term, freq) of the words that match the pattern, lower-cased."""
    return texts.select(F.explode(words(F.col(text_col), pattern)).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(term, freq): one token a line, trimmed and lower-cased; empty lines are skipped."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("freq"))


def read_misspellings(spark: SparkSession, path: str) -> DataFrame:
    """(correct, misspelling, freq) from files of ``$correct`` lines, each followed by ``misspelling [freq]`` lines.

    A file is one row, cut at its ``$``, so that no order of lines has to be kept across tasks.
    """
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.explode(F.split("value", r"(?m)^\$")).alias("b")).select(F.split("b", "\r?\n").alias("l")).where("l[0] <> ''")
    lines = blocks.select(F.trim(F.get("l", F.lit(0))).alias("correct"), F.explode(F.slice("l", 2, F.size("l"))).alias("x")).select("correct", F.trim("x").alias("x")).where("x <> ''")
    number = F.regexp_extract("x", r"\s(\d+)$", 1)
    return lines.select("correct", F.regexp_replace("x", r"\s+\d+$", "").alias("misspelling"), F.when(number == "", 1).otherwise(F.expr("try_cast(regexp_extract(x, '\\\\s(\\\\d+)$', 1) AS INT)")).alias("freq"))


def misspelling_stats(errors: DataFrame) -> DataFrame:
    return errors.agg(F.countDistinct("correct").alias("correct_words"), F.coalesce(F.sum("freq"), F.lit(0)).alias("total"), F.countDistinct("misspelling").alias("unique_misspellings"))


def edits(word: Column) -> Column:
    """All words one deletion, insertion or substitution of a letter, or swap of neighbours away; repeats are kept."""
    n = F.length(word)
    upto = lambda last: F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    letters = F.array(*[F.lit(c) for c in LETTERS])
    head, tail = lambda i: F.substring(word, F.lit(1), i - 1), lambda i: F.substring(word, i, n)
    deleted = F.transform(upto(n), lambda i: F.concat(head(i), tail(i + 1)))
    inserted = F.flatten(F.transform(upto(n + 1), lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i)))))
    substituted = F.flatten(F.transform(upto(n), lambda i: F.transform(F.filter(letters, lambda c: c != F.substring(word, i, F.lit(1))), lambda c: F.concat(head(i), c, tail(i + 1)))))
    swapped = F.transform(upto(n - 1), lambda i: F.concat(head(i), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), tail(i + 2)))
    return F.concat(deleted, inserted, substituted, swapped)


def distance_one(words: DataFrame, word_col: str = "term") -> DataFrame:
    """(term, typo), repeats kept."""
    renamed = words.select(F.col(word_col).alias("term"))
    return renamed.withColumn("typo", F.explode(edits(F.col("term"))))


def _drawn(*parts) -> Column:
    """A number from 0 to 2^32 - 1 from the MD5 of the parts, joined by colons: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def typos(words: DataFrame, distance: int, count: int, seed: int = 0, word_col: str = "term") -> DataFrame:
    """(term, draw, typo): count words for each term, each by so many edits that a hash of (seed, term, draw, step) picks."""
    out = words.select(F.col(word_col).alias("term"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("draw")).withColumn("typo", F.col("term"))
    for step in range(distance):
        at = _drawn(F.lit(seed), F.col("term"), F.col("draw"), F.lit(step))
        out = out.withColumn("e", edits(F.col("typo"))).withColumn("typo", F.element_at("e", (at % F.size("e") + 1).cast("int"))).drop("e")
    return out


def workload(frequencies: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(draw, term): terms drawn by frequency: each of size seeded points of [0, total) falls into one term's share.

    Shares are laid out by range-partitioned terms with sums before each partition, not by one global window. The partitions are
    written first, with their numbers, so that every later reading sees the same ones.
    """
    ordered = Cut(frequencies.repartitionByRange("term").select("term", "freq", F.spark_partition_id().alias("p")), "shares").df
    before = ordered.groupBy("p").agg(F.sum("freq").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("freq").over(Window.partitionBy("p").orderBy("term").rowsBetween(Window.unboundedPreceding, 0))
    laid = ordered.join(F.broadcast(before.select("p", "base")), "p").select("term", (F.col("base") + inside).alias("upto"), "freq").select("term", (F.col("upto") - F.col("freq")).alias("low"), "upto")
    total = ordered.agg(F.sum("freq")).first()[0] or 0
    if not total:
        return frequencies.select(F.lit(0).cast("long").alias("draw"), "term").limit(0)
    width = max(1, total // 4096)
    draws = frequencies.sparkSession.range(size).select(F.col("id").alias("draw"), (_drawn(F.lit(seed), F.col("id")) * 65536 + _drawn(F.lit(seed + 1), F.col("id")) % 65536).alias("h")).select("draw", F.pmod("h", F.lit(total)).alias("at")).withColumn("cell", F.floor(F.col("at") / width))
    cells = laid.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("upto") - 1) / width))))
    return draws.join(cells, "cell").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("upto"))).select("draw", "term")


def uniform_workload(words: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(draw, term): terms drawn evenly."""
    return workload(words.select("term").distinct().withColumn("freq", F.lit(1).cast("long")), size, seed)


def query_list(words: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(term): that many distinct terms (or all, if there are fewer), chosen by hash."""
    return words.select("term").distinct().orderBy(_drawn(F.lit(seed), F.col("term")), "term").limit(size)


def workload_stats(words: DataFrame, frequency_col: str = "freq") -> DataFrame:
    f = F.col(frequency_col)
    return words.agg(F.count("*").alias("total"), F.countDistinct("term").alias("unique_terms"), F.min(f).alias("least"), F.max(f).alias("most"), F.avg(f).alias("average"))


def recall_at(pairs: DataFrame, found: DataFrame, most: int = 3) -> DataFrame:
    """(pairs, recall_1 .. recall_most): shares of (query, term, distance) pairs within most that are found at each distance."""
    hit = found.select(F.col("query").alias("q"), F.col("term").alias("t"), F.col("distance").alias("d"))
    joined = pairs.where(F.col("distance") <= most).join(hit, (F.col("query") == F.col("q")) & (F.col("term") == F.col("t")), "left")
    return joined.agg(F.count("*").alias("pairs"), *[F.avg((F.col("d").isNotNull() & (F.col("d") <= k)).cast("double")).alias(f"recall_{k}") for k in range(1, most + 1)])
