"""Similarity join: queries with all terms within an edit distance.

Plans, all exact:

* ``segments``: a term is cut into n + 1 segments. n operations leave one of them untouched, so it stands in the
  query. Moreover, some untouched segment k (from 0) has at most k operations on its left and at most n - k on its right (the
  first one at which the operations so far are no more than k), so that only few places have to be tried for it. A swap, merge or
  split changes two neighbouring characters; for these there is a gap of one
  character between segments, so that it still reaches one segment only. Both sides explode to (length, segment
  number, segment) and meet in an equi-join, whose pairs are tested, made distinct and verified. Terms too short for that meet through
  deletion neighbourhoods: both words come to a common one by n deletions (merges and splits take two). So do, up to two deletions, the words
  of a segment that many queries and many terms share, such as the beginning of numbered names: all its pairs would be tested.
* ``nested``: a broadcast of the queries, in counted blocks of NESTED_MOST, and a scan of the terms for each.
* ``auto`` (the default): segments up to a distance of SEGMENTS_MOST. Beyond it segments are so short that they choose nothing, and
  most pairs of words are within the distance anyway: nested.

Nothing is broadcast unchecked. A distance above the longest word is that word's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.distance import ALGORITHMS, MERGE_AND_SPLIT, STANDARD, byte_view, distance, may_be_within
from termweave.plans.shared import Cut, ship

#: Queries that a nested plan broadcasts at once.
NESTED_MOST = 2000
#: Largest distance for which segments choose.
SEGMENTS_MOST = 4
#: Columns of a segment's key.
KEY = ["n", "k", "s"]
#: Queries and terms from which a segment that they share chooses too little, and deletions up to which such words meet through neighbourhoods.
CROWD, DROPPED_MOST = 500, 2
PLANS = ("auto", "segments", "nested")


def _numbers(low: Column, high: Column) -> Column:
    """low..high, empty if high is below low (a plain sequence would count down)."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _segments(length: Column, count: int, k: int, gap: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment k of count in a term of this length, gap characters between segments; the
    last ones take what is over."""
    usable = length - gap * (count - 1)
    size, over = F.floor(usable / count).cast("int"), usable % count
    first_long = count - over
    start = F.lit(k) * size + F.greatest(F.lit(0), F.lit(k) - first_long) + k * gap
    return start, size + (F.lit(k) >= first_long).cast("int")


#: Keys that one segment may become where characters have alternatives.
VARIANTS_MOST = 512


class Alternatives:
    """Term characters that each query character may stand for besides itself, and how long a segment's beginning may be for that."""

    def __init__(self, pairs):
        self.of: dict[str, list[str]] = {}
        for term, query in pairs:
            if term != query:
                self.of.setdefault(query, []).append(term)
        most = 1 + max(map(len, self.of.values()), default=0)
        self.length = 1
        while most > 1 and most ** (self.length + 1) <= VARIANTS_MOST:
            self.length += 1

    def variants(self, text: Column) -> Column:
        """All texts that a short text may stand for."""
        if not self.of:
            return F.array(text)
        table = F.create_map(*[x for q, terms in sorted(self.of.items()) for x in (F.lit(q), F.array(*map(F.lit, sorted(terms))))])
        each = lambda c: F.concat(F.array(c), F.coalesce(F.try_element_at(table, c), F.array().cast("array<string>")))
        grow = lambda done, c: F.flatten(F.transform(done, lambda d: F.transform(each(c), lambda x: F.concat(d, x))))
        return F.aggregate(F.split(text, ""), F.array(F.lit("")), grow)


def _term_keys(terms: DataFrame, n: int, gap: int, alternatives: Alternatives | None = None) -> DataFrame:
    parts = []
    for k in range(n + 1):
        start, size = _segments(F.length("c"), n + 1, k, gap)
        s = F.substring(F.col("c"), start + 1, size) if alternatives is None else F.substring(F.col("t"), start + 1, F.least(size, F.lit(alternatives.length)))
        parts.append(F.struct(F.length("c").alias("n"), F.lit(k).alias("k"), s.alias("s")))
    return terms.select("t", "c", F.explode(F.array(*parts)).alias("x")).select("t", "c", "x.*")


def _cutter(k: int, size: Column, alternatives: Alternatives | None):
    key = lambda s: F.struct(F.lit(k).alias("k"), s.alias("s"))
    if alternatives is None:
        return lambda p: F.array(key(F.substring(F.col("d"), p + 1, size)))
    return lambda p: F.transform(alternatives.variants(F.substring(F.col("q"), p + 1, F.least(size, F.lit(alternatives.length)))), key)


def _query_keys(queries: DataFrame, n: int, gap: int, least: int, alternatives: Alternatives | None = None) -> DataFrame:
    sized = queries.select("q", "d", F.explode(_numbers(F.greatest(F.length("d") - n, F.lit(least)), F.length("d") + n)).alias("n"))
    parts = []
    for k in range(n + 1):
        start, size = _segments(F.col("n"), n + 1, k, gap)
        longer = F.length("d") - F.col("n")
        low, high = F.greatest(start - k, start + longer - (n - k), F.lit(0)), F.least(start + k, start + longer + (n - k), F.length("d") - size)
        shifts = _numbers(low, high)
        parts.append(F.flatten(F.transform(shifts, _cutter(k, size, alternatives))))
    return sized.select("q", "d", "n", F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("x")).select("q", "d", "n", "x.*")


def deletions(word: Column, most: int) -> Column:
    """The word and all words that come of it by so many deletions at most."""
    out = step = F.array(word)
    for _ in range(most):
        cut = lambda w: F.transform(_numbers(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        step = F.array_distinct(F.flatten(F.transform(step, cut)))
        out = F.concat(out, step)
    return F.array_distinct(out)


def _crowded(asked: DataFrame, had: DataFrame) -> DataFrame | None:
    """The keys that many queries and many terms share, None if there are none."""
    many = lambda df: df.groupBy(KEY).count().where(F.col("count") > CROWD).select(KEY)
    own = Cut(many(asked), "crowded")
    if own.df.isEmpty():
        own.drop()
        return None
    both = Cut(many(had.join(own.df, KEY, "left_semi")), "crowded")
    return None if both.df.isEmpty() else both.df


def candidates(queries: DataFrame, terms: DataFrame, n: int, algorithm: str = STANDARD, alternatives: Alternatives | None = None) -> DataFrame:
    """(q, d, t, c): a superset of the pairs within n, each once. q, t are the words and d, c what is compared, letter by letter alike.

    With alternatives, segments are those of the words themselves: a beginning of the query's segment becomes all that it may stand for.
    """
    gap = 0 if algorithm == STANDARD else 1
    least = n + 1 + gap * n
    dropped = 2 * n if algorithm == MERGE_AND_SPLIT else n
    asked, had = _query_keys(queries, n, gap, least, alternatives), _term_keys(terms.where(F.length("c") >= least), n, gap, alternatives)
    fits = may_be_within(F.col("c"), F.col("d"), n, algorithm)
    parts = []
    if dropped <= DROPPED_MOST and (crowded := _crowded(asked, had)) is not None:
        most = lambda df, *names: df.join(crowded, KEY, "left_semi").select(*names).distinct()
        drop = lambda df, c: df.withColumn("s", F.explode(deletions(F.col(c), dropped)))
        parts.append(drop(most(asked, "q", "d"), "d").join(drop(most(had, "t", "c"), "c"), "s").select("q", "d", "t", "c").where(fits))
        asked, had = asked.join(crowded, KEY, "left_anti"), had.join(crowded, KEY, "left_anti")
    parts.append(asked.join(had, KEY).select("q", "d", "t", "c").where(fits))
    few = terms.where(F.length("c") < least).select("t", "c", F.explode(deletions(F.col("c"), dropped)).alias("s"))
    near = queries.where(F.length("d") < least + n).select("q", "d", F.explode(deletions(F.col("d"), dropped)).alias("s"))
    parts.append(near.join(few, "s").select("q", "d", "t", "c").where(fits))
    # a pair may share several keys: the cheap native test comes first, so that only what passes it is made distinct
    return reduce(DataFrame.unionByName, parts).distinct()


def blocks(q: DataFrame, col: str, most: int) -> list[DataFrame]:
    """The rows of q, whose texts in a column are distinct, in blocks of a bounded number."""
    many = q.count()
    if many <= most:
        return [q]
    count = -(-2 * many // most)  # half full, so that an uneven deal by hashes stays below the bound
    dealt = Cut(q.withColumn("b", F.pmod(F.xxhash64(col), F.lit(count)).cast("int")), "queries").df
    return [dealt.where(F.col("b") == b).drop("b") for b in range(count)]


def _nested(q: DataFrame, t: DataFrame, n: int, algorithm: str) -> DataFrame:
    """Pairs through one scan of the terms for each block of queries."""
    near = lambda block: t.join(F.broadcast(block), may_be_within(F.col("c"), F.col("d"), n, algorithm)).select("q", "d", "t", "c")
    return reduce(DataFrame.unionByName, map(near, blocks(q, "q", NESTED_MOST)))


def similarity_join(queries: DataFrame, terms: DataFrame, n: int, algorithm: str = STANDARD, unit: str = "char", query_col: str = "query", term_col: str = "term", plan: str = "auto") -> DataFrame:
    """(query, term, distance) of all pairs of distinct queries and terms within n. Null words match nothing."""
    if algorithm not in ALGORITHMS or unit not in ("char", "byte") or n < 0 or plan not in PLANS:
        raise ValueError(f"unknown algorithm, unit, plan or distance: {algorithm}, {unit}, {plan}, {n}")
    ship(queries.sparkSession)
    view = byte_view if unit == "byte" else (lambda c: c)
    q = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("q")).distinct().withColumn("d", view(F.col("q")))
    t = terms.where(F.col(term_col).isNotNull()).select(F.col(term_col).alias("t")).distinct().withColumn("c", view(F.col("t")))
    if n > SEGMENTS_MOST:
        longest = lambda df, c: df.agg(F.coalesce(F.max(F.length(c)), F.lit(0))).first()[0]
        n = min(n, max(longest(q, "d"), longest(t, "c")))
    if n == 0:
        return q.join(t, F.col("d") == F.col("c")).select(F.col("q").alias("query"), F.col("t").alias("term"), F.lit(0).alias("distance"))
    if plan == "nested" or (plan == "auto" and n > SEGMENTS_MOST):
        pairs = _nested(q, t, n, algorithm)
    else:
        pairs = candidates(q, t, n, algorithm)
    return pairs.select(F.col("q").alias("query"), F.col("t").alias("term"), distance(F.col("c"), F.col("d"), algorithm).alias("distance")).where(F.col("distance") <= n)
