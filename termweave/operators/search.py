"""Approximate lookups over a table of terms: ranked, top-k, prefix, filtered and restricted searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.distance import ALGORITHMS, STANDARD, capped_prefix_distance, distance, generalized_distance, prefix_distance, restricted_distance
from termweave.operators.join import PLANS, SEGMENTS_MOST, Alternatives, _numbers, _segments, blocks, candidates, similarity_join
from termweave.plans.shared import ship

DEFAULT_DISTANCE = 2
#: Keys of queries that a prefix search broadcasts at once.
PREFIX_KEYS_MOST = 100_000


def top_k(matches: DataFrame, k: int) -> DataFrame:
    """The k nearest terms of each query, by (distance, term)."""
    order = Window.partitionBy("query").orderBy("distance", "term")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _prefix_keys(q: DataFrame, n: int) -> DataFrame:
    """(query, rank, o, s, x): what stands in a term, at o, if one of its prefixes is within n of the query. The empty text where any term may match.

    Of n + 1 segments of a query some segment k is untouched with k operations on its left, so that it is k places away at most.
    """
    parts = []
    for k in range(n + 1 if n <= SEGMENTS_MOST else 0):
        start, size = _segments(F.length("query"), n + 1, k, 0)
        for shift in range(-k, k + 1):
            parts.append(F.struct(F.lit(len(parts)).alias("rank"), (start + shift).alias("o"), size.alias("s"), F.substring("query", start + 1, size).alias("x")))
    free = F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("o"), F.lit(0).alias("s"), F.lit("").alias("x")))
    keys = F.when(F.length("query") > n, F.array(*parts)).otherwise(free) if parts else free
    return q.select("query", F.explode(keys).alias("k")).select("query", "k.*")


def _first_key(n: int) -> Column:
    """Whether no key of a lower rank matches, too: a pair comes once."""
    out, rank = F.lit(True), 0
    for k in range(n + 1 if n <= SEGMENTS_MOST else 0):
        start, size = _segments(F.length("query"), n + 1, k, 0)
        for shift in range(-k, k + 1):
            out, rank = out & ((F.col("rank") <= rank) | (F.substring("term", start + shift + 1, size) != F.substring("query", start + 1, size))), rank + 1
    return out


def prefix_join(queries: DataFrame, terms: DataFrame, n: int, query_col: str = "query", term_col: str = "term") -> DataFrame:
    """(query, term, distance): terms of which some prefix is within n of the query, at its least distance.

    Segments of the queries are broadcast in counted blocks and sought in the terms, which are neither cut into prefixes nor shuffled.
    """
    q = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query")).distinct()
    t = terms.where(F.col(term_col).isNotNull()).select(F.col(term_col).alias("term")).distinct()

    def near(block: DataFrame) -> DataFrame:
        keys = _prefix_keys(block, n)
        cut = t.join(F.broadcast(keys.select("o", "s").distinct()), F.col("o") + F.col("s") <= F.length("term"))
        met = cut.withColumn("x", F.expr("substring(term, o + 1, s)")).join(F.broadcast(keys), ["o", "s", "x"]).where(_first_key(n))
        if 0 < n <= SEGMENTS_MOST:  # one prefix is within 2 n, if any is within n
            met = met.where(F.expr(f"levenshtein(query, substring(term, 1, length(query)), {2 * n}) >= 0"))
            least = capped_prefix_distance(F.col("query"), F.col("term"), n)
        else:
            least = prefix_distance(F.col("query"), F.col("term"), n)
        # exploded, as the distance would be put into the filter and be computed there, too
        return met.select("query", "term", F.explode(F.array(least)).alias("distance")).where(F.col("distance") <= n)

    return reduce(DataFrame.unionByName, map(near, blocks(q, "query", PREFIX_KEYS_MOST // min(n + 1, SEGMENTS_MOST + 1) ** 2)))


def starts_with(queries: DataFrame, terms: DataFrame, query_col: str = "query", term_col: str = "term") -> DataFrame:
    """(query, term): terms that begin with the query; an equi-join on prefixes of the lengths that queries have."""
    q = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query")).distinct()
    lengths = q.select(F.length("query").alias("k")).distinct()
    cut = terms.select(F.col(term_col).alias("term")).distinct().select("term", F.explode(_numbers(F.lit(0), F.length("term"))).alias("k")).join(lengths, "k", "left_semi")
    return cut.select("term", F.expr("substring(term, 1, k)").alias("query")).join(q, "query", "left_semi").select("query", "term")


def starts_with_values(queries: DataFrame, terms: DataFrame, query_col: str = "query") -> DataFrame:
    """(query, term, value): terms that begin with the query, with their values."""
    values = terms.select(F.col("term").alias("t"), "value")
    return starts_with(queries, terms, query_col).join(values, F.col("term") == F.col("t")).select("query", "term", "value")


def restricted_join(queries: DataFrame, terms: DataFrame, n: int, pairs, algorithm: str = STANDARD, query_col: str = "query", term_col: str = "term") -> DataFrame:
    """(query, term, distance) with (term's, query's) character pairs that match at no cost.

    Segments are joined through all that a query's characters may stand for. Characters that pairs connect are also mapped to one of
    them; the distance after that is no larger, so that testing mapped words first loses nothing. The exact distance follows.
    """
    ship(queries.sparkSession)
    pairs = sorted((x, y) for x, y in pairs if len(x) == len(y) == 1)
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.get(c, c) != c:
            c = root[c]
        return c

    for x, y in pairs:
        root[max(find(x), find(y))] = min(find(x), find(y))
    mapped = sorted({c for p in pairs for c in p})
    same = lambda c: F.translate(c, "".join(mapped), "".join(find(m) for m in mapped))
    q = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("q")).distinct().withColumn("d", same(F.col("q")))
    t = terms.where(F.col(term_col).isNotNull()).select(F.col(term_col).alias("t")).distinct().withColumn("c", same(F.col("t")))
    near = candidates(q, t, n, algorithm, Alternatives(pairs))
    return near.select(F.col("q").alias("query"), F.col("t").alias("term"), restricted_distance(F.col("t"), F.col("q"), pairs, algorithm).alias("distance")).where(F.col("distance") <= n)


def accepts(pairs: DataFrame, word: Column, given: Column, n: int, operations: list[dict] | None = None, algorithm: str = STANDARD, floor_weights: bool = True) -> DataFrame:
    """pairs with a column ``accepts``: the words are within n, by an algorithm or by weighted operations."""
    ship(pairs.sparkSession)
    d = distance(word, given, algorithm) if operations is None else generalized_distance(operations, floor_weights)(word, given)
    return pairs.withColumn("accepts", d <= n)


class FuzzyIndex:
    """A table of terms, optionally with values, bound to an algorithm and a unit."""

    def __init__(self, terms: DataFrame, algorithm: str = STANDARD, unit: str = "char", term_col: str = "term", value_col: str | None = None, pairs=None, plan: str = "auto"):
        if algorithm not in ALGORITHMS or unit not in ("char", "byte") or plan not in PLANS:
            raise ValueError(f"unknown algorithm, unit or plan: {algorithm}, {unit}, {plan}")
        self.terms, self.algorithm, self.unit, self.term_col, self.value_col, self.pairs, self.plan = terms, algorithm, unit, term_col, value_col, pairs, plan

    def _but(self, **changes) -> FuzzyIndex:
        return FuzzyIndex(**{k: getattr(self, k) for k in ("terms", "algorithm", "unit", "term_col", "value_col", "pairs", "plan")} | changes)

    def with_substitutions(self, pairs) -> FuzzyIndex:
        return self._but(pairs=pairs)

    def query_with_distance(self, queries: DataFrame, n: int = DEFAULT_DISTANCE, query_col: str = "query", terms: DataFrame | None = None) -> DataFrame:
        source = self.terms if terms is None else terms
        if self.pairs is not None:
            return restricted_join(queries, source, n, self.pairs, self.algorithm, query_col, self.term_col)
        return similarity_join(queries, source, n, self.algorithm, self.unit, query_col, self.term_col, self.plan)

    def query(self, queries: DataFrame, n: int = DEFAULT_DISTANCE, query_col: str = "query") -> DataFrame:
        return self.query_with_distance(queries, n, query_col).select("query", "term")

    def query_ranked(self, queries: DataFrame, n: int = DEFAULT_DISTANCE, query_col: str = "query") -> DataFrame:
        return self.query_with_distance(queries, n, query_col).orderBy("query", "distance", "term")

    def query_top(self, queries: DataFrame, n: int, k: int, query_col: str = "query") -> DataFrame:
        return top_k(self.query_with_distance(queries, n, query_col), k)

    def query_prefix(self, queries: DataFrame, n: int = DEFAULT_DISTANCE, query_col: str = "query") -> DataFrame:
        return prefix_join(queries, self.terms, n, query_col, self.term_col)

    def query_filtered(self, queries: DataFrame, n: int, predicate: Column, query_col: str = "query") -> DataFrame:
        """Terms whose value fits; terms without a value pass. The predicate is applied before any distance."""
        return self.query_with_distance(queries, n, query_col, self.terms.where(F.col(self.value_col).isNull() | predicate))

    def query_by_value_set(self, queries: DataFrame, n: int, values: DataFrame, query_col: str = "query") -> DataFrame:
        """Terms whose value is one of a table of values (its first column)."""
        v = values.select(F.col(values.columns[0]).alias("__v")).distinct()
        return self.query_with_distance(queries, n, query_col, self.terms.join(v, F.col(self.value_col) == F.col("__v"), "left_semi"))

    def builder(self, queries: DataFrame) -> QueryBuilder:
        return QueryBuilder(self, queries)


class QueryBuilder:
    """index.builder(queries).max_distance(1).ordered().limit(3).execute()"""

    def __init__(self, index: FuzzyIndex, queries: DataFrame):
        self._index, self._queries, self._n, self._k, self._ordered, self._prefix = index, queries, DEFAULT_DISTANCE, None, False, False

    def max_distance(self, n: int) -> QueryBuilder:
        self._n = n
        return self

    def algorithm(self, name: str) -> QueryBuilder:
        self._index = self._index._but(algorithm=name)
        return self

    def plan(self, name: str) -> QueryBuilder:
        self._index = self._index._but(plan=name)
        return self

    def filter(self, predicate: Column) -> QueryBuilder:
        """Only terms that fit; the predicate is over the columns of the index's table, and comes before any distance."""
        self._index = self._index._but(terms=self._index.terms.where(predicate))
        return self

    def ordered(self) -> QueryBuilder:
        self._ordered = True
        return self

    def prefix(self) -> QueryBuilder:
        self._prefix = True
        return self

    def limit(self, k: int) -> QueryBuilder:
        self._k = k
        return self

    def execute(self) -> DataFrame:
        got = self._index.query_prefix(self._queries, self._n) if self._prefix else self._index.query_with_distance(self._queries, self._n)
        if self._k is not None:
            got = top_k(got, self._k).drop("rank")
        return got.orderBy("query", "distance", "term") if self._ordered else got

    def collect(self) -> list[tuple[str, str, int]]:
        return [tuple(r) for r in self.execute().collect()]
