"""Dictionaries as tables: building, lookups, updates, merges and sizes. A dictionary is (term[, value]), one row a term."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_terms(rows: DataFrame, term_col: str = "term") -> DataFrame:
    return rows.where(F.col(term_col).isNotNull()).select(F.col(term_col).alias("term")).distinct()


def from_terms_with_values(rows: DataFrame, term_col: str, value_col: str, order_col: str) -> DataFrame:
    """The last value of each term, by order_col."""
    return rows.where(F.col(term_col).isNotNull()).groupBy(F.col(term_col).alias("term")).agg(F.max_by(value_col, order_col).alias("value"))


def contains(queries: DataFrame, terms: DataFrame, query_col: str = "query") -> DataFrame:
    """(query, found) per distinct query."""
    known = terms.select(F.col("term").alias("t"), F.lit(True).alias("f")).distinct()
    return queries.select(F.col(query_col).alias("query")).distinct().join(known, F.col("query") == F.col("t"), "left").select("query", F.coalesce("f", F.lit(False)).alias("found"))


def get_value(queries: DataFrame, terms: DataFrame, query_col: str = "query") -> DataFrame:
    """(query, value) per distinct query, null where there is none."""
    return queries.select(F.col(query_col).alias("query")).distinct().join(terms.select(F.col("term").alias("t"), "value"), F.col("query") == F.col("t"), "left").select("query", "value")


def contains_with_value(queries: DataFrame, terms: DataFrame, predicate: Column, query_col: str = "query") -> DataFrame:
    return contains(queries, terms.where(predicate), query_col)


def any_value(terms: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Terms with a list of values of which one fits at least."""
    return terms.where(F.exists("value", predicate))


def every_value(terms: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Terms with a list of values that all fit; an empty list does."""
    return terms.where(F.forall("value", predicate))


def union_with(left: DataFrame, right: DataFrame, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """All terms of both; merge(left's, right's value) where both have one."""
    r = right.select(F.col("term").alias("r_term"), F.col("value").alias("r_value"), F.lit(True).alias("r_has"))
    l_ = left.select(F.col("term").alias("l_term"), F.col("value").alias("l_value"), F.lit(True).alias("l_has"))
    joined = l_.join(r, F.col("l_term") == F.col("r_term"), "full_outer")
    value = F.when(F.col("l_has") & F.col("r_has"), merge(F.col("l_value"), F.col("r_value"))).when(F.col("l_has"), F.col("l_value")).otherwise(F.col("r_value"))
    return joined.select(F.coalesce("l_term", "r_term").alias("term"), value.alias("value"))


def union_replace(left: DataFrame, right: DataFrame) -> DataFrame:
    return union_with(left, right, lambda mine, other: F.coalesce(other, mine))


def insert(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Set union."""
    return terms.select("term").unionByName(new.select("term")).distinct()


def newly_inserted(terms: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("term").distinct().join(terms.select("term"), "term", "left_anti")


def remove(terms: DataFrame, gone: DataFrame) -> DataFrame:
    return terms.join(gone.select("term").distinct(), "term", "left_anti")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("term").intersect(right.select("term"))


def clear(terms: DataFrame) -> DataFrame:
    """No terms, with the same columns."""
    return terms.limit(0)


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("term").subtract(right.select("term"))


def stats(terms: DataFrame) -> DataFrame:
    """(terms, characters, longest, nodes): nodes of a trie are the distinct prefixes, the empty one too."""
    prefixes = terms.select(F.explode(F.expr("transform(sequence(0, length(term)), k -> substring(term, 1, k))")).alias("p")).agg(F.countDistinct("p").alias("nodes"))
    sizes = terms.agg(F.count("*").alias("terms"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("characters"), F.coalesce(F.max(F.length("term")), F.lit(0)).alias("longest"))
    return sizes.crossJoin(F.broadcast(prefixes))  # one row each


def children(terms: DataFrame, prefix: str) -> DataFrame:
    """Distinct characters that follow a prefix."""
    return terms.where(F.col("term").startswith(prefix) & (F.length("term") > len(prefix))).select(F.substring("term", len(prefix) + 1, 1).alias("next")).distinct()


def multimap(matches: DataFrame, terms: DataFrame, how: str = "union") -> DataFrame:
    """(query, value): values of all matched terms, as a sorted set, or concatenated by (distance, term). No match, no row."""
    joined = matches.join(terms.select(F.col("term").alias("t"), "value"), F.col("term") == F.col("t"))
    if how == "union":
        return joined.select("query", F.explode("value").alias("v")).groupBy("query").agg(F.array_sort(F.collect_set("v")).alias("value"))
    order = F.array_sort(F.collect_list(F.struct("distance", "term", F.col("value").alias("v"))))
    return joined.groupBy("query").agg(F.flatten(F.transform(order, lambda x: x["v"])).alias("value"))
