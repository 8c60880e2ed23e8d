"""SQL surface: functions and a table function for use in spark.sql()."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from termweave.functions.distance import MERGE_AND_SPLIT, STANDARD, TRANSPOSITION, batch_distance
from termweave.plans.shared import ship


class FuzzySearch:
    """fuzzy_search(TABLE(terms), query, n): the rows (term, ...) within n of the query, with their distance."""

    def eval(self, row: Row, query: str, n: int):
        term = row["term"]
        if term is None or query is None or abs(len(term) - len(query)) > n:
            return
        distance = int(batch_distance([term], [query], STANDARD)[0])
        if distance <= n:
            yield term, distance


def register(spark: SparkSession) -> None:
    """Make ``fuzzy_search``, ``osa_distance`` and ``merge_split_distance`` known to SQL."""
    from termweave.functions.distance import _udf

    ship(spark)
    spark.udtf.register("fuzzy_search", F.udtf(FuzzySearch, returnType="term string, distance int"))
    spark.udf.register("osa_distance", _udf(TRANSPOSITION))
    spark.udf.register("merge_split_distance", _udf(MERGE_AND_SPLIT))
