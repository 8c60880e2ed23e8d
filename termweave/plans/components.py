"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.plans.shared import Cut


def _fold(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of its neighbourhood. The minimum is aggregated map-side first. The pairs of a hub then
    meet its one row in a merge join: they stream past it and are never held together, and adaptive execution splits a hub
    with very many neighbours over several tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("hub", "m").alias("m"))
    hit = pairs.join(least, pairs["u"] == least["hub"])
    if keep_larger:
        return hit.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hit.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with an edge; root is the smallest node that can be reached.

    Self loops and null ends are ignored. Every round is written to the shared folder; the loop ends
    when a round leaves the edges as they were (their count and an order-free digest agree).
    """
    clean = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = Cut(clean, "edges")
    digest = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = digest(now.df)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.df.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _fold(both, True).distinct()
        small = _fold(large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False).distinct()
        after = Cut(small, "edges")
        again = digest(after.df)
        now.drop()
        now = after
        if again == seen:
            break
        seen = again
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.df.groupBy("b").agg(F.lit(1).alias("x")).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
