"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravitas.llm.text import remove, written


def _content(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: for every node of ``edges`` (a, b) the smallest node it can reach.

    Large-star and small-star steps take turns until nothing changes: each ties the neighbours of a node to the
    smallest of them. The number of rounds grows with the logarithm of the longest path. Every round is written to the
    shared folder and replaces the one before. A node's minimum is taken before shuffling and stands in a table of its
    own, so that adaptive execution can split a node with very many edges in the join.
    """
    plain = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    stars = written(plain, "edges")
    before = _content(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(near.withColumnRenamed("m", "v"))
        last, stars = stars, written(small.where("u <> v").distinct(), "edges")
        remove(last, low)
        now = _content(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
