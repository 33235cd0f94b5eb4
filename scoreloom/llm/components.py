"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first())


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of every id in ``pairs`` (columns a, b); root is the least id that can be reached.

    Each node needs only the least of its neighbours, a map-side combinable aggregate, so a node with very many neighbours makes no large group; the join that follows can be split by AQE.
    """
    edges = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select("m", F.explode(F.array("a", "b")).alias("a")).where("a <> m").select("a", F.col("m").alias("b")).distinct()
        edges = cut(small)
        release(edges.sparkSession)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())
