"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) to (node, component): the smallest node that can be reached. Isolated nodes don't occur.

    Each round is two aggregates and two joins on tables of at most the edges' size; a hot node's edges
    are reduced before they are shuffled and its join is one that Spark can split. Rounds grow with the
    logarithm of the longest path; each is written to the shared folder, which cuts the lineage.
    """
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star = stash(star, "components")
    seen = None
    for _ in range(max_rounds):
        both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        before, star = star, stash(small, "components")
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_stash(before)
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
