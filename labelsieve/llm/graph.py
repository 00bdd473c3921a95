"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.session import spool


def _mark(edges: DataFrame) -> tuple:
    found = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return found["n"], found["h"]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it is linked with) of links ``a``, ``b``.

    Large and small stars in turn: every node hands its neighbours to the least of
    them, until each component is one star. A round is two aggregations and joins on
    the links, written to the shared folder; no node's neighbours are ever collected.
    Null ends and links of a node with itself are left out.
    """
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    edges = spool(links.where(F.col("a") != F.col("b")).select(*pair).distinct())
    before = None
    while (mark := _mark(edges)) != before and mark[0]:
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(small, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = spool(handed.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
