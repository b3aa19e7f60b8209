"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmatch.operators.storage import written


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id of the links ``a, b`` (both long).

    Each round is written to the shared folder. A star's centre is found by a combining aggregate and joined
    back, so an id with very many links costs no more than its links. Ids without a link don't come back.
    """
    ways = written(_both(links.filter("a <> b")).filter("a > b").distinct(), "links")
    state = None
    while True:
        ways = written(_small(_large(ways)), "stars")
        now = ways.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # each id points at its centre now
    centres = ways.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return ways.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(centres)


def _both(ways: DataFrame) -> DataFrame:
    turned = ways.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return ways.select("a", "b").unionByName(turned)


def _large(ways: DataFrame) -> DataFrame:
    """Every larger neighbour of an id is linked to the smallest one around it."""
    both = _both(ways)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(ways: DataFrame) -> DataFrame:
    """Every smaller neighbour of an id, and the id, is linked to the smallest one (ways have a > b)."""
    least = ways.groupBy("a").agg(F.min("b").alias("m"))
    moved = ways.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
