"""Connected components of a graph of links, by alternating stars.

Each round replaces every node's links by links to its smallest neighbour:
first for larger neighbours, then for smaller ones.  The links end as stars
around the smallest node of each component.  Only minima and counts are
gathered per node, both combined on the map side, so a node with any number
of neighbours is handled; the join that attaches a minimum to a node's links
is left to adaptive execution, which splits hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.operators.scale import durable


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """``links`` point from the larger to the smaller node."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved)


def _print(links: DataFrame) -> tuple:
    """Count and order-free checksum; one row reaches the driver."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame, spread: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``) that is not its own root.

    The root is the smallest node reachable.  Links to itself and NULL ends
    are ignored; without links the result is empty.
    """
    larger = F.greatest("a", "b")
    clean = links.where(F.col("a") != F.col("b")).select(larger.alias("a"), F.least("a", "b").alias("b"))
    now = durable(clean.distinct())
    seen = _print(now)
    while seen[0]:
        now = durable(_small(_large(now).where(F.col("a") != F.col("b")).distinct()).where(F.col("a") != F.col("b")).distinct())
        last, seen = seen, _print(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
