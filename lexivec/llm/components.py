"""Connected components of links between keys, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import save


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger key a to the smaller key b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved)


def components(links: DataFrame) -> DataFrame:
    """(key, root) for every key in ``links`` (a, b: long): root is the least key reachable.

    Each round halves the depth of the trees at least; rounds are stored in the shared folder and
    end when the set of edges stays the same. Minima are combined before they are shuffled, and
    joins (not groups) carry a hub's edges, so a large component can be split over tasks.
    """
    turned = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = save(turned.distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = edges.agg(mark).first()[0]
    while seen[0]:
        edges = save(_small_star(_large_star(edges).where("a != b").distinct()).distinct(), "links")
        now = edges.agg(mark).first()[0]
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct()
    )
