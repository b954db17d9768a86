"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) that isn't the root itself; the root is its component's least node.

    Both kinds of round take only the least neighbour of a node (a partial aggregate) and a join, so a node of very
    many edges is never gathered. Every round is written, which cuts the lineage. Rows with a NULL end or with equal
    ends are no edges; no edges, no rows.
    """
    stars = materialize(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .where("a is not null and b is not null and lo < hi").distinct(), "edges",
    )
    seen = _fingerprint(stars)
    while seen[0]:
        both = stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(stars.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(root.select("hi", F.col("m").alias("lo"))).distinct()
        )
        stars = materialize(small, "edges")
        now = _fingerprint(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
