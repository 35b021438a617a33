"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b: longs, either way round); root is the least node it reaches. Roots have no row.

    Each step lets nodes point at the least neighbour that they or their neighbours see, which takes a number of steps that grows with
    the logarithm of the longest path, squared at most. A step's links are written to the shared folder, so lineage stays short
    and nothing about the nodes is gathered on the driver but a count and a checksum. Nulls and self-links are left out.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(a.alias("a"), b.alias("b")).distinct()
    edges, seen = materialize(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF)), F.lit(0))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "edges")
