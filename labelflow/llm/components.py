"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of the links ``a``, ``b`` (long).

    Each round points a node's larger neighbours at its smallest one (large
    star), then the node and its smaller ones as well (small star); links
    never grow in number, and the number of rounds grows with the logarithm of
    the largest component. Smallest neighbours are aggregated map-side and
    joined back, so a hub is never gathered in one task. Nulls, self-links and
    repeated links are ignored; no link gives an empty table."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
                   .select("a", "b").distinct(), "links")
    known = _fingerprint(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        edges = stored(small, "links")
        before, known = known, _fingerprint(edges)
        if known == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
