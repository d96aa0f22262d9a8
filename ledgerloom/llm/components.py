"""Connected components of an edge table: each node takes the smallest id it has seen, through stars that get larger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u, v) hangs on one node only, which itself hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return not (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
                .agg(F.count_if(F.expr("up > 1 OR (up = 1 AND down = 1)"))).first()[0])


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, component), for nodes with a link; the component is its smallest node.

    Alternates two steps on rows (larger, smaller): every node's larger neighbours are hung on its smallest neighbour;
    then every node's smaller neighbours are. Rows never grow in number, and the rounds follow the logarithm of the
    longest path. Ends as soon as all are such stars, if need be without a round.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                   "edges")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(own, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(own.select("u", F.col("m").alias("v"))).distinct())
        edges = stored(small, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct())
