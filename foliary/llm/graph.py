"""Connected components by alternating star contraction, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import materialize

SPREAD = 16  # tasks that share the links of one node


def _digest(links: DataFrame) -> tuple:
    """Order-free digest of a table of links (one row)."""
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of an undirected graph.

    ``edges`` has two long columns ``a`` and ``b``; loops, repeated and null ends are harmless. The result has one row
    (``node``, ``root``) per node with at least one edge to another node; ``root`` is the smallest node of its component.

    Every round hangs the larger neighbours of a node below the smallest one (a minimum per node, combined on the map
    side, and a join back, salted by the neighbour), so no adjacency list is ever gathered. Rounds
    are logarithmic in the longest path. Each round is written to the shared folder, which cuts the lineage.
    """
    links = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND u <> v")
        .distinct(),
        "links",
    )
    before = _digest(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        salted = both.filter("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int"))
        everywhere = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        large = salted.join(everywhere, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "links")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(moved.union(lowest.select("u", "m")).distinct(), "links")
        after = _digest(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
