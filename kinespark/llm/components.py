"""Connected components of a graph given as links, by alternating minimum stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import cut, stored


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link, root being the least node that can be reached.

    Each round links every node's larger neighbours to the least node of its neighbourhood, then its smaller ones; both
    are joins and minimum aggregations over links, so no node's neighbourhood is gathered in one task. Rounds end when
    the links no longer change; their number grows with the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    last = None
    while True:
        # large star: neighbours above a node go to the least node near it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # least neighbours are tables of their own, so that the joins can split a node with very many links
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of these
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last is not None and tuple(now) == last:
            break
        last = tuple(now)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
