"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges (u, v long); component is the least id reachable.

    Each step is a keyed aggregation and a join on that key, so a node with very many links is split
    like any skewed join. Each round is written to the shared folder and the one before it deleted.
    """
    now = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(small, "v")
        stars = linked.select(F.col("m").alias("u"), "v").union(linked.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
        after = materialize(stars, "edges")
        new = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("v")).first())
        discard(now)
        now = after
        if new == mark or new[0] == new[2] and not now.join(now.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
            break
        mark = new
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
