"""Connected components by alternating large-star and small-star steps, without any node's neighbours in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (u, v) of longs: component is the smallest node that can be reached.

    Nulls and loops are ignored. Every round ends in a table of the shared folder."""
    edges = common.stage(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = common.stage(small, "edges")
        common.discard(edges)
        edges = new
        # a star forest stays as it is: then one row a node, and none of the centres is itself below another
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
