"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links: (a, b) longs, in any direction, repeated or not. (id, root) for every node that
    isn't the least of its component. Each round links every node's neighbours to the least of
    them (larger ones first, then smaller ones); least neighbours are found by partial
    aggregates and joined back, so a node with very many links is no single task's list. Rounds
    go on until every node is linked to its root alone; their number grows with the logarithm of the nodes."""
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut(large, name)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        edges = cut(small.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).filter("hi != lo").distinct(), name)
        heads = edges.groupBy("hi").count()
        if heads.filter("count > 1").isEmpty() and edges.join(heads.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            break  # every node hangs on a node that hangs on none
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
