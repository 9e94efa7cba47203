"""Connected components of links, as joins and aggregates over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlex.shared import Tables


def _star(both: DataFrame) -> DataFrame:
    """u, v and least, the smallest of u and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return both.join(least, "u")


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(u, v). Isolated nodes are not in it.

    Alternating large-star and small-star steps: the number of rounds grows as the logarithm of the longest path, and
    a node's links are never gathered, only their minimum. Each round's table replaces the one before. Two numbers for
    each round come to the driver.
    """
    tables = tables or Tables(links.sparkSession)
    ends = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    edges = tables.write(links.select(*ends).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        before, edges = edges, tables.write(small.where("u <> v").distinct(), "edges")
        tables.drop(before)
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = tables.write(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots), "components")
    tables.drop(edges)
    return out
