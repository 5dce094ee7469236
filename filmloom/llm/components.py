"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.plans.storage import write_through


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of an edge.

    Nodes may be of any ordered type. Edges with a null end and loops add nothing; repeated edges
    count once. Each round groups by node with a map-side minimum and joins back, so a node with many
    edges never meets them as one list, and writes its edges to the shared folder: lineage stays short
    and nothing but two counts per round reaches the driver. The number of rounds grows with
    the logarithm of the longest path. An empty table gives an empty table.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    ).distinct()
    # Each table that is read more than once is written, so that no plan holds copies of copies of it.
    now = write_through(now, "edges")
    while True:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = write_through(both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        ends = F.when(F.col("v") == F.col("m"), F.array("u")).otherwise(F.array("u", "v"))
        now = write_through(small.select(F.explode(ends).alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # Done when every node points once, and at a root.
        rows = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
        ).groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        if rows.filter("out > 1 OR (out = 1 AND in = 1)").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
