"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.plans.storage import write_through


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for all nodes of ``edges`` (``a``, ``b``).

    Every round points each node at the smallest of its neighbours and of what they point at, and then at what that
    one points at, so rounds grow with the logarithm of the longest path. A round is two aggregates with a map-side
    minimum and joins by node, written to the shared folder; no node's neighbours are gathered. All joins sort and merge: a
    written table of labels packs into a small part of its size in memory, so by file size Spark would broadcast it through the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = write_through(both, "links")
    now = write_through(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        seen = links.join(now.select(F.col("node").alias("b"), F.col("root").alias("r")).hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        low = now.join(seen.hint("merge"), "node").select("node", "root", F.least("root", "r").alias("low"))
        # The old root hears of the smaller one too, so whole trees move at once.
        told = low.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        joined = low.join(told.hint("merge"), "node", "left").select("node", "root", F.least("low", F.coalesce("told", "low")).alias("low"))
        ahead = joined.select(F.col("node").alias("low"), F.col("low").alias("further"))
        new = joined.join(ahead.hint("merge"), "low", "left").select("node", F.least("low", F.coalesce("further", "low")).alias("new"), "root")
        new = write_through(new, "roots")
        if new.filter("new <> root").isEmpty():
            return new.select("node", "root")
        now = new.select("node", F.col("new").alias("root"))
