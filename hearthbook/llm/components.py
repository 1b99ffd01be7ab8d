"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import temporary, written


def connected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Alternating large-star and small-star steps: every node hands its larger (then
    its smaller) neighbours to the least node it knows of, until nothing changes,
    which takes about log(n) rounds whatever the shape. A hub is never gathered: its
    least neighbour is an aggregate with partial sums, and the join that follows is
    an equality join whose hot partitions adaptive execution splits. Each round is
    written to the shared folder, so a lost executor costs a round at most."""
    with temporary():
        now = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
        now = written(now.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        known = None
        while not now.isEmpty():
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = written(large.where("a <> b").distinct())
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            joined = large.join(least, "a")
            small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
            after = written(small.where("a <> b").distinct())
            state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            now = after
            if state == known:
                break
            known = state
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        return written(found, "components", keep=True)
