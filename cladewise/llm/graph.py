"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import materialize, released


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``: the smallest node reachable.

    Alternates two steps until nothing changes: each node's larger neighbours move to its smallest
    neighbour, then its smaller ones do. Each round is a written table; the driver sees a count and
    a checksum.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        seen_rows = Observation()
        checked = small.filter("a <> b").distinct().observe(seen_rows, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"))
        following = materialize(checked)
        state = seen_rows.get
        released(now)
        now = following
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
