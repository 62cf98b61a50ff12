"""Ranks with ties, as joins on counted values: no window holds more than a group's distinct values, and where
all rows are one group, no more than a range of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import checkpointed


def value_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``(keys, column, ties, below, total)``: equal, smaller and all values of a group."""
    by = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("ties"))
    if not keys:
        return _ordered(by, column)
    before = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return by.withColumn("below", F.coalesce(F.sum("ties").over(before), F.lit(0))).withColumn("total", F.sum("ties").over(whole))


def _ordered(by: DataFrame, column: str) -> DataFrame:
    """``by(column, ties)`` with ``below`` and ``total``: values are dealt by range, and a range starts where the
    counts of those before it end; of them there are as many as partitions."""
    ranges = checkpointed(by.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in ranges.groupBy("part").agg(F.sum("ties").alias("n")).collect())  # partitions
    total, rows = 0, []
    for part, n in sizes:
        rows.append((part, total))
        total += n
    ahead = by.sparkSession.createDataFrame(rows, "part int, ahead long")
    before = Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumn("inside", F.coalesce(F.sum("ties").over(before), F.lit(0))).join(F.broadcast(ahead), "part")
    return out.select(column, "ties", (F.col("inside") + F.col("ahead")).alias("below"), F.lit(total).cast("long").alias("total"))


def with_ranks(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``df`` with ``avg_rank`` (ties share the mean of their ranks), ``pct_rank`` (that over the
    group's size) and ``centred_pct`` (values below plus half of the ties, over the size)."""
    counts = value_counts(df, keys, column)
    avg = F.col("below") + (F.col("ties") + 1) / 2
    ranks = counts.select(*keys, column, avg.alias("avg_rank"), (avg / F.col("total")).alias("pct_rank"), ((2 * F.col("below") + F.col("ties")) / (2 * F.col("total"))).alias("centred_pct"))
    return df.join(ranks, [*keys, column], "left")


def quantiles(df: DataFrame, keys: list[str], column: str, shares: list[float]) -> DataFrame:
    """``(keys, q)``: the exact quantiles of a column by group, between neighbours by their distance, as ``percentile`` gives them.

    Values are counted first and dealt by group and range, so no group's values meet in one task or map; a range
    starts where the counts of its group's ranges before it end."""
    by = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("ties"))
    ranges = checkpointed(by.repartitionByRange(*keys, "__v").withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy(*keys, "part").agg(F.sum("ties").alias("n"))  # a row for each group and range
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(*keys, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("inside", F.coalesce(F.sum("ties").over(inside), F.lit(0))).join(ahead, [*keys, "part"])
    below = F.col("inside") + F.col("ahead")
    found = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("total") - 1)
        held = lambda k, below=below: (below <= k) & (k < below + F.col("ties"))
        found += [F.max(F.when(held(end), F.col("__v"))).alias(f"{name}{i}") for name, end in (("low", F.floor(at)), ("high", F.ceil(at)))]
    ends = placed.groupBy(*keys).agg(F.first("total").alias("total"), *found)
    between = []
    for i, share in enumerate(shares):
        at, low, high = F.lit(float(share)) * (F.col("total") - 1), F.col(f"low{i}"), F.col(f"high{i}")
        between.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return ends.select(*keys, F.array(*between).alias("q"))
