"""Exact quantiles by counted values, against the percentiles that gather a group's values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions.ranks import quantiles
from cladewise.operators import metrics


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_are_the_percentiles(spark, keys):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v) if v > -50 else None) for k, v in zip(rng.integers(0, 4, 3000), np.round(rng.normal(0, 40, 3000), 1), strict=True)]
    df = spark.createDataFrame([*rows, (7, 1.5), (8, None), (9, -2.0), (9, 3.0)], "k int, v double")
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    told = {r["k"] if keys else 0: r["q"] for r in quantiles(df, keys, "v", shares).collect()}
    want = df.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).filter("q IS NOT NULL").collect()
    assert told == {r["k"] if keys else 0: r["q"] for r in want}


def test_histogram_gathers_no_values(spark):
    """A map of all values of a group in one task grows with the table."""
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 1000 + 0.5).alias("v"))
    out = metrics.histogram_auto(df, "v", ["g"])
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert out.agg(F.sum("n")).first()[0] == 5000
    empty = metrics.histogram_auto(df.withColumn("v", F.lit(None).cast("double")), "v", ["g"])
    assert empty.count() == 0
