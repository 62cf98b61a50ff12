"""Result analytics: accuracy, ranks, correlations, per-species tables, densities and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import quantiles, value_counts, with_ranks


def clip_sps(prediction: DataFrame) -> DataFrame:
    return prediction.withColumn("sps", F.least(F.greatest(F.col("sps"), F.lit(-1.0)), F.lit(1.0)))


def threshold_labels(df: DataFrame, column: str, low: float, high: float, inclusive: bool) -> DataFrame:
    """``label``: +1 beyond ``high``, -1 beyond ``low``, else 0; ``inclusive`` takes the bounds in."""
    c = F.col(column)
    up, down = (c >= high, c <= low) if inclusive else (c > high, c < low)
    return df.withColumn("label", F.when(up, 1).when(down, -1).otherwise(0))


def mfs_subsets(prediction: DataFrame, shares: tuple[float, ...] = (0.05, 0.10, 0.25)) -> DataFrame:
    """Each row once per subset that it is in: ``all``, and the lowest shares of models by the
    percentile rank of their error over rows (strictly below)."""
    counts = value_counts(prediction, [], "input_rmse")
    pct = (F.col("below") + (F.col("ties") + 1) / 2) / F.col("total")
    ranked = prediction.join(counts.select("input_rmse", pct.alias("pct")), "input_rmse", "left")
    names = F.array(F.lit("all"), *(F.when(F.col("pct") < s, f"mfs_{round(100 * s)}") for s in shares))
    return ranked.withColumn("subset", F.explode(F.array_compact(names))).drop("pct")


def binary_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, rates and balance of the sign of ``sps`` against ``label``; a rate without cases is 0.

    ``plot_accuracy`` asks for a product over 0, so that a score of 0 is always wrong there."""
    label, hit = F.col("label") > 0, (F.col("sps") > 0) == (F.col("label") > 0)
    rate = lambda cond: F.coalesce(F.avg(F.when(cond, hit.cast("double"))), F.lit(0.0))
    r = lambda c: F.round(c, 6)
    return df.filter("label <> 0 AND sps IS NOT NULL").groupBy(*keys).agg(
        F.count("*").alias("n"), r(F.avg(hit.cast("double"))).alias("accuracy"), r(rate(label)).alias("tpr"), r(rate(~label)).alias("tnr"),
        r((rate(label) + rate(~label)) / 2).alias("balanced"), r(F.avg((F.col("sps") * F.col("label") > 0).cast("double"))).alias("plot_accuracy"),
    )


def auroc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney by average ranks; null without both classes. Values are counted before ranking."""
    d = df.filter("label <> 0 AND sps IS NOT NULL")
    by = value_counts(d, keys, "sps").withColumn("rank", F.col("below") + (F.col("ties") + 1) / 2).select(*keys, "sps", "rank")
    pos = d.groupBy(*keys, "sps").agg(F.count_if(F.col("label") > 0).cast("double").alias("p"), F.count_if(F.col("label") < 0).cast("double").alias("q"))
    s = pos.join(by, [*keys, "sps"]).groupBy(*keys).agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return s.select(*keys, F.round(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")), 6).alias("auroc"))


def _corr(x: Column, y: Column) -> Column:
    ok = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    top = n * F.sum(x * y) - sx * sy
    return F.when(ok, F.try_divide(top, F.sqrt((n * F.sum(x * x) - sx * sx) * (n * F.sum(y * y) - sy * sy))))


def continuous_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson, Spearman, RMSE, MAE and R2 of ``sps`` against ``y``; null where undefined."""
    d = df.filter("sps IS NOT NULL AND y IS NOT NULL")
    a = with_ranks(d.select(*keys, "sps", "y"), keys, "sps").withColumnRenamed("avg_rank", "ra").drop("pct_rank", "centred_pct")
    b = with_ranks(a, keys, "y").withColumnRenamed("avg_rank", "rb")
    e = F.col("sps") - F.col("y")
    total = F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / F.count("*")
    r = lambda c: F.round(c, 6)
    return b.groupBy(*keys).agg(
        F.count("*").alias("n"), r(_corr(F.col("sps"), F.col("y"))).alias("pearson"), r(_corr(F.col("ra"), F.col("rb"))).alias("spearman"),
        r(F.sqrt(F.avg(e * e))).alias("rmse"), r(F.avg(F.abs(e))).alias("mae"),
        r(F.when((F.count("*") >= 2) & (total > 1e-9), 1 - F.sum(e * e) / F.when(total > 1e-9, total))).alias("r2"),
    )


def species_means(prediction: DataFrame, keys: list[str]) -> DataFrame:
    """One row per species: mean score and its label."""
    return prediction.groupBy(*keys, "species").agg(F.round(F.avg("sps"), 9).alias("sps"), F.min("label").alias("label"))


def per_species(prediction: DataFrame, keys: list[str]) -> DataFrame:
    q = F.percentile("sps", F.array(F.lit(0.25), F.lit(0.75)))
    e = F.col("sps") - F.col("label")
    r = lambda c: F.round(c, 6)
    return prediction.groupBy(*keys, "species").agg(
        F.count("*").alias("n"), r(F.avg("sps")).alias("mean"), r(q[0]).alias("q25"), r(q[1]).alias("q75"), r(q[1] - q[0]).alias("iqr"),
        r(F.avg(((F.col("sps") > 0) == (F.col("label") > 0)).cast("double"))).alias("sign_match"), r(F.avg(e)).alias("bias"),
        r(F.avg(F.abs(e))).alias("mae"), r(F.sqrt(F.avg(e * e))).alias("rmse"),
    )


def robust_scale(df: DataFrame, keys: list[str], column: str, floor: float = 1e-9) -> DataFrame:
    """``(keys, median, mad, scale)``: the larger of 1.4826 MAD, (p90 - p10) / 2.563 and ``floor``."""
    q = F.percentile(column, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    base = df.groupBy(*keys).agg(q.alias("q"))
    mad = df.join(base, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(column) - F.col("q")[1]), 0.5).alias("mad"))
    scale = F.greatest(1.4826 * F.col("mad"), (F.col("q")[2] - F.col("q")[0]) / 2.563, F.lit(floor))
    return base.join(mad, keys).select(*keys, F.round(F.col("q")[1], 6).alias("median"), F.round("mad", 6).alias("mad"), F.round(scale, 6).alias("scale"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``(bin, n)`` of an integer column, empty bins between the ends included."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    bins = ends.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("bin"))
    found = df.groupBy(F.col(column).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_log(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """``(bin, n)`` of a positive column over equal steps of its decimal logarithm."""
    d = df.filter(F.col(column) > 0)
    ends = d.agg(F.log10(F.min(column)).alias("a"), F.log10(F.max(column)).alias("b"))
    at = F.floor((F.log10(column) - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) * bins + 1e-9)
    return d.crossJoin(F.broadcast(ends)).select(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))  # one row


def histogram_auto(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``(keys, is_log, bins, bin, n)`` of a real column, without empty bins.

    Positive values over two decades or more have bins at equal ratios, 15 edges a decade and 20 to 60 in all. Others
    have equal bins as wide as the less of Sturges' width and, unless it is 0, that of Freedman and Diaconis. One
    aggregate gives the range and count, counted values give the quartiles; a last pass counts."""
    v = F.col(column)
    shape = df.groupBy(*keys).agg(F.count(column).alias("k"), F.min(column).alias("a"), F.max(column).alias("b"))
    q = quantiles(df, keys, column, [0.25, 0.75])
    shape = shape.join(q, keys, "left") if keys else shape.join(q, how="left")
    decades = F.when(F.col("a") > 0, F.log10("b") - F.log10("a")).otherwise(0.0)
    spread = F.col("b") - F.col("a")
    sturges, fd = spread / (F.log2(F.col("k").cast("double")) + 1), 2 * (F.col("q")[1] - F.col("q")[0]) / F.pow(F.col("k").cast("double"), F.lit(1 / 3))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    edges = F.least(F.lit(60), F.greatest(F.lit(20), (15 * decades).cast("int")))
    bins = F.when(decades >= 2, edges - 1).when(spread > 0, F.ceil(F.try_divide(spread, width)).cast("int")).otherwise(1)
    shape = shape.select(*keys, "a", "b", (decades >= 2).alias("is_log"), bins.alias("bins"))
    share = F.when(F.col("is_log"), F.try_divide(F.log10(v) - F.log10("a"), F.log10("b") - F.log10("a"))).otherwise(F.try_divide(v - F.col("a"), F.col("b") - F.col("a")))
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("bins") + 1e-9).cast("int"), F.col("bins") - 1)
    joined = df.filter(v.isNotNull()).join(F.broadcast(shape), keys) if keys else df.filter(v.isNotNull()).crossJoin(F.broadcast(shape))  # a row per group
    return joined.select(*keys, "is_log", "bins", at.alias("bin")).groupBy(*keys, "is_log", "bins", "bin").agg(F.count("*").alias("n"))


def density(df: DataFrame, keys: list[str], column: str, low: float, high: float, points: int = 41, bandwidth: float = 0.1) -> DataFrame:
    """``(keys, i, density)``: Gaussian kernel density on a fixed grid, from counts of equal values."""
    step = (high - low) / (points - 1)
    by = df.groupBy(*keys, column).agg(F.count("*").alias("c"))
    total = df.groupBy(*keys).agg(F.count(column).alias("total"))
    grid = by.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.lit(low) + F.col("i") * step - F.col(column)) / bandwidth
    s = grid.groupBy(*keys, "i").agg(F.sum(F.col("c") * F.exp(-0.5 * z * z)).alias("s"))
    scale = bandwidth * 2.5066282746310002
    return s.join(total, keys).select(*keys, "i", F.round(F.col("s") / (F.col("total") * scale), 6).alias("density"))


def benchmark_summary(background: DataFrame, simulated: DataFrame, keys: list[str], k: int = 100) -> DataFrame:
    """Per parameter set: background genes that were not simulated and the simulated ones together,
    the best ``k`` by score (ties by gene), and how many of those were simulated."""
    plain = background.join(simulated.select(*keys, "gene"), [*keys, "gene"], "left_anti").withColumn("sim", F.lit(0))
    both = plain.select(*keys, "gene", "score", "sim").unionByName(simulated.withColumn("sim", F.lit(1)).select(*keys, "gene", "score", "sim"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "gene")))
    return ranked.groupBy(*keys).agg(F.count_if((F.col("r") <= k) & (F.col("sim") == 1)).alias("found"), F.sum("sim").alias("simulated"), F.count("*").alias("genes"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(n, pearson)`` of two result sets on their common keys."""
    j = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    return j.agg(F.count("*").alias("n"), F.round(_corr(F.col("x"), F.col("y")), 6).alias("pearson"))
