"""Contrast designs: combinations of species, responses, null designs and parameter grids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import blocks as B
from .sites import in_blocks

#: Ranks that one row is exploded into at a step; pairs of a design whose subsets a long can number.
RANKS_IN_ROW, MOST_PAIRS = 1 << 16, 62


def dealt_ranks(rows: DataFrame, total: Column, name: str, first: int = 0, count: int | None = None) -> DataFrame:
    """``rows`` once for each rank below ``total``, or of those from ``first`` on at most ``count``, in the column ``name``.

    Ranks are dealt in blocks, and blocks over the tasks, so that neither one row nor one task holds all of a row's."""
    end = total.cast("long") if count is None else F.least(total.cast("long"), F.lit(first + count).cast("long"))
    of = lambda low, high, step: F.when(low < high, F.sequence(low, high - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out, low, kept = rows.withColumn("__end", end), F.lit(first).cast("long"), list(rows.columns)
    for step in (RANKS_IN_ROW**2, RANKS_IN_ROW):
        out = out.withColumn("__low", F.explode(of(low, F.col("__end"), step)))
        out = out.withColumn("__end", F.least(F.col("__end"), F.col("__low") + step))
        low = F.col("__low")
    return out.repartition("__low", *kept).withColumn(name, F.explode(of(low, F.col("__end"), 1))).select(*kept, name)


def expand_combos(groups: DataFrame, first: int = 0, count: int | None = None) -> DataFrame:
    """``groups(design, line_no, members)`` -> ``(design, combo_idx, slot, pair, role, species)``.

    All ways to take one member of each line, the last line fastest, in mixed radix: combination
    ``i`` takes member ``i div (product of the later lines' sizes) mod own size``. No line meets another in a join, and
    no row holds the product; ``first`` and ``count`` pick a range of it. More combinations than a long counts are an error."""
    lines = groups.groupBy("design").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "members"))), lambda x: x["members"]).alias("lines"))
    sizes = F.transform("lines", lambda m: F.size(m).cast("long"))
    later = lambda i: F.aggregate(F.slice(F.col("sizes"), i + 2, F.size("sizes")), F.lit(1).cast("long"), lambda a, x: a * x)
    roughly = F.aggregate("sizes", F.lit(0.0), lambda a, x: a + F.log2(x.cast("double")))
    exact = F.aggregate("sizes", F.lit(1).cast("long"), lambda a, x: a * x)
    total = F.when(roughly > 62, F.raise_error(F.lit("too many combinations of a design")).cast("long")).otherwise(exact)
    picked = F.transform("lines", lambda m, i: F.get(m, (F.call_function("div", F.col("combo_idx"), later(i)) % F.size(m)).cast("int")))
    return (
        dealt_ranks(lines.withColumn("sizes", sizes), total, "combo_idx", first, count)
        .select("design", "combo_idx", F.posexplode(picked).alias("slot", "species"))
        .withColumn("pair", F.floor(F.col("slot") / 2).cast("int"))
        .withColumn("role", F.when(F.col("slot") % 2 == 0, "convergent").otherwise("control"))
    )


def two_pair_combos(pairs: DataFrame) -> DataFrame:
    """``pairs(design, pair, conv, ctrl)`` -> ``(design, i, j, c0, c1, c2, c3)`` of each i < j."""
    a, b = pairs.alias("a"), pairs.alias("b")
    return a.join(b, (F.col("a.design") == F.col("b.design")) & (F.col("a.pair") < F.col("b.pair"))).select(
        "a.design", F.col("a.pair").alias("i"), F.col("b.pair").alias("j"),
        F.col("a.conv").alias("c0"), F.col("a.ctrl").alias("c1"), F.col("b.conv").alias("c2"), F.col("b.ctrl").alias("c3"),
    )


def assign_response(combo: DataFrame, pheno: DataFrame | None = None) -> DataFrame:
    """``combo`` with ``y``: +1 and -1 by slot, or the species' phenotype, which must exist."""
    if pheno is None:
        return combo.withColumn("y", F.when(F.col("slot") % 2 == 0, 1.0).otherwise(-1.0))
    found = combo.join(pheno.select("species", F.col("value").alias("y")), "species", "left")
    missing = F.concat(F.lit("no phenotype for "), F.coalesce("species", F.lit("a null species")))
    return found.withColumn("y", F.when(F.col("y").isNull(), F.raise_error(missing).cast("double")).otherwise(F.col("y")))


def combo_tag(combo: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, combo_tag)``: the label for over 12 species, else three letters of each, or of each
    one's second part if the first species has an underscore."""
    ordered = F.array_sort(F.collect_list(F.struct("slot", "species")))
    g = combo.groupBy(*keys).agg(F.transform(ordered, lambda x: x["species"]).alias("s"))
    parted = F.contains(F.element_at("s", 1), F.lit("_"))
    second = lambda x: F.coalesce(F.get(F.split(x, "_"), F.lit(1)), x)
    short = F.array_join(F.transform("s", lambda x: F.substring(F.when(parted, second(x)).otherwise(x), 1, 3)), ".")
    label = F.concat(F.lit("combo_"), F.col("combo_idx").cast("string"))
    return g.select(*keys, F.when(F.size("s") > 12, label).otherwise(short).alias("combo_tag"))


def _binomials() -> Column:
    return F.array(*(F.array(*(F.lit(math.comb(c, j)).cast("long") for j in range(MOST_PAIRS // 2 + 1))) for c in range(MOST_PAIRS)))


def subset_of_rank(rank: Column, n: Column, k: Column) -> Column:
    """The ``rank``-th subset of ``k`` of ``n`` things as a mask, masks in their order as numbers: from the last
    thing down, one is in if as many subsets as lie below all those with it are not more than what is left of the rank."""
    choose = lambda c, j: F.get(F.get(_binomials(), c), j)
    zero = F.struct(rank.cast("long").alias("r"), k.cast("int").alias("j"), F.lit(0).cast("long").alias("mask"))

    def step(a: Column, c: Column) -> Column:
        below = choose(c, a["j"])
        takes = (a["j"] > 0) & (a["r"] >= below)
        return F.struct(
            F.when(takes, a["r"] - below).otherwise(a["r"]).alias("r"), F.when(takes, a["j"] - 1).otherwise(a["j"]).alias("j"),
            F.when(takes, a["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c))).otherwise(a["mask"]).alias("mask"),
        )

    return F.aggregate(F.sequence(n.cast("int") - 1, F.lit(0), F.lit(-1)), zero, step, lambda a: a["mask"])


def flip_mask(rank: Column, n: Column, even: Column) -> Column:
    """The ``rank``-th half of ``n`` pairs as a mask: those with pair 0 for an ``even`` design, those without for others."""
    rest = subset_of_rank(rank, n - 1, (n / 2).cast("int") - even.cast("int"))
    return F.call_function("shiftleft", rest, F.lit(1)) + even.cast("long")


def null_flips(combo: DataFrame, keys: list[str], first: int = 0, count: int | None = None) -> DataFrame:
    """Designs with half of their pairs swapped: ``(keys, flip, slot, species)``, ``flip`` from 0.

    Of each choice and its mirror image one remains: those with pair 0 swapped for even designs,
    those without for odd ones. Designs with an odd number of pairs have none. A flip is made from its rank, so
    ``first`` and ``count`` pick a range of them; more than ``MOST_PAIRS`` pairs are an error."""
    ordered = F.array_sort(F.collect_list(F.struct("slot", "species")))
    g = combo.groupBy(*keys).agg(F.transform(ordered, lambda x: x["species"]).alias("s"))
    g = g.withColumn("n", (F.size("s") / 2).cast("int")).filter((F.col("n") % 2 == 0) & (F.size("s") % 2 == 0) & (F.col("n") > 0))
    halves = F.get(F.get(_binomials(), F.col("n") - 1), (F.col("n") / 2).cast("int"))
    total = F.when(F.col("n") > MOST_PAIRS, F.raise_error(F.lit(f"more than {MOST_PAIRS} pairs in a design")).cast("long")).otherwise(halves)
    ranked = dealt_ranks(g, total, "flip", first, count).withColumn("m", flip_mask(F.col("flip"), F.col("n"), F.col("combo_idx") % 2 == 0))
    bit = lambda i: F.call_function("shiftright", F.col("m"), F.floor(i / 2).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    swapped = F.transform("s", lambda x, i: F.when(bit(i) == 1, F.get("s", i + 1 - 2 * (i % 2))).otherwise(x))
    return ranked.select(*keys, "flip", F.posexplode(swapped).alias("slot", "species"))


def arithmetic_hash(*parts: Column) -> Column:
    """A reproducible number in 0..999982 from integers, the same in any SQL engine."""
    out = F.lit(17).cast("long")
    for p in parts:
        out = (out * 1009 + p.cast("long")) % 999983
    return out


def pair_randomize(sites: DataFrame, number: Column, repeats: int = 10, seed: int = 0) -> DataFrame:
    """``sites`` with ``rep``: in each repeat, each pair of each site swaps its residues at even odds.

    ``number`` is an integer that stands for the gene; a hash of it decides, so that a lost task is
    repeated with the same outcome."""
    reps = sites.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    coin = lambda i: arithmetic_hash(F.lit(seed), F.col("rep"), number, F.col("pos"), F.floor(i / 2)) % 2
    return reps.withColumn("res", F.transform("res", lambda x, i: F.when(coin(i) == 1, F.get("res", i + 1 - 2 * (i % 2))).otherwise(x)))


def _coins(seed: int, rep: int, number: np.ndarray, pos: np.ndarray, pair: int) -> np.ndarray:
    """:func:`arithmetic_hash` of whole arrays, modulo 2."""
    out = np.full(len(pos), 17, np.int64)
    for p in (seed, rep, number, pos, pair):
        out = np.fmod(out * 1009 + p, 999983)
    return np.fmod(out, 2) == 1


def randomized_sequences(filled: DataFrame, number: Column, repeats: int = 10, seed: int = 0) -> DataFrame:
    """``(gene, combo_idx, rep, slot, seq)``: whole sequences after :func:`pair_randomize`; a gene's row stays where it is."""
    def rule(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        numbers = batch.column("number").to_numpy(zero_copy_only=False)
        by_slots: dict[int, list[B.Block]] = {}
        for b in B.blocks(batch):
            by_slots.setdefault(len(b.res), []).append(b)
        for k, parts in by_slots.items():
            rows, at = np.unique(np.concatenate([b.row for b in parts]), return_inverse=True)
            for rep in range(repeats):
                for pair in range(-(-k // 2)):
                    coins = [_coins(seed, rep, numbers[b.row], b.pos, pair) for b in parts]
                    for slot in range(2 * pair, min(2 * pair + 2, k)):
                        other = [b.res[slot ^ 1] if slot ^ 1 < k else np.full(len(b.pos), b.empty, b.res.dtype) for b in parts]
                        res = np.concatenate([np.where(c, x, b.res[slot]) for c, x, b in zip(coins, other, parts, strict=True)])
                        same = np.full(len(rows), rep, np.int32), np.full(len(rows), slot, np.int32)
                        yield rows, {"rep": pa.array(same[0]), "slot": pa.array(same[1]), "seq": B.texts(at, res, len(rows))}

    return in_blocks(filled.withColumn("number", number), "rep int, slot int, seq string", rule, "seqs", "number")


def grid_linear(bounds: DataFrame, step: float = 0.05) -> DataFrame:
    """``bounds(key, low1, high1, low2, high2)`` -> ``(key, lambda1, lambda2)``, both ends included."""
    def axis(low: str, high: str) -> Column:
        n = F.floor((F.col(high) - F.col(low) + 1e-12) / step + 1e-9)
        return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0).cast("long"))), lambda i: F.round(F.col(low) + i * step, 3))

    one = bounds.withColumn("lambda1", F.explode(axis("low1", "high1")))
    return one.withColumn("lambda2", F.explode(axis("low2", "high2"))).select("key", "lambda1", "lambda2")


def grid_log(bounds: DataFrame, points: int = 20) -> DataFrame:
    """As :func:`grid_linear`, ``points`` values on each axis at equal ratios, rounded to the size of
    the smallest first one and five more digits."""
    def axis(low: str, high: str) -> Column:
        a, b = F.log10(low), F.log10(high)
        digits = F.abs(F.log10("low1")).cast("int") + 5
        scale = F.pow(F.lit(10.0), digits)
        value = lambda i: F.pow(F.lit(10.0), a + i * (b - a) / (points - 1))
        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.round(value(i) * scale) / scale)

    one = bounds.withColumn("lambda1", F.explode(axis("low1", "high1")))
    return one.withColumn("lambda2", F.explode(axis("low2", "high2"))).select("key", "lambda1", "lambda2")


def penalties(groups: DataFrame, kind: str = "median", first: float = 1, last: float = 1, step: float = 6) -> DataFrame:
    """``(combo_idx, penalty)``: the floored median of variable sites, or a range of values."""
    if kind == "median":
        return groups.filter("var_sites > 0").groupBy("combo_idx").agg(F.floor(F.percentile("var_sites", 0.5)).cast("double").alias("penalty"))
    n = int((last - first) / step + 1e-9)
    return groups.select("combo_idx").distinct().select("combo_idx", F.explode(F.array(*(F.lit(round(first + i * step, 6)) for i in range(n + 1)))).alias("penalty"))


def design_grid(genes: DataFrame, number: Column, replicates: int, k: int, n_sites: list[int], scales: list[float], seed: int = 0) -> DataFrame:
    """``(rep, gene, sites, scale)``: per replicate ``k`` genes drawn by hash, with each setting."""
    h = arithmetic_hash(F.lit(seed), F.col("rep"), number)
    drawn = genes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("h", h)
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("h", "gene"))).filter(F.col("r") <= k)
    return (
        ranked.withColumn("sites", F.explode(F.array(*map(F.lit, n_sites)))).withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
        .select("rep", "gene", "sites", "scale")
    )
