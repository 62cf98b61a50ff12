"""Checks of inputs, as queries that return what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_species(combo: DataFrame, aln: DataFrame) -> DataFrame:
    """``(species)`` of designs that no alignment has."""
    return combo.select("species").distinct().join(aln.select("species"), "species", "left_anti")


def phenotype_kind(pheno: DataFrame, keys: list[str], tol: float = 1e-12) -> DataFrame:
    """``(keys, is_binary)``: all values are -1, 0 or 1; a malformed one makes it continuous."""
    v = F.expr("try_cast(value AS double)")
    ok = F.coalesce((F.abs(v + 1) <= tol) | (F.abs(v) <= tol) | (F.abs(v - 1) <= tol), F.lit(False))
    return pheno.groupBy(*keys).agg(F.bool_and(ok).alias("is_binary"))


_PHENO = r"^\s*[^,]+,\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def bad_pheno_lines(lines: DataFrame, keys: list[str], max_errors: int = 5) -> DataFrame:
    """``(keys, line_no, line)``: each file's first lines that are no ``name,number``; a header may
    stand in line 1. The limit is the report's."""
    bad = lines.filter((F.trim("line") != "") & ~F.col("line").rlike(_PHENO) & ~((F.col("line_no") == 1) & F.lower("line").startswith("species")))
    first = bad.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("line_no", "line"))), 1, max_errors).alias("x"))
    return first.select(*keys, F.explode("x").alias("x")).select(*keys, "x.line_no", "x.line")


def looks_like_pheno(lines: DataFrame, keys: list[str], sample: int = 20, threshold: float = 0.8) -> DataFrame:
    """``(keys, flag)``: at least a share of a file's first non-empty lines are ``name,1`` or ``name,-1``."""
    full = lines.filter(F.trim("line") != "").groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("line_no", "line"))), 1, sample).alias("x"))
    hits = F.size(F.filter("x", lambda r: r["line"].rlike(r"^\s*[^,]+,\s*[+-]?1(\.0*)?\s*$")))
    return full.select(*keys, (hits >= F.lit(threshold) * F.size("x")).alias("flag"))


def pheno_overlap(pheno: DataFrame, combo: DataFrame) -> DataFrame:
    """``(raw_n, stripped_n)``: designs' species in the phenotypes as written, and without quotes."""
    names = combo.select("species").distinct()
    strip = F.regexp_replace(F.trim("species"), "[\"']", "")
    raw = names.join(pheno.select("species").distinct(), "species", "left_semi").agg(F.count("*").alias("raw_n"))
    bare = names.select(strip.alias("species")).distinct().join(pheno.select(strip.alias("species")).distinct(), "species", "left_semi").agg(F.count("*").alias("stripped_n"))
    return raw.crossJoin(bare)  # one row each


def fully_gapped(sites: DataFrame) -> DataFrame:
    """``(combo_idx)`` of designs whose sites are all gaps."""
    some = F.exists("res", lambda x: x != "-")
    return sites.groupBy("combo_idx").agg(F.bool_or(some).alias("some")).filter("NOT some").select("combo_idx")


def validate_tree(nodes: DataFrame, species: DataFrame) -> DataFrame:
    """``(tree_id, root_children, missing)``: children of the root (2 for a split) and species that the
    tree lacks."""
    root = nodes.filter("parent_id IS NULL").select("tree_id", F.col("node_id").alias("parent_id"))
    kids = nodes.join(root, ["tree_id", "parent_id"]).groupBy("tree_id").agg(F.count("*").alias("root_children"))
    lost = species.select("tree_id", "node_id").distinct().join(nodes, ["tree_id", "node_id"], "left_anti").groupBy("tree_id").agg(F.count("*").alias("missing"))
    return kids.join(lost, "tree_id", "left").select("tree_id", "root_children", F.coalesce("missing", F.lit(0)).alias("missing"))


def check_options(design_sources: int, lambda_bounds: tuple[float, ...], points: int = 20, step: float = 0.05, maxiter: int = 100, min_pairs: int = 2, repeats: int = 10) -> None:
    """Raises on settings that no run can have."""
    if design_sources != 1:
        raise ValueError("exactly one source of designs is needed")
    if min(lambda_bounds) <= 0 or step <= 0 or points < 2 or min(maxiter, min_pairs, repeats) < 1:
        raise ValueError("bounds and steps must be positive, counts at least 1, log grids of 2 points")
