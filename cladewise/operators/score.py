"""Scoring fitted models: species scores, input error, gene and site ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.residues import slots_of

RUN = ["combo_idx", "run"]


def score_alignment(coef: DataFrame, aln: DataFrame) -> DataFrame:
    """``(combo_idx, run, species, weight)`` of coefficients whose residue a species has there. A sequence
    meets the coefficients of its gene, so that no row per cell is made."""
    return coef.join(aln, "gene").filter(F.substring("seq", F.col("pos") + 1, F.lit(1)) == F.col("aa")).select(*RUN, "species", "weight")


def exclude_training(hits: DataFrame, training: DataFrame) -> DataFrame:
    return hits.join(training.select("combo_idx", "species").distinct(), ["combo_idx", "species"], "left_anti")


def score_inputs(coef: DataFrame, features: DataFrame, combo: DataFrame) -> DataFrame:
    """``(combo_idx, run, slot, weight)``: coefficients at the slots of their (cancelled) features."""
    slots = features.withColumn("slot", F.explode(slots_of(F.col("mask"), dict(features.dtypes)["mask"].startswith("array"))))
    return coef.hint("merge").join(slots, ["combo_idx", "gene", "pos", "aa"]).select(*RUN, "slot", "weight")


def species_scores(hits: DataFrame, models: DataFrame) -> DataFrame:
    """``(combo_idx, run, species, sps)``; species without a hit have no row."""
    s = hits.groupBy(*RUN, "species").agg(F.sum("weight").alias("s"))
    return s.join(models, RUN).select(*RUN, "species", F.round(F.col("s") + F.col("intercept"), 6).alias("sps"))


def predict_saved(coef: DataFrame, models: DataFrame, aln: DataFrame, training: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, species, sps)`` of models read back, on another alignment: the intercept and the weights of the
    residues that a species has. Species of the models' own designs are left out; species without a hit have no row."""
    hits = coef.join(aln, "gene").filter(F.substring("seq", F.col("pos") + 1, F.lit(1)) == F.col("aa")).select(*keys, "species", "weight")
    s = exclude_training(hits, training).groupBy(*keys, "species").agg(F.sum("weight").alias("s"))
    return s.join(models.select(*keys, "intercept"), keys).select(*keys, "species", (F.col("s") + F.col("intercept")).alias("sps"))


def order_sites(scored: DataFrame, by_score: bool = True) -> DataFrame:
    """``place`` of each site in its gene and design: best score first, or by position alone."""
    w = Window.partitionBy("gene", "combo_idx").orderBy(*([F.desc("score")] if by_score else []), "pos")
    return scored.withColumn("place", F.row_number().over(w))


def order_species(species: DataFrame, pheno: DataFrame, highest_first: bool = True) -> DataFrame:
    """Species by phenotype, those without one as 0, ties by name."""
    known = species.join(pheno.select("species", "value"), "species", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return known.orderBy(F.desc("value") if highest_first else F.asc("value"), "species")


def input_rmse(input_hits: DataFrame, models: DataFrame, combo: DataFrame, untouched: str = "zero") -> DataFrame:
    """``(combo_idx, run, rmse)`` over the training species; those without a hit predict 0, or the
    intercept where saved models are applied (``untouched='intercept'``)."""
    s = input_hits.groupBy(*RUN, "slot").agg(F.sum("weight").alias("s"))
    all_slots = models.join(combo.select("combo_idx", "slot", "y"), "combo_idx")
    base = F.lit(0.0) if untouched == "zero" else F.col("intercept")
    p = all_slots.join(s, [*RUN, "slot"], "left").withColumn("p", F.coalesce(F.col("s") + F.col("intercept"), base))
    return p.groupBy(*RUN).agg(F.round(F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), 2))), 6).alias("rmse"))


def attach_phenotype(prediction: DataFrame, pheno: DataFrame | None, binary: bool = True) -> DataFrame:
    """Species without a phenotype go if there is a table; a binary 0 is blank."""
    if pheno is None:
        return prediction.withColumn("true_phenotype", F.lit(None).cast("double"))
    value = F.nullif(F.col("value"), F.lit(0.0)) if binary else F.col("value")
    return prediction.join(pheno.select("species", value.alias("true_phenotype")), "species")


def gene_scores(coef: DataFrame) -> DataFrame:
    """``(combo_idx, run, gene, gss)`` of genes with a score over 0."""
    return coef.groupBy(*RUN, "gene").agg(F.round(F.sum(F.abs("weight")), 6).alias("gss")).filter("gss > 0")


def num_genes(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*RUN).agg(F.count("*").alias("num_genes"))


def site_scores(coef: DataFrame) -> DataFrame:
    """``(gene, pos, pss)``: a site's largest sum of absolute weights in any run."""
    return coef.groupBy(*RUN, "gene", "pos").agg(F.round(F.sum(F.abs("weight")), 6).alias("pss")).groupBy("gene", "pos").agg(F.max("pss").alias("pss"))


def rank_genes(scores: DataFrame) -> DataFrame:
    """``scores`` with ``rank`` in each run, best first, ties by gene name."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("gss"), "gene")))


def gene_ranks_multi(ranked: DataFrame, genes: DataFrame, top_rank_frac: float = 0.01) -> DataFrame:
    """Per gene over designs: how often ranked at all and near the top, best score and rank ever.

    Genes never ranked stay, with zero counts. The top ends at ``max(1, genes * top_rank_frac)``."""
    best = ranked.groupBy("combo_idx", "gene").agg(F.min("rank").alias("rank"), F.max("gss").alias("gss"))
    n = genes.select("gene").distinct().agg(F.count("*").alias("n_genes"))
    limit = F.greatest(F.lit(1.0), F.col("n_genes") * top_rank_frac)
    flagged = best.crossJoin(F.broadcast(n)).withColumn("top", F.col("rank") <= limit)  # one row
    agg = flagged.groupBy("gene").agg(
        F.count("*").alias("ranked"), F.count_if("top").alias("top"), F.max("gss").alias("highest_ever_gss"), F.min("rank").cast("double").alias("best_ever_rank")
    )
    out = genes.select("gene").distinct().join(agg, "gene", "left")
    return out.select(
        "gene", F.coalesce("ranked", F.lit(0)).alias("num_combos_ranked"), F.coalesce("top", F.lit(0)).alias("num_combos_ranked_top"),
        F.coalesce("highest_ever_gss", F.lit(0.0)).alias("highest_ever_gss"), "best_ever_rank",
    )


def gene_ranks_single(ranked: DataFrame, genes: DataFrame) -> DataFrame:
    agg = ranked.groupBy("gene").agg(F.max("gss").alias("highest_gss"), F.min("rank").cast("double").alias("best_rank"))
    return genes.select("gene").distinct().join(agg, "gene", "left").select("gene", F.coalesce("highest_gss", F.lit(0.0)).alias("highest_gss"), "best_rank")


def order_multi(ranks: DataFrame) -> DataFrame:
    return ranks.orderBy(F.desc("num_combos_ranked"), F.desc("num_combos_ranked_top"), F.asc_nulls_last("best_ever_rank"), F.desc("highest_ever_gss"), "gene")


def order_single(ranks: DataFrame) -> DataFrame:
    return ranks.orderBy(F.asc_nulls_last("best_rank"), F.desc("highest_gss"), "gene")


def selected_sites(site_pss: DataFrame) -> DataFrame:
    """The site report: positions from 1."""
    return site_pss.select(F.col("gene").alias("gene_name"), (F.col("pos") + 1).alias("position"), "pss")


def sites_with_length(ranks: DataFrame, sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(gene, n_sites, length)``: the alignment's length, else the last selected position, else 1."""
    per = sites.groupBy("gene").agg(F.count("*").alias("n_sites"), F.max("pos").alias("last"))
    return ranks.select("gene").join(per, "gene", "left").join(lengths.select("gene", "n"), "gene", "left").select(
        "gene", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.coalesce("n", "last", F.lit(1)).alias("length")
    )
