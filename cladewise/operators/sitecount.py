"""The site counter: convergent, control-convergent and high-score sites per gene and design."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import blocks as B
from ..functions import residues as R
from ..sources.tables import checkpointed
from .sites import explode_sites, fill_species, gene_table, in_blocks, intact_pairs, with_designs
from .tree import ancestral_masks, ancestral_states, skip_reasons, state_bits


def pair_sites(aln: DataFrame, combo: DataFrame, outgroup: str) -> DataFrame:
    """``(gene, combo_idx, pos, k, conv, ctrl, out)``: masked residues of the pairs whose two species
    are both in the gene; ``k`` is their number. Designs with fewer than two such pairs are left out."""
    return _masked_pairs(fill_species(aln, combo, outgroup))


def _paired(filled: DataFrame) -> DataFrame:
    """``filled`` with the sequences of the ``k`` pairs that the gene has, two at least."""
    filled = filled.withColumn("k", intact_pairs(F.col("missing"))).filter("k >= 2")
    missing = F.col("missing")
    lone = lambda i: F.get(missing, i - i % 2) | F.get(missing, i - i % 2 + 1)
    kept = filled.withColumn("seqs", F.filter("seqs", lambda s, i: ~lone(i)))
    return kept.withColumn("out", F.coalesce("out", F.repeat(F.lit("?"), F.col("n"))))


def _masked_pairs(filled: DataFrame, *more: str) -> DataFrame:
    sites = explode_sites(_paired(filled), *more)
    conv, ctrl = R.side(F.col("res"), 0), R.side(F.col("res"), 1)
    return sites.select(
        "gene", "combo_idx", "pos", (F.size("res") / 2).cast("int").alias("k"),
        R.masked(conv, F.col("res")).alias("conv"), R.masked(ctrl, F.col("res")).alias("ctrl"), "out", *more,
    )


def paired_genes(aln: DataFrame, combo: DataFrame, outgroup: str) -> DataFrame:
    """Genes with the sequences of the pairs that they have, for each design; see :func:`pair_sites`."""
    return _paired(fill_species(aln, combo, outgroup))


def ancestral_genes(aln: DataFrame, combo: DataFrame, program: DataFrame, outgroup: str | None = None) -> DataFrame:
    """As :func:`paired_genes`, with ``sets``: by position, as bits, what the ancestor may have; see :func:`ancestral_pair_sites`."""
    analysis = sorted(r["species"] for r in combo.select("species").distinct().collect())  # species of the designs
    told = ancestral_masks(gene_table(aln), program, analysis).filter("skip_reason IS NULL")
    return _paired(with_designs(told, combo, outgroup, "sets"))


def ancestral_pair_sites(aln: DataFrame, combo: DataFrame, program: DataFrame, outgroup: str | None = None) -> DataFrame:
    """As :func:`pair_sites`, with ``states``: what the ancestor of all designs' species may have at a site, by
    parsimony over the species tree ``program`` (see :func:`tree_program`). Genes without such an ancestor have no rows
    here; :func:`skipped_genes` has them."""
    analysis = sorted(r["species"] for r in combo.select("species").distinct().collect())  # species of the designs
    told = ancestral_states(gene_table(aln), program, analysis).filter("skip_reason IS NULL").select("gene", "states")
    filled = fill_species(aln, combo, outgroup).join(told, "gene")
    return _masked_pairs(filled, "states")


def _flagged(batch: pa.RecordBatch, min_agreement: float, unambiguous: bool) -> Iterator[tuple[B.Block, np.ndarray, np.ndarray, np.ndarray]]:
    """By block, ``is_ccs``, ``ctrl_conv`` and ``score`` of its sites; see :func:`flag_sites`."""
    if "sets" in batch.schema.names:
        start, sets = B.slots_by_row(batch.column("sets"))
        sets = np.append(sets.to_numpy(zero_copy_only=False), 0)
    bits = state_bits()
    for b in B.blocks(batch):
        if "sets" in batch.schema.names:
            anc = sets[start[b.row] + b.pos]
            anc = np.where(anc & (anc - 1) != 0, 0, anc) if unambiguous else anc
            known, old = anc != 0, lambda kind, b=b, anc=anc: anc & bits.get(b.residue(kind), 0) != 0
        else:
            known = ~np.isin(b.out, b.named(*R.MISSING))
            old = lambda kind, b=b, known=known: known & (b.out == kind)
        s = B.sides(b, old)
        least = max(0.0, min(1.0, min_agreement))
        is_ccs = known & (s.size[1] > 0) & (s.old[1] >= least * s.size[1] - 1e-12) & s.shared[0]
        ctrl_conv = known & (s.size[0] > 0) & (s.old[0] == s.size[0]) & s.shared[1]
        yield b, is_ccs, ctrl_conv, s.score


def _read(paired: DataFrame) -> list[str]:
    return ["k", "seqs", "out", *(["sets"] if "sets" in paired.columns else [])]


def gene_flags(paired: DataFrame, min_agreement: float = 1.0, unambiguous: bool = False) -> DataFrame:
    """:func:`flag_sites` of whole sequences."""
    def rule(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        for b, is_ccs, ctrl_conv, score in _flagged(batch, min_agreement, unambiguous):
            k = batch.column("k").take(pa.array(b.row))
            yield b.row, {"pos": pa.array(b.pos.astype(np.int32)), "k": k, "is_ccs": pa.array(is_ccs), "ctrl_conv": pa.array(ctrl_conv), "score": pa.array(score.astype(np.int32))}

    return in_blocks(paired, "pos int, k int, is_ccs boolean, ctrl_conv boolean, score int", rule, *_read(paired))


def gene_counts(paired: DataFrame, min_agreement: float = 1.0, unambiguous: bool = False) -> DataFrame:
    """:func:`site_counts` of whole sequences, within a gene's row."""
    def rule(batch: pa.RecordBatch) -> Iterator[tuple[None, dict[str, pa.Array]]]:
        found = {c: np.zeros(batch.num_rows, np.int64) for c in ("true_n", "ctrl_n", "cs_n")}
        for b, is_ccs, ctrl_conv, score in _flagged(batch, min_agreement, unambiguous):
            for c, on in (("true_n", is_ccs), ("ctrl_n", ctrl_conv), ("cs_n", score >= 4)):
                found[c] += np.bincount(b.row[on], minlength=batch.num_rows)
        yield None, {"k": batch.column("k")} | {c: pa.array(x) for c, x in found.items()}

    return in_blocks(paired, "k int, true_n bigint, ctrl_n bigint, cs_n bigint", rule, *_read(paired))


def skipped_genes(aln: DataFrame, combo: DataFrame, program: DataFrame) -> DataFrame:
    """``(gene, skip_reason)`` of genes that :func:`ancestral_pair_sites` leaves out; a report has zero counts for them."""
    analysis = sorted(r["species"] for r in combo.select("species").distinct().collect())  # species of the designs
    return skip_reasons(gene_table(aln), program, analysis).filter("skip_reason IS NOT NULL")


def with_skipped(report: DataFrame, skipped: DataFrame) -> DataFrame:
    """A report by gene of :func:`gene_site_counts` with the skipped genes' zero rows and reasons."""
    zero = [F.lit(0).cast(t).alias(c) for c, t in report.dtypes if c != "gene"]
    told = report.withColumn("skip_reason", F.lit(None).cast("string"))
    return told.unionByName(skipped.select("gene", *zero, "skip_reason"))


def flag_sites(sites: DataFrame, min_agreement: float = 1.0, states: str | None = None, unambiguous: bool = False) -> DataFrame:
    """``sites`` with ``is_ccs``, ``ctrl_conv`` and ``score``."""
    anc = R.ancestral_set(F.col("out"), F.col(states) if states else None, unambiguous)
    s = sites.withColumn("anc", anc)
    conv, ctrl = F.col("conv"), F.col("ctrl")
    return s.select(
        "gene", "combo_idx", "pos", "k", R.is_ccs(conv, ctrl, F.col("anc"), min_agreement).alias("is_ccs"),
        R.is_control_convergence(conv, ctrl, F.col("anc")).alias("ctrl_conv"), R.cs_score(conv, ctrl).alias("score"),
    )


def site_counts(flags: DataFrame) -> DataFrame:
    """``(gene, combo_idx, k, true_n, ctrl_n, cs_n)``; all designs with two pairs are eligible."""
    return flags.groupBy("gene", "combo_idx").agg(
        F.max("k").alias("k"), F.count_if("is_ccs").alias("true_n"), F.count_if("ctrl_conv").alias("ctrl_n"),
        F.count_if(F.col("score") >= 4).alias("cs_n"),
    )


def gene_site_counts(counts: DataFrame) -> DataFrame:
    """Averages over designs, and the best high-score count with its number of pairs (first design wins)."""
    best = F.struct("cs_n", -F.col("combo_idx"))
    return counts.groupBy("gene").agg(
        F.round(F.avg("true_n"), 6).alias("avg_true"), F.round(F.avg("ctrl_n"), 6).alias("avg_control"),
        F.round(F.avg("true_n") - F.avg("ctrl_n"), 6).alias("diff"), F.max("cs_n").alias("cs_sites_ge_4"),
        F.when(F.max("cs_n") == 0, 0).otherwise(F.max_by("k", best)).alias("k_pairs"),
    )


def combo_lists(counts: DataFrame, n_combos: int) -> DataFrame:
    """``(gene, per_combo_true, per_combo_diff)``: arrays by design, null where it was not eligible."""
    by = lambda c: F.map_from_entries(F.collect_list(F.struct("combo_idx", c.cast("double").alias("v"))))
    g = counts.groupBy("gene").agg(by(F.col("true_n")).alias("t"), by(F.col("true_n") - F.col("ctrl_n")).alias("d"))
    spread = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n_combos - 1)), lambda i: F.try_element_at(m, i))
    return g.select("gene", spread(F.col("t")).alias("per_combo_true"), spread(F.col("d")).alias("per_combo_diff"))


def top_fraction(counts: DataFrame, metric: str, frac: float = 0.01) -> DataFrame:
    """``(gene, n_top)``: in how many designs the gene is in the top fraction, ties at its edge included.

    ``metric`` is ``true``, ``diff`` or ``ratio`` (true over control plus one). A design's genes are
    counted and ranked by value first, so that its window holds distinct values only. Values are written once, as they are
    read for both."""
    value = {
        "true": F.col("true_n").cast("double"), "diff": (F.col("true_n") - F.col("ctrl_n")).cast("double"),
        "ratio": F.col("true_n") / (F.greatest(F.col("ctrl_n"), F.lit(0)) + 1),
    }[metric]
    v = checkpointed(counts.select("gene", "combo_idx", value.alias("v")))
    per_value = v.groupBy("combo_idx", "v").agg(F.count("*").alias("n"))
    above = Window.partitionBy("combo_idx").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("combo_idx")
    best = F.greatest(F.lit(1), F.floor(F.sum("n").over(whole) * F.lit(frac)))
    ranked = per_value.withColumn("top", F.coalesce(F.sum("n").over(above), F.lit(0)) + 1 <= best)
    return v.join(ranked.select("combo_idx", "v", "top"), ["combo_idx", "v"]).groupBy("gene").agg(F.count_if("top").alias("n_top"))


def viewer_flags(paired: DataFrame) -> DataFrame:
    """``(gene, combo_idx, pos, score, is_ccs, ctrl_conv)`` by the viewer's rule: controls unanimous and like a known
    outgroup; X is a residue."""
    def rule(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        for b in B.blocks(batch):
            s = B.sides(b, lambda kind, b=b: b.out == kind, (R.UNKNOWN, R.GAP))
            known = ~np.isin(b.out, b.named(R.UNKNOWN, R.GAP))
            one = [known & (s.kinds[i] == 1) & (s.old[i] > 0) for i in (0, 1)]
            yield b.row, {
                "pos": pa.array(b.pos.astype(np.int32)), "score": pa.array(s.score.astype(np.int32)),
                "is_ccs": pa.array(one[1] & s.shared[0]), "ctrl_conv": pa.array(one[0] & s.shared[1]),
            }

    return in_blocks(paired, "pos int, score int, is_ccs boolean, ctrl_conv boolean", rule, "seqs", "out")


def filter_sites(scored: DataFrame, threshold: int = 2, only_ccs: bool = False, hide_ctrl: bool = True, selected: DataFrame | None = None) -> DataFrame:
    out = scored.filter(F.col("score") >= threshold)
    if only_ccs:
        out = out.filter("is_ccs")
    if hide_ctrl:
        out = out.filter("NOT ctrl_conv")
    return out if selected is None else out.join(selected.select("gene", "pos").distinct(), ["gene", "pos"], "left_semi")


def default_threshold(scored: DataFrame, target: int = 10) -> DataFrame:
    """``(gene, combo_idx, threshold)``: the score of the target-th best site, of the last if there are fewer.

    Scores are few, so sites are counted by score before they are ranked."""
    by = scored.groupBy("gene", "combo_idx", "score").agg(F.count("*").alias("n"))
    above = Window.partitionBy("gene", "combo_idx").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return by.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).filter(F.col("above") < target).groupBy("gene", "combo_idx").agg(F.min("score").alias("threshold"))


def strict_ccs(aln: DataFrame, combo: DataFrame, outgroup: str) -> DataFrame:
    """``(gene, combo_idx, n_sites, true_n, ctrl_n)``: genes with all species and the outgroup, sites
    without gaps; one side is all like the outgroup, two of the other share another residue."""
    filled = fill_species(aln, combo, outgroup, drop_incomplete=True).filter("out IS NOT NULL")
    s = explode_sites(filled).filter(~F.array_contains("res", R.GAP) & (F.col("out") != R.GAP))
    conv, ctrl = R.side(F.col("res"), 0), R.side(F.col("res"), 1)
    like = lambda r: F.forall(r, lambda x: x == F.col("out"))
    twice = lambda r: F.exists(F.array_distinct(r), lambda d: (d != F.col("out")) & (R.count_in(r, d) >= 2))
    return s.groupBy("gene", "combo_idx").agg(
        F.count("*").alias("n_sites"), F.count_if(like(ctrl) & twice(conv)).alias("true_n"), F.count_if(like(conv) & twice(ctrl)).alias("ctrl_n")
    )


def ccs_table(counts: DataFrame) -> DataFrame:
    """Mean counts over designs and their difference, per gene."""
    return counts.groupBy("gene").agg(
        F.round(F.avg("true_n"), 6).alias("mean_true"), F.round(F.avg("ctrl_n"), 6).alias("mean_control"),
        F.round(F.avg("true_n") - F.avg("ctrl_n"), 6).alias("diff"),
    )
