"""Sites of alignments: from one row per sequence to one row per gene, design and position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import residues as R

#: Designs that are sent to every task at once.
DESIGNS_AT_ONCE = 10_000


def gene_table(aln: DataFrame) -> DataFrame:
    """``(gene, n, by_species)``: the gene's length and a map species -> sequence. One shuffle of sequences,
    by gene; no cells. They are dealt before they are grouped: a gene's sequences are in as many texts, so grouping ahead
    of the shuffle would only sort them."""
    return aln.repartition("gene").groupBy("gene").agg(
        F.max(F.length("seq")).alias("n"), F.map_from_entries(F.collect_list(F.struct("species", "seq"))).alias("by_species")
    )


def design_rows(combo: DataFrame) -> DataFrame:
    """One row per design: ``(combo_idx, species)`` with the species by slot."""
    ordered = F.array_sort(F.collect_list(F.struct("slot", "species")))
    return combo.groupBy("combo_idx").agg(F.transform(ordered, lambda x: x["species"]).alias("species"))


def fill_species(aln: DataFrame, combo: DataFrame, outgroup: str | None = None, drop_incomplete: bool = False) -> DataFrame:
    """``(gene, combo_idx, n, seqs, missing, out)``: sequences by slot; absent species are all gaps.

    Each gene meets each design, which is the result's size; designs are broadcast ``DESIGNS_AT_ONCE`` at once."""
    filled = with_designs(gene_table(aln), combo, outgroup)
    return filled.filter(~F.array_contains("missing", True)) if drop_incomplete else filled


def with_designs(genes: DataFrame, combo: DataFrame, outgroup: str | None, *more: str) -> DataFrame:
    """Each gene of a :func:`gene_table` with each design; columns ``more`` of the genes are kept."""
    designs = design_rows(combo)
    blocks = max(1, -(-designs.count() // DESIGNS_AT_ONCE))
    pairs = None
    for block in range(blocks):
        part = designs.filter(F.pmod(F.xxhash64("combo_idx"), F.lit(blocks)) == block) if blocks > 1 else designs
        part = genes.crossJoin(F.broadcast(part))
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs.select(
        "gene", "combo_idx", "n",
        F.transform("species", lambda s: F.coalesce(F.try_element_at("by_species", s), F.repeat(F.lit(R.GAP), F.col("n")))).alias("seqs"),
        F.transform("species", lambda s: F.try_element_at("by_species", s).isNull()).alias("missing"),
        (F.try_element_at("by_species", F.lit(outgroup)) if outgroup else F.lit(None).cast("string")).alias("out"), *more,
    )


def in_blocks(filled: DataFrame, kind: str, rule: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray | None, dict[str, pa.Array]]]], *columns: str) -> DataFrame:
    """``(gene, combo_idx, *kind)``: what ``rule`` makes of batches of genes with their ``columns``, as rows of the batch
    (all of them, if none are named) and new columns. A gene's row stays where it is; nothing is shuffled."""
    keys = ["gene", "combo_idx"]
    types = dict(filled.dtypes)
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, made in rule(batch):
                own = [batch.column(c) if rows is None else batch.column(c).take(pa.array(rows)) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, *(made[c] for c in names)], [*keys, *names])

    return filled.filter("n > 0").select(*keys, "n", *columns).mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keys), kind]))


def _lettered(filled: DataFrame, *more: str) -> DataFrame:
    """``filled`` with its sequences as arrays of ``letters``, made once for all positions: a projection
    would be merged with the next one and split a sequence again at each of its positions."""
    split = F.struct(F.transform("seqs", lambda s: F.split(s, "")).alias("letters"), F.split("out", "").alias("out_letters"))
    return filled.filter("n > 0").select("gene", "combo_idx", "n", "missing", *more, F.inline(F.array(split)))


def _places() -> Column:
    """``(res, out)`` by position, of a row of :func:`_lettered`."""
    at = lambda letters, p: F.coalesce(F.get(letters, p), F.lit(""))
    return F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda p: F.struct(F.transform("letters", lambda s: at(s, p)).alias("res"), F.when(F.col("out_letters").isNotNull(), at(F.col("out_letters"), p)).alias("out")),
    )


def explode_sites(filled: DataFrame, *more: str) -> DataFrame:
    """``(gene, combo_idx, pos, res, missing, out)``: residues by slot at each position. Arrays by position in the
    columns ``more`` give up their element, in a column of that name."""
    places = F.transform(_places(), lambda x, p: F.struct(x["res"].alias("res"), x["out"].alias("out"), *(F.get(c, p).alias(c) for c in more))) if more else _places()
    sites = _lettered(filled, *more).select("gene", "combo_idx", "missing", F.posexplode(places).alias("pos", "site"))
    return sites.select("gene", "combo_idx", "pos", "site.res", "missing", "site.out", *(f"site.{c}" for c in more))


def _gaps_cancelled(batch: pa.RecordBatch, cancel: dict | None) -> Iterator[B.Block]:
    """Blocks of a batch after :func:`cancel_gaps` with its settings ``cancel``, if there are any."""
    intact = None if cancel is None else B.intact_pairs(batch.column("missing"))
    rest = {"outgroup": False, "min_pairs": 2, "only_partner": False, "tri_allelic": False} | (cancel or {})
    for b in B.blocks(batch):
        if cancel is None:
            yield b
        else:
            gap = [] if ord(R.GAP) in b.kinds else [ord(R.GAP)]
            yield b._replace(res=B.cancelled(b, intact[b.row], **rest), kinds=np.append(b.kinds, gap).astype(np.int64))


_CELLS = ("seqs", "missing", "out")


def cancelled_sequences(
    filled: DataFrame, min_pairs: int = 2, only_partner: bool = False, outgroup: bool = False, tri_allelic: bool = False
) -> DataFrame:
    """``(gene, combo_idx, slot, seq)``: the sequences after :func:`cancel_gaps`; a gene's row stays where it is."""
    cancel = {"outgroup": outgroup, "min_pairs": min_pairs, "only_partner": only_partner, "tri_allelic": tri_allelic}

    def rule(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        by_slots: dict[int, list[B.Block]] = {}
        for b in _gaps_cancelled(batch, cancel):
            by_slots.setdefault(len(b.res), []).append(b)
        for k, parts in by_slots.items():
            rows, at = np.unique(np.concatenate([b.row for b in parts]), return_inverse=True)
            for slot in range(k):
                seq = B.texts(at, np.concatenate([b.res[slot] for b in parts]), len(rows))
                yield rows, {"slot": pa.array(np.full(len(rows), slot, np.int32)), "seq": seq}

    return in_blocks(filled, "slot int, seq string", rule, *_CELLS)


def intact_pairs(missing: Column) -> Column:
    """Pairs with both species in the alignment."""
    return F.size(F.filter(F.transform(missing, lambda x, i: (i % 2 == 0) & ~x & ~F.coalesce(F.get(missing, i + 1), F.lit(True))), lambda x: x))


def cancel_gaps(
    sites: DataFrame, min_pairs: int = 2, only_partner: bool = False, outgroup: bool = False, tri_allelic: bool = False
) -> DataFrame:
    """``sites`` with ``res`` cancelled; an outgroup test, if asked for, follows a partial cancel."""
    out = F.col("out") if outgroup else None
    return sites.withColumn("res", R.cancelled(F.col("res"), intact_pairs(F.col("missing")), out, min_pairs, only_partner, tri_allelic))


def variable_sites(filled: DataFrame) -> DataFrame:
    """``(gene, combo_idx, pos)``, of whole sequences."""
    def rule(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        for b in B.blocks(batch):
            at = np.flatnonzero(B.variable(b))
            yield b.row[at], {"pos": pa.array(b.pos[at].astype(np.int32))}

    return in_blocks(filled, "pos int", rule, "seqs")


def var_site_counts(sites: DataFrame) -> DataFrame:
    """``(gene, combo_idx, var_sites)``, zero counts kept."""
    return sites.groupBy("gene", "combo_idx").agg(F.count_if(R.is_variable(F.col("res"))).alias("var_sites"))


def variable_site_counts(filled: DataFrame) -> DataFrame:
    """As :func:`var_site_counts` of whole sequences, within a gene's row."""
    return _sizes(filled, 1, None).select("gene", "combo_idx", "var_sites")


def _sizes(filled: DataFrame, min_count: int, cancel: dict | None) -> DataFrame:
    """``(gene, combo_idx, n_features, var_sites)``, zero counts kept."""
    def rule(batch: pa.RecordBatch) -> Iterator[tuple[None, dict[str, pa.Array]]]:
        features, places = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for b in _gaps_cancelled(batch, cancel):
            places += np.bincount(b.row[B.variable(b)], minlength=batch.num_rows)
            for _, at, _ in B.informative(b, min_count):
                features += np.bincount(b.row[at], minlength=batch.num_rows)
        yield None, {"n_features": pa.array(features), "var_sites": pa.array(places)}

    return in_blocks(filled, "n_features bigint, var_sites bigint", rule, *_CELLS)


def gene_sizes(filled: DataFrame, min_count: int = 2, cancel: dict | None = None) -> DataFrame:
    """:func:`gene_groups` of whole sequences, within a gene's row; ``cancel`` has settings of :func:`cancel_gaps`."""
    return _sizes(filled, min_count, cancel).filter("n_features > 0").select("combo_idx", "gene", "n_features", "var_sites")


def gene_features(filled: DataFrame, min_count: int = 2, wide: bool = False, cancel: dict | None = None) -> DataFrame:
    """:func:`informative_features` of whole sequences; ``cancel`` has settings of :func:`cancel_gaps`."""
    def rule(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
        for b in _gaps_cancelled(batch, cancel):
            for kind, at, n in B.informative(b, min_count):
                if len(b.res) > R.WORD and not wide:
                    raise ValueError(f"more than {R.WORD} slots: ask for wide masks")
                words = B.masks(b, kind, at)
                ends = pa.array(np.arange(len(at) + 1) * len(words), pa.int32())
                mask = pa.ListArray.from_arrays(ends, pa.array(words.T.ravel())) if wide else pa.array(words[0])
                aa = pa.array([b.residue(kind)]).take(pa.array(np.zeros(len(at), np.int64)))
                yield b.row[at], {"pos": pa.array(b.pos[at].astype(np.int32)), "aa": aa, "mask": mask, "n_hit": pa.array(n.astype(np.int32))}

    found = in_blocks(filled, f"pos int, aa string, mask {'array<bigint>' if wide else 'bigint'}, n_hit int", rule, *_CELLS)
    return found.select("combo_idx", "gene", "pos", "aa", "mask", "n_hit")


def feature_lists(filled: DataFrame, min_count: int = 2, cancel: dict | None = None) -> DataFrame:
    """``(combo_idx, gene, n_features, var_sites, features, kinds)`` of genes with features, in one pass over whole sequences: what
    :func:`gene_sizes` says, the rows of :func:`gene_features` as an array, and its distinct masks in order with how many features have each."""
    feature = pa.struct([("pos", pa.int32()), ("aa", pa.string()), ("mask", pa.int64()), ("n_hit", pa.int32())])

    def rule(batch: pa.RecordBatch) -> Iterator[tuple[None, dict[str, pa.Array]]]:
        places, parts = np.zeros(batch.num_rows, np.int64), []
        for b in _gaps_cancelled(batch, cancel):
            places += np.bincount(b.row[B.variable(b)], minlength=batch.num_rows)
            for kind, at, n in B.informative(b, min_count):
                if len(b.res) > R.WORD:
                    raise ValueError(f"more than {R.WORD} slots: ask gene_features for wide masks")
                parts.append((b.row[at], b.pos[at], np.full(len(at), kind), B.masks(b, kind, at)[0], n, np.full(len(at), kind == b.empty)))
        row, pos, kind, mask, n, ended = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
        order = np.lexsort((kind, pos, row))
        row, pos, kind, mask, n, ended = (x[order] for x in (row, pos, kind, mask, n, ended))
        ends = lambda of: np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
        letters, of = np.unique(np.where(ended, -1, kind), return_inverse=True)
        aa = pa.array(["" if k < 0 else chr(k) for k in letters], pa.string()).take(pa.array(of.reshape(-1)))
        features = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), aa, pa.array(mask), pa.array(n.astype(np.int32))], fields=list(feature))
        by = np.lexsort((mask, row))
        row2, mask2 = row[by], mask[by]
        new = np.flatnonzero(np.append(True, (row2[1:] != row2[:-1]) | (mask2[1:] != mask2[:-1]))[: len(row2)])
        times = np.diff(np.append(new, len(row2)))
        kinds = pa.StructArray.from_arrays([pa.array(mask2[new]), pa.array(times.astype(np.int64))], names=["mask", "times"])
        yield None, {
            "n_features": pa.array(np.diff(ends(row)).astype(np.int64)), "var_sites": pa.array(places),
            "features": pa.ListArray.from_arrays(ends(row), features), "kinds": pa.ListArray.from_arrays(ends(row2[new]), kinds),
        }

    kind = "n_features bigint, var_sites bigint, features array<struct<pos:int,aa:string,mask:bigint,n_hit:int>>, kinds array<struct<mask:bigint,times:bigint>>"
    return in_blocks(filled, kind, rule, *_CELLS).filter("n_features > 0").select("combo_idx", "gene", "n_features", "var_sites", "features", "kinds")


def has_wide_masks(combo: DataFrame) -> bool:
    """Whether a design has more slots than a long has bits for."""
    return (combo.agg(F.max("slot").alias("last")).first()["last"] or 0) >= R.WORD


def informative_features(sites: DataFrame, min_count: int = 2, wide: bool = False) -> DataFrame:
    """``(combo_idx, gene, pos, aa, mask, n_hit)``: a feature per informative residue, as slot bits; for designs
    of more slots than ``R.WORD``, ``wide`` masks (see :func:`has_wide_masks`)."""
    one = sites.withColumn("aa", F.explode(R.informative_residues(F.col("res"), min_count)))
    return one.select(
        "combo_idx", "gene", "pos", "aa", R.slot_mask(F.col("res"), F.col("aa"), wide).alias("mask"), R.count_in(F.col("res"), F.col("aa")).alias("n_hit")
    )


def gene_groups(features: DataFrame, counts: DataFrame) -> DataFrame:
    """``(combo_idx, gene, n_features, var_sites)`` of genes with features."""
    n = features.groupBy("combo_idx", "gene").agg(F.count("*").alias("n_features"))
    return n.join(counts, ["combo_idx", "gene"])


def sequence_lengths(aln: DataFrame) -> DataFrame:
    """``(species, n)``: residues of all genes; ``-``, ``.`` and blanks don't count."""
    return aln.groupBy("species").agg(F.sum(F.length(F.regexp_replace("seq", "[-. ]", ""))).alias("n"))


def ragged_genes(aln: DataFrame) -> DataFrame:
    n = F.length("seq")
    return aln.groupBy("gene").agg(F.min(n).alias("shortest"), F.max(n).alias("longest")).filter("shortest <> longest")


def limit_genes(aln: DataFrame, genes: DataFrame) -> DataFrame:
    return aln.join(genes.select("gene").distinct(), "gene", "left_semi")


def missing_genes(aln: DataFrame, genes: DataFrame) -> DataFrame:
    return genes.select("gene").distinct().join(aln.select("gene"), "gene", "left_anti")


def taas(aln: DataFrame, targets: list[str], min_fg: int = 2) -> DataFrame:
    """``(gene, n)``: positions where no target residue is a non-target's; gaps count as residues."""
    hit = lambda s, want: F.array_contains(F.lit(targets), s) == F.lit(want)
    g = gene_table(aln)
    side = lambda want: F.transform(F.map_values(F.map_filter("by_species", lambda k, v: hit(k, want))), lambda s: F.split(s, ""))
    # Sequences are split once, not at each position (as in _lettered).
    g = g.select("gene", "n", F.inline(F.array(F.struct(side(True).alias("fg"), side(False).alias("bg"))))).filter((F.size("fg") >= min_fg) & (F.size("bg") > 0))
    at = lambda c, p: F.transform(c, lambda letters: F.coalesce(F.get(letters, p), F.lit("")))
    own = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda p: ~F.arrays_overlap(at(F.col("fg"), p), at(F.col("bg"), p)))
    return g.select("gene", F.size(own).alias("n"))
