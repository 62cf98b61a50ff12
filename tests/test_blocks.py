"""Rules over blocks of sites give what the column functions give for one site after the other."""

import random

import pytest
from pyspark.sql import functions as F

from cladewise.functions import blocks as B
from cladewise.operators import sitecount, sites, tree
from cladewise.sources.trees import parse_trees

SPECIES = [f"s{i}" for i in range(10)]


@pytest.fixture(scope="module", params=["AC-", "ACDEx?X-", "AÄ世-"])
def tables(request, spark):
    draw = random.Random(request.param)
    rows = []
    for g in range(30):
        n = draw.randrange(1, 40)
        held = [s for s in SPECIES if draw.random() < 0.85]
        common = [draw.choice(request.param) for _ in range(n)]
        for s in held:
            seq = "".join(c if draw.random() < 0.6 else draw.choice(request.param) for c in common)
            rows.append((f"g{g:02d}", s, seq[: draw.randrange(n + 1)] if draw.random() < 0.1 else seq))
    combos = [(0, SPECIES[:8]), (1, SPECIES[:4]), (2, SPECIES[1:7]), (3, SPECIES[:5])]
    combo = spark.createDataFrame([(c, i, s) for c, held in combos for i, s in enumerate(held)], "combo_idx long, slot int, species string")
    return spark.createDataFrame(rows, "gene string, species string, seq string"), combo


def same(a, b):
    columns = sorted(a.columns)
    rows = lambda d: sorted(map(str, d.select(*columns).collect()))
    assert rows(a) == rows(b)


def test_sites_and_features(spark, tables):
    filled = sites.fill_species(*tables, "s9").cache()
    each = sites.explode_sites(filled).cache()
    from cladewise.functions import residues as R

    same(sites.variable_sites(filled), each.filter(R.is_variable(F.col("res"))).select("gene", "combo_idx", "pos"))
    same(sites.variable_site_counts(filled), sites.var_site_counts(each))
    for cancel in (None, {}, {"only_partner": True}, {"only_partner": True, "outgroup": True, "min_pairs": 1}, {"tri_allelic": True, "min_pairs": 1}):
        cut = each if cancel is None else sites.cancel_gaps(each, **cancel)
        f = sites.informative_features(cut)
        same(sites.gene_features(filled, cancel=cancel), f)
        same(sites.gene_features(filled, 3, wide=True, cancel=cancel), sites.informative_features(cut, 3, wide=True))
        same(sites.gene_sizes(filled, cancel=cancel), sites.gene_groups(f, sites.var_site_counts(cut)))
        if cancel is not None:
            text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "slot", "x"))), lambda x: x["x"]), "")
            whole = cut.select("gene", "combo_idx", "pos", F.posexplode("res").alias("slot", "x")).groupBy("gene", "combo_idx", "slot").agg(text.alias("seq"))
            same(sites.cancelled_sequences(filled, **cancel), whole)


@pytest.mark.parametrize("agreement", [1.0, 0.5])
def test_site_counter(spark, tables, agreement):
    each = sitecount.flag_sites(sitecount.pair_sites(*tables, "s9"), agreement)
    genes = sitecount.paired_genes(*tables, "s9")
    same(sitecount.gene_flags(genes, agreement), each)
    same(sitecount.gene_counts(genes, agreement), sitecount.site_counts(each))


@pytest.mark.parametrize("unambiguous", [False, True])
def test_ancestral_site_counter(spark, tables, unambiguous):
    newick = "((((s0,s1,s2),(s3,s4)),(s5,s6)),((s7,s8),s9));"
    program = tree.tree_program(parse_trees(spark.createDataFrame([(0, newick)], "tree_id long, newick string")))
    combo = tables[1].filter("slot < 4")
    each = sitecount.flag_sites(sitecount.ancestral_pair_sites(tables[0], combo, program, "s9"), states="states", unambiguous=unambiguous)
    same(sitecount.gene_flags(sitecount.ancestral_genes(tables[0], combo, program, "s9"), unambiguous=unambiguous), each)


def test_blocks_cut_long_genes(tables, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"n": [5, 0, 3], "seqs": [["ABCDE", "AB"], ["", ""], ["xyz", "zyx"]]})
    monkeypatch.setattr(B, "CELLS", 6)
    found = list(B.blocks(batch))
    assert len(found) == 3 and [x for b in found for x in zip(b.row.tolist(), b.pos.tolist(), strict=True)] == [(0, i) for i in range(5)] + [(2, i) for i in range(3)]
    assert ["".join(b.residue(c) for b in found for c in b.res[s]) for s in (0, 1)] == ["ABCDExyz", "ABzyx"]


def test_randomized_sequences(spark, tables):
    from cladewise.operators import design

    filled = sites.fill_species(*tables)
    number = F.substring("gene", 2, 2).cast("long")
    each = design.pair_randomize(sites.explode_sites(filled), number, 3, 5).select("gene", "combo_idx", "rep", "pos", F.posexplode("res").alias("slot", "x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda x: x["x"]), "")
    same(design.randomized_sequences(filled, number, 3, 5), each.groupBy("gene", "combo_idx", "rep", "slot").agg(text.alias("seq")))
