"""Scores over every gene of the alignment, against plain Python over whole texts."""

import math
from collections import Counter, defaultdict

import pytest

import __spark_entry__
from cladewise.plans import adapters as A


def test_coefficients_reach_every_part_of_the_texts(spark, sf_dir):
    coef = A.coefficients(spark, sf_dir)
    groups = {r["q"]: r["m"] for r in A.text_groups(spark, sf_dir).collect()}
    genes = {(int(r["gene"][1:7]), int(r["gene"][8:])) for r in coef.select("gene").distinct().collect()}
    assert {q for q, _ in genes} == set(groups)
    assert all(0 <= j < groups[q] for q, j in genes)
    # An even deal of c items to m genes leaves m * exp(-c / m) of them without one.
    c = coef.count() / len(groups)
    assert len(genes) > 0.95 * sum(m * (1 - math.exp(-c / m)) for m in groups.values())
    assert {r["pos"] for r in coef.select("pos").distinct().collect()} == set(range(A.WIDTH))


def test_all_texts_take_part_in_scores(spark, sf_dir):
    run = lambda name: __spark_entry__.queries()[name](spark, sf_dir).collect()
    coef = A.all_gene_coefficients(spark, sf_dir).collect()
    classes = {c: k for k, v in A.CLASSES.items() for c in v + v.upper()}
    cells, genes = {}, defaultdict(set)
    for r in A.table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        for i in range(-(-len(r["text"] or "") // A.WIDTH)):
            gene, species = f"g{r['doc_id'] // 16:06d}s{i:04d}", f"sp{r['doc_id'] % 16:02d}"
            cells[gene, species] = "".join(classes.get(c, "-") for c in r["text"][i * A.WIDTH : (i + 1) * A.WIDTH]).ljust(A.WIDTH, "-")
            genes[gene].add(species)
    assert {r["gene"] for r in coef} == set(genes)
    hits, sums = Counter(), Counter()
    training = {(c, x) for c, line in enumerate(A.COMBOS) for x in line}
    for r in coef:
        for species in genes[r["gene"]]:
            if cells[r["gene"], species][r["pos"]] == r["aa"] and (r["combo_idx"], species) not in training:
                key = r["combo_idx"], r["run"], species
                hits[key] += 1
                sums[key] += r["weight"]
    got = {(r["combo_idx"], r["run"], r["species"]): (r["hits"], r["s"]) for r in run("J2_prediction_hits_all_genes")}
    assert {k: v[0] for k, v in got.items()} == hits
    assert {k: v[1] for k, v in got.items()} == pytest.approx(dict(sums), abs=2e-6)
    start = {(r["combo_idx"], r["run"]): r["intercept"] for r in A.models(spark, sf_dir).collect()}
    for name in ("A3_species_scores_all_genes", "S15_prediction_parts_all_genes", "J4_attach_phenotype_all_genes"):
        sps = {(r["combo_idx"], r["run"], r["species"]): r["sps"] for r in run(name)}
        assert sps == pytest.approx({k: v + start[k[:2]] for k, v in sums.items()}, abs=2e-6)
    kept = {(r["gene"], r["species"]) for r in run("S3_limit_genes_all_genes")}
    assert kept == {k for k in cells if k[0] in {r["gene"] for r in coef}}
