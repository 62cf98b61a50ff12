"""Fits of dealt genes against fits in one task, their residuals, and designs of many slots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.operators import fit, score, sites

GRID = "lambda1 double, lambda2 double"


def problem(spark, n=8, genes=25, seed=3, wide=False):
    """Features of random masks, a design, weights with two penalties."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in (0, 1):
        for g in range(genes):
            for pos in range(rng.integers(1, 9)):
                slots = np.flatnonzero(rng.random(n) < 0.4)
                if len(slots) >= 2:
                    mask = sum(1 << int(i) for i in slots) if not wide else [sum(1 << int(i - 62 * w) for i in slots if i // 62 == w) for w in range((n - 1) // 62 + 1)]
                    rows.append((c, f"g{g:03d}", pos, "A", mask))
    f = spark.createDataFrame(rows, f"combo_idx long, gene string, pos int, aa string, mask {'array<bigint>' if wide else 'bigint'}")
    combo = spark.createDataFrame([(c, s, f"sp{s}", 1.0 if s % 2 == 0 else -1.0) for c in (0, 1) for s in range(n)], "combo_idx long, slot int, species string, y double")
    groups = f.groupBy("combo_idx", "gene").agg(F.count("*").alias("n_features")).withColumn("var_sites", F.col("n_features") + 1)
    weights = None
    for p in (0.5, 3.0):
        w = fit.group_weights(groups.withColumn("penalty", F.lit(p)), "median")
        weights = w if weights is None else weights.unionByName(w)
    return f, combo, weights, spark.createDataFrame([(a, b) for a in (0.05, 0.4) for b in (0.1, 0.6)], GRID)


def rows_of(pair):
    models, coef = pair
    return (
        {(r["combo_idx"], r["penalty"], r["lambda1"], r["lambda2"]): (r["intercept"], r["rmse"], r["num_genes"]) for r in models.collect()},
        {(r["combo_idx"], r["penalty"], r["lambda1"], r["lambda2"], r["gene"], r["pos"], r["aa"]): r["weight"] for r in coef.collect()},
    )


@pytest.mark.parametrize("continuous, strict, n, wide", [(False, True, 8, False), (True, True, 8, False), (False, False, 8, False), (False, True, 80, True)])
def test_dealt_genes_fit_like_one_task(spark, continuous, strict, n, wide):
    f, combo, weights, grid = problem(spark, n, 12, wide=wide)
    if continuous:
        combo = combo.withColumn("y", F.sin(F.col("slot") * 2.5 + 1) + F.col("combo_idx"))
    one, dealt = (rows_of(fit.fit_models(f, combo, weights, grid, continuous, 12, strict, masks_in_task=m)) for m in (10**6, 100 if not wide else 0))
    assert set(one[0]) == set(dealt[0]) and len(one[0]) == 16 and set(one[1]) == set(dealt[1]) and one[1]
    for a, b in zip(one, dealt, strict=True):
        for k, v in a.items():
            assert np.allclose(v, b[k], rtol=0, atol=1e-8)


@pytest.mark.parametrize("continuous", [False, True])
def test_models_are_the_least(spark, continuous):
    f, combo, weights, grid = problem(spark, 8, 12, seed=5)
    if continuous:
        combo = combo.withColumn("y", F.sin(F.col("slot") * 2.5 + 1))
    models, coef = fit.fit_models(f, combo, weights, grid, continuous, 3000)
    worst = fit.kkt_residuals(f, combo, weights, models, coef, continuous).agg(F.max("residual").alias("r"), F.count("*").alias("n")).first()
    assert worst["n"] == 16 and worst["r"] < 2e-4
    off = coef.withColumn("weight", F.col("weight") * 1.05)
    assert fit.kkt_residuals(f, combo, weights, models, off, continuous).agg(F.max("residual")).first()[0] > 1e-3


def test_model_rows_have_the_input_error(spark):
    f, combo, weights, grid = problem(spark)
    models, coef = fit.fit_models(f, combo, weights.filter("penalty = 0.5"), grid, maxiter=30)
    numbered = models.withColumn("run", (F.col("lambda1") * 100 + F.col("lambda2")).cast("string"))
    hits = score.score_inputs(coef.withColumn("run", (F.col("lambda1") * 100 + F.col("lambda2")).cast("string")), f, combo)
    again = {(r["combo_idx"], r["run"]): r["rmse"] for r in score.input_rmse(hits, numbered.select("combo_idx", "run", "intercept"), combo).collect()}
    told = {(r["combo_idx"], r["run"]): r["rmse"] for r in numbered.collect()}
    assert told.keys() == again.keys() and all(abs(told[k] - again[k]) < 2e-6 for k in told)


def test_many_slots(spark):
    """66 slots: masks of two words; as longs they are an error and not a loss of slots."""
    rows = [("g", f"s{i}", "".join("AC"[(i // (p + 1)) % 2] for p in range(6))) for i in range(66)]
    aln = spark.createDataFrame(rows, "gene string, species string, seq string")
    combo = spark.createDataFrame([(0, i, f"s{i}", 1.0 - 2 * (i % 2)) for i in range(66)], "combo_idx long, slot int, species string, y double")
    site = sites.explode_sites(sites.fill_species(aln, combo))
    assert sites.has_wide_masks(combo) and not sites.has_wide_masks(combo.filter("slot < 62"))
    f = sites.informative_features(site, wide=True)
    coef = f.select("combo_idx", F.lit(1).alias("run"), "gene", "pos", "aa", F.lit(0.5).alias("weight"))
    hits = {(r["slot"], r["n"]) for r in score.score_inputs(coef, f, combo).groupBy("slot").agg(F.count("*").alias("n")).collect()}
    assert hits == {(i, f.select("pos").distinct().count()) for i in range(66)}
    w = fit.group_weights(sites.gene_groups(f, sites.var_site_counts(site)), "std")
    models, _ = fit.fit_models(f, combo, w, spark.createDataFrame([(0.1, 0.1)], GRID))
    assert models.collect()[0]["num_genes"] == 1
    with pytest.raises(Exception, match="wide masks"):
        sites.informative_features(site).collect()


def test_without_features(spark):
    f, combo, weights, grid = problem(spark)
    models, coef = fit.fit_models(f.limit(0), combo, weights, grid)
    assert models.count() == 0 and coef.count() == 0


@pytest.mark.parametrize("continuous, maxiter, near", [(False, 40, 1e-8), (True, 40, 1e-8), (False, 3000, 1e-4)])
def test_genes_near_the_gradient_fit_like_all(spark, continuous, maxiter, near, monkeypatch):
    """A design that one task can't hold: in each round only genes that may get a coefficient go to a task, and models are the same."""
    f, combo, weights, _ = problem(spark, 8, 60, seed=11)
    grid = spark.createDataFrame([(a, b) for a in (0.5, 0.7) for b in (0.4, 0.8)], GRID)
    if continuous:
        combo = combo.withColumn("y", F.sin(F.col("slot") * 2.5 + 1) + F.col("combo_idx"))
    n = f.select("combo_idx", "gene", "mask").distinct().groupBy("combo_idx").count().agg(F.min("count")).first()[0]
    one = rows_of(fit.fit_models(f, combo, weights, grid, continuous, maxiter))
    monkeypatch.setattr(fit, "_fit_block", None)  # no step is a job of its own
    monkeypatch.setattr(fit, "LONG_DESCENT", 0)
    kept = rows_of(fit.fit_models(f, combo, weights, grid, continuous, maxiter, masks_in_task=n - 1))
    assert len(one[0]) == 16 and set(one[0]) == set(kept[0]) and set(one[1]) == set(kept[1]) and one[1]
    for a, b in zip(one, kept, strict=True):
        for k, v in a.items():
            assert np.allclose(v, b[k], rtol=0, atol=near)


@pytest.mark.parametrize("continuous", [False, True])
def test_steps_near_the_gradient_are_those_over_all_genes(continuous):
    """To the end and to the least: many genes are near the gradient in the first steps and hold the step size down later."""
    rng = np.random.default_rng(4)
    genes = np.sort(rng.integers(0, 4000, 60000))
    masks, weight, y = rng.integers(3, 256, 60000), rng.integers(3, 30, 4000).astype(float), np.array([1.0, -1.0] * 4) if not continuous else np.sin(np.arange(8) * 2.5 + 1)
    design = fit.Genes(masks, genes, weight, 8)
    first = fit.first_gradient(y, continuous)
    l1 = 0.4 * np.abs(design.back(first)).max()
    l2 = 0.3 * design.most(l1, first)
    asked, zero = fit.descent(y, continuous, 60), np.zeros(60000)
    trial, beta, prev = next(asked), zero, zero
    try:
        while True:
            new, s, g = design.step((beta, prev), trial, l1, l2)
            later = asked.send(design.sums(new, s, g))
            if later.b is not trial.b:
                beta, prev = new, beta
            trial = later
    except StopIteration as end:
        intercept = end.value.intercept
    got, c, _ = fit._descend(design, y, l1, l2, continuous, 60, True)
    assert np.count_nonzero(new) and np.allclose(got, new, rtol=0, atol=1e-9) and abs(c - intercept) < 1e-9
    got, c, scores = fit._descend(design, y, l1, l2, continuous, 4000, True)
    g = design.back(scores - y if continuous else -y / 8 / (1 + np.exp(y * (scores + c))))
    norm = design.norms(got)[design.group]
    zero_genes = design.norms(np.maximum(np.abs(g) - l1, 0)) - l2 * design.weight
    on = got != 0
    pull = np.abs(g + l1 * np.sign(got) + l2 * design.weight[design.group] * got / np.where(on, norm, 1))
    assert on.any() and pull[on].max() < 1e-3 * l1 and zero_genes[design.norms(got) == 0].max() < 1e-3 * l1


def test_one_pass_makes_features_sizes_and_kinds(spark):
    from cladewise.plans import adapters as A

    filled = sites.fill_species(A.alignment(spark, "/root/testdata/sf0.001"), A.combos(spark), A.OUTGROUP)
    for cancel in (None, {"only_partner": True}):
        held = sites.feature_lists(filled, cancel=cancel)
        want = sites.gene_features(filled, cancel=cancel)
        table = lambda d: sorted(map(tuple, d.collect()), key=str)
        assert table(held.select("combo_idx", "gene", F.inline("features"))) == table(want) != []
        assert table(held.select("combo_idx", "gene", "n_features", "var_sites")) == table(sites.gene_sizes(filled, cancel=cancel))
        assert table(held.select("combo_idx", "gene", "kinds")) == table(fit.feature_kinds(want))
