"""Hand-computed cases and invariants of the genomics operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import residues as R
from cladewise.functions.ranks import with_ranks
from cladewise.operators import design, fit, ledger, pairs, score, sitecount, sites, tree, validate
from cladewise.sources import alignments, texts
from cladewise.sources.trees import newick_nodes, parse_trees


def aln(spark, rows, gene="g"):
    return spark.createDataFrame([(gene, s, q) for s, q in rows.items()], "gene string, species string, seq string")


def combo(spark, *designs):
    rows = [(c, i, s, 1.0 if i % 2 == 0 else -1.0) for c, d in enumerate(designs) for i, s in enumerate(d)]
    return spark.createDataFrame(rows, "combo_idx long, slot int, species string, y double")


def test_fractional_average(spark):
    lines = [("A", "B"), ("C", "D"), ("A", "E"), ("C", "D")]
    groups = spark.createDataFrame([(0, i, list(x)) for i, x in enumerate(lines)], "design int, line_no int, members array<string>")
    c = design.expand_combos(groups).select("combo_idx", "slot", "species")
    assert c.select("combo_idx").distinct().count() == 16
    first = [r["species"] for r in c.filter("combo_idx = 1").orderBy("slot").collect()]
    assert first == ["A", "C", "A", "D"]  # the last line is the fastest
    a = aln(spark, {"A": "BBBAA", "B": "BBBAA", "C": "AAAAA", "D": "AAAAA", "E": "CBBAA", "OG": "AAAAA"})
    counts = sitecount.site_counts(sitecount.flag_sites(sitecount.pair_sites(a, c, "OG")))
    r = sitecount.gene_site_counts(counts).first()
    assert (r["avg_true"], r["avg_control"]) == (2.5, 0.0)


def test_scores_and_flags(spark):
    a = aln(spark, {"A": "AAAA", "B": "AAAA", "C": "BBBB", "D": "BBBB", "E": "BBBB"})
    flags = sitecount.flag_sites(sitecount.pair_sites(a, combo(spark, ["A", "C", "B", "D"]), "E")).collect()
    assert len(flags) == 4 and all(r["score"] == 4 and r["is_ccs"] and not r["ctrl_conv"] for r in flags)


def test_cancelled_columns(spark):
    a = aln(spark, {"a": "ACGT", "b": "A-GT", "c": "ACGT", "d": "AC-T"})
    s = sites.explode_sites(sites.fill_species(a, combo(spark, ["a", "b", "c", "d"])))
    text = lambda x: ["".join(r["res"]) for r in x.orderBy("pos").collect()]
    assert text(sites.cancel_gaps(s)) == ["AAAA", "----", "----", "TTTT"]
    assert text(sites.cancel_gaps(s, 1, only_partner=True)) == ["AAAA", "--CC", "GG--", "TTTT"]
    assert text(sites.cancel_gaps(s, 3)) == ["----"] * 4


NWK = "(((A:1,B:1):1,(C:1,D:1):1):1,E:2);"


def tree_of(spark, newick=NWK):
    return parse_trees(spark.createDataFrame([(1, newick)], "tree_id long, newick string"))


def test_newick():
    nodes = newick_nodes("('a b':1.5,(c,d)x:2)root[note];")
    assert [(n[2], n[3], n[4]) for n in nodes] == [("root", None, 0), ("a b", 1.5, 1), ("x", 2.0, 1), ("c", None, 2), ("d", None, 2)]


def test_fitch_prefix_and_ambiguity(spark):
    nodes = tree_of(spark).cache()
    seqs = {"A": "GATTACA", "B": "GATTACA", "C": "GATTAGA", "D": "GATTAGA", "E": "CTGCTGC"}
    rows = [(p, s, c) for s, q in seqs.items() for p, c in enumerate(q)]
    leaf = spark.createDataFrame(rows, "site int, name string, c string").join(nodes.select("tree_id", "node_id", "name"), "name")
    sets = tree.fitch_down(leaf.select("site", "tree_id", "node_id", tree.residue_bit(F.col("c")).alias("mask")), nodes)
    up = tree.fitch_up(sets, nodes).filter("node_id = 1").orderBy("site").collect()
    assert "".join(r["state"] for r in up)[:5] == "GATTA"
    six = sets.filter("node_id = 1 AND site = 5").first()["mask"]
    assert six == (1 << 2) | (1 << 6)  # C or G


def test_closure_distance_and_mrca(spark):
    nodes = tree_of(spark)
    anc = tree.closure(nodes)
    ids = {r["name"]: r["node_id"] for r in nodes.filter("name IS NOT NULL").collect()}
    d = tree.distances(anc, spark.createDataFrame([(1, ids["A"], ids["C"]), (1, ids["A"], ids["E"])], "tree_id long, a long, b long")).collect()
    assert sorted(r["dist"] for r in d) == [4.0, 5.0]
    got = tree.mrca(anc, spark.createDataFrame([(7, 1, ids["A"]), (7, 1, ids["B"])], "set_id long, tree_id long, node_id long"), nodes).first()
    assert got["mrca"] == nodes.filter(F.col("name") == "A").first()["parent_id"]


def test_sweep_never_rises(spark):
    nodes = tree_of(spark, "((A:1,B:1):1,(C:1,D:1):1);")
    anc = tree.closure(nodes)
    value = {"A": 1.0, "B": 2.0, "C": 1.0, "D": 2.0}
    traits = nodes.filter("name IS NOT NULL").select("tree_id", "node_id", F.create_map(*[F.lit(x) for kv in value.items() for x in kv])[F.col("name")].alias("value"))
    n = {r["threshold"]: r["n"] for r in pairs.pct_sweep(pairs.pct_candidates(traits, anc), anc, [0.0, 25.0, 50.0, 150.0]).collect()}
    assert n == {0.0: 2, 25.0: 2, 50.0: 2}


def test_null_flips_of_four_pairs(spark):
    c = combo(spark, list("abcdefgh"), list("abcdefgh"))
    out = design.null_flips(c, ["combo_idx"]).collect()
    assert len(out) == 2 * 3 * 8
    assert {tuple(sorted(r["species"] for r in out if r["combo_idx"] == k and r["flip"] == f)) for k in (0, 1) for f in range(3)} == {tuple("abcdefgh")}


def test_site_and_gene_scores_agree(spark):
    coef = spark.createDataFrame([(0, 0, "g", 1, "A", 0.5), (0, 0, "g", 1, "C", -0.25), (0, 0, "h", 2, "A", 1.0)], "combo_idx long, run long, gene string, pos int, aa string, weight double")
    assert score.gene_scores(coef).agg(F.sum("gss")).first()[0] == score.site_scores(coef).agg(F.sum("pss")).first()[0] == 1.75
    r = score.gene_ranks_multi(score.rank_genes(score.gene_scores(coef)), coef.select("gene"), 0.5).collect()
    assert all(x["num_combos_ranked_top"] <= x["num_combos_ranked"] for x in r)


def test_randomized_pairs_keep_their_residues(spark):
    a = aln(spark, {"a": "ACGT", "b": "TTTT", "c": "AAAA", "d": "CCCC"})
    s = sites.explode_sites(sites.fill_species(a, combo(spark, list("abcd"))))
    out = design.pair_randomize(s, F.lit(1), 20).collect()
    plain = {r["pos"]: r["res"] for r in s.collect()}
    assert len(out) == 80 and any(r["res"] != plain[r["pos"]] for r in out)
    for r in out:
        for k in (0, 2):
            assert sorted(r["res"][k : k + 2]) == sorted(plain[r["pos"]][k : k + 2])


def dense_fit(x, genes, weight, y, l1, l2):
    """Plain proximal gradient descent on the dense matrix, many small steps."""
    n, p = x.shape
    b, c, step = np.zeros(p), 0.0, 1.0 / (np.linalg.norm(np.c_[x, np.ones(n)], 2) ** 2 / (4 * n))
    for _ in range(60000):
        e = -y / n / (1 + np.exp(y * (x @ b + c)))
        b, c = b - step * (x.T @ e), c - step * e.sum()
        b = np.sign(b) * np.maximum(np.abs(b) - step * l1, 0)
        for g in np.unique(genes):
            m = genes == g
            s = np.linalg.norm(b[m])
            b[m] *= max(0, 1 - step * l2 * weight[g] / s) if s else 0
    return b, c


def test_fit_reaches_the_optimum(spark):
    rng = np.random.default_rng(2)
    y = np.array([1.0, -1.0] * 3)
    masks = rng.integers(1, 63, 14)
    genes = np.sort(rng.integers(0, 4, 14))
    genes = np.unique(genes, return_inverse=True)[1]
    weight = np.sqrt(np.bincount(genes))
    x = ((masks[:, None] >> np.arange(6)) & 1).astype(float).T
    g = x.T @ (np.where(y > 0, 0.5, -0.5) / 6)
    l1 = 0.2 * np.abs(g).max()
    rest = np.maximum(np.abs(g) - l1, 0)
    l2 = 0.2 * max(np.linalg.norm(rest[genes == k]) / weight[k] for k in np.unique(genes))
    beta, c = fit.fit_one(masks, genes, weight, y, 0.2, 0.2, False, maxiter=4000)
    b2, c2 = dense_fit(x, genes, weight, y, l1, l2)
    loss = lambda b, c: np.logaddexp(0, -y * (x @ b + c)).mean() + l1 * np.abs(b).sum() + l2 * sum(weight[k] * np.linalg.norm(b[genes == k]) for k in np.unique(genes))
    assert abs(loss(beta, c) - loss(b2, c2)) < 1e-7
    none, _ = fit.fit_one(masks, genes, weight, y, 1.0, 1.0, False)
    assert not none.any()


def test_equal_masks_of_a_gene_are_fitted_once():
    rng = np.random.default_rng(5)
    y = np.array([1.0, -1.0] * 3)
    pairs = np.unique(np.c_[rng.integers(0, 4, 30), rng.integers(1, 63, 30)], axis=0)
    times = rng.integers(1, 6, len(pairs))
    genes, masks = pairs[:, 0], pairs[:, 1]
    weight = np.sqrt(np.bincount(genes, times))
    for continuous in (False, True):
        one, c1 = fit.fit_one(masks, genes, weight, y, 0.1, 0.2, continuous, 500, times=times)
        each, c2 = fit.fit_one(np.repeat(masks, times), np.repeat(genes, times), weight, y, 0.1, 0.2, continuous, 500)
        assert np.allclose(np.repeat(one, times), each, atol=1e-7) and abs(c1 - c2) < 1e-7
        assert one.any()


def test_grid_job_equals_the_kernel(spark):
    a = aln(spark, {"a": "AACC", "b": "CCCA", "c": "AACA", "d": "CCAC", "e": "AAAA", "f": "CACC"})
    c = combo(spark, list("abcdef"))
    s = sites.explode_sites(sites.fill_species(a, c))
    f = sites.informative_features(s)
    w = fit.group_weights(sites.gene_groups(f, sites.var_site_counts(s)), "std")
    grid = spark.createDataFrame([(0.1, 0.1), (0.1, 0.5)], "lambda1 double, lambda2 double")
    out = fit.fit_grid(f, c, w, grid).collect()
    rows = f.orderBy("gene", "pos", "aa").collect()
    for second in (0.1, 0.5):
        beta, c0 = fit.fit_one(np.array([r["mask"] for r in rows]), np.zeros(len(rows), int), np.array([np.sqrt(len(rows))]), np.array([1.0, -1.0] * 3), 0.1, second, False)
        got = {(r["pos"], r["aa"]): r["weight"] for r in out if r["lambda2"] == second and r["gene"]}
        assert got == pytest.approx({(r["pos"], r["aa"]): b for r, b in zip(rows, beta, strict=True) if b}, abs=1e-8)


def test_report_numbers_and_lists(spark):
    values = [0.0, 0.5, -12.25, 1.0, 10.0, 100.0, 123456.0, 100000.0, 999999.6, 1234567.0, 0.0001, 0.00012, 0.00001234, -3.3333333, 1e-300, 2e22, float("inf"), float("nan"), None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["v"] for r in texts.site_count_csv(d).orderBy(F.col("i").cast("int")).collect()]
    assert got == [None if v is None else f"{v:.6g}" for v in values]
    lists = spark.createDataFrame([([1.0, None, 2.5],), ([],), (None,)], "v array<double>")
    assert [r["v"] for r in texts.site_count_csv(lists).collect()] == ["[1.0, null, 2.5]", "[]", None]


def test_ranks_with_ties(spark):
    d = spark.createDataFrame([(0, v) for v in (1.0, 2.0, 2.0, 3.0)], "k int, v double")
    r = [tuple(x[c] for c in ("avg_rank", "pct_rank", "centred_pct")) for x in with_ranks(d, ["k"], "v").orderBy("v").collect()]
    assert r == [(1.0, 0.25, 0.125), (2.5, 0.625, 0.5), (2.5, 0.625, 0.5), (4.0, 1.0, 0.875)]


def test_alignment_files(spark, tmp_path):
    (tmp_path / "one.fas").write_text(">sp 1\nac?\nGT\n>sp2\nACGTA\n>sp2\nCCCCC\n")
    (tmp_path / "two.FA").write_text(">sp2\nTT\n")
    (tmp_path / "note.txt").write_text("no")
    a = {(r["gene"], r["species"]): r["seq"] for r in alignments.read_alignments(spark, str(tmp_path)).collect()}
    assert a == {("one", "sp 1"): "AC-GT", ("one", "sp2"): "CCCCC", ("two", "sp2"): "TT"}
    b = {(r["gene"], r["species"]): r["seq"] for r in alignments.read_alignments(spark, str(tmp_path), "site_counter").collect()}
    assert b["one", "sp2"] == "ACGTACCCCC" and b["one", "sp 1"] == "ac?GT"
    ok = {r["file"]: r["reason"] for r in alignments.check_two_line(alignments.read_files(spark, str(tmp_path))).collect()}
    assert ok == {"one.fas": "sequence over several lines", "two.FA": ""}
    (tmp_path / "bad.fas").write_text(">a\nAC\n>b\nACG\n")
    with pytest.raises(Exception, match="different sizes"):
        alignments.read_alignments(spark, str(tmp_path)).collect()


def test_resume(spark, tmp_path):
    c = combo(spark, list("ab"), list("cd"), list("ef"))
    done = spark.createDataFrame([(0, 0.1), (2, 0.1)], "combo_idx long, lambda1 double")
    ledger.append_audit(done, str(tmp_path / "audit"), {"step": 0.05, "threads": 4})
    audit = spark.read.json(str(tmp_path / "audit"))
    assert [r[0] for r in ledger.pending(c, audit).select("combo_idx").distinct().collect()] == [1]
    assert ledger.same_config({"threads": 1, "step": 0.05}, audit) and not ledger.same_config({"step": 0.1}, audit)


def test_stream_counts_each_gene_once(spark, tmp_path):
    from cladewise.streaming.counts import stream_site_counts

    folder = tmp_path / "in"
    folder.mkdir()
    text = ">A\nBBBA\n>B\nBBBA\n>C\nAAAA\n>D\nAAAA\n>OG\nAAAA\n"
    (folder / "g1.fas").write_text(text)
    run = lambda: stream_site_counts(spark, str(folder), combo(spark, ["A", "C", "B", "D"]), "OG", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (folder / "g2.fas").write_text(text)
    run()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["gene"], r["true_n"]) for r in out) == [("g1", 3), ("g2", 3)]


def test_checks(spark):
    lines = spark.createDataFrame([(1, "species,value"), (2, "a,1"), (3, "b;2"), (4, "c,x")], "line_no int, line string").withColumn("f", F.lit(0))
    assert [r["line_no"] for r in validate.bad_pheno_lines(lines, ["f"]).orderBy("line_no").collect()] == [3, 4]
    assert {r["species"]: r["value"] for r in texts.read_phenotypes(lines, ["f"]).collect()} == {"a": 1.0}
    with pytest.raises(ValueError):
        validate.check_options(2, (0.1, 0.9))
    assert R.MISSING == ("?", "-", "X", "x")


def test_sequences_are_cancelled_within_their_row(spark):
    a = aln(spark, {"a": "ACGT", "b": "A-GT", "c": "ACGT", "d": "AC-T"})
    filled = sites.fill_species(a, combo(spark, list("abcd")))
    rows = {r["slot"]: r["seq"] for r in sites.cancelled_sequences(filled).collect()}
    assert [rows[i] for i in range(4)] == ["A--T"] * 4
    counts = {r["var_sites"] for r in sites.var_site_counts(sites.explode_sites(filled)).collect()}
    assert counts == {r["var_sites"] for r in sites.variable_site_counts(filled).collect()}


def test_more_designs_than_are_sent_at_once(spark, monkeypatch):
    a = aln(spark, {"a": "AC", "b": "AG", "c": "TC", "d": "TG"})
    many = combo(spark, list("abcd")).drop("combo_idx").crossJoin(spark.range(7).withColumnRenamed("id", "combo_idx"))
    whole = sorted(map(str, sites.fill_species(a, many).collect()))
    monkeypatch.setattr(sites, "DESIGNS_AT_ONCE", 3)
    assert sorted(map(str, sites.fill_species(a, many).collect())) == whole and len(whole) == 7


def fitch_sets(children, names, node, residues):
    """Sets by plain recursion; ``children`` by node."""
    if node not in children:
        r = residues.get(names[node], "-")
        return set() if r in "?-Xx" else {r}
    known = [s for s in (fitch_sets(children, names, c, residues) for c in children[node]) if s]
    return set() if not known else set.intersection(*known) or set.union(*known)


def leaf_names(children, names, node):
    return {names[node]} if node not in children else set().union(*(leaf_names(children, names, c) for c in children[node]))


def test_ancestral_states_against_recursion(spark):
    import random

    rng = random.Random(8)
    nodes = tree_of(spark, "((((A,B),(C,(D,E))),F),((G,H),I,J),K);")
    rows = nodes.collect()
    names, children = {r["node_id"]: r["name"] for r in rows}, {}
    for r in rows:
        if r["parent_id"] is not None:
            children.setdefault(r["parent_id"], []).append(r["node_id"])
    genes = []
    for g in range(60):
        for sp in "ABCDEFGHIJKZ":
            if rng.random() < 0.4:
                genes.append((f"g{g:02d}", sp, "".join(rng.choice("ACD-?Xx") for _ in range(7))))
    wanted = ["A", "C", "D", "F"]
    a = spark.createDataFrame(genes, "gene string, species string, seq string")
    got = {r["gene"]: (r["states"], r["skip_reason"]) for r in tree.ancestral_states(sites.gene_table(a), tree.tree_program(nodes), wanted).collect()}
    skipped = 0
    for g in {x[0] for x in genes}:
        seqs = {sp: s for gene, sp, s in genes if gene == g}
        there = set(seqs) & leaf_names(children, names, 0)
        best = [n for n in names if there & set(wanted) and there & set(wanted) <= leaf_names(children, names, n)]
        node = min(best, key=lambda n: len(leaf_names(children, names, n)), default=None)
        if node is None or there <= leaf_names(children, names, node):
            skipped += 1
            assert got[g][0] is None and got[g][1]
            continue
        assert [set(x) for x in got[g][0]] == [fitch_sets(children, names, node, {sp: s[p] for sp, s in seqs.items()}) for p in range(7)]
    assert skipped and skipped < 50


def test_ambiguous_ancestor_is_not_counted_and_an_outgroup_resolves_it(spark):
    """Golden cases: sets {A, G} without, {A} with a species outside that has A."""
    rows = [("A", "G"), ("B", "G"), ("C", "A"), ("D", "A"), ("E", "A"), ("F", "G")]
    c = combo(spark, ["A", "C", "B", "D"])
    for newick, unambiguous, expected in [("(((A,B),(C,D)),F);", False, 0), ("((((A,B),E),(C,D)),F);", False, 1), ("((((A,B),E),(C,D)),F);", True, 1), ("(((A,B),(C,D)),F);", True, 0)]:
        at = sitecount.ancestral_pair_sites(aln(spark, dict(rows)), c, tree.tree_program(tree_of(spark, newick)))
        assert [int(r["is_ccs"]) for r in sitecount.flag_sites(at, states="states", unambiguous=unambiguous).collect()] == [expected]
    whole = sitecount.skipped_genes(aln(spark, dict(rows[:4])), c, tree.tree_program(tree_of(spark, "((A,B),(C,D));")))
    assert whole.count() == 1


def test_forty_pairs_flip_by_rank(spark):
    """A range of the ranks of forty pairs; for six pairs all ranks are the subsets in order."""
    forty = combo(spark, [f"s{i}" for i in range(80)])
    some = design.null_flips(forty, ["combo_idx"], 68_923_264_400, 100).filter("slot % 2 = 0").collect()
    assert {r["flip"] for r in some} == set(range(68_923_264_400, 68_923_264_410))
    for flip in {r["flip"] for r in some}:
        swapped = [r["slot"] // 2 for r in some if r["flip"] == flip and int(r["species"][1:]) % 2]
        assert len(swapped) == 20 and 0 in swapped
    six = design.null_flips(combo(spark, [f"s{i}" for i in range(12)]), ["combo_idx"]).filter("slot % 2 = 0").collect()
    masks = {}
    for r in six:
        masks[r["flip"]] = masks.get(r["flip"], 0) | (int(r["species"][1:]) % 2) << r["slot"] // 2
    assert [masks[k] for k in sorted(masks)] == [m for m in range(64) if m.bit_count() == 3 and m & 1]
    with pytest.raises(Exception, match="more than 62 pairs"):
        design.null_flips(combo(spark, [f"s{i}" for i in range(256)]), ["combo_idx"], 0, 5).collect()


def test_a_range_of_a_large_product(spark):
    groups = spark.createDataFrame([(0, k, ["a", "b", "c"]) for k in range(36)], "design int, line_no int, members array<string>")
    last = 3**36 - 1
    got = design.expand_combos(groups, last - 1, 50).collect()
    assert {r["combo_idx"] for r in got} == {last - 1, last} and "".join(r["species"] for r in sorted(got, key=lambda r: (r["combo_idx"], r["slot"]))) == "c" * 35 + "b" + "c" * 36
    with pytest.raises(Exception, match="too many combinations"):
        design.expand_combos(groups.unionByName(groups.withColumn("line_no", F.col("line_no") + 36)), 0, 5).collect()


def test_ranks_of_all_rows_hold_no_window_of_all(spark):
    from cladewise.functions.ranks import value_counts

    df = spark.range(5000).select((F.col("id") * 7919 % 997).alias("v"))
    got = {r["v"]: (r["ties"], r["below"], r["total"]) for r in value_counts(df, [], "v").collect()}
    values = sorted(i * 7919 % 997 for i in range(5000))
    assert got == {v: (values.count(v), values.index(v), 5000) for v in set(values)}
    assert value_counts(df.limit(0), [], "v").count() == 0


def test_random_pairs_respect_exclusions(spark):
    nodes = tree_of(spark, "(((A:1,B:1):1,(C:1,D:1):1):1,((E:1,F:1):1,(G:0.1,H:0.1):1):1,(I:1,J:1):1);")
    anc = tree.closure(nodes)
    names = {r["node_id"]: r["name"] for r in nodes.collect()}
    excluded = nodes.filter("name IN ('A', 'J')").select("tree_id", "node_id")
    for seed in (1, 2):
        found = pairs.random_pairs_with_exclusions(nodes, anc, excluded, 2, 2, 1.0, seed)
        rows = found.collect()
        assert len(rows) == 4 and not {"A", "J"} & {names[r[c]] for r in rows for c in ("conv", "ctrl")}
        assert {frozenset((names[r["conv"]], names[r["ctrl"]])) & set("GH") for r in rows} <= {frozenset(), frozenset("G"), frozenset("H")}
        assert [tuple(r)[2:] for r in pairs.pair_violations(found, anc, excluded, 1.0).collect()] == [(2, 0), (2, 0)]
    bad = spark.createDataFrame([(r["tree_id"], 0, k, r["conv"], r["ctrl"], r["mrca"]) for k, r in enumerate(rows[:1] * 2)], "tree_id long, set_id int, pair int, conv long, ctrl long, mrca long")
    assert pairs.pair_violations(bad, anc, excluded, 1.0).collect()[0]["violations"] > 0
    with pytest.raises(ValueError, match="no 4 such pairs"):
        pairs.random_pairs_with_exclusions(nodes, anc, excluded, 1, 4, 1.0, 1, attempts=2)


def test_best_pairs_need_not_all_pairs(spark):
    """The choice is that among all candidates, on random trees with ties and missing branch lengths."""
    import random

    rng = random.Random(6)

    def grown(depth):
        kids = [grown(depth - 1) if depth and rng.random() < 0.6 else f"L{rng.randrange(10**9)}" for _ in range(rng.choice((2, 2, 3, 5)))]
        return "(" + ",".join(k + ("" if rng.random() < 0.1 else f":{rng.randrange(1, 6) / 2}") for k in kids) + ")"

    from cladewise.sources.trees import parse_trees

    nodes = parse_trees(spark.createDataFrame([(k, grown(4) + ";") for k in range(12)], "tree_id long, newick string"))
    anc = tree.closure(nodes)
    tips = [(r["tree_id"], r["node_id"], float(rng.choice((-1, 0, 1, 2, 2, 3, 5, 8, 13)))) for r in tree.leaves(nodes).collect()]
    pheno = spark.createDataFrame(tips, "tree_id long, node_id long, value double")
    thresholds = [0.0, 40.0, 160.0]
    ladder = pheno.select("tree_id").distinct().withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    key = lambda df: sorted(map(tuple, df.select("tree_id", "threshold", "conv", "ctrl", "mrca", "dist").collect()))
    every = key(pairs.greedy_select(pairs.pct_candidates(pheno, anc).filter("pct > 0"), anc, thresholds))
    assert every and key(pairs.pct_select(pheno, anc, nodes, ladder)) == every


def test_random_sets_of_a_clade(spark):
    """Each set draws from both sides, sets differ by their seed alone, and clades without a side have no row."""
    edges = [(1, 10, k) for k in range(1, 7)] + [(1, 20, k) for k in range(7, 9)]
    anc = spark.createDataFrame([(t, a, n) for t, a, n in edges], "tree_id long, anc_id long, node_id long")
    labels = {1: 1, 2: 1, 3: 1, 4: -1, 5: -1, 6: 0, 7: 1, 8: 1}
    traits = spark.createDataFrame([(1, k, v) for k, v in labels.items()] + [(1, 1, 1)], "tree_id long, node_id long, label int")
    clades = spark.createDataFrame([(1, 10), (1, 10), (1, 20)], "tree_id long, mrca long")
    draw = lambda n, seed, more=3: {r["set_id"] + seed: (r["mrca"], r["conv"], r["ctrl"]) for r in pairs.random_sets(clades, anc, traits, n, seed, more).collect()}
    sets = draw(40, 5)
    assert set(sets) == set(range(5, 45)) and {x[0] for x in sets.values()} == {10}
    assert all(sorted(x[1]) == [1, 2, 3] and sorted(x[2]) == [4, 5] for x in sets.values())
    assert {x[1][0] for x in sets.values()} == {1, 2, 3} and {x[2][0] for x in sets.values()} == {4, 5}
    later = draw(2, 30, 0)
    assert later == {k: (10, sets[k][1][:1], sets[k][2][:1]) for k in (30, 31)}
    assert pairs.random_sets(clades.limit(0), anc, traits, 3).count() == 0
