"""Files and stores: trees of both formats, model files, artefacts by design, restarts."""

import pytest
from pyspark.sql import functions as F

from cladewise.operators import ledger, score
from cladewise.sources import alignments, artefacts, texts, trees

NEXUS = """#NEXUS
Begin taxa; Dimensions ntax=3; End;
BEGIN TREES;
  Translate 1 Homo_sapiens, 2 'Mus ''x'' musculus', 3 Rattus;
  tree first = [&R] ((1:0.1,2:0.2)inner:0.05,3:1e-2);
  TREE * 'the second' = (3,(2,1));
END;
"""


def test_tree_files(spark, tmp_path):
    cases = {
        "a.nex": NEXUS, "b.nwk": "((A:1,B:2):0.5,'C d':3);", "c.nwk": "this is not a tree", "d.nwk": "((A,B);", "e.nwk": "Solo;", "f.nwk": "(A:x,B);", "g.nex": "#nexus\nbegin data; end;",
        "h.nwk": "", "i.nwk": "((A,B));C)", "j.nwk": "(A B,C);",
    }
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    files = alignments.read_files(spark, str(tmp_path), "*")
    rows = trees.parse_tree_files(files).collect()
    faults = {r["file"]: r["fault"] for r in rows if r["fault"]}
    assert faults == {"c.nwk": "no tree", "d.nwk": "unbalanced brackets", "f.nwk": "branch length is no number", "g.nex": "no block of trees", "h.nwk": "empty", "j.nwk": "label after label"}
    named = sorted((r["tree_no"], r["tree_name"], r["name"], r["branch_length"], r["depth"]) for r in rows if r["file"] == "a.nex" and r["name"])
    assert named == [
        (0, "first", "Homo_sapiens", 0.1, 2), (0, "first", "Mus 'x' musculus", 0.2, 2), (0, "first", "Rattus", 0.01, 1), (0, "first", "inner", 0.05, 1),
        (1, "the second", "Homo_sapiens", None, 2), (1, "the second", "Mus 'x' musculus", None, 2), (1, "the second", "Rattus", None, 1),
    ]
    assert [r["name"] for r in rows if r["file"] == "e.nwk"] == ["Solo"] and "C d" in [r["name"] for r in rows if r["file"] == "b.nwk"]


def test_trees_written_and_parsed(spark):
    nodes = trees.parse_trees(spark.createDataFrame([(1, "((A:1.5,'B c':2)x:0.5,(D,E)y,F)root;"), (2, "((((A,B),C),D),E);")], "tree_id long, newick string"))
    again = trees.parse_trees(trees.newick_texts(nodes))
    key = lambda df: sorted(map(tuple, df.select("tree_id", "name", "branch_length", "depth").collect()), key=repr)
    assert key(again) == key(nodes)


def test_model_files(spark, tmp_path):
    coef = spark.createDataFrame([(0, 0.1, 0.25, "g_1", 7, "A", 0.1 + 0.2), (0, 0.1, 0.25, "g_1", 12, "C", -1e-7), (3, 0.12346, 1.0, "g2", 0, "D", 2.0)], "combo_idx long, lambda1 double, lambda2 double, gene string, pos int, aa string, weight double")
    models = spark.createDataFrame([(0, 0.1, 0.25, -0.5), (3, 0.12346, 1.0, 1 / 3), (4, 0.5, 0.5, 0.0)], "combo_idx long, lambda1 double, lambda2 double, intercept double")
    texts.write_models(coef, models, f"file://{tmp_path}/m")
    names = sorted(p.name for p in (tmp_path / "m").glob("model*"))
    assert names == ["model_combo_0_l1_0.1_l2_0.25_out_feature_weights.txt", "model_combo_3_l1_0.12346_l2_1.0_out_feature_weights.txt", "model_combo_4_l1_0.5_l2_0.5_out_feature_weights.txt"]
    text = (tmp_path / "m" / names[0]).read_text().split("\n")
    assert [x.split("\t")[0] for x in text if x] == ["g_1_7_A", "g_1_12_C", "Intercept"] and float(text[0].split("\t")[1]) == 0.1 + 0.2
    c, m = texts.read_models(spark, f"file://{tmp_path}/m")
    order = lambda df, cols: sorted(map(tuple, df.select(cols).collect()))
    assert order(c, coef.columns) == order(coef, coef.columns) and order(m, models.columns) == order(models, models.columns)
    aln = spark.createDataFrame([("g_1", "x", "-------A"), ("g_1", "y", "-------C"), ("g_1", "t", "-------A"), ("g2", "x", "D")], "gene string, species string, seq string")
    training = spark.createDataFrame([(0, "t")], "combo_idx long, species string")
    got = {(r["combo_idx"], r["species"]): r["sps"] for r in score.predict_saved(c, m, aln, training, ["combo_idx", "lambda1", "lambda2"]).collect()}
    assert got == {(0, "x"): pytest.approx(-0.2), (3, "x"): pytest.approx(2 + 1 / 3)}


def test_artefacts_survive_a_killed_run(spark, tmp_path):
    root, settings = f"file://{tmp_path}/store", {"min_pairs": 2}
    table = lambda designs, v: spark.createDataFrame([(c, f"g{i}", v) for c in designs for i in range(3)], "combo_idx long, gene string, v double")
    built = []

    def build(designs):
        built.append(designs)
        return {"feature": table(designs, 1.0), "response": table(designs, 2.0)}

    assert artefacts.finished(spark, root, settings) == []
    artefacts.reuse_designs(spark, root, settings, [0, 1], build)
    artefacts.write_attempt(spark, root, {"feature": table([1, 2], 9.0)})  # killed before its manifest
    (tmp_path / "store" / "manifests" / "_half.tmp").write_text('{"settings"')
    got = artefacts.reuse_designs(spark, root, settings, [0, 1, 2], build)
    assert built == [[0, 1], [2]] and {r["combo_idx"] for r in got["feature"].collect()} == {0, 1, 2}
    assert got["feature"].agg(F.sum("v"), F.count("*")).first()[:] == (9.0, 9) and got["response"].columns == ["combo_idx", "gene", "v"]
    artefacts.save(spark, root, settings, {"feature": table([1], 5.0), "response": table([1], 5.0)})
    assert artefacts.load(spark, root, settings)["feature"].filter("combo_idx = 1").agg(F.sum("v")).first()[0] == 15.0
    assert artefacts.finished(spark, root, {"min_pairs": 3}) == [] and artefacts.discard_unfinished(spark, root) == 1
    assert artefacts.load(spark, root, settings)["feature"].count() == 9


def test_restart(spark, tmp_path):
    path, rows = f"file://{tmp_path}/run", spark.createDataFrame([(0, 0.5), (1, 0.5)], "combo_idx long, rmse double")
    assert ledger.start_run(spark, path, {"grid": 3}).count() == 0
    ledger.append_audit(rows, path, {"grid": 3})
    assert ledger.start_run(spark, path, {"grid": 3, "threads": 9}).count() == 2
    with pytest.raises(ValueError, match="other settings"):
        ledger.start_run(spark, path, {"grid": 4})
    assert ledger.start_run(spark, path, {"grid": 4}, force=True).count() == 0 and not (tmp_path / "run").exists()


def test_faulty_lists(spark):
    aln = spark.createDataFrame([("g1", "a", "A")], "gene string, species string, seq string")
    lines = spark.createDataFrame([(1, "x/g1.fas"), (2, "g9")], "line_no int, line string")
    assert [tuple(r) for r in alignments.ordered_genes(lines.limit(1), aln, []).collect()] == [("g1", 1)]
    with pytest.raises(Exception, match="listed gene g9"):
        alignments.ordered_genes(lines, aln, []).collect()
    groups = spark.createDataFrame([(0, 1, "a,b"), (0, 2, "c"), (0, 3, "d"), (1, 1, "e,,f"), (1, 2, "g")], "file int, line_no int, line string")
    with pytest.raises(Exception, match="odd number"):
        texts.read_groups(groups.filter("file = 0"), ["file"]).collect()
    with pytest.raises(Exception, match="empty member"):
        texts.read_groups(groups.filter("file = 1"), ["file"]).collect()


def test_folders(spark, tmp_path):
    for name, text in {"b.txt": "x\t1\ny\t0\n", "a.txt": "x,-1\nz,2.5", "skip.csv": "q,1"}.items():
        (tmp_path / name).write_text(text)
    got = sorted(map(tuple, texts.read_response_folder(spark, f"file://{tmp_path}").select("combo_idx", "species", "y").collect()))
    assert got == [(0, "x", -1.0), (0, "z", 2.5), (1, "x", 1.0)]
    (tmp_path / "empty.fas").write_text("")
    with pytest.raises(Exception, match="no sequence in empty.fas"):
        alignments.read_alignments(spark, f"file://{tmp_path}/empty.fas").collect()
    aln = spark.createDataFrame([("g 1", "a", "AC"), ("g 1", "b", "A-"), ("g%2", "a", "D")], "gene string, species string, seq string")
    alignments.write_alignments(aln, f"file://{tmp_path}/aln")
    assert sorted(p.name for p in (tmp_path / "aln").glob("*.fas")) == ["g 1.fas", "g%2.fas"]
    back = alignments.read_alignments(spark, f"file://{tmp_path}/aln").select("gene", "species", "seq")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, aln.collect()))


def test_converted_folders_keep_their_place(spark, tmp_path):
    source = tmp_path / "in"
    (source / "a b" / "c").mkdir(parents=True)
    (source / "top.fasta").write_text(">x\nAC\nGT\n>y\nTT\nGG\n")
    (source / "a b" / "c" / "deep.fa").write_text(">z\nA\nC\n")
    (source / "note.txt").write_text("no alignment")
    alignments.convert_folder(spark, f"file://{source}", f"file://{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_text().strip() for p in (tmp_path / "out").rglob("*.fas")}
    assert found == {"top.fas": ">x\nACGT\n>y\nTTGG", "a b/c/deep.fas": ">z\nAC"}


def test_prediction_text(spark, tmp_path):
    rows = [(2, "b,c", 0.1, 1, 1 / 3, "x", -2.0, None), (0, "a", 0.5, 3, 12.345678, 'q"r', 1e-16, "1")]
    p = spark.createDataFrame(rows, "combo_idx long, species_combo string, lambda1 double, num_genes int, input_RMSE double, species string, SPS double, true_phenotype string")
    texts.write_prediction_text(p, f"file://{tmp_path}/p")
    files = sorted((tmp_path / "p").glob("part-*"))
    lines = [x for f in files for x in f.read_text().splitlines() if not x.startswith("species_combo")]
    digits = f"{12.345678:.15f}".rstrip("0")
    assert lines == [f'a,0.5,3,{digits},"q""r",0,1', '"b,c",0.1,1,0.333333333333333,x,-2,']
