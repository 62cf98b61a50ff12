"""Files by name, written by tasks, and alignments read back in one shuffle."""

import re

from cladewise.sources import alignments, texts
from cladewise.sources.tables import write_named


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan)), "Join" in plan


def test_named_files(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.txt").write_text("old")
    rows = [(f"part {i % 3}/{i} 100%+é.txt", f"text {i}\nof two lines") for i in range(40)] + [("plain.txt", None)]
    files = spark.createDataFrame(rows, "file string, value string").repartition(4)
    for path in (f"file://{tmp_path}/out", f"{tmp_path}/in a folder"):
        for _ in range(2):
            write_named(files, path)
    write_named(files.unionByName(files), f"file://{tmp_path}/twice")  # as if all tasks ran again
    for folder in ("out", "in a folder", "twice"):
        found = {str(p.relative_to(tmp_path / folder)): p.read_text() for p in (tmp_path / folder).rglob("*") if p.is_file()}
        assert found == {name: f"{value or ''}\n" for name, value in rows}
    back = {r["file"]: r["text"] for r in alignments.read_files(spark, f"file://{tmp_path}/out", "*.txt").collect()}
    assert back == {name.split("/")[-1]: f"{value or ''}\n" for name, value in rows}


def test_models_whose_names_agree_share_a_file(spark, tmp_path):
    coef = spark.createDataFrame([(0, 0.1, 0.2, "g", 1, "A", 1.0), (0, 0.1000001, 0.2, "g", 2, "C", 2.0)], "combo_idx long, lambda1 double, lambda2 double, gene string, pos int, aa string, weight double")
    models = spark.createDataFrame([(0, 0.1, 0.2, 3.0), (0, 0.1000001, 0.2, 4.0)], "combo_idx long, lambda1 double, lambda2 double, intercept double").repartition(2, "lambda1")
    texts.write_models(coef, models, f"file://{tmp_path}/m")
    lines = [x.split("\t")[0] for p in (tmp_path / "m").glob("model*") for x in p.read_text().splitlines()]
    assert sorted(lines) == ["Intercept", "Intercept", "g_1_A", "g_2_C"]


def test_empty_files_are_found_in_sub_folders(spark, tmp_path):
    for name in ("a/x.fas", "a/b/y.fas", "a/.z.fas", "_c/w.fas", "v.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / "a" / "full.fas").write_text(">s\nA\n")
    assert sorted(r["file"] for r in alignments.read_files(spark, f"file://{tmp_path}").collect()) == ["full.fas", "x.fas", "y.fas"]


def test_sequences_are_shuffled_once_when_parsed(spark):
    files = spark.createDataFrame([("g.fas", ">a\nAC\n>b\nA?\n>a\nGG\n")], "file string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        aln = alignments.parse_alignments(files)
        assert _shuffles(aln) == (1, False)
        assert sorted(map(tuple, aln.collect())) == [("g", "a", "GG", 2), ("g", "b", "A-", 2)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
