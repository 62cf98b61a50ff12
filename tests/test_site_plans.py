"""What plans of site queries do once: sequences dealt, values counted, sets spelled."""

from cladewise.operators import sitecount, sites, tree
from cladewise.plans import adapters, site_queries  # noqa: F401
from cladewise.plans.registry import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_are_not_grouped_ahead_of_their_shuffle(spark):
    aln = spark.createDataFrame([("g", "a", "AC"), ("g", "b", "A-"), ("h", "a", "D")], "gene string, species string, seq string")
    genes = sites.gene_table(aln)
    plan = _plan(genes)
    assert plan.count("Exchange hashpartitioning(gene") == 1 and "Aggregate" not in plan.split("Exchange hashpartitioning(gene")[1]
    assert {r["gene"]: (r["n"], r["by_species"]) for r in genes.collect()} == {"g": (2, {"a": "AC", "b": "A-"}), "h": (1, {"a": "D"})}


def test_sets_are_spelled_in_tasks(spark, sf_dir):
    nodes = adapters.species_tree(spark)
    aln = spark.createDataFrame([("g", "sp00", "AA-"), ("g", "sp01", "AC-"), ("g", "sp08", "DDz")], "gene string, species string, seq string")
    got = tree.ancestral_states(sites.gene_table(aln), tree.tree_program(nodes), ["sp00", "sp01"])
    assert "shiftright" not in _plan(got)
    assert [r["states"] for r in got.collect()] == [[["A"], ["A", "C"], []]]


def test_counts_are_made_once(spark, sf_dir, monkeypatch):
    counts = spark.createDataFrame([("g", 0, 3, 1), ("h", 0, 1, 1)], "gene string, combo_idx long, true_n long, ctrl_n long")
    passes = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    top = sitecount.top_fraction(counts.mapInArrow(count, counts.schema), "true", 0.5)
    assert sorted(map(tuple, top.collect())) == [("g", 1), ("h", 0)] and passes.value == 2


def test_stored_designs_read_the_alignment_once(spark, sf_dir, monkeypatch):
    made, real = [], adapters.alignment
    monkeypatch.setattr(adapters, "alignment", lambda s, d: made.append(d) or real(s, d))
    QUERIES["S13_artefacts"](spark, sf_dir)
    assert len(made) == 1
