"""Trees of many leaves: pairs meet in blocks, no level is sent through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from cladewise.operators import pairs, tree


@pytest.fixture(scope="module")
def grown(spark):
    draw, rows, traits = random.Random(3), [], []
    for t in range(3):
        rows.append((t, 0, None, None, 0, 0))
        depth = {0: 0}
        for n in range(1, 40):
            parent = draw.randrange(min(n, 12))
            depth[n] = depth[parent] + 1
            rows.append((t, n, parent, draw.choice([None, 0.1, 0.25, 1.0, 0.125]), depth[n], n))
        inner = {r[2] for r in rows if r[0] == t}
        traits += [(t, n, float(draw.choice([-1, 0, 1, 2, 3, 5, 512, 513]))) for n in depth if n not in inner]
    nodes = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, branch_length double, depth int, ord int")
    return nodes, tree.closure(nodes).cache(), spark.createDataFrame(traits, "tree_id long, node_id long, value double")


def rows_of(d):
    return sorted(map(tuple, d.collect()))


def test_pairs_met_in_blocks(spark, grown, monkeypatch):
    _, anc, traits = grown
    monkeypatch.setattr(pairs, "MET_AT_ONCE", 2)
    held = [tuple(r) for r in traits.collect()]
    want = sorted((t, a, b) for t, a, x in held for u, b, y in held if t == u and x > y > 0)
    found = pairs.trait_pairs(traits).cache()
    assert [r[:3] for r in rows_of(found)] == want
    assert all(abs(r["pct"] * 1e6 - round(r["pct"] * 1e6)) < 1e-3 for r in found.collect())
    far = tree.distances(anc, found.select("tree_id", F.col("conv").alias("a"), F.col("ctrl").alias("b"))).withColumnsRenamed({"a": "conv", "b": "ctrl"})
    both = pairs.pct_candidates(traits, anc).cache()
    assert rows_of(both) == rows_of(found.join(far, ["tree_id", "conv", "ctrl"]).select(both.columns))
    most = both.groupBy("tree_id", "mrca").agg(F.max("pct").alias("pct"))
    assert rows_of(pairs.most_contrast(traits, anc)) == rows_of(most)
    keys = pairs.trait_pairs(traits)._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in keys


def test_levels_are_not_broadcast(spark, grown):
    nodes, _, traits = grown
    sets = traits.select(F.lit(0).alias("site"), "tree_id", "node_id", F.lit(1).cast("long").alias("mask"))
    down = tree.fitch_down(sets, nodes)
    for plan in (down, tree.fitch_up(down, nodes), tree.leaf_layout(nodes)):
        assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString().split("LeftAnti")[0]


def test_trees_without_a_free_clade_are_told_at_once(spark, grown):
    nodes, anc, _ = grown
    every = tree.leaves(nodes).select("tree_id", "node_id")
    with pytest.raises(ValueError, match="3 trees"):
        pairs.random_pairs_with_exclusions(nodes, anc, every, 2, 1, 0.0)
