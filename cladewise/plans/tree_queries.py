"""Queries over trees and contrast pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, pairs, tree, validate
from ..sources.tables import checkpointed
from . import adapters as A
from .registry import query


def _anc(s, d):
    return tree.closure(A.trees(s, d))


@query("T1_closure", f"WITH {A.ANC} SELECT tree_id, node_id, anc_id, round(dist, 6) AS dist, hops, lacking FROM anc")
def t1(s, d):
    return _anc(s, d).withColumn("dist", F.round("dist", 6))


#: Sets of leaves: a nation's customers of one market segment and remainder.
_SETS = "sets AS (SELECT CAST(c_nationkey AS BIGINT) * 1000 + c_custkey % 48 AS set_id, CAST(c_nationkey AS BIGINT) AS tree_id, c_custkey + 10000 AS node_id FROM customer)"
_MRCA = f"""{A.ANC}, {_SETS}, ca AS (SELECT set_id, a.tree_id, anc_id, count(*) AS n FROM sets JOIN anc a USING (tree_id, node_id) GROUP BY ALL), sz AS (SELECT set_id, count(*) AS size FROM sets GROUP BY ALL),
mrca AS (SELECT set_id, tree_id, arg_max(anc_id, depth) AS mrca FROM ca JOIN sz USING (set_id) JOIN tree_node t USING (tree_id) WHERE n = size AND t.node_id = anc_id GROUP BY ALL)"""


def _sets(s, d):
    c = A.table(s, d, "customer")
    return c.select((F.col("c_nationkey").cast("long") * 1000 + F.col("c_custkey") % 48).alias("set_id"), F.col("c_nationkey").cast("long").alias("tree_id"), (F.col("c_custkey") + 10000).alias("node_id"))


@query("T2_mrca", f"WITH {_MRCA} SELECT set_id, mrca FROM mrca")
def t2(s, d):
    return tree.mrca(_anc(s, d), _sets(s, d), A.trees(s, d))


@query("T3_mrca_is_root", f"""WITH {_MRCA}, tot AS (SELECT tree_id, count(*) AS total FROM tree_node WHERE depth = 4 GROUP BY ALL)
SELECT set_id, (SELECT count(*) FROM anc a WHERE a.tree_id = m.tree_id AND a.anc_id = m.mrca AND a.node_id >= 10000) = total AS is_root FROM mrca m JOIN tot USING (tree_id)""")
def t3(s, d):
    anc, nodes, sets = _anc(s, d), A.trees(s, d), _sets(s, d)
    return tree.mrca_is_root(anc, nodes, tree.mrca_of_tree(anc, sets, nodes), sets.select("tree_id", "node_id").distinct())


@query("T4_prune", f"""WITH {A.ANC}, kp AS (SELECT DISTINCT tree_id, anc_id AS node_id FROM anc WHERE node_id >= 10000 AND node_id % 3 = 0),
wp AS (SELECT tree_id, node_id, parent_id FROM kp JOIN tree_node USING (tree_id, node_id)), kd AS (SELECT tree_id, parent_id AS node_id, count(*) AS kids FROM wp WHERE parent_id IS NOT NULL GROUP BY ALL),
so AS (SELECT tree_id, node_id FROM wp LEFT JOIN kd USING (tree_id, node_id) WHERE kids IS NULL OR kids >= 2),
ne AS (SELECT s.tree_id, s.node_id, arg_min(a.anc_id, a.hops) AS parent_id, round(arg_min(a.dist, a.hops), 6) AS dist FROM so s JOIN anc a USING (tree_id, node_id) JOIN so p ON p.tree_id = a.tree_id AND p.node_id = a.anc_id WHERE a.hops > 0 GROUP BY ALL)
SELECT tree_id, node_id, coalesce(parent_id, -1) AS parent_id, coalesce(dist, -1) AS dist FROM so LEFT JOIN ne USING (tree_id, node_id)""")
def t4(s, d):
    keep = _sets(s, d).filter("node_id % 3 = 0")
    return tree.prune(A.trees(s, d), _anc(s, d), keep).na.fill(-1)


_TP = """tp AS (SELECT a.tree_id, a.node_id AS conv, b.node_id AS ctrl, round((a.value - b.value) / b.value * 100, 6) AS pct FROM trait a JOIN trait b ON a.tree_id = b.tree_id AND a.value > b.value AND b.value > 0)"""
_CAND = f"""{A.ANC}, {A.TRAIT}, {_TP}, cm AS (SELECT p.tree_id, p.conv, p.ctrl, p.pct, x.anc_id, x.hops + y.hops AS h, CASE WHEN x.lacking + y.lacking > 0 THEN (x.hops + y.hops)::DOUBLE ELSE x.dist + y.dist END AS far
  FROM tp p JOIN anc x ON x.tree_id = p.tree_id AND x.node_id = p.conv JOIN anc y ON y.tree_id = p.tree_id AND y.node_id = p.ctrl AND y.anc_id = x.anc_id),
cand AS (SELECT tree_id, conv, ctrl, pct, arg_min(anc_id, h) AS mrca, round(arg_min(far, h), 6) AS dist FROM cm GROUP BY ALL)"""


def _candidates(s, d):
    return pairs.pct_candidates(A.traits(s, d), checkpointed(_anc(s, d)))


@query("J7_trait_pairs", f"WITH {A.TRAIT}, {_TP} SELECT tree_id, conv, ctrl, pct FROM tp")
def j7(s, d):
    return pairs.trait_pairs(A.traits(s, d))


@query("T5_P1_pct_candidates", f"WITH {_CAND} SELECT tree_id, conv, ctrl, pct, mrca, dist FROM cand")
def p1(s, d):
    return _candidates(s, d)


def _greedy_sql(thresholds: str) -> str:
    """The choice by recursion: one candidate of a tree and threshold at a step, with what is taken and what lies above that."""
    return f"""WITH RECURSIVE {_CAND}, th AS ({thresholds}), bs AS (SELECT tree_id, threshold, mrca, min((dist, -pct, conv, ctrl)) AS x FROM cand JOIN th USING (tree_id) WHERE pct >= threshold GROUP BY ALL),
up_list AS (SELECT tree_id, node_id AS mrca, list(anc_id) AS above FROM anc GROUP BY ALL),
bo AS (SELECT tree_id, threshold, mrca, x, above, row_number() OVER (PARTITION BY tree_id, threshold ORDER BY x) AS k FROM bs JOIN up_list USING (tree_id, mrca)),
rec AS (SELECT tree_id, threshold, 0::BIGINT AS k, []::BIGINT[] AS taken, []::BIGINT[] AS over_list FROM bo GROUP BY ALL
  UNION ALL SELECT r.tree_id, r.threshold, b.k, CASE WHEN list_contains(over_list, b.mrca) OR list_has_any(taken, above) THEN taken ELSE list_append(taken, b.mrca) END,
    CASE WHEN list_contains(over_list, b.mrca) OR list_has_any(taken, above) THEN over_list ELSE list_concat(over_list, above) END
  FROM rec r JOIN bo b ON b.tree_id = r.tree_id AND b.threshold = r.threshold AND b.k = r.k + 1),
fin AS (SELECT tree_id, threshold, arg_max(taken, k) AS taken FROM rec GROUP BY ALL)"""


_THRESHOLDS = [0.0, 25.0, 50.0, 150.0]


def _thresholds(s, d):
    return A.traits(s, d).select("tree_id").distinct().withColumn("threshold", F.explode(F.array(*map(F.lit, _THRESHOLDS))))


@query("P2_W11_pct_select", f"{_greedy_sql('SELECT tree_id, unnest([0.0::DOUBLE, 25.0, 50.0, 150.0]) AS threshold FROM (SELECT DISTINCT tree_id FROM trait)')} SELECT tree_id, threshold, x[3] AS conv, x[4] AS ctrl, mrca, x[1] AS dist FROM fin JOIN bo USING (tree_id, threshold) WHERE list_contains(taken, mrca)")
def p2(s, d):
    """Pairs chosen greedily in each tree at four thresholds."""
    return pairs.pct_select(A.traits(s, d), checkpointed(_anc(s, d)), A.trees(s, d), _thresholds(s, d))


@query("P3_pct_sweep", f"{_greedy_sql('SELECT tree_id, unnest([0.0::DOUBLE, 10.0, 100.0, 1000.0, 10000.0]) AS threshold FROM (SELECT DISTINCT tree_id FROM trait)')} SELECT tree_id, threshold, len(taken)::BIGINT AS n FROM fin")
def p3(s, d):
    t = A.traits(s, d)
    points = t.select("tree_id").distinct().withColumn("threshold", F.explode(F.array(*map(F.lit, [0.0, 10.0, 100.0, 1000.0, 10000.0]))))
    return pairs.sweep(t, checkpointed(_anc(s, d)), A.trees(s, d), points).filter("n > 0")


_LADDER = """SELECT DISTINCT tree_id, round(t, 6) AS threshold FROM (SELECT tree_id, most, unnest(CASE WHEN most <= 0 THEN [0.0::DOUBLE] ELSE list_concat(list_transform(range(25), lambda i: least(most, 1000.0) * i / 24), CASE WHEN most > 1000 THEN [most] ELSE [] END) END) AS t
  FROM (SELECT tree_id, (max(value) - min(value)) / min(value) * 100 AS most FROM trait WHERE value > 0 GROUP BY ALL))"""


@query("P3_default_ladder", f"{_greedy_sql(_LADDER)} SELECT tree_id, threshold, coalesce(len(taken), 0)::BIGINT AS n FROM th LEFT JOIN fin USING (tree_id, threshold)")
def p3_ladder(s, d):
    """How many pairs each of the default thresholds of a tree leaves."""
    t = A.traits(s, d)
    return pairs.sweep(t, checkpointed(_anc(s, d)), A.trees(s, d), checkpointed(pairs.default_ladder(t)))


def _level(depth: int, source: str) -> str:
    return f"""u{depth} AS (SELECT site, tree_id, parent_id AS node_id, CASE WHEN coalesce(bit_and(mask) FILTER (mask <> 0), 0) <> 0 THEN bit_and(mask) FILTER (mask <> 0) ELSE bit_or(mask) END AS mask
  FROM {source} JOIN tree_node USING (tree_id, node_id) GROUP BY site, tree_id, parent_id)"""


_FITCH = f"{A.TREE}, {A.LEAF}, {_level(3, 'leaf')}, {_level(2, 'u3')}, {_level(1, 'u2')}, {_level(0, 'u1')}, fit AS (SELECT * FROM leaf UNION ALL SELECT * FROM u3 UNION ALL SELECT * FROM u2 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM u0)"


def _fitch(s, d):
    return tree.fitch_down(A.leaf_sets(s, d), A.trees(s, d))


@query("T6_U4_fitch_down", f"WITH {_FITCH} SELECT site, tree_id, node_id, mask FROM fit")
def t6(s, d):
    return _fitch(s, d)


_PICK = "CASE WHEN f.mask = 0 THEN '?' ELSE chr(65 + CAST(round(log2(f.mask & -f.mask)) AS INT)) END"


def _down(depth: int) -> str:
    return f"""d{depth} AS (SELECT f.site, f.tree_id, f.node_id, CASE WHEN p.state <> '?' AND f.mask & (1::BIGINT << (ascii(p.state) - 65)) <> 0 THEN p.state ELSE {_PICK} END AS state
  FROM fit f JOIN tree_node t USING (tree_id, node_id) JOIN d{depth - 1} p ON p.site = f.site AND p.tree_id = f.tree_id AND p.node_id = t.parent_id WHERE t.depth = {depth})"""


_STATES = f"{_FITCH}, d0 AS (SELECT f.site, f.tree_id, f.node_id, {_PICK} AS state FROM fit f WHERE node_id = 1), {_down(1)}, {_down(2)}, {_down(3)}, {_down(4)}, st AS (" + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(5)) + ")"


@query("T7_fitch_up", f"WITH {_STATES} SELECT site, tree_id, node_id, state FROM st")
def t7(s, d):
    return tree.fitch_up(checkpointed(_fitch(s, d)), A.trees(s, d))


@query("T8_ancestral_sequence", f"WITH {_STATES} SELECT tree_id, node_id, string_agg(state, '' ORDER BY site) AS seq FROM st WHERE node_id < 10000 GROUP BY tree_id, node_id")
def t8(s, d):
    st = tree.fitch_up(checkpointed(_fitch(s, d)), A.trees(s, d)).filter("node_id < 10000")
    return st.groupBy("tree_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "state"))), lambda x: x["state"]), "").alias("seq"))


@query("F14_branch_convergence", f"""WITH {_STATES}, ch AS (SELECT c.tree_id AS gene, c.site AS pos, c.node_id % 10 AS species, min(c.state) AS residue, min(p.state) AS parent_residue FROM st c JOIN tree_node t USING (tree_id, node_id) JOIN st p ON p.site = c.site AND p.tree_id = c.tree_id AND p.node_id = t.parent_id WHERE t.depth = 4 GROUP BY ALL),
lp AS (SELECT i AS pair_id, i AS a, i + 5 AS b FROM (SELECT unnest(range(5)) AS i))
SELECT x.gene, pair_id, count(*) FILTER (x.residue = y.residue AND x.residue <> x.parent_residue AND y.residue <> y.parent_residue AND '-' NOT IN (x.residue, y.residue, x.parent_residue, y.parent_residue)) AS n FROM lp JOIN ch x ON x.species = a JOIN ch y ON y.species = b AND x.gene = y.gene AND x.pos = y.pos GROUP BY x.gene, pair_id""")
def f14(s, d):
    nodes = A.trees(s, d)
    st = checkpointed(tree.fitch_up(checkpointed(_fitch(s, d)), nodes))
    child = st.join(nodes.filter("depth = 4").select("tree_id", "node_id", "parent_id"), ["tree_id", "node_id"])
    up = st.select("site", "tree_id", F.col("node_id").alias("parent_id"), F.col("state").alias("parent_residue"))
    j = child.join(up, ["site", "tree_id", "parent_id"]).groupBy(F.col("tree_id").alias("gene"), F.col("site").alias("pos"), (F.col("node_id") % 10).alias("species")).agg(F.min("state").alias("residue"), F.min("parent_residue").alias("parent_residue"))
    return tree.branch_convergence(j, s.createDataFrame([(i, i, i + 5) for i in range(5)], "pair_id long, a long, b long"))


@query("T9_leaf_layout", f"""WITH {A.TREE}, l4 AS (SELECT tree_id, node_id, (row_number() OVER (PARTITION BY tree_id ORDER BY ord, node_id) - 1) * 30.0::DOUBLE AS y FROM tree_node WHERE depth = 4),
l3 AS (SELECT tree_id, parent_id AS node_id, avg(y) AS y FROM l4 JOIN tree_node USING (tree_id, node_id) GROUP BY ALL), l2 AS (SELECT tree_id, parent_id AS node_id, avg(y) AS y FROM l3 JOIN tree_node USING (tree_id, node_id) GROUP BY ALL),
l1 AS (SELECT tree_id, parent_id AS node_id, avg(y) AS y FROM l2 JOIN tree_node USING (tree_id, node_id) GROUP BY ALL), l0 AS (SELECT tree_id, parent_id AS node_id, avg(y) AS y FROM l1 JOIN tree_node USING (tree_id, node_id) GROUP BY ALL)
SELECT tree_id, node_id, round(y, 6) AS y FROM (SELECT * FROM l4 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0)""")
def t9(s, d):
    return tree.leaf_layout(A.trees(s, d))


# ---- deep trees: a chain of forty inner nodes with a leaf at each ----

_DEEP = 40


def _deep(tail: str) -> str:
    return f"""WITH dn AS (SELECT c_custkey // {_DEEP} AS tree_id, c_custkey % {_DEEP} AS node_id, CASE WHEN c_custkey % {_DEEP} > 0 THEN c_custkey % {_DEEP} - 1 END AS parent_id, (c_custkey % {_DEEP})::INT AS depth FROM customer WHERE c_custkey >= {_DEEP}
  UNION ALL SELECT c_custkey // {_DEEP}, c_custkey % {_DEEP} + 100, c_custkey % {_DEEP}, (c_custkey % {_DEEP})::INT + 1 FROM customer WHERE c_custkey >= {_DEEP}),
dl AS (SELECT CAST(site AS INT) AS site, c_custkey // {_DEEP} AS tree_id, c_custkey % {_DEEP} + 100 AS node_id, c_custkey % {_DEEP} AS spot, [1, 1, 4, 8, 0][(c_custkey // (site + 1) % 5)::INT + 1]::BIGINT AS mask
  FROM customer, (SELECT unnest(range(6)) AS site) WHERE c_custkey >= {_DEEP}), {tail}"""


_DEEP_SETS = f"d{_DEEP} AS (SELECT site, tree_id, {_DEEP}::BIGINT AS node_id, 0::BIGINT AS mask FROM dl WHERE false), " + ", ".join(
    f"""d{k} AS (SELECT site, tree_id, {k}::BIGINT AS node_id, CASE WHEN coalesce(bit_and(mask) FILTER (mask <> 0), 0) <> 0 THEN bit_and(mask) FILTER (mask <> 0) ELSE bit_or(mask) END AS mask
  FROM (SELECT site, tree_id, mask FROM d{k + 1} UNION ALL SELECT site, tree_id, mask FROM dl WHERE spot = {k}) GROUP BY site, tree_id)""" for k in reversed(range(_DEEP))
)
_DEEP_Y = f"tips AS (SELECT tree_id, spot, (row_number() OVER (PARTITION BY tree_id ORDER BY node_id) - 1) * 30.0::DOUBLE AS y FROM dl WHERE site = 0), y{_DEEP} AS (SELECT tree_id, y FROM tips WHERE false), " + ", ".join(
    f"y{k} AS (SELECT tree_id, avg(y) AS y FROM (SELECT * FROM y{k + 1} UNION ALL SELECT tree_id, y FROM tips WHERE spot = {k}) GROUP BY tree_id)" for k in reversed(range(_DEEP))
)


def _deep_trees(s, d):
    c = A.table(s, d, "customer").filter(F.col("c_custkey") >= _DEEP)
    t, k = F.floor(F.col("c_custkey") / _DEEP).alias("tree_id"), F.col("c_custkey") % _DEEP
    inner = c.select(t, k.alias("node_id"), F.when(k > 0, k - 1).alias("parent_id"), k.cast("int").alias("depth"))
    return inner.unionByName(c.select(t, (k + 100).alias("node_id"), k.alias("parent_id"), (k + 1).cast("int").alias("depth"))).withColumn("ord", F.col("node_id").cast("int"))


def _deep_leaves(s, d):
    c = A.table(s, d, "customer").filter(F.col("c_custkey") >= _DEEP).withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(5))))
    kind = (F.floor(F.col("c_custkey") / (F.col("site") + 1)) % 5).cast("int")
    return c.select("site", F.floor(F.col("c_custkey") / _DEEP).alias("tree_id"), (F.col("c_custkey") % _DEEP + 100).alias("node_id"), F.get(F.array(*(F.lit(x).cast("long") for x in (1, 1, 4, 8, 0))), kind).alias("mask"))


_INNER = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(_DEEP))


@query("T6_fitch_down_deep", _deep(f"{_DEEP_SETS} SELECT site, tree_id, node_id, mask FROM dl UNION ALL {_INNER}"))
def t6_deep(s, d):
    return tree.fitch_down(_deep_leaves(s, d), _deep_trees(s, d))


@query("T9_leaf_layout_deep", _deep(f"{_DEEP_Y} SELECT tree_id, spot + 100 AS node_id, y FROM tips UNION ALL " + " UNION ALL ".join(f"SELECT tree_id, {k}, round(y, 6) FROM y{k}" for k in range(_DEEP))))
def t9_deep(s, d):
    return tree.leaf_layout(_deep_trees(s, d))


_DEEP_UP = f"fs AS ({_INNER} UNION ALL SELECT site, tree_id, node_id, mask FROM dl), up AS (SELECT f.site, f.tree_id, f.node_id, {_PICK} AS state FROM fs f WHERE node_id = 0 UNION ALL SELECT f.site, f.tree_id, f.node_id, CASE WHEN p.state <> '?' AND f.mask & (1::BIGINT << (ascii(p.state) - 65)) <> 0 THEN p.state ELSE {_PICK} END FROM up p JOIN dn t ON t.tree_id = p.tree_id AND t.parent_id = p.node_id JOIN fs f ON f.site = p.site AND f.tree_id = t.tree_id AND f.node_id = t.node_id)"


@query("T7_fitch_up_deep", _deep(f"{_DEEP_SETS}, {_DEEP_UP} SELECT site, tree_id, node_id, state FROM up").replace("WITH dn", "WITH RECURSIVE dn", 1))
def t7_deep(s, d):
    return tree.fitch_up(checkpointed(tree.fitch_down(_deep_leaves(s, d), _deep_trees(s, d))), _deep_trees(s, d))


_FIRST = f"{_CAND}, pr AS (SELECT tree_id, mrca AS pair_id, mrca, min(dist) AS dist FROM cand WHERE pct > 50 GROUP BY ALL)"


@query("T10_J8_drop_nested", f"WITH {_FIRST} SELECT tree_id, pair_id, mrca FROM pr p WHERE NOT EXISTS (SELECT 1 FROM pr q JOIN anc a ON a.tree_id = q.tree_id AND a.node_id = q.mrca WHERE q.tree_id = p.tree_id AND q.pair_id <> p.pair_id AND a.anc_id = p.mrca)")
def t10(s, d):
    anc = checkpointed(_anc(s, d))
    p = pairs.most_contrast(A.traits(s, d), anc).filter("pct > 50").select("tree_id", F.col("mrca").alias("pair_id"), "mrca")
    return tree.drop_nested(checkpointed(p), anc)


@query("V9_validate_tree", f"WITH {A.TREE}, sp AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS tree_id, s_suppkey + 10000 AS node_id FROM supplier), ms AS (SELECT tree_id, count(*) AS m FROM sp WHERE (tree_id, node_id) NOT IN (SELECT (tree_id, node_id) FROM tree_node) GROUP BY ALL) SELECT t.tree_id, count(*) AS root_children, coalesce(any_value(m), 0) AS missing FROM tree_node t LEFT JOIN ms USING (tree_id) WHERE depth = 1 GROUP BY t.tree_id")
def v9(s, d):
    sp = A.table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("tree_id"), (F.col("s_suppkey") + 10000).alias("node_id"))
    return validate.validate_tree(A.trees(s, d), sp)


@query("P4_binarize_tails", f"WITH {A.TRAIT}, q AS (SELECT tree_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM trait GROUP BY ALL) SELECT tree_id, node_id, CASE WHEN value >= b THEN 1 ELSE -1 END AS label FROM trait JOIN q USING (tree_id) WHERE value >= b OR value <= a")
def p4(s, d):
    return pairs.binarize(A.traits(s, d), ["tree_id"], tails=0.25).select("tree_id", "node_id", "label")


@query("P4_binarize_bounds", f"WITH {A.TRAIT} SELECT tree_id, node_id, CASE WHEN value > 6000 THEN 1 ELSE -1 END AS label FROM trait WHERE value > 6000 OR value < 1000")
def p4b(s, d):
    return pairs.binarize(A.traits(s, d), ["tree_id"], 1000.0, 6000.0).select("tree_id", "node_id", "label")


_LAB = f"{A.TREE}, {A.TRAIT}, lab AS (SELECT tree_id, node_id, value, n, CASE WHEN value > 6000 THEN 1 ELSE -1 END AS label FROM trait WHERE value > 6000 OR value < 1000)"


def _labelled(s, d):
    return pairs.binarize(A.traits(s, d), ["tree_id"], 1000.0, 6000.0)


@query("W12_adjacent_candidates", f"""WITH {_LAB}, w AS (SELECT l.tree_id, l.node_id, label, lag(label) OVER w AS pl, lag(l.node_id) OVER w AS pn FROM lab l JOIN tree_node t USING (tree_id, node_id) WINDOW w AS (PARTITION BY l.tree_id ORDER BY ord, l.node_id))
SELECT tree_id, CASE WHEN label > 0 THEN node_id ELSE pn END AS conv, CASE WHEN label > 0 THEN pn ELSE node_id END AS ctrl FROM w WHERE pl <> label""")
def w12(s, d):
    tips = _labelled(s, d).join(A.trees(s, d).select("tree_id", "node_id", "ord"), ["tree_id", "node_id"])
    return pairs.adjacent_candidates(tips)


_CLADE = f"{A.ANC}, {A.TRAIT}, lab AS (SELECT tree_id, node_id, value, n, CASE WHEN value > 6000 THEN 1 ELSE -1 END AS label FROM trait WHERE value > 6000 OR value < 1000), cl AS (SELECT a.tree_id, a.anc_id AS mrca, l.node_id, l.label, l.value, l.n FROM anc a JOIN lab l USING (tree_id, node_id) WHERE a.anc_id BETWEEN 1000 AND 9999)"
_ORDER = {
    "longest": "n * 100000000 + node_id", "shortest": "-n * 100000000 + node_id",
    "contrast": "CAST(round(value * label * 100) AS BIGINT) * 100000000 + node_id", "random": "(node_id * 7919 + 104729) % 999983 * 100000000 + node_id",
}


def _resolve(method: str) -> None:
    o = _ORDER[method]
    sql = f"WITH {_CLADE} SELECT tree_id, mrca, arg_max(node_id, {o}) FILTER (label = 1) AS conv, arg_max(node_id, {o}) FILTER (label = -1) AS ctrl FROM cl GROUP BY ALL HAVING bool_or(label = 1) AND bool_or(label = -1)"

    @query(f"P5_resolve_{method}", sql)
    def run(s, d):
        clades = A.trees(s, d).filter("depth = 3").select("tree_id", F.col("node_id").alias("mrca"))
        return pairs.resolve(clades, _anc(s, d), _labelled(s, d), method, 1)


for _m in _ORDER:
    _resolve(_m)


@query("P8_random_sets", f"""WITH {_CLADE}, o AS (SELECT cl.*, set_id, row_number() OVER (PARTITION BY tree_id, set_id, mrca, label ORDER BY md5(concat_ws(':', set_id + 7, tree_id, mrca, node_id)), node_id) AS r FROM cl, (SELECT unnest(range(5)) AS set_id)),
l AS (SELECT tree_id, set_id::INT AS set_id, mrca, label, string_agg(node_id::VARCHAR, ',' ORDER BY r) AS species FROM o WHERE r <= 4 GROUP BY ALL)
SELECT a.tree_id, a.set_id, a.mrca, a.species AS conv, b.species AS ctrl FROM l a JOIN l b ON a.tree_id = b.tree_id AND a.set_id = b.set_id AND a.mrca = b.mrca AND a.label = 1 AND b.label = -1""")
def p8(s, d):
    """Five random choices of each clade's pair, with three alternates on both sides."""
    clades = A.trees(s, d).filter("depth = 3").select("tree_id", F.col("node_id").alias("mrca"))
    found = pairs.random_sets(clades, _anc(s, d), _labelled(s, d), 5, 7)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("tree_id", "set_id", "mrca", text("conv"), text("ctrl"))


@query("P6_composite", f"""WITH {_CLADE}, cr AS (SELECT a.tree_id, a.mrca, a.node_id AS conv, b.node_id AS ctrl, a.value AS va, b.value AS vb, a.n AS la, b.n AS lb, CAST(abs(a.node_id - b.node_id) AS DOUBLE) AS dist FROM cl a JOIN cl b ON a.tree_id = b.tree_id AND a.mrca = b.mrca AND a.label = 1 AND b.label = -1),
q AS (SELECT tree_id, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.9) AS b, quantile_cont(n, 0.5) AS mn FROM trait GROUP BY ALL), dv AS (SELECT tree_id, quantile_cont(abs(value - m), 0.5) AS mad FROM trait JOIN q USING (tree_id) GROUP BY ALL),
sc AS (SELECT tree_id, round(greatest(1.4826 * round(mad, 6), (b - a) / 2.563, 1e-9), 6) AS scale, mn FROM q JOIN dv USING (tree_id)),
f AS (SELECT cr.*, round((va - vb) / scale, 6) AS t, 2.0 * la * lb / ((la + lb) * mn) AS r, (va - vb) / scale AS ct FROM cr JOIN sc USING (tree_id)),
g AS (SELECT *, round(ct * CASE WHEN r >= 0.9 THEN 1.0 WHEN r <= 0.5 THEN 0.05 ELSE 0.05 + (r - 0.5) / 0.4 * 0.95 END, 6) AS score FROM f), tp AS (SELECT tree_id, mrca, max(score) AS top FROM g GROUP BY ALL),
o AS (SELECT g.*, row_number() OVER (PARTITION BY g.tree_id, g.mrca ORDER BY dist, -t, -(la + lb), conv, ctrl) AS rn FROM g JOIN tp USING (tree_id, mrca) WHERE score >= greatest(top - 0.15, 0.95 * top) - 1e-9)
SELECT tree_id, mrca, conv, ctrl, score FROM o WHERE rn = 1""")
def p6(s, d):
    t = A.traits(s, d)
    lab = _labelled(s, d).select("tree_id", "node_id", "label")
    clade = _anc(s, d).filter("anc_id BETWEEN 1000 AND 9999").select("tree_id", F.col("anc_id").alias("mrca"), "node_id").join(lab, ["tree_id", "node_id"])
    a, b = clade.filter("label = 1").alias("a"), clade.filter("label = -1").alias("b")
    cross = a.join(b, (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("a.mrca") == F.col("b.mrca")))
    c = cross.select("a.tree_id", "a.mrca", F.col("a.node_id").alias("conv"), F.col("b.node_id").alias("ctrl"), F.abs(F.col("a.node_id") - F.col("b.node_id")).cast("double").alias("dist"))
    scale = metrics.robust_scale(t, ["tree_id"], "value")
    lengths = t.groupBy("tree_id").agg(F.percentile("n", 0.5).alias("median_n"))
    return pairs.composite(c, t, scale, lengths)


@query("P7_alternates", f"""WITH {_CLADE}, r AS (SELECT *, row_number() OVER (PARTITION BY tree_id, mrca, label ORDER BY n DESC, node_id) AS r FROM cl) SELECT tree_id, mrca, CASE WHEN label = 1 THEN 'conv' ELSE 'ctrl' END AS role, string_agg(node_id, ',' ORDER BY r) AS members FROM r WHERE r <= 3 GROUP BY ALL""")
def p7(s, d):
    lab = _labelled(s, d).select("tree_id", "node_id", "label", F.col("n").alias("score"))
    clade = _anc(s, d).filter("anc_id BETWEEN 1000 AND 9999").select("tree_id", F.col("anc_id").alias("mrca"), "node_id").join(lab, ["tree_id", "node_id"])
    m = clade.select("tree_id", "mrca", F.when(F.col("label") == 1, "conv").otherwise("ctrl").alias("role"), F.col("node_id").alias("species"), "score")
    return pairs.alternates(m, ["tree_id", "mrca"], 3).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query("P7_trimmed_alternates", f"""WITH RECURSIVE {A.TRAIT}, sc AS (SELECT tree_id AS set_id, CAST(node_id % 4 AS INT) AS pair, CASE WHEN value > 4500 THEN 'conv' ELSE 'ctrl' END AS role, value AS score FROM trait),
ln AS (SELECT set_id, pair, role, count(*) AS n FROM sc GROUP BY ALL), od AS (SELECT set_id, pair, role, row_number() OVER (PARTITION BY set_id ORDER BY score, pair, role) AS k FROM sc),
st AS (SELECT set_id, 0::BIGINT AS k, map_from_entries(list((pair || role, n))) AS left_n FROM ln GROUP BY set_id
  UNION ALL SELECT s.set_id, o.k, map_from_entries(list_transform(map_entries(left_n), lambda e: (e.key, e.value - CASE WHEN e.key = o.pair || o.role THEN 1 ELSE 0 END)))
  FROM st s JOIN od o ON o.set_id = s.set_id AND o.k = s.k + 1 WHERE list_product(list_transform(map_values(left_n), lambda x: (1 + x)::DOUBLE)) > 64),
fin AS (SELECT set_id, arg_max(left_n, k) AS left_n FROM st GROUP BY set_id)
SELECT set_id, pair, role, CAST(left_n[pair || role] AS INT) AS kept FROM ln JOIN fin USING (set_id)""")
def p7t(s, d):
    """Each tree's alternates, cut until no more than 64 combinations remain."""
    t = A.traits(s, d).select(F.col("tree_id").alias("set_id"), (F.col("node_id") % 4).cast("int").alias("pair"), F.when(F.col("value") > 4500, "conv").otherwise("ctrl").alias("role"), F.col("value").alias("score"))
    return pairs.trim_alternates(t.groupBy("set_id", "pair", "role").agg(F.array_sort(F.collect_list("score")).alias("scores")), 64)


@query("P8_P9_random_sets")
def p9(s, d):
    nodes = A.trees(s, d)
    return pairs.random_pair_sets(tree.leaves(nodes), _anc(s, d), 3, 4, 1.0, 7)


@query("P9_random_pairs", f"WITH {A.TREE} SELECT tree_id, set_id::INT AS set_id, 2::BIGINT AS pairs, 0::BIGINT AS violations FROM (SELECT DISTINCT tree_id FROM tree_node), (SELECT unnest(range(3)) AS set_id)")
def p9_pairs(s, d):
    """Three sets of two random pairs in each tree, each seventh species excluded: how many pairs, how many break a rule."""
    nodes, anc = A.trees(s, d), checkpointed(_anc(s, d))
    excluded = tree.leaves(nodes).filter("node_id % 7 = 0").select("tree_id", "node_id")
    found = pairs.random_pairs_with_exclusions(nodes, anc, excluded, 3, 2, 1.0, 7)
    return pairs.pair_violations(checkpointed(found), anc, excluded, 1.0)


@query("S10_newick_trees", f"""WITH {A.TREE} SELECT 'tree_' || tree_id || CASE WHEN tree_id % 2 = 0 THEN '.nwk' ELSE '.nex' END AS file, NULL::VARCHAR AS fault, name, round(branch_length, 3) AS branch_length, depth FROM tree_node
UNION ALL SELECT DISTINCT 'note_' || tree_id || '.nwk', 'no tree', NULL, NULL, NULL FROM tree_node""")
def s10(s, d):
    """Each nation's tree as a file, Newick or NEXUS, read back with all its nodes; files of prose are rows with a reason."""
    from ..sources import alignments, trees
    from ..sources.tables import shared_folder, write_named

    nodes, folder = A.trees(s, d), shared_folder(s)
    text = trees.newick_texts(nodes)
    even, name = F.col("tree_id") % 2 == 0, lambda kind: F.concat(F.lit(kind), F.col("tree_id").cast("string"))
    nexus = F.concat(F.lit("#NEXUS\nBegin trees;\n  tree one = [&R] "), "newick", F.lit("\nEnd;"))
    files = text.select(F.concat(name("tree_"), F.when(even, ".nwk").otherwise(".nex")).alias("file"), F.when(even, F.col("newick")).otherwise(nexus).alias("value"))
    notes = nodes.select("tree_id").distinct().select(F.concat(name("note_"), F.lit(".nwk")).alias("file"), F.lit("this is not a tree").alias("value"))
    write_named(files.unionByName(notes), folder)
    rows = trees.parse_tree_files(alignments.read_files(s, folder, "*.{nwk,nex}"))
    return rows.select("file", "fault", "name", F.round("branch_length", 3).alias("branch_length"), "depth")
