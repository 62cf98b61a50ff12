"""Trees as node tables: ``tree_node(tree_id, node_id, parent_id, name, branch_length, depth, ord)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import blocks as B
from ..functions.residues import MISSING
from ..sources.tables import checkpointed


def closure(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(tree_id, node_id, anc_id, dist, hops, lacking)``: every ancestor of every node, itself
    included. Paths double each round, so that a tree of depth d takes log2(d) rounds."""
    known = nodes.select("tree_id", "node_id", "parent_id", F.coalesce("branch_length", F.lit(0.0)).alias("b"), F.col("branch_length").isNull().cast("int").alias("lack"))
    own = known.select("tree_id", "node_id", F.col("node_id").alias("anc_id"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(0).alias("lacking"))
    steps = known.filter("parent_id IS NOT NULL").select("tree_id", "node_id", F.col("parent_id").alias("anc_id"), F.col("b").alias("dist"), F.lit(1).alias("hops"), F.col("lack").alias("lacking"))
    paths = own.unionByName(steps)
    reach = 1
    for _ in range(max_rounds):
        a, b = paths.filter(F.col("hops") == reach).alias("a"), paths.filter("hops > 0").alias("b")
        longer = a.join(b, (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("a.anc_id") == F.col("b.node_id"))).select(
            "a.tree_id", "a.node_id", "b.anc_id", (F.col("a.dist") + F.col("b.dist")).alias("dist"),
            (F.col("a.hops") + F.col("b.hops")).alias("hops"), (F.col("a.lacking") + F.col("b.lacking")).alias("lacking"),
        )
        longer = checkpointed(longer)
        if longer.isEmpty():
            break
        paths = paths.unionByName(longer)
        reach *= 2
    return paths


def leaves(nodes: DataFrame) -> DataFrame:
    inner = nodes.select("tree_id", F.col("parent_id").alias("node_id")).filter("node_id IS NOT NULL")
    return nodes.join(inner, ["tree_id", "node_id"], "left_anti")


def mrca(anc: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets(set_id, tree_id, node_id)`` -> ``(set_id, mrca)``: the deepest common ancestor; nodes that
    the tree lacks are ignored."""
    return mrca_of_tree(anc, sets, nodes).drop("tree_id")


def mrca_of_tree(anc: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """As :func:`mrca`, with ``tree_id``; a set has one for each tree that it has nodes of."""
    found = sets.distinct().join(anc, ["tree_id", "node_id"]).join(nodes.select("tree_id", F.col("node_id").alias("anc_id"), "depth"), ["tree_id", "anc_id"])
    size = sets.distinct().join(nodes.select("tree_id", "node_id"), ["tree_id", "node_id"]).groupBy("set_id", "tree_id").agg(F.count("*").alias("size"))
    per = found.groupBy("set_id", "tree_id", "anc_id").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    return per.join(size, ["set_id", "tree_id"]).filter("n = size").groupBy("set_id", "tree_id").agg(F.max_by("anc_id", F.struct("depth", "anc_id")).alias("mrca"))


def mrca_is_root(anc: DataFrame, nodes: DataFrame, mrcas: DataFrame, present: DataFrame) -> DataFrame:
    """``mrcas(set_id, tree_id, mrca)`` -> ``(set_id, is_root)``: all ``present`` leaves of the tree are below the set's ancestor."""
    tips = present.join(nodes.select("tree_id", "node_id"), ["tree_id", "node_id"])
    total = tips.groupBy("tree_id").agg(F.count("*").alias("total"))
    below = mrcas.join(anc.withColumnRenamed("anc_id", "mrca"), ["tree_id", "mrca"]).join(tips, ["tree_id", "node_id"]).groupBy("set_id", "tree_id").agg(F.count("*").alias("below"))
    return below.join(total, "tree_id").select("set_id", (F.col("below") == F.col("total")).alias("is_root"))


def prune(nodes: DataFrame, anc: DataFrame, keep: DataFrame) -> DataFrame:
    """``(tree_id, node_id, parent_id, dist)`` of the tree cut down to the ``keep`` leaves, nodes with
    one child left out and their branches added to the child's."""
    kept = keep.select("tree_id", "node_id").distinct().join(anc, ["tree_id", "node_id"]).select("tree_id", F.col("anc_id").alias("node_id")).distinct()
    with_parent = kept.join(nodes.select("tree_id", "node_id", "parent_id"), ["tree_id", "node_id"])
    kids = with_parent.filter("parent_id IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    solid = with_parent.join(kids, ["tree_id", "node_id"], "left").filter("kids IS NULL OR kids >= 2").select("tree_id", "node_id")
    up = solid.join(anc.filter("hops > 0"), ["tree_id", "node_id"]).join(solid.select("tree_id", F.col("node_id").alias("anc_id")), ["tree_id", "anc_id"])
    nearest = up.groupBy("tree_id", "node_id").agg(F.min_by(F.struct("anc_id", "dist"), "hops").alias("p"))
    return solid.join(nearest, ["tree_id", "node_id"], "left").select("tree_id", "node_id", F.col("p.anc_id").alias("parent_id"), F.round("p.dist", 6).alias("dist"))


def distances(anc: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(tree_id, a, b)`` with ``mrca`` and ``dist``: branch lengths through the deepest common
    ancestor, or the number of edges if a length is missing on the way."""
    x = anc.select("tree_id", F.col("node_id").alias("a"), "anc_id", F.col("dist").alias("da"), F.col("hops").alias("ha"), F.col("lacking").alias("la"))
    y = anc.select("tree_id", F.col("node_id").alias("b"), "anc_id", F.col("dist").alias("db"), F.col("hops").alias("hb"), F.col("lacking").alias("lb"))
    common = pairs.join(x, ["tree_id", "a"]).join(y, ["tree_id", "b", "anc_id"])
    far = F.when(F.col("la") + F.col("lb") > 0, (F.col("ha") + F.col("hb")).cast("double")).otherwise(F.col("da") + F.col("db"))
    best = F.min_by(F.struct(F.col("anc_id").alias("mrca"), far.alias("dist")), F.struct(F.col("ha") + F.col("hb"), "anc_id"))
    return common.groupBy("tree_id", "a", "b").agg(best.alias("m")).select("tree_id", "a", "b", "m.mrca", F.round("m.dist", 6).alias("dist"))


#: Residues as bits of a long.
def residue_bit(residue):
    code = F.ascii(residue)
    return F.when((code >= 65) & (code <= 90), F.pow(F.lit(2.0), code - 65).cast("long")).otherwise(F.lit(0).cast("long"))


#: Levels of a tree after which what they hand on is written: plans stay short, and no level is made again for all above it.
LEVELS_IN_PLAN = 4


def _levels(nodes: DataFrame) -> list[int]:
    return sorted(r["depth"] for r in nodes.select("depth").distinct().collect())  # levels of the tree


def _unsent(side: DataFrame) -> DataFrame:
    """A side of a join that is never sent through the driver: there is one at each level, as large as a level of all trees."""
    return side.hint("merge")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fitch_down(leaf_sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``leaf_sets(site, tree_id, node_id, mask)`` -> the same for all nodes: bits of possible residues.

    From the deepest level up; a parent has what all its known children share, else what any has.
    Leaves that are missing are empty sets and change nothing. One group-by a level."""
    place = nodes.select("tree_id", "node_id", "parent_id", "depth")
    level = leaf_sets.select("site", "tree_id", "node_id", "mask").join(_unsent(place), ["tree_id", "node_id"])
    done, carried = [], None
    for k, depth in enumerate(reversed(_levels(nodes)), 1):
        own = level.filter(F.col("depth") == depth)
        here = own if carried is None else own.unionByName(carried.join(_unsent(place.filter(F.col("depth") == depth)), ["tree_id", "node_id"]))
        if k % LEVELS_IN_PLAN == 0:
            here = checkpointed(here)
        done.append(here.select("site", "tree_id", "node_id", "mask"))
        up = here.filter("parent_id IS NOT NULL").groupBy("site", "tree_id", F.col("parent_id").alias("node_id")).agg(
            F.bit_and(F.when(F.col("mask") != 0, F.col("mask"))).alias("all"), F.bit_or("mask").alias("any")
        )
        carried = up.select("site", "tree_id", "node_id", F.when(F.coalesce("all", F.lit(0)) != 0, F.col("all")).otherwise(F.col("any")).alias("mask"))
    return _union(done)


def fitch_up(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(site, tree_id, node_id, state)``: the root takes its least residue, a child its parent's if
    it can, else its own least; empty sets are ``?``. One join a level."""
    least = lambda m: F.char(F.lit(65) + F.floor(F.log2(m.bitwiseAND(-m).cast("double")) + 0.5))
    pick = F.when(F.col("mask") == 0, F.lit("?")).otherwise(least(F.col("mask")))
    s = sets.join(_unsent(nodes.select("tree_id", "node_id", "parent_id", "depth")), ["tree_id", "node_id"])
    first, *rest = _levels(nodes)
    if len(rest) >= LEVELS_IN_PLAN:
        s = checkpointed(s)
    now = s.filter(F.col("depth") == first).select("site", "tree_id", "node_id", pick.alias("state"))
    done = [now]
    for k, depth in enumerate(rest, 1):
        parent = now.select("site", "tree_id", F.col("node_id").alias("parent_id"), F.col("state").alias("above"))
        child = s.filter(F.col("depth") == depth).join(_unsent(parent), ["site", "tree_id", "parent_id"], "left")
        keeps = (residue_bit(F.col("above")) != 0) & (F.col("mask").bitwiseAND(residue_bit(F.col("above"))) != 0)
        now = child.select("site", "tree_id", "node_id", F.when(F.coalesce(keeps, F.lit(False)), F.col("above")).otherwise(pick).alias("state"))
        if k % LEVELS_IN_PLAN == 0:
            now = checkpointed(now)
        done.append(now)
    return _union(done)


def leaf_layout(nodes: DataFrame, step: int = 30) -> DataFrame:
    """``(tree_id, node_id, y)``: leaves ``step`` apart in tree order, inner nodes at their children's mean.

    A node's children are all one level below it, so a level is made of its leaves and of the level below alone."""
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy("ord", "node_id")) - 1
    tips = leaves(nodes).select("tree_id", "node_id", "parent_id", "depth", (rank * step).cast("double").alias("y"))
    place, levels = nodes.select("tree_id", "node_id", "parent_id", "depth"), _levels(nodes)
    if len(levels) > LEVELS_IN_PLAN:
        tips = checkpointed(tips)
    done, up = [], None
    for k, depth in enumerate(reversed(levels), 1):
        here = tips.filter(F.col("depth") == depth)
        if up is not None:
            here = here.unionByName(up.join(_unsent(place.filter(F.col("depth") == depth)), ["tree_id", "node_id"]))
        if k % LEVELS_IN_PLAN == 0:
            here = checkpointed(here)
        done.append(here.select("tree_id", "node_id", F.round("y", 6).alias("y")))
        up = here.filter("parent_id IS NOT NULL").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.avg("y").alias("y"))
    return _union(done)


def drop_nested(pairs: DataFrame, anc: DataFrame) -> DataFrame:
    """``pairs(tree_id, pair_id, mrca)`` without those whose ancestor is above or at another pair's."""
    a, b = pairs.alias("a"), pairs.alias("b")
    under = b.join(anc, (F.col("b.tree_id") == anc["tree_id"]) & (F.col("b.mrca") == anc["node_id"])).select(F.col("b.tree_id").alias("tree_id"), F.col("b.pair_id").alias("lower"), F.col("anc_id").alias("mrca"))
    outer = a.join(under, ["tree_id", "mrca"]).filter("pair_id <> lower").select("tree_id", "pair_id").distinct()
    return pairs.join(outer, ["tree_id", "pair_id"], "left_anti")


def branch_convergence(states: DataFrame, list_pairs: DataFrame) -> DataFrame:
    """``states(gene, pos, species, residue, parent_residue)`` and ``(pair_id, a, b)``: per gene and pair
    the positions where both have the same residue and neither has its own parent's."""
    x, y = states.alias("x"), states.alias("y")
    j = list_pairs.join(x, F.col("a") == F.col("x.species")).join(y, (F.col("b") == F.col("y.species")) & (F.col("x.gene") == F.col("y.gene")) & (F.col("x.pos") == F.col("y.pos")))
    full = ~F.array_contains(F.array("x.residue", "y.residue", "x.parent_residue", "y.parent_residue"), "-")
    hit = full & (F.col("x.residue") == F.col("y.residue")) & (F.col("x.residue") != F.col("x.parent_residue")) & (F.col("y.residue") != F.col("y.parent_residue"))
    return j.groupBy(F.col("x.gene").alias("gene"), "pair_id").agg(F.count_if(hit).alias("n"))


def tree_program(nodes: DataFrame, tree_id: int | None = None) -> DataFrame:
    """One row ``(leaf_names, levels, clades)``: a species tree as steps over arrays.

    Nodes are numbered leaves first, then by height; ``levels`` has, by height, the children of each inner node, and
    ``clades`` each node's leaves. Gathers one species tree, which has as many rows as species; alignments are not looked at."""
    one = nodes if tree_id is None else nodes.filter(F.col("tree_id") == tree_id)
    rows = one.select("node_id", "parent_id", "name").collect()  # one species tree
    children: dict[int, list[int]] = {}
    for r in rows:
        if r["parent_id"] is not None:
            children.setdefault(r["parent_id"], []).append(r["node_id"])
    parent, waiting = {r["node_id"]: r["parent_id"] for r in rows}, {n: len(c) for n, c in children.items()}
    names = {r["node_id"]: r["name"] for r in rows}
    order, levels = sorted((n for n in names if n not in children), key=lambda n: (names[n] or "", n)), []
    leaf_count = len(order)
    clades = {n: [i] for i, n in enumerate(order)}
    number = {n: i for i, n in enumerate(order)}
    level = order
    while level:
        ready = []
        for n in level:
            up = parent[n]
            if up is not None:
                waiting[up] -= 1
                if not waiting[up]:
                    ready.append(up)
        for n in ready:
            number[n] = len(number)
            clades[n] = sorted(i for c in children[n] for i in clades[c])
        if ready:
            levels.append([[number[c] for c in children[n]] for n in ready])
        level = ready
    by_number = sorted(number, key=number.get)
    row = ([names[n] for n in by_number[:leaf_count]], levels, [clades[n] for n in by_number])
    return one.sparkSession.createDataFrame([row], "leaf_names array<string>, levels array<array<array<int>>>, clades array<array<int>>")


#: Residues that a reconstructed set can hold, a bit each; case counts, as the site counter reads it.
STATES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz*.~_#@+=&!"


def state_bits() -> dict[str, int]:
    return {x: 1 << i for i, x in enumerate(STATES) if x not in MISSING}


def set_letters(masks: np.ndarray) -> pa.Array:
    """The residues of masks of :func:`state_bits`, in order; different masks are few, and each is spelled once."""
    kinds, which = np.unique(masks, return_inverse=True)
    letters = [[x for i, x in enumerate(STATES) if int(k) >> i & 1] for k in kinds]
    return pa.array(letters, pa.list_(pa.string())).take(pa.array(which))


def _ancestors(genes: DataFrame, program: DataFrame, analysis: list[str]) -> DataFrame:
    """``genes`` with the ``node`` of the ancestor and ``skip_reason``; see :func:`ancestral_states`."""
    here = F.filter(F.sequence(F.lit(0), F.size("leaf_names") - 1), lambda i: F.map_contains_key(F.col("by_species"), F.get("leaf_names", i)))
    wanted = F.filter(F.col("here"), lambda i: F.array_contains(F.array(*map(F.lit, analysis)), F.get("leaf_names", i)))
    numbers = F.sequence(F.lit(0), F.size("clades") - 1)
    holding = F.filter(numbers, lambda k: F.size(F.array_except(F.col("wanted"), F.get("clades", k))) == 0)
    node = F.array_min(F.transform(holding, lambda k: F.struct(F.size(F.get("clades", k)).alias("size"), k.alias("k"))))
    g = genes.crossJoin(F.broadcast(program)).withColumn("here", here)  # one row
    g = g.withColumn("wanted", wanted).withColumn("node", F.when(F.size("wanted") > 0, node["k"]))
    outside = F.size(F.array_except(F.col("here"), F.get("clades", F.col("node"))))
    reason = F.when(F.col("node").isNull(), "no analysis species in tree and alignment").when(outside == 0, "no species outside the ancestor's clade")
    return g.withColumn("skip_reason", reason)


def skip_reasons(genes: DataFrame, program: DataFrame, analysis: list[str]) -> DataFrame:
    """``(gene, skip_reason)`` of all genes."""
    return _ancestors(genes, program, analysis).select("gene", "skip_reason")


def ancestral_masks(genes: DataFrame, program: DataFrame, analysis: list[str]) -> DataFrame:
    """As :func:`_reconstructed`, with ``sets``: by position, as bits, the residues that the ancestor may have."""
    return _reconstructed(genes, program, analysis, "sets", "bigint", pa.array)


def _reconstructed(genes: DataFrame, program: DataFrame, analysis: list[str], name: str, kind: str, told: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """``genes(gene, n, by_species)`` with ``skip_reason`` and, in the column ``name``: by position, what ``told`` makes of
    the residues that the ancestor of the ``analysis`` species of the gene may have, a bit each as in ``STATES``; null where there
    is no such ancestor.

    The tree counts for a gene as far as the gene has its species. The ancestor is the node of the smallest clade with
    all analysis species that are there; if no species of the gene is outside of it, the gene is skipped. From the leaves
    up a node has what all its children with known residues share, or else what any has. All within a gene's row."""
    levels, bits = program.first()["levels"], state_bits()  # one row
    leaves = F.transform("leaf_names", lambda x: F.coalesce(F.try_element_at("by_species", x), F.lit("")))
    g = _ancestors(genes, program, analysis)
    kept = [*genes.columns, "skip_reason"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = batch.column("skip_reason").is_null().to_numpy(zero_copy_only=False)
            node = batch.column("node").fill_null(0).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(on))
            own = node[on]
            parts = [B.ancestral_sets(b, levels, bits, own[b.row]) for b in B.blocks(some, "leaves")]
            n = np.where(on, batch.column("n").fill_null(0).to_numpy(zero_copy_only=False), 0)
            ends = np.append(0, np.cumsum(n)).astype(np.int32)
            found = told(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            sets = pa.ListArray.from_arrays(pa.array(ends), found, mask=pa.array(~on | (n <= 0)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sets], [*kept, name])

    types = dict(g.dtypes)
    return g.select(*kept, "node", leaves.alias("leaves")).mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), f"{name} array<{kind}>"]))


def ancestral_states(genes: DataFrame, program: DataFrame, analysis: list[str]) -> DataFrame:
    """:func:`ancestral_masks` with ``states``, the sets as arrays of residues, in place of ``sets``."""
    return _reconstructed(genes, program, analysis, "states", "array<string>", set_letters)
