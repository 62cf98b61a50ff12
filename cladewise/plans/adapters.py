"""The domain's tables, derived from the test tables: the same rows in Spark and in SQL.

Alignments come from whole texts: letters become three residues, everything else a gap; a text is a
species (its id modulo 16) of a group of 16, and each 60 positions of a group's texts are a gene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.trees import newick_nodes, parse_trees

#: Letters by residue, both cases; a gene's length; species by slot.
CLASSES = {"A": "etaoinsh", "C": "rdlucm", "D": "wfgypbvk"}
LETTERS = "".join(x + x.upper() for x in CLASSES.values())
RESIDUES = "".join(k * 2 * len(x) for k, x in CLASSES.items())
WIDTH, OUTGROUP = 60, "sp08"
LINES = [["sp00", "sp09"], ["sp01"], ["sp02"], ["sp03"], ["sp04"], ["sp05"], ["sp06"], ["sp07"]]
COMBOS = [[first, *(x[0] for x in LINES[1:])] for first in LINES[0]]
TARGETS = ["sp00", "sp02", "sp04"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``aln(gene, species, seq)``."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    d = d.select("doc_id", F.regexp_replace(F.translate("text", LETTERS, RESIDUES), "[^ACD]", "-").alias("s"))
    # Pieces are cut in one pass; a text is not copied for each of them.
    parts = d.select("doc_id", F.posexplode(F.regexp_extract_all("s", F.lit(f".{{1,{WIDTH}}}"), F.lit(0))).alias("i", "piece"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return parts.select(
        F.concat(F.lit("g"), pad(F.floor(F.col("doc_id") / 16), 6), F.lit("s"), pad(F.col("i"), 4)).alias("gene"),
        F.concat(F.lit("sp"), pad(F.col("doc_id") % 16, 2)).alias("species"), F.rpad("piece", WIDTH, "-").alias("seq"),
    )


ALN = f"""doc AS (SELECT doc_id, regexp_replace(translate(text, '{LETTERS}', '{RESIDUES}'), '[^ACD]', '-', 'g') AS s FROM documents WHERE length(text) > 0),
aln AS (SELECT 'g' || lpad(CAST(doc_id // 16 AS VARCHAR), 6, '0') || 's' || lpad(CAST(i AS VARCHAR), 4, '0') AS gene,
  'sp' || lpad(CAST(doc_id % 16 AS VARCHAR), 2, '0') AS species, rpad(substr(s, CAST(i * {WIDTH} + 1 AS INT), {WIDTH}), {WIDTH}, '-') AS seq
  FROM (SELECT doc_id, s, unnest(range((length(s) + {WIDTH - 1}) // {WIDTH})) AS i FROM doc)),
places AS (SELECT CAST(unnest(range({WIDTH})) AS INT) AS pos)"""


def combos(spark: SparkSession) -> DataFrame:
    """``combo(combo_idx, slot, species, y)``."""
    rows = [(c, s, x, 1.0 if s % 2 == 0 else -1.0) for c, line in enumerate(COMBOS) for s, x in enumerate(line)]
    return spark.createDataFrame(rows, "combo_idx long, slot int, species string, y double")


COMBO = "combo(combo_idx, slot, species) AS (VALUES " + ", ".join(f"({c}, {s}, '{x}')" for c, line in enumerate(COMBOS) for s, x in enumerate(line)) + ")"

CELL = f"""{ALN}, {COMBO}, genes AS (SELECT DISTINCT gene FROM aln),
cell AS (SELECT g.gene, c.combo_idx, c.slot, p.pos, coalesce(substr(a.seq, p.pos + 1, 1), '-') AS residue, a.seq IS NULL AS missing
  FROM genes g CROSS JOIN combo c LEFT JOIN aln a ON a.gene = g.gene AND a.species = c.species CROSS JOIN places p)"""

#: Masked residues of the pairs that a gene has, their counts by side, and the flags of each site.
SITE = f"""{ALN}, {COMBO},
pp AS (SELECT a.gene, c.combo_idx, c.slot // 2 AS pair FROM combo c JOIN aln a USING (species) GROUP BY ALL HAVING count(*) = 2),
kk AS (SELECT gene, combo_idx, count(*) AS k FROM pp GROUP BY ALL HAVING count(*) >= 2),
pc AS (SELECT a.gene, c.combo_idx, c.slot, p.pos, substr(a.seq, p.pos + 1, 1) AS r, kk.k FROM combo c JOIN aln a USING (species)
  JOIN pp ON pp.gene = a.gene AND pp.combo_idx = c.combo_idx AND pp.pair = c.slot // 2
  JOIN kk ON kk.gene = a.gene AND kk.combo_idx = c.combo_idx CROSS JOIN places p),
mk AS (SELECT *, CASE WHEN r <> '-' AND count(*) OVER (PARTITION BY gene, combo_idx, pos, r) = 1 THEN '?' ELSE r END AS m FROM pc),
rc AS (SELECT gene, combo_idx, pos, m, max(k) AS k, count(*) FILTER (slot % 2 = 0) AS a, count(*) FILTER (slot % 2 = 1) AS b,
  m NOT IN ('?', '-', 'X', 'x') AS ok FROM mk GROUP BY gene, combo_idx, pos, m),
og AS (SELECT gene, pos, substr(seq, pos + 1, 1) AS o FROM aln CROSS JOIN places WHERE species = '{OUTGROUP}' AND substr(seq, pos + 1, 1) <> '-'),
site AS (SELECT gene, combo_idx, pos, max(k) AS k,
  greatest(0, coalesce(sum(abs(a - b)) FILTER (ok), 0) - coalesce(sum(a + b) FILTER (m = '-'), 0))::INT AS score,
  coalesce(any_value(o) IS NOT NULL AND sum(b) FILTER (ok) > 0 AND coalesce(sum(b) FILTER (ok AND m = o), 0) >= sum(b) FILTER (ok)
    AND bool_or(ok AND m <> o AND a >= 2), false) AS is_ccs,
  coalesce(any_value(o) IS NOT NULL AND sum(a) FILTER (ok) > 0 AND coalesce(sum(a) FILTER (ok AND m <> o), 0) = 0
    AND bool_or(ok AND m <> o AND b >= 2), false) AS ctrl_conv
  FROM rc LEFT JOIN og USING (gene, pos) GROUP BY gene, combo_idx, pos),
counts AS (SELECT gene, combo_idx, max(k) AS k, count(*) FILTER (is_ccs) AS true_n, count(*) FILTER (ctrl_conv) AS ctrl_n,
  count(*) FILTER (score >= 4) AS cs_n FROM site GROUP BY gene, combo_idx)"""


#: A species tree of all sixteen species; three clades stand outside the designs' species.
SPECIES_TREE = "((((((sp00,sp09),sp01),(sp02,sp03)),((sp04,sp05),(sp06,sp07))),(sp08,(sp10,sp11))),(sp12,(sp13,(sp14,sp15))));"


def species_tree(spark: SparkSession) -> DataFrame:
    """``tree_node`` of the species tree."""
    return parse_trees(spark.createDataFrame([(0, SPECIES_TREE)], "tree_id long, newick string"))


def _tree_sql() -> str:
    """``tn(node, parent, name, height)`` and ``clade(node, species, size)`` of the species tree, as values."""
    rows = {n[0]: n for n in newick_nodes(SPECIES_TREE)}
    children: dict[int, list[int]] = {}
    for n in rows.values():
        if n[1] is not None:
            children.setdefault(n[1], []).append(n[0])
    below = lambda k: [rows[k][2]] if k not in children else [x for c in children[k] for x in below(c)]
    height = lambda k: 0 if k not in children else 1 + max(map(height, children[k]))
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    tn = ", ".join(f"({k}, {text(n[1])}, {text(n[2])}, {height(k)})" for k, n in rows.items())
    clade = ", ".join(f"({k}, '{x}', {len(below(k))})" for k in rows for x in below(k))
    levels = "".join(f""",
s{h} AS (SELECT * FROM s{h - 1} UNION ALL SELECT gene, pos, p.node, CASE WHEN coalesce(bit_and(mask) FILTER (mask <> 0), 0) <> 0 THEN bit_and(mask) FILTER (mask <> 0) ELSE bit_or(mask) END
  FROM s{h - 1} JOIN tn c USING (node) JOIN tn p ON p.node = c.parent WHERE p.height = {h} GROUP BY ALL)""" for h in range(1, height(0) + 1))  # fmt: skip
    return f"""tn(node, parent, name, height) AS (VALUES {tn}), clade(node, species, size) AS (VALUES {clade}),
s0 AS (SELECT a.gene, p.pos, t.node, CASE substr(a.seq, p.pos + 1, 1) WHEN 'A' THEN 1 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 0 END::BIGINT AS mask
  FROM aln a JOIN tn t ON t.name = a.species CROSS JOIN places p){levels},
wanted AS (SELECT DISTINCT a.gene, a.species FROM aln a JOIN combo USING (species)), nw AS (SELECT gene, count(*) AS n FROM wanted GROUP BY gene),
holds AS (SELECT w.gene, c.node, any_value(c.size) AS size FROM wanted w JOIN clade c USING (species) JOIN nw USING (gene) GROUP BY w.gene, c.node, n HAVING count(*) = n),
ancestor AS (SELECT gene, arg_min(node, size) AS node FROM holds GROUP BY gene),
outer_species AS (SELECT a.gene, count(*) - count(c.species) AS n FROM aln a JOIN ancestor t USING (gene) LEFT JOIN clade c ON c.node = t.node AND c.species = a.species GROUP BY a.gene),
told AS (SELECT s.gene, s.pos, s.mask FROM s{height(0)} s JOIN ancestor t USING (gene, node) JOIN outer_species o USING (gene) WHERE o.n > 0)"""


SPECIES_SETS = _tree_sql()


def text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(q, m)``: a group of texts and how many genes it has."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return d.groupBy(F.floor(F.col("doc_id") / 16).alias("q")).agg(F.max(F.floor((F.length("text") + WIDTH - 1) / WIDTH)).alias("m"))


def gene_name(q: Column, j: Column) -> Column:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.lit("g"), pad(q, 6), F.lit("s"), pad(j, 4))


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``coef(combo_idx, run, gene, pos, aa, weight)`` without zeros. Items are dealt to all groups of texts, and
    to all genes and positions of a group, so genes are as many as the alignment has and items name."""
    groups = text_groups(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(groups.agg((F.max("q") + 1).alias("n"))))  # one row
    items = items.withColumn("q", (F.col("l_orderkey") * 31 + F.col("l_partkey")) % F.col("n")).join(groups, "q")
    aa = F.when(F.col("l_returnflag") == "N", "A").when(F.col("l_returnflag") == "R", "C").otherwise("D")
    key = [
        F.col("l_linenumber").cast("long").alias("combo_idx"), (F.col("l_suppkey") % 20).alias("run"),
        gene_name(F.col("q"), (F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")) % F.col("m")).alias("gene"),
        ((F.col("l_quantity").cast("long") * 7 + F.col("l_partkey")) % WIDTH).cast("int").alias("pos"), aa.alias("aa"),
    ]
    # Cents times hundredths are whole numbers, so the sum and its rounding to six places are exact.
    parts = F.sum((F.round(F.col("l_discount") * 100).cast("long") - 5) * F.round(F.col("l_extendedprice") * 100).cast("long"))
    w = (F.signum("parts") * F.expr("(abs(parts) + 500) div 1000") / 1e6).alias("weight")
    found = items.groupBy(*key).agg(parts.alias("parts"))
    return found.select(*(c for c in found.columns if c != "parts"), w).filter("weight <> 0")


GROUPS = f"""docq AS (SELECT doc_id // 16 AS q, max((length(text) + {WIDTH - 1}) // {WIDTH}) AS m FROM documents WHERE length(text) > 0 GROUP BY 1),
docn AS (SELECT max(q) + 1 AS n FROM docq)"""

COEF = f"""{GROUPS}, coef AS (SELECT combo_idx, run, gene, pos, aa, sign(parts) * ((abs(parts) + 500) // 1000) / 1e6 AS weight FROM (SELECT CAST(l_linenumber AS BIGINT) AS combo_idx, l_suppkey % 20 AS run,
  'g' || lpad(CAST(docq.q AS VARCHAR), 6, '0') || 's' || lpad(CAST((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % m AS VARCHAR), 4, '0') AS gene,
  CAST((CAST(l_quantity AS BIGINT) * 7 + l_partkey) % {WIDTH} AS INT) AS pos, CASE l_returnflag WHEN 'N' THEN 'A' WHEN 'R' THEN 'C' ELSE 'D' END AS aa,
  CAST(sum((CAST(round(l_discount * 100) AS BIGINT) - 5) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS parts
  FROM lineitem CROSS JOIN docn JOIN docq ON docq.q = (l_orderkey * 31 + l_partkey) % n GROUP BY ALL) WHERE abs(parts) >= 500)"""


def all_gene_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``coef`` as above over the genes that the alignment has: items are dealt to groups of texts, and
    within a group items and genes go round until each has been met, so no gene and no item with a weight is left out."""
    group = text_groups(spark, sf_dir)
    aa = F.when(F.col("l_returnflag") == "N", "A").when(F.col("l_returnflag") == "R", "C").otherwise("D")
    parts = (F.round(F.col("l_discount") * 100).cast("long") - 5) * F.round(F.col("l_extendedprice") * 100).cast("long")
    items = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(group.agg((F.max("q") + 1).alias("n")))).select(  # one row
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey")) % F.col("n")).alias("q"), F.col("l_linenumber").cast("long").alias("combo_idx"),
        (F.col("l_suppkey") % 20).alias("run"), F.col("l_quantity").cast("int").alias("pos"), aa.alias("aa"), parts.alias("parts"), "l_orderkey", "l_partkey",
    )
    order = ["l_orderkey", "combo_idx", "l_partkey", "run", "pos", "aa", "parts"]
    items = items.filter(F.abs("parts") >= 500).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order)) - 1)
    dealt = items.join(items.groupBy("q").agg(F.count("*").alias("rows")), "q").join(group, "q")
    turns = F.sequence(F.col("r").cast("long"), F.greatest("rows", "m") - 1, F.col("rows"))
    gene = gene_name(F.col("q"), F.col("j") % F.col("m")).alias("gene")
    found = dealt.withColumn("j", F.explode(turns)).groupBy("combo_idx", "run", gene, "pos", "aa").agg(F.sum("parts").alias("parts"))
    weight = (F.signum("parts") * F.expr("(abs(parts) + 500) div 1000") / 1e6).alias("weight")
    return found.select("combo_idx", "run", "gene", "pos", "aa", weight).filter("weight <> 0")


ALL_COEF = f"""{GROUPS}, item AS (SELECT (l_orderkey * 31 + l_linenumber * 17 + l_partkey) % n AS q, CAST(l_linenumber AS BIGINT) AS combo_idx, l_suppkey % 20 AS run, CAST(l_quantity AS INT) AS pos,
  CASE l_returnflag WHEN 'N' THEN 'A' WHEN 'R' THEN 'C' ELSE 'D' END AS aa, (CAST(round(l_discount * 100) AS BIGINT) - 5) * CAST(round(l_extendedprice * 100) AS BIGINT) AS parts, l_orderkey, l_partkey FROM lineitem CROSS JOIN docn),
turn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY l_orderkey, combo_idx, l_partkey, run, pos, aa, parts) - 1 AS r, count(*) OVER (PARTITION BY q) AS held FROM item WHERE abs(parts) >= 500),
coef AS (SELECT combo_idx, run, gene, pos, aa, sign(parts) * ((abs(parts) + 500) // 1000) / 1e6 AS weight FROM (SELECT combo_idx, run,
  'g' || lpad(CAST(q AS VARCHAR), 6, '0') || 's' || lpad(CAST(j % m AS VARCHAR), 4, '0') AS gene, pos, aa, CAST(sum(parts) AS BIGINT) AS parts
  FROM (SELECT *, unnest(range(r, greatest(held, m), held)) AS j FROM turn JOIN docq USING (q)) GROUP BY ALL) WHERE abs(parts) >= 500)"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model(combo_idx, run, intercept)``."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("combo_idx"), (F.col("l_suppkey") % 20).alias("run")).agg(
        F.round(F.avg("l_tax") - 0.04, 6).alias("intercept")
    )


MODEL = "model AS (SELECT CAST(l_linenumber AS BIGINT) AS combo_idx, l_suppkey % 20 AS run, round(avg(l_tax) - 0.04, 6) AS intercept FROM lineitem GROUP BY ALL)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prediction(run, species, sps, label, input_rmse, num_genes)``."""
    e = table(spark, sf_dir, "events")
    run = F.col("event_id") % 50
    return e.select(
        run.alias("run"), F.col("user_id").alias("species"), F.round((F.col("value") - 50) / 50, 9).alias("sps"),
        (F.col("user_id") % 3 - 1).cast("int").alias("label"), (run * 7 % 50 / 50).alias("input_rmse"), (run % 9).alias("num_genes"),
    )


PRED = """prediction AS (SELECT event_id % 50 AS run, user_id AS species, round((value - 50) / 50, 9) AS sps,
  CAST(user_id % 3 - 1 AS INT) AS label, (event_id % 50 * 7 % 50) / 50.0::DOUBLE AS input_rmse, event_id % 50 % 9 AS num_genes FROM events)"""

#: A tree for each nation: four levels by remainders of the customer's key, then the customers.
_LEVELS = ((4, 10), (16, 100), (64, 1000))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree_node``; each tenth customer has no branch length."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("tree_id"), "c_custkey", "c_name", "c_acctbal")
    kind = "tree_id long, node_id long, parent_id long, name string, branch_length double, depth int, ord int"
    root = c.select("tree_id").distinct().select("tree_id", F.lit(1).alias("node_id"), F.lit(None).alias("parent_id"), F.lit("root").alias("name"), F.lit(0.0).alias("branch_length"), F.lit(0).alias("depth"), F.lit(0).alias("ord"))
    parts, parent = [root], lambda k: F.lit(1)
    for depth, (m, base) in enumerate(_LEVELS, 1):
        k = c.select("tree_id", (F.col("c_custkey") % m).alias("k")).distinct()
        parts.append(k.select("tree_id", (F.col("k") + base).alias("node_id"), parent(F.col("k")).alias("parent_id"), F.concat(F.lit(f"n{m}_"), F.col("k").cast("string")).alias("name"), ((F.col("k") % 7 + 1) / 10).alias("branch_length"), F.lit(depth).alias("depth"), F.col("k").alias("ord")))
        parent = lambda k, m=m, base=base: k % m + base
    parts.append(c.select("tree_id", (F.col("c_custkey") + 10000).alias("node_id"), parent(F.col("c_custkey")).alias("parent_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 10 != 0, F.round(F.abs("c_acctbal") / 1000, 3)).alias("branch_length"), F.lit(4).alias("depth"), F.col("c_custkey").alias("ord")))
    casts = [F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in kind.split(", ")]
    out = parts[0].select(*casts)
    for p in parts[1:]:
        out = out.unionByName(p.select(*casts))
    return out


TREE = """tree_node AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS tree_id, 1::BIGINT AS node_id, NULL::BIGINT AS parent_id, 'root' AS name, 0.0::DOUBLE AS branch_length, 0 AS depth, 0::BIGINT AS ord FROM customer
  UNION ALL SELECT DISTINCT CAST(c_nationkey AS BIGINT), c_custkey % 4 + 10, 1, 'n4_' || (c_custkey % 4), (c_custkey % 4 % 7 + 1) / 10.0::DOUBLE, 1, c_custkey % 4 FROM customer
  UNION ALL SELECT DISTINCT CAST(c_nationkey AS BIGINT), c_custkey % 16 + 100, c_custkey % 4 + 10, 'n16_' || (c_custkey % 16), (c_custkey % 16 % 7 + 1) / 10.0::DOUBLE, 2, c_custkey % 16 FROM customer
  UNION ALL SELECT DISTINCT CAST(c_nationkey AS BIGINT), c_custkey % 64 + 1000, c_custkey % 16 + 100, 'n64_' || (c_custkey % 64), (c_custkey % 64 % 7 + 1) / 10.0::DOUBLE, 3, c_custkey % 64 FROM customer
  UNION ALL SELECT CAST(c_nationkey AS BIGINT), c_custkey + 10000, c_custkey % 64 + 1000, c_name, CASE WHEN c_custkey % 10 <> 0 THEN round(abs(c_acctbal) / 1000, 3) END, 4, c_custkey FROM customer)"""

#: Every ancestor of every node, by recursion over parents.
ANC = f"""{TREE}, anc AS (
  WITH RECURSIVE up AS (SELECT tree_id, node_id, node_id AS anc_id, 0.0::DOUBLE AS dist, 0 AS hops, 0 AS lacking FROM tree_node
    UNION ALL SELECT u.tree_id, u.node_id, t.parent_id, u.dist + coalesce(t.branch_length, 0), u.hops + 1, u.lacking + (t.branch_length IS NULL)::INT
    FROM up u JOIN tree_node t ON t.tree_id = u.tree_id AND t.node_id = u.anc_id WHERE t.parent_id IS NOT NULL)
  SELECT * FROM up)"""


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tree_id, node_id, value, n)`` of leaves: a continuous trait and a sequence length."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_nationkey").cast("long").alias("tree_id"), (F.col("c_custkey") + 10000).alias("node_id"), F.col("c_acctbal").alias("value"),
        (F.col("c_custkey") * 37 % 400 + 100).alias("n"),
    )


TRAIT = "trait AS (SELECT CAST(c_nationkey AS BIGINT) AS tree_id, c_custkey + 10000 AS node_id, c_acctbal AS value, c_custkey * 37 % 400 + 100 AS n FROM customer)"


def leaf_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site, tree_id, node_id, mask)``: six sites, a residue bit per leaf or 0 where it is missing."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("tree_id"), "c_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("site"))
    kind = F.floor(F.col("c_custkey") / (F.col("site") + 1)) % 5
    mask = F.when(kind <= 1, 1).when(kind == 2, 4).when(kind == 3, 8).otherwise(0).cast("long")
    return c.select("site", "tree_id", (F.col("c_custkey") + 10000).alias("node_id"), mask.alias("mask"))


LEAF = """leaf AS (SELECT CAST(site AS INT) AS site, CAST(c_nationkey AS BIGINT) AS tree_id, c_custkey + 10000 AS node_id,
  CASE WHEN c_custkey // (site + 1) % 5 <= 1 THEN 1 WHEN c_custkey // (site + 1) % 5 = 2 THEN 4 WHEN c_custkey // (site + 1) % 5 = 3 THEN 8 ELSE 0 END::BIGINT AS mask
  FROM customer, (SELECT unnest(range(6)) AS site))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, line_no, line)``: a file of mixed lines per nation, of its customers in order."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    name = F.col("c_name")
    line = (
        F.when(k % 11 == 0, text("species,value")).when(k % 11 == 1, text("  ")).when(k % 11 == 2, text(name, ",1"))
        .when(k % 11 == 3, text(name, ",-1")).when(k % 11 == 4, text(name, "\t", k % 3 - 1)).when(k % 11 == 5, text(name, ", ", k % 40, ".5"))
        .when(k % 11 == 6, text("\"", name, "\",1,x")).when(k % 11 == 7, text(name, " ", k % 5)).when(k % 11 == 8, text(name))
        .when(k % 11 == 9, text(name, ",abc")).otherwise(text(name, ",0"))
    )
    no = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(k))
    return c.select(F.col("c_nationkey").cast("long").alias("file"), no.alias("line_no"), line.alias("line"))


LINE = r"""line AS (SELECT CAST(c_nationkey AS BIGINT) AS file, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS line_no,
  CASE c_custkey % 11 WHEN 0 THEN 'species,value' WHEN 1 THEN '  ' WHEN 2 THEN c_name || ',1' WHEN 3 THEN c_name || ',-1'
  WHEN 4 THEN c_name || chr(9) || (c_custkey % 3 - 1) WHEN 5 THEN c_name || ', ' || (c_custkey % 40) || '.5' WHEN 6 THEN '"' || c_name || '",1,x'
  WHEN 7 THEN c_name || ' ' || (c_custkey % 5) WHEN 8 THEN c_name WHEN 9 THEN c_name || ',abc' ELSE c_name || ',0' END AS line FROM customer)"""


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``groups(design, line_no, members)``: an order is a design, its items are the lines, and each has
    two or, for the even parts, one member."""
    one = F.concat(F.lit("s_"), F.col("l_suppkey").cast("string"))
    two = F.concat(F.lit("part_"), F.col("l_partkey").cast("string"))
    members = F.when(F.col("l_partkey") % 2 == 0, F.array(one)).otherwise(F.array(one, two))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("design"), F.col("l_linenumber").alias("line_no")).agg(F.min(members).alias("members"))


DESIGN = """grp AS (SELECT l_orderkey AS design, l_linenumber AS line_no, min(CASE WHEN l_partkey % 2 = 0 THEN ['s_' || l_suppkey] ELSE ['s_' || l_suppkey, 'part_' || l_partkey] END) AS members
  FROM lineitem GROUP BY ALL)"""
