"""Queries over coefficients, predictions and designs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import with_ranks
from ..operators import design, ledger, metrics, score, validate
from ..operators import fit as fitting
from ..sources import texts
from ..sources.tables import checkpointed, shared_folder
from . import adapters as A
from .registry import query

# ---- designs ----

_PROD = f"""WITH RECURSIVE {A.DESIGN}, ln AS (SELECT *, row_number() OVER (PARTITION BY design ORDER BY line_no) - 1 AS slot, len(members) AS m FROM grp),
ex AS (SELECT design, 0::BIGINT AS combo_idx, -1::BIGINT AS slot FROM ln WHERE slot = 0
  UNION ALL SELECT e.design, e.combo_idx * l.m + i.i, e.slot + 1 FROM ex e JOIN ln l ON l.design = e.design AND l.slot = e.slot + 1 CROSS JOIN LATERAL (SELECT unnest(range(l.m)) AS i) i),
size AS (SELECT design, max(slot) AS last FROM ln GROUP BY design),
later AS (SELECT a.design, a.slot, a.members, a.m, CAST(coalesce(product(b.m), 1) AS BIGINT) AS w FROM ln a LEFT JOIN ln b ON a.design = b.design AND b.slot > a.slot GROUP BY ALL),
combo AS (SELECT e.design, e.combo_idx, CAST(l.slot AS INT) AS slot, l.members[e.combo_idx // l.w % l.m + 1] AS species FROM ex e JOIN size s ON s.design = e.design AND s.last = e.slot JOIN later l ON l.design = e.design)"""


def _combos(s, d):
    return design.expand_combos(A.designs(s, d))


@query("G1_expand_combos", f"{_PROD} SELECT design, combo_idx, slot, slot // 2 AS pair, CASE WHEN slot % 2 = 0 THEN 'convergent' ELSE 'control' END AS role, species FROM combo")
def g1(s, d):
    return _combos(s, d)


_PAIRS = f"""WITH {A.DESIGN}, ln AS (SELECT design, members, row_number() OVER (PARTITION BY design ORDER BY line_no) - 1 AS slot FROM grp),
p AS (SELECT a.design, CAST(a.slot // 2 AS INT) AS pair, a.members[1] AS conv, b.members[1] AS ctrl FROM ln a JOIN ln b ON a.design = b.design AND a.slot % 2 = 0 AND b.slot = a.slot + 1)"""


def _pairs(s, d):
    g = A.designs(s, d).groupBy("design").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "members"))), lambda x: x["members"][0]).alias("m"))
    halves = F.transform(F.sequence(F.lit(0), (F.size("m") / 2).cast("int") - 1), lambda i: F.struct(i.alias("pair"), F.get("m", 2 * i).alias("conv"), F.get("m", 2 * i + 1).alias("ctrl")))
    return g.filter(F.size("m") >= 2).select("design", F.explode(halves).alias("p")).select("design", "p.pair", "p.conv", "p.ctrl")


@query("G2_two_pair_combos", f"{_PAIRS} SELECT a.design, a.pair AS i, b.pair AS j, a.conv AS c0, a.ctrl AS c1, b.conv AS c2, b.ctrl AS c3 FROM p a JOIN p b ON a.design = b.design AND a.pair < b.pair")
def g2(s, d):
    return design.two_pair_combos(_pairs(s, d))


@query("G3_binary_response", f"{_PROD} SELECT design, combo_idx, slot, species, CASE WHEN slot % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS y FROM combo")
def g3(s, d):
    return design.assign_response(_combos(s, d)).select("design", "combo_idx", "slot", "species", "y")


_SUPP = "SELECT 's_' || s_suppkey AS species, s_acctbal AS value FROM supplier"


@query("G3_continuous_response", f"WITH {A.DESIGN}, x AS (SELECT design, line_no, members[1] AS species FROM grp) SELECT x.design, x.line_no AS slot, species, value AS y FROM x JOIN ({_SUPP}) USING (species)")
def g3c(s, d):
    combo = A.designs(s, d).select("design", F.col("line_no").alias("slot"), F.get("members", F.lit(0)).alias("species"))
    pheno = A.table(s, d, "supplier").select(F.concat(F.lit("s_"), F.col("s_suppkey").cast("string")).alias("species"), F.col("s_acctbal").alias("value"))
    return design.assign_response(combo, pheno).select("design", "slot", "species", "y")


@query("G4_combo_tag", f"""{_PROD}, f AS (SELECT design, combo_idx, max(species) FILTER (slot = 0) AS first, count(*) AS n FROM combo GROUP BY ALL)
SELECT design, combo_idx, CASE WHEN n > 12 THEN 'combo_' || combo_idx ELSE string_agg(substr(CASE WHEN contains(first, '_') THEN coalesce(nullif(split_part(species, '_', 2), ''), species) ELSE species END, 1, 3), '.' ORDER BY slot) END AS combo_tag
FROM combo JOIN f USING (design, combo_idx) GROUP BY design, combo_idx, n""")
def g4(s, d):
    return design.combo_tag(_combos(s, d), ["design", "combo_idx"])


@query("G5_null_flips", f"""{_PROD}, n AS (SELECT design, combo_idx, count(*) // 2 AS n FROM combo GROUP BY ALL HAVING count(*) % 4 = 0),
m AS (SELECT design, combo_idx, n, unnest(range(1 << n::INT)) AS m FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY design, combo_idx ORDER BY m) - 1 AS flip FROM m WHERE bit_count(m) * 2 = n AND m & 1 = CASE WHEN combo_idx % 2 = 0 THEN 1 ELSE 0 END)
SELECT k.design, k.combo_idx, CAST(flip AS INT) AS flip, c.slot, CASE WHEN (m >> (c.slot // 2)) & 1 = 1 THEN o.species ELSE c.species END AS species
FROM k JOIN combo c USING (design, combo_idx) JOIN combo o ON o.design = k.design AND o.combo_idx = k.combo_idx AND o.slot = xor(c.slot, 1)""")
def g5(s, d):
    return design.null_flips(_combos(s, d), ["design", "combo_idx"]).withColumn("flip", F.col("flip").cast("int"))


@query("G5_flip_of_rank", """WITH RECURSIVE pascal AS (SELECT 0 AS n, [1::BIGINT] AS row UNION ALL SELECT n + 1, list_transform(range(n + 2), lambda i: (CASE WHEN i > 0 THEN row[i] ELSE 0 END) + coalesce(row[i + 1], 0)) FROM pascal WHERE n < 40),
a AS (SELECT p_partkey AS key, p_partkey * 1000003 * 977 % 68923264410 AS r FROM part),
st AS (SELECT key, r, 20 - (key % 2)::INT AS j, 0::BIGINT AS m, 38 AS c FROM a UNION ALL SELECT key, CASE WHEN t THEN r - b ELSE r END, CASE WHEN t THEN j - 1 ELSE j END, CASE WHEN t THEN m + (1::BIGINT << c) ELSE m END, c - 1
  FROM (SELECT st.*, coalesce(row[j + 1], 0) AS b, j > 0 AND r >= coalesce(row[j + 1], 0) AS t FROM st JOIN pascal ON pascal.n = c WHERE c >= 0))
SELECT key, m * 2 + key % 2 AS mask, bit_count(m * 2 + key % 2)::INT AS swapped FROM st WHERE c < 0""")
def g5_rank(s, d):
    """Halves of forty pairs by their rank; there are 68,923,264,410 for a design."""
    key = F.col("p_partkey")
    mask = design.flip_mask(key * 1000003 * 977 % 68923264410, F.lit(40), key % 2 == 1)
    return A.table(s, d, "part").select(key.alias("key"), mask.alias("mask")).withColumn("swapped", F.bit_count("mask").cast("int"))


def _bounds(s, d):
    b = A.table(s, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 9 + 1).alias("k"))
    return b.select("key", (F.col("k") / 20).alias("low1"), (F.col("k") / 20 + 0.3).alias("high1"), F.lit(0.1).alias("low2"), (F.col("k") / 10 + 0.05).alias("high2"))


_B = "b AS (SELECT p_partkey AS key, (p_partkey % 9 + 1) / 20.0::DOUBLE AS low1, (p_partkey % 9 + 1) / 20.0::DOUBLE + 0.3 AS high1, 0.1::DOUBLE AS low2, (p_partkey % 9 + 1) / 10.0::DOUBLE + 0.05 AS high2 FROM part)"


@query("G7_grid_linear", f"""WITH {_B}, x AS (SELECT key, round(low1 + unnest(range(CAST(greatest(floor((high1 - low1 + 1e-12) / 0.05 + 1e-9), 0) AS BIGINT) + 1)) * 0.05::DOUBLE, 3) AS lambda1 FROM b),
y AS (SELECT key, round(low2 + unnest(range(CAST(greatest(floor((high2 - low2 + 1e-12) / 0.05 + 1e-9), 0) AS BIGINT) + 1)) * 0.05::DOUBLE, 3) AS lambda2 FROM b) SELECT key, lambda1, lambda2 FROM x JOIN y USING (key)""")
def g7(s, d):
    return design.grid_linear(_bounds(s, d))


@query("G8_grid_log", f"""WITH {_B}, i AS (SELECT unnest(range(20)) AS i), c AS (SELECT *, power(10.0::DOUBLE, CAST(trunc(abs(log10(low1))) AS INT) + 5) AS sc FROM b),
x AS (SELECT key, round(power(10.0::DOUBLE, log10(low1) + i * (log10(high1) - log10(low1)) / 19) * sc) / sc AS lambda1 FROM c CROSS JOIN i),
y AS (SELECT key, round(power(10.0::DOUBLE, log10(low2) + i * (log10(high2) - log10(low2)) / 19) * sc) / sc AS lambda2 FROM c CROSS JOIN i) SELECT key, lambda1, lambda2 FROM x JOIN y USING (key)""")
def g8(s, d):
    return design.grid_log(_bounds(s, d))


# ---- coefficients ----

_TRAIN = f"WITH {A.ALN}, {A.COMBO}, {A.COEF}, {A.MODEL}, hits AS (SELECT c.combo_idx, c.run, x.species, c.weight FROM coef c JOIN aln x ON x.gene = c.gene AND substr(x.seq, c.pos + 1, 1) = c.aa WHERE NOT EXISTS (SELECT 1 FROM combo t WHERE t.combo_idx = c.combo_idx AND t.species = x.species))"


def _hits(s, d):
    return score.exclude_training(score.score_alignment(A.coefficients(s, d), A.alignment(s, d)), A.combos(s))


@query("J2_prediction_hits", f"{_TRAIN} SELECT combo_idx, run, species, count(*) AS hits, round(sum(weight), 6) AS s FROM hits GROUP BY ALL")
def j2(s, d):
    return _hits(s, d).groupBy("combo_idx", "run", "species").agg(F.count("*").alias("hits"), F.round(F.sum("weight"), 6).alias("s"))


@query("A3_species_scores", f"{_TRAIN} SELECT combo_idx, run, species, round(sum(weight) + any_value(intercept), 6) AS sps FROM hits JOIN model USING (combo_idx, run) GROUP BY ALL")
def a3(s, d):
    return score.species_scores(_hits(s, d), A.models(s, d))


@query("J4_attach_phenotype", f"""{_TRAIN}, p AS (SELECT combo_idx, run, species, round(sum(weight) + any_value(intercept), 6) AS sps FROM hits JOIN model USING (combo_idx, run) GROUP BY ALL),
ph AS (SELECT 'sp' || lpad(CAST(doc_id % 16 AS VARCHAR), 2, '0') AS species, CAST(min(doc_id % 16) % 3 - 1 AS DOUBLE) AS value FROM documents GROUP BY 1)
SELECT combo_idx, run, species, sps, nullif(value, 0.0) AS true_phenotype FROM p JOIN ph USING (species)""")
def j4(s, d):
    return score.attach_phenotype(score.species_scores(_hits(s, d), A.models(s, d)), _phenotypes(s, d))


def _phenotypes(s, d):
    return A.table(s, d, "documents").groupBy(F.concat(F.lit("sp"), F.lpad((F.col("doc_id") % 16).cast("string"), 2, "0")).alias("species")).agg((F.min(F.col("doc_id") % 16) % 3 - 1).cast("double").alias("value"))


# The same with a coefficient for each gene, however many items there are.

_TRAIN_ALL = _TRAIN.replace(A.COEF, A.ALL_COEF)
_SPS_ALL = "SELECT combo_idx, run, species, round(sum(weight) + any_value(intercept), 6) AS sps FROM hits JOIN model USING (combo_idx, run) GROUP BY ALL"


def _all_hits(s, d):
    return score.exclude_training(score.score_alignment(A.all_gene_coefficients(s, d), A.alignment(s, d)), A.combos(s))


@query("J2_prediction_hits_all_genes", f"{_TRAIN_ALL} SELECT combo_idx, run, species, count(*) AS hits, round(sum(weight), 6) AS s FROM hits GROUP BY ALL")
def j2_all(s, d):
    return _all_hits(s, d).groupBy("combo_idx", "run", "species").agg(F.count("*").alias("hits"), F.round(F.sum("weight"), 6).alias("s"))


@query("A3_species_scores_all_genes", f"{_TRAIN_ALL} {_SPS_ALL}")
def a3_all(s, d):
    return score.species_scores(_all_hits(s, d), A.models(s, d))


@query("J4_attach_phenotype_all_genes", f"""{_TRAIN_ALL}, p AS ({_SPS_ALL}),
ph AS (SELECT 'sp' || lpad(CAST(doc_id % 16 AS VARCHAR), 2, '0') AS species, CAST(min(doc_id % 16) % 3 - 1 AS DOUBLE) AS value FROM documents GROUP BY 1)
SELECT combo_idx, run, species, sps, nullif(value, 0.0) AS true_phenotype FROM p JOIN ph USING (species)""")
def j4_all(s, d):
    return score.attach_phenotype(score.species_scores(_all_hits(s, d), A.models(s, d)), _phenotypes(s, d))


@query("S15_prediction_parts_all_genes", f"{_TRAIN_ALL} {_SPS_ALL}")
def s15_all(s, d):
    return _prediction_parts(s, score.species_scores(_all_hits(s, d), A.models(s, d)))


_FEATS = """fx AS (SELECT combo_idx, gene, pos, aa, CAST(hash_mask AS BIGINT) AS mask FROM (SELECT DISTINCT combo_idx, gene, pos, aa, (pos * 7 + combo_idx * 13) % 255 + 1 AS hash_mask FROM coef)),
ih AS (SELECT c.combo_idx, c.run, s.slot, c.weight FROM coef c JOIN fx USING (combo_idx, gene, pos, aa) JOIN (SELECT CAST(unnest(range(8)) AS INT) AS slot) s ON (mask >> s.slot) & 1 = 1),
cy AS (SELECT DISTINCT c.combo_idx, s.slot, CASE WHEN s.slot % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS y FROM coef c CROSS JOIN (SELECT CAST(unnest(range(8)) AS INT) AS slot) s)"""


def _inputs(s, d):
    coef = A.coefficients(s, d)
    f = coef.select("combo_idx", "gene", "pos", "aa").distinct().withColumn("mask", (F.col("pos") * 7 + F.col("combo_idx") * 13) % 255 + 1)
    combo = coef.select("combo_idx").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("y", F.when(F.col("slot") % 2 == 0, 1.0).otherwise(-1.0))
    return score.score_inputs(coef, f, combo), combo


@query("J3_input_hits", f"WITH {A.COEF}, {_FEATS} SELECT combo_idx, run, slot, count(*) AS hits, round(sum(weight), 6) AS s FROM ih GROUP BY ALL")
def j3(s, d):
    return _inputs(s, d)[0].groupBy("combo_idx", "run", "slot").agg(F.count("*").alias("hits"), F.round(F.sum("weight"), 6).alias("s"))


def _rmse(name: str, untouched: str, base: str) -> None:
    @query(name, f"""WITH {A.COEF}, {A.MODEL}, {_FEATS}, sl AS (SELECT combo_idx, run, slot, sum(weight) AS s FROM ih GROUP BY ALL)
    SELECT m.combo_idx, m.run, round(sqrt(avg(power(coalesce(s + intercept, {base}) - y, 2))), 6) AS rmse FROM model m JOIN cy USING (combo_idx) LEFT JOIN sl ON sl.combo_idx = m.combo_idx AND sl.run = m.run AND sl.slot = cy.slot GROUP BY m.combo_idx, m.run""")
    def run(s, d):
        hits, combo = _inputs(s, d)
        return score.input_rmse(hits, A.models(s, d), combo, untouched)


_rmse("A4_input_rmse", "zero", "0.0")
_rmse("M7_saved_model_rmse", "intercept", "intercept")

_GSS = f"WITH {A.COEF}, gs AS (SELECT combo_idx, run, gene, round(sum(abs(weight)), 6) AS gss FROM coef GROUP BY ALL HAVING round(sum(abs(weight)), 6) > 0), rk AS (SELECT *, row_number() OVER (PARTITION BY combo_idx, run ORDER BY gss DESC, gene) AS rank FROM gs)"


@query("A1_gene_scores", f"{_GSS} SELECT combo_idx, run, gene, gss FROM gs")
def a1(s, d):
    return score.gene_scores(A.coefficients(s, d))


@query("A1_num_genes", f"{_GSS} SELECT combo_idx, run, count(*) AS num_genes FROM gs GROUP BY ALL")
def a1n(s, d):
    return score.num_genes(score.gene_scores(A.coefficients(s, d)))


_PSS = f"WITH {A.COEF}, ps AS (SELECT gene, pos, max(p) AS pss FROM (SELECT combo_idx, run, gene, pos, round(sum(abs(weight)), 6) AS p FROM coef GROUP BY ALL) GROUP BY ALL)"


@query("A2_site_scores", f"{_PSS} SELECT gene, pos, pss FROM ps")
def a2(s, d):
    return score.site_scores(A.coefficients(s, d))


@query("S17_selected_sites", f"{_PSS} SELECT gene AS gene_name, pos + 1 AS position, pss FROM ps")
def s17(s, d):
    return score.selected_sites(score.site_scores(A.coefficients(s, d))).orderBy("gene_name", "position")


@query("W1_rank_genes", f"{_GSS} SELECT combo_idx, run, gene, gss, CAST(rank AS INT) AS rank FROM rk")
def w1(s, d):
    return score.rank_genes(score.gene_scores(A.coefficients(s, d)))


_ALLG = "allg AS (SELECT DISTINCT gene FROM coef UNION SELECT DISTINCT 'x' || p_partkey % 5 FROM part)"
_MULTI = f"""{_GSS}, {_ALLG}, cb AS (SELECT combo_idx, gene, min(rank) AS rank, max(gss) AS gss FROM rk GROUP BY ALL), mr AS (SELECT a.gene, count(c.gene) AS num_combos_ranked,
  count(*) FILTER (c.rank <= greatest(1.0, (SELECT count(*) FROM allg) * 0.1)) AS num_combos_ranked_top, coalesce(max(c.gss), 0.0) AS highest_ever_gss, CAST(min(c.rank) AS DOUBLE) AS best_ever_rank FROM allg a LEFT JOIN cb c USING (gene) GROUP BY a.gene)"""


def _genes(s, d):
    extra = A.table(s, d, "part").select(F.concat(F.lit("x"), (F.col("p_partkey") % 5).cast("string")).alias("gene"))
    return A.coefficients(s, d).select("gene").unionByName(extra).distinct()


@query("A5_W7_gene_ranks_multi", f"{_MULTI} SELECT * FROM mr")
def a5(s, d):
    return score.order_multi(score.gene_ranks_multi(score.rank_genes(score.gene_scores(A.coefficients(s, d))), _genes(s, d), 0.1))


@query("R3_rebuilt_ranks", f"{_MULTI} SELECT * FROM mr")
def r3(s, d):
    """Ranks from stored coefficients; some designs were stored twice, as after a broken run."""
    coef, folder = checkpointed(A.coefficients(s, d)), shared_folder(s)
    ledger.store_coefficients(coef.filter("combo_idx <= 4"), folder)
    ledger.store_coefficients(coef.filter("combo_idx > 2"), folder)
    return ledger.rebuild_ranks(ledger.stored_coefficients(s, folder, coef.schema), _genes(s, d), 0.1)


@query("R2_force_restart", f"WITH {A.COEF} SELECT DISTINCT combo_idx FROM coef WHERE combo_idx > 2")
def r2(s, d):
    """Designs that are left after a run was started anew under other settings and broke off."""
    designs, folder = checkpointed(A.coefficients(s, d).select("combo_idx").distinct()), shared_folder(s)
    ledger.start_run(s, folder, {"grid": "a"})
    ledger.append_audit(designs.filter("combo_idx <= 5"), folder, {"grid": "a"})
    ledger.start_run(s, folder, {"grid": "b"}, force=True)
    ledger.append_audit(designs.filter("combo_idx <= 2"), folder, {"grid": "b"})
    return ledger.pending(designs, ledger.start_run(s, folder, {"grid": "b", "threads": 3}))


@query("S20_audit_ledger", f"WITH {A.MODEL} SELECT combo_idx, run, intercept + 0.0 AS intercept FROM model")
def s20(s, d):
    """The ledger of finished models as JSON lines, added to twice."""
    models, folder = checkpointed(A.models(s, d)), shared_folder(s)
    for part in ("combo_idx <= 3", "combo_idx > 3"):
        ledger.append_audit(models.filter(part), folder, {"grid": "a"})
    return s.read.schema("combo_idx long, run long, intercept double, config string").json(folder).withColumn("intercept", F.col("intercept") + 0.0).drop("config")


@query("S16_gene_rank_files", f"""{_MULTI}, t AS (SELECT *, regexp_replace(printf('%.15f', highest_ever_gss), '\\.?0+$', '') AS g, coalesce(regexp_replace(printf('%.15f', best_ever_rank), '\\.?0+$', ''), 'None') AS r FROM mr)
SELECT gene || ',' || num_combos_ranked || ',' || num_combos_ranked_top || ',' || g || ',' || r AS line FROM t""")
def s16(s, d):
    folder = shared_folder(s)
    texts.write_gene_ranks(score.gene_ranks_multi(score.rank_genes(score.gene_scores(A.coefficients(s, d))), _genes(s, d), 0.1), folder)
    return texts.read_ranged(s, folder).select("line")


@query("A6_W6_gene_ranks_single", f"{_GSS}, {_ALLG} SELECT a.gene, coalesce(max(gss), 0.0) AS highest_gss, CAST(min(rank) AS DOUBLE) AS best_rank FROM allg a LEFT JOIN rk USING (gene) GROUP BY a.gene")
def a6(s, d):
    return score.order_single(score.gene_ranks_single(score.rank_genes(score.gene_scores(A.coefficients(s, d))), _genes(s, d)))


@query("W10_top_genes", f"{_GSS} SELECT gene, max(gss) AS gss FROM gs GROUP BY gene ORDER BY gss DESC, gene LIMIT 10")
def w10(s, d):
    """A top-ten report."""
    return score.gene_scores(A.coefficients(s, d)).groupBy("gene").agg(F.max("gss").alias("gss")).orderBy(F.desc("gss"), "gene").limit(10)


@query("J9_sites_with_length", f"{_PSS}, {_ALLG}, ln AS (SELECT 'x' || p_partkey % 5 AS gene, CAST(max(p_partkey) AS INT) AS n FROM part GROUP BY 1) SELECT a.gene, count(pos) AS n_sites, coalesce(any_value(n), max(pos), 1) AS length FROM allg a LEFT JOIN ps USING (gene) LEFT JOIN ln USING (gene) GROUP BY a.gene")
def j9(s, d):
    lengths = A.table(s, d, "part").groupBy(F.concat(F.lit("x"), (F.col("p_partkey") % 5).cast("string")).alias("gene")).agg(F.max("p_partkey").cast("int").alias("n"))
    return score.sites_with_length(_genes(s, d), score.site_scores(A.coefficients(s, d)), lengths)


@query("M4_prox", f"""WITH {A.COEF}, so AS (SELECT *, sign(weight) * greatest(abs(weight) - 0.004, 0) AS s FROM coef), nz AS (SELECT * FROM so WHERE s <> 0),
nm AS (SELECT combo_idx, run, gene, sqrt(sum(s * s)) AS norm FROM nz GROUP BY ALL)
SELECT combo_idx, run, gene, pos, aa, round(s * greatest(norm - 0.01, 0) / norm, 9) AS weight FROM nz JOIN nm USING (combo_idx, run, gene) WHERE round(s * greatest(norm - 0.01, 0) / norm, 9) <> 0""")
def m4(s, d):
    return fitting.prox(A.coefficients(s, d), F.lit(0.004), F.lit(0.01), ["combo_idx", "run", "gene"])


@query("M8_is_continuous", f"WITH {A.COEF} SELECT combo_idx, NOT bool_and(abs(abs(weight) - 1) <= 1e-12 OR abs(weight) <= 1e-12) AS is_continuous FROM coef GROUP BY combo_idx")
def m8(s, d):
    k = validate.phenotype_kind(A.coefficients(s, d).select("combo_idx", F.col("weight").alias("value")), ["combo_idx"])
    return k.select("combo_idx", (~F.col("is_binary")).alias("is_continuous"))


@query("S14_split_labels", f"WITH {A.COEF} SELECT combo_idx, run, gene, pos, aa, weight FROM coef")
def s14(s, d):
    c = A.coefficients(s, d)
    return texts.split_labels(c.select("combo_idx", "run", "weight", F.concat_ws("_", "gene", F.col("pos").cast("string"), "aa").alias("label")))


@query("R1_pending_designs", f"WITH {A.COEF}, k AS (SELECT DISTINCT combo_idx, run FROM coef) SELECT combo_idx, run FROM k WHERE combo_idx NOT IN (SELECT o_orderkey % 4 FROM orders)")
def r1(s, d):
    audit = A.table(s, d, "orders").select((F.col("o_orderkey") % 4).alias("combo_idx"))
    return ledger.pending(A.coefficients(s, d).select("combo_idx", "run").distinct(), audit)


@query("S15_prediction_parts", f"{_TRAIN} SELECT combo_idx, run, species, round(sum(weight) + any_value(intercept), 6) AS sps FROM hits JOIN model USING (combo_idx, run) GROUP BY ALL")
def s15(s, d):
    """Predictions written a part per design, twice, and read back: no row is there twice."""
    return _prediction_parts(s, score.species_scores(_hits(s, d), A.models(s, d)))


@query("S15_prediction_text", f"""{_TRAIN}, p AS (SELECT combo_idx, run, species, round(sum(weight) + any_value(intercept), 6) AS sps FROM hits JOIN model USING (combo_idx, run) GROUP BY ALL)
SELECT 'combo_' || combo_idx || ',' || regexp_replace(printf('%.15f', (run + 1) / 100.0::DOUBLE), '\\.?0+$', '') || ',' || species || ',' || regexp_replace(printf('%.15f', sps), '\\.?0+$', '') AS line, true AS in_order FROM p""")
def s15_text(s, d):
    """Parts by design merged as text in the designs' order: no line has one of a later design before it."""
    p, folder = _prediction_parts(s, score.species_scores(_hits(s, d), A.models(s, d))), shared_folder(s)
    label = F.concat(F.lit("combo_"), F.col("combo_idx").cast("string")).alias("species_combo")
    texts.write_prediction_text(p.select("combo_idx", label, ((F.col("run") + 1) / 100).alias("lambda1"), "species", "sps"), folder)
    lines = checkpointed(texts.read_ranged(s, folder).withColumn("combo", F.regexp_extract("line", r"^combo_(\d+),", 1).cast("int")))
    ends = lines.groupBy("file").agg(F.min("combo").alias("low"), F.max("combo").alias("high"))
    before = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    wrong = ends.alias("a").join(ends.alias("b"), F.col("a.file") < F.col("b.file")).groupBy(F.col("b.file").alias("file")).agg(F.max("a.high").alias("ahead"))
    placed = lines.withColumn("top", F.max("combo").over(before)).join(wrong, "file", "left")
    return placed.select("line", (F.coalesce("combo", F.lit(0)) >= F.greatest(F.coalesce("top", F.lit(0)), F.coalesce("ahead", F.lit(0)))).alias("in_order"))


@query("S14_model_files", f"WITH {A.COEF}, {A.MODEL} SELECT combo_idx, run, gene, pos, aa, weight FROM coef UNION ALL SELECT combo_idx, run, 'Intercept', -1, '', intercept + 0.0 FROM model")
def s14_files(s, d):
    """Models as text files, a file each, and read back; penalties come from the names."""
    coef, models = _saved(s, d)
    run = (F.round(F.col("lambda1") * 100).cast("long") - 1).alias("run")
    whole = models.select("combo_idx", run, F.lit("Intercept").alias("gene"), F.lit(-1).alias("pos"), F.lit("").alias("aa"), (F.col("intercept") + 0.0).alias("weight"))
    return coef.select("combo_idx", run, "gene", "pos", "aa", "weight").unionByName(whole)


@query("M7_saved_model_scores", f"{_TRAIN} SELECT combo_idx, run, species, round(sum(weight) + any_value(intercept), 6) AS sps FROM hits JOIN model USING (combo_idx, run) GROUP BY ALL")
def m7_scores(s, d):
    """Saved models, read from their files, score the species that they were not fitted on."""
    coef, models = _saved(s, d)
    p = score.predict_saved(coef, models, A.alignment(s, d), A.combos(s), ["combo_idx", "lambda1", "lambda2"])
    return p.select("combo_idx", (F.round(F.col("lambda1") * 100).cast("long") - 1).alias("run"), "species", F.round("sps", 6).alias("sps"))


def _saved(s, d):
    folder = shared_folder(s)
    points = lambda df: df.withColumn("lambda1", (F.col("run") + 1) / 100).withColumn("lambda2", F.lit(0.5)).drop("run")
    texts.write_models(points(A.coefficients(s, d)), points(A.models(s, d)), folder)
    return texts.read_models(s, folder)


def _prediction_parts(s, predictions):
    p = checkpointed(predictions)
    folder = shared_folder(s)
    texts.write_predictions(p, folder)
    texts.write_predictions(p.filter("combo_idx <= 2"), folder)
    return s.read.parquet(folder).select(F.col("combo_idx").cast("long").alias("combo_idx"), "run", "species", "sps")


@query("R4_reuse", f"{_PSS} SELECT gene, pos, pss FROM ps")
def r4(s, d):
    folder = shared_folder(s)
    ledger.reuse(s, folder, lambda: score.site_scores(A.coefficients(s, d)))
    return ledger.reuse(s, folder, lambda: s.createDataFrame([], "gene string, pos int, pss double"))


@query("A22_J6_U1_benchmark_summary", f"""WITH {A.COEF}, bg AS (SELECT combo_idx, run, gene, round(sum(abs(weight)), 6) AS score FROM coef GROUP BY ALL), sm AS (SELECT combo_idx, run, gene, round(score * 1.5, 6) AS score FROM bg WHERE (run + length(gene) + combo_idx) % 3 = 0 AND substr(gene, 7, 1) IN ('1', '2')),
al AS (SELECT *, 0 AS sim FROM bg WHERE (combo_idx, run, gene) NOT IN (SELECT (combo_idx, run, gene) FROM sm) UNION ALL SELECT *, 1 FROM sm), r AS (SELECT *, row_number() OVER (PARTITION BY combo_idx, run ORDER BY score DESC, gene) AS r FROM al)
SELECT combo_idx, run, count(*) FILTER (r <= 10 AND sim = 1) AS found, CAST(sum(sim) AS BIGINT) AS simulated, count(*) AS genes FROM r GROUP BY ALL""")
def a22(s, d):
    bg = score.gene_scores(A.coefficients(s, d)).withColumnRenamed("gss", "score")
    sm = bg.filter(((F.col("run") + F.length("gene") + F.col("combo_idx")) % 3 == 0) & F.substring("gene", 7, 1).isin("1", "2")).withColumn("score", F.round(F.col("score") * 1.5, 6))
    return metrics.benchmark_summary(bg, sm, ["combo_idx", "run"], 10)


@query("A23_parity", f"""{_GSS}, j AS (SELECT a.gss AS x, b.gss AS y FROM gs a JOIN gs b ON a.combo_idx = b.combo_idx AND a.gene = b.gene AND a.run = b.run + 1) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson FROM j""")
def a23(s, d):
    g = score.gene_scores(A.coefficients(s, d))
    return metrics.parity(g, g.withColumn("run", F.col("run") + 1), ["combo_idx", "gene", "run"], "gss")


@query("U2_common_top_genes", f"{_GSS}, t AS (SELECT combo_idx, gene FROM rk WHERE rank <= 10 GROUP BY ALL) SELECT DISTINCT a.gene FROM t a JOIN t b USING (gene) WHERE a.combo_idx = 1 AND b.combo_idx = 2")
def u2(s, d):
    r = score.rank_genes(score.gene_scores(A.coefficients(s, d))).filter("rank <= 10")
    return r.filter("combo_idx = 1").select("gene").intersect(r.filter("combo_idx = 2").select("gene"))


@query("U3_genes_except", f"WITH {A.COEF} SELECT DISTINCT gene FROM coef WHERE combo_idx = 1 EXCEPT SELECT gene FROM coef WHERE combo_idx = 7 AND run < 10")
def u3(s, d):
    c = A.coefficients(s, d)
    return c.filter("combo_idx = 1").select("gene").subtract(c.filter("combo_idx = 7 AND run < 10").select("gene"))


# ---- predictions ----

_BIN = """count(*) AS n, round(avg(((sps > 0) = (label > 0))::INT), 6) AS accuracy, round(coalesce(avg(((sps > 0) = (label > 0))::INT) FILTER (label > 0), 0), 6) AS tpr,
  round(coalesce(avg(((sps > 0) = (label > 0))::INT) FILTER (label <= 0), 0), 6) AS tnr,
  round((coalesce(avg(((sps > 0) = (label > 0))::INT) FILTER (label > 0), 0) + coalesce(avg(((sps > 0) = (label > 0))::INT) FILTER (label <= 0), 0)) / 2, 6) AS balanced, round(avg((sps * label > 0)::INT), 6) AS plot_accuracy"""


@query("A11_binary_metrics", f"WITH {A.PRED} SELECT run, {_BIN} FROM prediction WHERE label <> 0 AND sps IS NOT NULL GROUP BY run")
def a11(s, d):
    return metrics.binary_metrics(A.predictions(s, d), ["run"])


_AUC = """r AS (SELECT {k}, label, rank() OVER (PARTITION BY {k} ORDER BY sps) + (count(*) OVER (PARTITION BY {k}, sps) - 1) / 2.0::DOUBLE AS rk FROM {t} WHERE label <> 0 AND sps IS NOT NULL)
SELECT {k}, round((sum(rk) FILTER (label > 0) - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS auroc FROM r JOIN (SELECT {k}, count(*) FILTER (label > 0)::DOUBLE AS p, count(*) FILTER (label < 0)::DOUBLE AS q FROM r GROUP BY {k}) USING ({k}) GROUP BY {k}, p, q"""


@query("A12_auroc", f"WITH {A.PRED}, {_AUC.format(k='run', t='prediction')}")
def a12(s, d):
    return metrics.auroc(A.predictions(s, d), ["run"])


_CONT = """a AS (SELECT run, sps, label::DOUBLE AS y FROM prediction WHERE sps IS NOT NULL), b AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY sps) + (count(*) OVER (PARTITION BY run, sps) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY run ORDER BY y) + (count(*) OVER (PARTITION BY run, y) - 1) / 2.0::DOUBLE AS rb FROM a)
SELECT run, count(*) AS n, CASE WHEN var_pop(sps) > 0 AND var_pop(y) > 0 THEN round(corr(sps, y), 6) END AS pearson, CASE WHEN var_pop(sps) > 0 AND var_pop(y) > 0 THEN round(corr(ra, rb), 6) END AS spearman,
  round(sqrt(avg((sps - y) * (sps - y))), 6) AS rmse, round(avg(abs(sps - y)), 6) AS mae, CASE WHEN count(*) >= 2 AND var_pop(y) > 1e-12 THEN round(1 - sum((sps - y) * (sps - y)) / (var_pop(y) * count(*)), 6) END AS r2 FROM b GROUP BY run"""


@query("A13_continuous_metrics", f"WITH {A.PRED}, {_CONT}")
def a13(s, d):
    return metrics.continuous_metrics(A.predictions(s, d).withColumn("y", F.col("label").cast("double")), ["run"])


@query("A14_species_mean_metrics", f"WITH {A.PRED}, m AS (SELECT num_genes, species, round(avg(sps), 9) AS sps, min(label) AS label FROM prediction GROUP BY ALL) SELECT num_genes, {_BIN} FROM m WHERE label <> 0 GROUP BY num_genes")
def a14(s, d):
    return metrics.binary_metrics(metrics.species_means(A.predictions(s, d), ["num_genes"]), ["num_genes"])


@query("A15_per_species", f"""WITH {A.PRED} SELECT species, count(*) AS n, round(avg(sps), 6) AS mean, round(quantile_cont(sps, 0.25), 6) AS q25, round(quantile_cont(sps, 0.75), 6) AS q75, round(quantile_cont(sps, 0.75) - quantile_cont(sps, 0.25), 6) AS iqr,
  round(avg(((sps > 0) = (label > 0))::INT), 6) AS sign_match, round(avg(sps - label), 6) AS bias, round(avg(abs(sps - label)), 6) AS mae, round(sqrt(avg((sps - label) * (sps - label))), 6) AS rmse FROM prediction GROUP BY species""")
def a15(s, d):
    return metrics.per_species(A.predictions(s, d), [])


@query("A16_mfs_subsets", f"""WITH {A.PRED}, p AS (SELECT *, (rank() OVER (ORDER BY input_rmse) + (count(*) OVER (PARTITION BY input_rmse) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM prediction),
x AS (SELECT 'all' AS subset, * FROM p UNION ALL SELECT 'mfs_5', * FROM p WHERE pct < 0.05 UNION ALL SELECT 'mfs_10', * FROM p WHERE pct < 0.10 UNION ALL SELECT 'mfs_25', * FROM p WHERE pct < 0.25)
SELECT subset, {_BIN} FROM x WHERE label <> 0 AND sps IS NOT NULL GROUP BY subset""")
def a16(s, d):
    return metrics.binary_metrics(metrics.mfs_subsets(A.predictions(s, d)), ["subset"])


@query("A17_robust_scale", f"""WITH {A.PRED}, q AS (SELECT run, quantile_cont(sps, 0.1) AS a, quantile_cont(sps, 0.5) AS m, quantile_cont(sps, 0.9) AS b FROM prediction GROUP BY run), d AS (SELECT run, quantile_cont(abs(sps - m), 0.5) AS mad FROM prediction JOIN q USING (run) GROUP BY run)
SELECT run, round(m, 6) AS median, round(mad, 6) AS mad, round(greatest(1.4826 * mad, (b - a) / 2.563, 1e-9), 6) AS scale FROM q JOIN d USING (run)""")
def a17(s, d):
    return metrics.robust_scale(A.predictions(s, d), ["run"], "sps")


@query("A18_log_histogram", """WITH c AS (SELECT o_totalprice AS v FROM orders WHERE o_totalprice > 0), e AS (SELECT log10(min(v)) AS a, log10(max(v)) AS b FROM c)
SELECT CAST(least(coalesce(floor((log10(v) - a) / nullif(b - a, 0) * 40 + 1e-9), 0), 39) AS BIGINT) AS bin, count(*) AS n FROM c, e GROUP BY 1""")
def a18(s, d):
    return metrics.histogram_log(A.table(s, d, "orders"), "o_totalprice")


@query("A18_auto_histogram", """WITH v AS (SELECT 'balance' AS what, c_acctbal AS v FROM customer UNION ALL SELECT 'price', o_totalprice FROM orders UNION ALL SELECT 'amount', l_extendedprice * l_extendedprice FROM lineitem),
s AS (SELECT what, count(v)::DOUBLE AS k, min(v) AS a, max(v) AS b, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY what),
w AS (SELECT *, CASE WHEN a > 0 THEN log10(b) - log10(a) ELSE 0 END AS dec, (b - a) / (log2(k) + 1) AS st, 2 * (q3 - q1) / power(k, 1 / 3.0::DOUBLE) AS fd FROM s),
e AS (SELECT what, a, b, dec >= 2 AS is_log, CASE WHEN dec >= 2 THEN least(60, greatest(20, CAST(trunc(15 * dec) AS INT))) - 1 ELSE CAST(ceil((b - a) / CASE WHEN fd > 0 THEN least(st, fd) ELSE st END) AS INT) END AS bins FROM w)
SELECT what, is_log, bins, least(CAST(floor(CASE WHEN is_log THEN (log10(v) - log10(a)) / (log10(b) - log10(a)) ELSE (v - a) / (b - a) END * bins + 1e-9) AS INT), bins - 1) AS bin, count(*) AS n FROM v JOIN e USING (what) GROUP BY ALL""")
def a18_auto(s, d):
    parts = [("balance", "customer", F.col("c_acctbal")), ("price", "orders", F.col("o_totalprice")), ("amount", "lineitem", F.col("l_extendedprice") * F.col("l_extendedprice"))]
    rows = None
    for what, name, v in parts:
        part = A.table(s, d, name).select(F.lit(what).alias("what"), v.alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return metrics.histogram_auto(rows, "v", ["what"])


@query("A20_sps_density", f"""WITH {A.PRED}, p AS (SELECT *, (rank() OVER (ORDER BY input_rmse) + (count(*) OVER (PARTITION BY input_rmse) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM prediction WHERE num_genes > 0),
x AS (SELECT label, floor((round(least(greatest(sps, -1), 1) * 1e9) + 5e6) / 1e7) / 100 AS sps FROM p WHERE pct < 0.25 AND label <> 0), g AS (SELECT CAST(unnest(range(41)) AS INT) AS i)
SELECT label, i, round(sum(exp(-0.5 * power((-1.0 + i * 0.05::DOUBLE - sps) / 0.1, 2))) / (any_value(n) * 0.1 * 2.5066282746310002), 6) AS density FROM x JOIN (SELECT label, count(*) AS n FROM x GROUP BY label) USING (label) CROSS JOIN g GROUP BY label, i""")
def a20(s, d):
    """Densities of the best quarter of models with genes, per class, over scores to two places."""
    p = metrics.mfs_subsets(A.predictions(s, d).filter("num_genes > 0")).filter("subset = 'mfs_25' AND label <> 0")
    return metrics.density(metrics.clip_sps(p).withColumn("sps", F.floor((F.round(F.col("sps") * 1e9) + 5e6) / 1e7) / 100), ["label"], "sps", -1.0, 1.0)


@query("F17_threshold_labels", f"WITH {A.PRED} SELECT run, species, sps, CASE WHEN sps > 0.2 THEN 1 WHEN sps < -0.2 THEN -1 ELSE 0 END AS label, CASE WHEN sps >= 0.2 THEN 1 WHEN sps <= -0.2 THEN -1 ELSE 0 END AS label_inclusive FROM prediction")
def f17(s, d):
    p = A.predictions(s, d).select("run", "species", "sps")
    a = metrics.threshold_labels(p, "sps", -0.2, 0.2, True).withColumnRenamed("label", "label_inclusive")
    return metrics.threshold_labels(a, "sps", -0.2, 0.2, False)


@query("F18_clip_sps", f"WITH {A.PRED} SELECT run, species, least(greatest(sps, -1), 1) AS sps FROM prediction")
def f18(s, d):
    return metrics.clip_sps(A.predictions(s, d)).select("run", "species", "sps")


@query("W3_W4_W5_ranks", f"""WITH {A.PRED} SELECT run, species, sps, rank() OVER w + (count(*) OVER t - 1) / 2.0::DOUBLE AS avg_rank, round((rank() OVER w + (count(*) OVER t - 1) / 2.0::DOUBLE) / count(*) OVER a, 9) AS pct_rank,
  round((2 * (rank() OVER w - 1) + count(*) OVER t) / (2.0::DOUBLE * count(*) OVER a), 9) AS centred_pct FROM prediction WINDOW w AS (PARTITION BY run ORDER BY sps), t AS (PARTITION BY run, sps), a AS (PARTITION BY run)""")
def w3(s, d):
    r = with_ranks(A.predictions(s, d).select("run", "species", "sps"), ["run"], "sps")
    return r.withColumn("pct_rank", F.round("pct_rank", 9)).withColumn("centred_pct", F.round("centred_pct", 9))


@query("V2_phenotype_kind", f"WITH {A.PRED} SELECT species, bool_and(sps IN (-1, 0, 1)) AS is_binary FROM prediction GROUP BY species")
def v2(s, d):
    return validate.phenotype_kind(A.predictions(s, d).select("species", F.col("sps").alias("value")), ["species"])


# ---- text formats ----

_NUM = r"'^\s*[^,]+,\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$'"


@query("V3_bad_pheno_lines", f"""WITH {A.LINE}, b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS r FROM line WHERE trim(line) <> '' AND NOT regexp_matches(line, {_NUM}) AND NOT (line_no = 1 AND lower(line) LIKE 'species%'))
SELECT file, line_no, line FROM b WHERE r <= 5""")
def v3(s, d):
    return validate.bad_pheno_lines(A.lines(s, d), ["file"])


@query("V4_looks_like_pheno", f"""WITH {A.LINE}, b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS r FROM line WHERE trim(line) <> '')
SELECT file, avg(regexp_matches(line, '^\\s*[^,]+,\\s*[+-]?1(\\.0*)?\\s*$')::INT) >= 0.8 AS flag FROM b WHERE r <= 20 GROUP BY file""")
def v4(s, d):
    return validate.looks_like_pheno(A.lines(s, d), ["file"])


_RESP = f"""WITH {A.LINE}, f AS (SELECT file, CASE WHEN contains(line, chr(9)) THEN split_part(line, chr(9), 1) WHEN contains(line, ',') THEN split_part(line, ',', 1) ELSE regexp_split_to_array(trim(line), '\\s+')[1] END AS a,
  CASE WHEN contains(line, chr(9)) THEN split_part(line, chr(9), 2) WHEN contains(line, ',') THEN split_part(line, ',', 2) ELSE regexp_split_to_array(trim(line), '\\s+')[2] END AS b FROM line)"""


@query("S8_response_lines", f"{_RESP} SELECT file, trim(a) AS species, TRY_CAST(trim(b) AS DOUBLE) AS y FROM f WHERE abs(TRY_CAST(trim(b) AS DOUBLE)) >= 1e-12")
def s8(s, d):
    return texts.read_responses(A.lines(s, d), ["file"])


@query("S9_phenotype_lines", f"WITH {A.LINE} SELECT file, trim(split_part(line, ',', 1)) AS species, TRY_CAST(trim(split_part(line, ',', 2)) AS DOUBLE) AS value FROM line WHERE len(string_split(line, ',')) = 2 AND TRY_CAST(trim(split_part(line, ',', 2)) AS DOUBLE) IS NOT NULL")
def s9(s, d):
    return texts.read_phenotypes(A.lines(s, d), ["file"])


@query("S9_phenotype_lines_quoted", f"""WITH {A.LINE}, l AS (SELECT file, replace(line, '"', '') AS line FROM line) SELECT file, trim(split_part(line, ',', 1)) AS species, TRY_CAST(trim(split_part(line, ',', 2)) AS DOUBLE) AS value FROM l WHERE len(string_split(line, ',')) >= 2 AND TRY_CAST(trim(split_part(line, ',', 2)) AS DOUBLE) IS NOT NULL""")
def s9q(s, d):
    return texts.read_phenotypes(A.lines(s, d), ["file"], strip_quotes=True)


@query("S7_group_lines", f"WITH {A.DESIGN} SELECT design AS file, CAST(row_number() OVER (PARTITION BY design ORDER BY line_no) - 1 AS INT) AS line_no, array_to_string(members, '|') AS members FROM grp")
def s7(s, d):
    ls = A.designs(s, d).select(F.col("design").alias("file"), (F.col("line_no") * 2).alias("line_no"), F.array_join("members", " , ").alias("line"))
    blank = ls.select("file", (F.col("line_no") + 1).alias("line_no"), F.lit("  ").alias("line"))
    return texts.read_groups(ls.unionByName(blank), ["file"], even=False).withColumn("members", F.array_join("members", "|"))


@query("S19_group_writer", f"""WITH {A.DESIGN}, l AS (SELECT design, members, row_number() OVER (PARTITION BY design ORDER BY line_no) - 1 AS slot, count(*) OVER (PARTITION BY design) AS n FROM grp) SELECT design, CAST(slot AS INT) AS line_no, array_to_string(members, ',') AS line FROM l WHERE slot < n // 2 * 2""")
def s19(s, d):
    g = A.designs(s, d).groupBy("design").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "members"))), lambda x: x["members"]).alias("m")).filter(F.size("m") >= 2)
    rest = lambda x: F.slice(x, 2, 9)
    halves = F.transform(F.sequence(F.lit(0), (F.size("m") / 2).cast("int") - 1), lambda i: F.struct(i.alias("pair"), F.get("m", 2 * i).alias("a"), F.get("m", 2 * i + 1).alias("b")))
    p = g.select("design", F.explode(halves).alias("p")).select("design", "p.pair", F.col("p.a")[0].alias("conv"), F.col("p.b")[0].alias("ctrl"), rest(F.col("p.a")).alias("conv_alts"), rest(F.col("p.b")).alias("ctrl_alts"))
    return texts.groups_lines(p, ["design"])


@query("V5_pheno_overlap", f"""WITH {A.LINE}, n AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN '"' || c_name || '"' ELSE c_name END AS species FROM customer), p AS (SELECT DISTINCT trim(split_part(line, ',', 1)) AS species FROM line WHERE contains(line, ','))
SELECT (SELECT count(*) FROM n WHERE species IN (SELECT species FROM p)) AS raw_n, (SELECT count(DISTINCT replace(species, '"', '')) FROM n WHERE replace(species, '"', '') IN (SELECT replace(species, '"', '') FROM p)) AS stripped_n""")
def v5(s, d):
    c = A.table(s, d, "customer")
    names = c.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), "c_name", F.lit('"'))).otherwise(F.col("c_name")).alias("species"))
    p = A.lines(s, d).filter(F.contains("line", F.lit(","))).select(F.trim(F.split("line", ",")[0]).alias("species"))
    return validate.pheno_overlap(p, names)
