"""Queries over alignments: sites, features, the site counter and its ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import residues as R
from ..operators import design, sitecount, sites, tree, validate
from . import adapters as A
from .registry import query


def _filled(s, d, **k):
    return sites.fill_species(A.alignment(s, d), A.combos(s), A.OUTGROUP, **k)


def _sites(s, d):
    return sites.explode_sites(_filled(s, d))


def _flags(s, d):
    return sitecount.gene_flags(sitecount.paired_genes(A.alignment(s, d), A.combos(s), A.OUTGROUP))


def _counts(s, d):
    return sitecount.gene_counts(sitecount.paired_genes(A.alignment(s, d), A.combos(s), A.OUTGROUP))


_JOINED = "SELECT gene, combo_idx, slot, string_agg(r, '' ORDER BY pos) AS seq FROM ({}) GROUP BY gene, combo_idx, slot"


@query("F1_fill_species", f"WITH {A.CELL} SELECT gene, combo_idx, slot, string_agg(residue, '' ORDER BY pos) AS seq, bool_or(missing) AS missing FROM cell GROUP BY gene, combo_idx, slot")
def f1(s, d):
    f = _filled(s, d)
    zipped = F.transform("seqs", lambda x, i: F.struct(x.alias("seq"), F.get("missing", i).alias("missing")))
    return f.select("gene", "combo_idx", F.posexplode(zipped).alias("slot", "x")).select("gene", "combo_idx", "slot", "x.seq", "x.missing")


@query("F1_drop_incomplete", f"WITH {A.CELL} SELECT gene, combo_idx FROM cell GROUP BY gene, combo_idx HAVING NOT bool_or(missing)")
def f1b(s, d):
    return _filled(s, d, drop_incomplete=True).select("gene", "combo_idx")


_CANCEL = f"""WITH {A.CELL},
intact AS (SELECT gene, combo_idx, count(*) FILTER (NOT m) AS n FROM (SELECT gene, combo_idx, slot // 2 AS pair, bool_or(missing) AS m FROM cell WHERE pos = 0 GROUP BY ALL) GROUP BY ALL),
marked AS (SELECT *, bool_or(residue = '-') OVER (PARTITION BY gene, combo_idx, pos, slot // 2) AS pgap, bool_or(residue = '-') OVER (PARTITION BY gene, combo_idx, pos) AS gap FROM cell),
og AS (SELECT gene, pos, substr(seq, pos + 1, 1) AS o FROM aln CROSS JOIN places WHERE species = '{A.OUTGROUP}' AND substr(seq, pos + 1, 1) <> '-'),
stepped AS (SELECT m.*, i.n, o, count(*) FILTER (NOT pgap AND slot % 2 = 0) OVER w AS intact_here,
  CASE WHEN NOT partial AND gap THEN '-' WHEN partial AND pgap THEN '-' ELSE residue END AS r0
  FROM marked m JOIN intact i USING (gene, combo_idx) LEFT JOIN og USING (gene, pos), (SELECT {{partial}} AS partial) WINDOW w AS (PARTITION BY gene, combo_idx, pos)),
ended AS (SELECT *, coalesce(bool_or(slot % 2 = 1 AND r0 <> o) OVER (PARTITION BY gene, combo_idx, pos), false) AS off FROM stepped)
"""
_CANCELLED = "SELECT gene, combo_idx, slot, pos, CASE WHEN n < {mp} OR (gap AND {partial} AND intact_here < {mp}) OR ({out} AND off) THEN '-' ELSE r0 END AS r FROM ended"


def _cancel(name: str, mp: int, partial: bool, out: bool) -> None:
    inner = _CANCELLED.format(mp=mp, partial=str(partial).lower(), out=str(out).lower())
    sql = _CANCEL.replace("{partial}", str(partial).lower()) + _JOINED.format(inner)

    @query(name, sql)
    def run(s, d):
        return sites.cancelled_sequences(_filled(s, d), mp, partial, out)


_cancel("F2_cancel_default", 2, False, False)
_cancel("F2_cancel_only_partner", 2, True, False)
_cancel("F2_cancel_outgroup", 2, False, True)
_cancel("F2_cancel_partner_outgroup_min3", 3, True, True)

_FOUR = "four AS (SELECT gene, combo_idx, pos, bool_or(residue = '-') AS gap, count(DISTINCT residue) AS kinds, bool_or(missing) AS lost FROM cell WHERE slot < 4 GROUP BY ALL)"


@query("F2_cancel_tri_allelic", f"WITH {A.CELL}, {_FOUR} SELECT gene, combo_idx, count(*) FILTER (NOT gap AND kinds <> 3 AND NOT lost) AS left_sites FROM four GROUP BY gene, combo_idx")
def f2_tri(s, d):
    combo = A.combos(s).filter("slot < 4")
    site = sites.explode_sites(sites.fill_species(A.alignment(s, d), combo))
    done = sites.cancel_gaps(site, tri_allelic=True)
    return done.groupBy("gene", "combo_idx").agg(F.count_if(~F.array_contains("res", "-")).alias("left_sites"))


_VAR = """res AS (SELECT gene, combo_idx, pos, residue, count(*) AS n, CAST(sum(1 << slot) AS BIGINT) AS mask FROM cell WHERE residue <> '-' GROUP BY ALL),
tot AS (SELECT gene, combo_idx, pos, count(*) AS k, sum(n) AS t, max(n) AS m FROM res GROUP BY ALL), var AS (SELECT * FROM tot WHERE k >= 2 AND k <> t AND m <> t - 1)"""


@query("F3_variable_sites", f"WITH {A.CELL}, {_VAR} SELECT gene, combo_idx, pos FROM var")
def f3(s, d):
    return sites.variable_sites(_filled(s, d))


@query("A7_variable_site_counts", f"WITH {A.CELL}, {_VAR} SELECT g.gene, c.combo_idx, count(v.pos) AS var_sites FROM genes g CROSS JOIN (SELECT DISTINCT combo_idx FROM combo) c LEFT JOIN var v ON v.gene = g.gene AND v.combo_idx = c.combo_idx GROUP BY g.gene, c.combo_idx")
def a7(s, d):
    return sites.variable_site_counts(_filled(s, d))


_FEATURE = f"{_VAR}, feature AS (SELECT r.combo_idx, r.gene, r.pos, r.residue AS aa, r.mask, r.n AS n_hit FROM res r JOIN var v USING (gene, combo_idx, pos) WHERE v.t - v.m >= 2 AND r.n >= 2)"


@query("F4_F5_features", f"WITH {A.CELL}, {_FEATURE} SELECT combo_idx, gene, pos, aa, mask, n_hit FROM feature")
def f4(s, d):
    return sites.gene_features(_filled(s, d))


@query("F6_F7_cs_scores", f"WITH {A.SITE} SELECT gene, combo_idx, pos, k, score FROM site WHERE score > 0")
def f7(s, d):
    return _flags(s, d).filter("score > 0").select("gene", "combo_idx", "pos", "k", "score")


@query("F8_F9_F11_convergence", f"WITH {A.SITE} SELECT gene, combo_idx, pos, is_ccs, ctrl_conv FROM site WHERE is_ccs OR ctrl_conv")
def f8(s, d):
    return _flags(s, d).filter("is_ccs OR ctrl_conv").select("gene", "combo_idx", "pos", "is_ccs", "ctrl_conv")


_HALF = A.SITE.replace(">= sum(b) FILTER (ok)\n", ">= 0.5 * sum(b) FILTER (ok)\n")


@query("F8_half_agreement", f"WITH {_HALF} SELECT gene, combo_idx, count(*) FILTER (is_ccs) AS n FROM site GROUP BY gene, combo_idx")
def f8_half(s, d):
    pairs = sitecount.paired_genes(A.alignment(s, d), A.combos(s), A.OUTGROUP)
    return sitecount.gene_counts(pairs, 0.5).select("gene", "combo_idx", F.col("true_n").alias("n"))


_VIEW = f"""WITH {A.SITE}, rv AS (SELECT *, m NOT IN ('?', '-') AS seen FROM rc),
v AS (SELECT gene, combo_idx, pos, any_value(o) AS o, count(*) FILTER (seen AND b > 0) AS kb, count(*) FILTER (seen AND a > 0) AS ka,
  coalesce(bool_or(seen AND b > 0 AND m = o), false) AS bo, coalesce(bool_or(seen AND a > 0 AND m = o), false) AS ao,
  coalesce(bool_or(seen AND m <> o AND a >= 2), false) AS a2, coalesce(bool_or(seen AND m <> o AND b >= 2), false) AS b2
  FROM rv LEFT JOIN og USING (gene, pos) GROUP BY gene, combo_idx, pos),
view AS (SELECT v.gene, v.combo_idx, v.pos, score, kb = 1 AND bo AND a2 AS is_ccs, ka = 1 AND ao AND b2 AS ctrl_conv FROM v JOIN site USING (gene, combo_idx, pos))"""


def _view(s, d):
    return sitecount.viewer_flags(sitecount.paired_genes(A.alignment(s, d), A.combos(s), A.OUTGROUP))


@query("F10_viewer_flags", f"{_VIEW} SELECT gene, combo_idx, pos, score, is_ccs, ctrl_conv FROM view WHERE is_ccs OR ctrl_conv OR score >= 4")
def f10(s, d):
    return _view(s, d).filter("is_ccs OR ctrl_conv OR score >= 4")


@query("F15_site_filter", f"{_VIEW}, {A.COEF}, sel AS (SELECT DISTINCT gene, pos FROM coef) SELECT gene, combo_idx, pos, score FROM view JOIN sel USING (gene, pos) WHERE score >= 2 AND NOT ctrl_conv")
def f15(s, d):
    return sitecount.filter_sites(_view(s, d), 2, selected=A.coefficients(s, d)).select("gene", "combo_idx", "pos", "score")


@query("F12_strict_ccs", f"""WITH {A.CELL},
og AS (SELECT gene, pos, substr(seq, pos + 1, 1) AS o FROM aln CROSS JOIN places WHERE species = '{A.OUTGROUP}'),
full_genes AS (SELECT gene, combo_idx FROM cell GROUP BY ALL HAVING NOT bool_or(missing)),
rs AS (SELECT c.gene, c.combo_idx, c.pos, c.slot % 2 AS side, c.residue, any_value(o) AS o, count(*) AS n FROM cell c JOIN full_genes USING (gene, combo_idx) JOIN og USING (gene, pos) GROUP BY ALL),
st AS (SELECT gene, combo_idx, pos, bool_or(residue = '-') OR any_value(o) = '-' AS gap, bool_and(side = 0 OR residue = o) AS ctrl_like, bool_and(side = 1 OR residue = o) AS conv_like,
  bool_or(side = 0 AND residue <> o AND n >= 2) AS conv2, bool_or(side = 1 AND residue <> o AND n >= 2) AS ctrl2 FROM rs GROUP BY gene, combo_idx, pos)
SELECT gene, combo_idx, count(*) AS n_sites, count(*) FILTER (ctrl_like AND conv2) AS true_n, count(*) FILTER (conv_like AND ctrl2) AS ctrl_n FROM st WHERE NOT gap GROUP BY gene, combo_idx""")
def f12(s, d):
    return sitecount.strict_ccs(A.alignment(s, d), A.combos(s), A.OUTGROUP)


_T = ", ".join(f"'{x}'" for x in A.TARGETS)


@query("F13_taas", f"""WITH {A.ALN}, g AS (SELECT gene, count(*) FILTER (species IN ({_T})) AS fg, count(*) FILTER (species NOT IN ({_T})) AS bg FROM aln GROUP BY gene HAVING fg >= 2 AND bg > 0),
r AS (SELECT gene, pos, substr(seq, pos + 1, 1) AS x, bool_or(species IN ({_T})) AS f, bool_or(species NOT IN ({_T})) AS b FROM aln JOIN g USING (gene) CROSS JOIN places GROUP BY ALL),
p AS (SELECT gene, pos, bool_or(f AND b) AS shared FROM r GROUP BY ALL) SELECT gene, CAST(count(*) FILTER (NOT shared) AS INT) AS n FROM p GROUP BY gene""")
def f13(s, d):
    return sites.taas(A.alignment(s, d), A.TARGETS)


@query("F16_sequence_lengths", f"WITH {A.ALN} SELECT species, CAST(sum(length(replace(seq, '-', ''))) AS BIGINT) AS n FROM aln GROUP BY species")
def f16(s, d):
    return sites.sequence_lengths(A.alignment(s, d))


@query("A8_site_counts", f"WITH {A.SITE} SELECT gene, combo_idx, k, true_n, ctrl_n, cs_n FROM counts")
def a8(s, d):
    return _counts(s, d)


@query("A9_gene_site_counts", f"""WITH {A.SITE} SELECT gene, round(avg(true_n), 6) AS avg_true, round(avg(ctrl_n), 6) AS avg_control, round(avg(true_n) - avg(ctrl_n), 6) AS diff,
  max(cs_n) AS cs_sites_ge_4, CASE WHEN max(cs_n) = 0 THEN 0 ELSE arg_max(k, cs_n * 1000 - combo_idx) END AS k_pairs FROM counts GROUP BY gene""")
def a9(s, d):
    return sitecount.gene_site_counts(_counts(s, d))


_N = len(A.COMBOS)


@query("A10_combo_lists", f"""WITH {A.SITE}, g AS (SELECT DISTINCT gene FROM counts), c AS (SELECT DISTINCT combo_idx FROM combo)
SELECT g.gene, string_agg(coalesce(CAST(true_n AS VARCHAR), 'null'), ',' ORDER BY c.combo_idx) AS trues, string_agg(coalesce(CAST(true_n - ctrl_n AS VARCHAR), 'null'), ',' ORDER BY c.combo_idx) AS diffs
FROM g CROSS JOIN c LEFT JOIN counts t ON t.gene = g.gene AND t.combo_idx = c.combo_idx GROUP BY g.gene""")
def a10(s, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",", "null")
    return sitecount.combo_lists(_counts(s, d), _N).select("gene", text("per_combo_true").alias("trues"), text("per_combo_diff").alias("diffs"))


# ---- the site counter's ancestral mode ----

_BIT = "CASE m WHEN 'A' THEN 1 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 0 END"


def _ancestral_sql(unambiguous: bool) -> str:
    mask = "CASE WHEN bit_count(mask) > 1 THEN 0 ELSE mask END" if unambiguous else "mask"
    return f"""WITH {A.SITE}, {A.SPECIES_SETS}, rt AS (SELECT rc.*, {_BIT}::BIGINT & t.anc <> 0 AS old, t.anc FROM rc JOIN (SELECT gene, pos, {mask} AS anc FROM told) t USING (gene, pos)),
af AS (SELECT gene, combo_idx, pos, max(k) AS k, greatest(0, coalesce(sum(abs(a - b)) FILTER (ok), 0) - coalesce(sum(a + b) FILTER (m = '-'), 0)) AS score,
  coalesce(any_value(anc) <> 0 AND sum(b) FILTER (ok) > 0 AND coalesce(sum(b) FILTER (ok AND old), 0) >= sum(b) FILTER (ok) AND bool_or(ok AND NOT old AND a >= 2), false) AS is_ccs,
  coalesce(any_value(anc) <> 0 AND sum(a) FILTER (ok) > 0 AND coalesce(sum(a) FILTER (ok AND NOT old), 0) = 0 AND bool_or(ok AND NOT old AND b >= 2), false) AS ctrl_conv FROM rt GROUP BY gene, combo_idx, pos),
ac AS (SELECT gene, combo_idx, max(k) AS k, count(*) FILTER (is_ccs) AS true_n, count(*) FILTER (ctrl_conv) AS ctrl_n, count(*) FILTER (score >= 4) AS cs_n FROM af GROUP BY gene, combo_idx)"""


def _ancestral_counts(s, d, unambiguous: bool):
    at = sitecount.ancestral_genes(A.alignment(s, d), A.combos(s), tree.tree_program(A.species_tree(s)), A.OUTGROUP)
    return sitecount.gene_counts(at, unambiguous=unambiguous)


def _ancestral(name: str, unambiguous: bool) -> None:
    @query(name, f"{_ancestral_sql(unambiguous)} SELECT gene, combo_idx, k, true_n, ctrl_n, cs_n FROM ac")
    def run(s, d):
        return _ancestral_counts(s, d, unambiguous)


_ancestral("F11_ancestral_site_counts", False)
_ancestral("F11_ancestral_unambiguous", True)


@query("T8_ancestral_sets", f"WITH {A.ALN}, {A.COMBO}, {A.SPECIES_SETS} SELECT gene, string_agg(CASE WHEN mask = 0 THEN '?' ELSE (CASE WHEN mask & 1 > 0 THEN 'A' ELSE '' END) || (CASE WHEN mask & 4 > 0 THEN 'C' ELSE '' END) || (CASE WHEN mask & 8 > 0 THEN 'D' ELSE '' END) END, '/' ORDER BY pos) AS sets FROM told GROUP BY gene")
def t8_sets(s, d):
    """Sets of the ancestor by position, for each gene that has one."""
    analysis = sorted({x for line in A.COMBOS for x in line})
    g = tree.ancestral_states(sites.gene_table(A.alignment(s, d)), tree.tree_program(A.species_tree(s)), analysis).filter("skip_reason IS NULL")
    text = F.transform("states", lambda x: F.when(F.size(x) == 0, "?").otherwise(F.array_join(x, "")))
    return g.select("gene", F.array_join(text, "/").alias("sets"))


@query("V9_A9_ancestral_report", f"""{_ancestral_sql(False)}, g AS (SELECT gene, round(avg(true_n), 6) AS avg_true, round(avg(ctrl_n), 6) AS avg_control, max(cs_n) AS cs_sites_ge_4 FROM ac GROUP BY gene),
sk AS (SELECT x.gene, CASE WHEN t.gene IS NULL THEN 'no analysis species in tree and alignment' ELSE 'no species outside the ancestor''s clade' END AS skip_reason
  FROM (SELECT DISTINCT gene FROM aln) x LEFT JOIN ancestor t USING (gene) LEFT JOIN outer_species o USING (gene) WHERE t.gene IS NULL OR o.n = 0)
SELECT gene, avg_true, avg_control, cs_sites_ge_4, NULL::VARCHAR AS skip_reason FROM g UNION ALL SELECT gene, 0, 0, 0, skip_reason FROM sk""")
def v9_report(s, d):
    """The report by gene; genes without an ancestor, or with no species outside its clade, are zero rows with a reason."""
    aln, program = A.alignment(s, d), tree.tree_program(A.species_tree(s))
    report = sitecount.gene_site_counts(_ancestral_counts(s, d, False)).select("gene", "avg_true", "avg_control", "cs_sites_ge_4")
    return sitecount.with_skipped(report, sitecount.skipped_genes(aln, A.combos(s), program))


def _w2(metric: str, value: str) -> None:
    sql = f"""WITH {A.SITE}, v AS (SELECT gene, combo_idx, {value} AS v FROM counts),
    r AS (SELECT *, rank() OVER (PARTITION BY combo_idx ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY combo_idx) AS n FROM v)
    SELECT gene, count(*) FILTER (r <= greatest(1, floor(n * 0.05))) AS n_top FROM r GROUP BY gene"""

    @query(f"W2_top_fraction_{metric}", sql)
    def run(s, d):
        return sitecount.top_fraction(_counts(s, d), metric, 0.05)


_w2("true", "true_n")
_w2("diff", "true_n - ctrl_n")
_w2("ratio", "true_n / (ctrl_n + 1)")


@query("W8_site_counter_order", f"""WITH {A.SITE}, g AS (SELECT gene, round(avg(true_n), 6) AS avg_true FROM counts GROUP BY gene),
    r AS (SELECT *, rank() OVER (PARTITION BY combo_idx ORDER BY true_n DESC) AS r, count(*) OVER (PARTITION BY combo_idx) AS n FROM counts),
    t AS (SELECT gene, count(*) FILTER (r <= greatest(1, floor(n * 0.05))) AS n_top FROM r GROUP BY gene)
    SELECT gene, n_top, avg_true FROM g JOIN t USING (gene) WHERE avg_true > 0""")
def w8(s, d):
    from ..sources.tables import checkpointed

    c = checkpointed(_counts(s, d))
    out = sitecount.gene_site_counts(c).join(sitecount.top_fraction(c, "true", 0.05), "gene").filter("avg_true > 0")
    return out.orderBy(F.desc("n_top"), F.desc("avg_true"), F.desc("gene")).select("gene", "n_top", "avg_true")


@query("A18_score_histogram", f"""WITH {A.SITE}, e AS (SELECT min(score) AS a, max(score) AS b FROM site), b AS (SELECT CAST(unnest(range(a, b + 1)) AS INT) AS bin FROM e)
    SELECT bin, count(score) AS n FROM b LEFT JOIN site ON score = bin GROUP BY bin""")
def a18(s, d):
    from ..operators.metrics import histogram

    return histogram(_flags(s, d), "score")


@query("A19_default_threshold", f"""WITH {A.SITE}, r AS (SELECT gene, combo_idx, score, row_number() OVER (PARTITION BY gene, combo_idx ORDER BY score DESC) AS r FROM site)
    SELECT gene, combo_idx, min(score) AS threshold FROM r WHERE r <= 10 GROUP BY gene, combo_idx""")
def a19(s, d):
    return sitecount.default_threshold(_flags(s, d))


@query("A21_ccs_table", f"WITH {A.SITE} SELECT gene, round(avg(true_n), 6) AS mean_true, round(avg(ctrl_n), 6) AS mean_control, round(avg(true_n) - avg(ctrl_n), 6) AS diff FROM counts GROUP BY gene")
def a21(s, d):
    return sitecount.ccs_table(_counts(s, d))


_NUM = "(CAST(substr(gene, 2, 6) AS BIGINT) * 10000 + CAST(substr(gene, 9, 4) AS BIGINT))"
_HASH = "(((((17 * 1009 + {a}) % 999983) * 1009 + {b}) % 999983 * 1009 + {c}) % 999983 * 1009 + {d}) % 999983"


@query("G6_pair_randomize", f"""WITH {A.CELL}, rep AS (SELECT CAST(unnest(range(2)) AS INT) AS rep),
    h AS (SELECT c.gene, c.combo_idx, c.slot, c.pos, rep, c.residue, ((({_HASH.format(a=0, b='rep', c=_NUM, d='pos')}) * 1009 + slot // 2) % 999983) % 2 AS coin FROM cell c CROSS JOIN rep),
    w AS (SELECT *, CASE WHEN coin = 1 THEN max(residue) FILTER (slot % 2 = 1) OVER w1 ELSE residue END AS x FROM h WINDOW w1 AS (PARTITION BY gene, combo_idx, pos, rep, slot // 2))
    SELECT gene, combo_idx, rep, string_agg(CASE WHEN coin = 0 THEN residue ELSE x END, '' ORDER BY pos) AS seq0 FROM w WHERE slot = 0 GROUP BY gene, combo_idx, rep""".replace("FROM w WHERE slot = 0", "FROM w WHERE slot = 0"))
def g6(s, d):
    number = F.substring("gene", 2, 6).cast("long") * 10000 + F.substring("gene", 9, 4).cast("long")
    r = design.randomized_sequences(_filled(s, d), number, 2)
    return r.filter("slot = 0").select("gene", "combo_idx", "rep", F.col("seq").alias("seq0"))


@query("G10_design_grid", f"""WITH {A.ALN}, g AS (SELECT DISTINCT gene FROM aln), r AS (SELECT CAST(unnest(range(5)) AS INT) AS rep),
    h AS (SELECT gene, rep, row_number() OVER (PARTITION BY rep ORDER BY (((17 * 1009 + 0) % 999983 * 1009 + rep) % 999983 * 1009 + {_NUM}) % 999983, gene) AS r FROM g CROSS JOIN r)
    SELECT rep, gene, sites, scale FROM h CROSS JOIN (SELECT unnest([10, 20]) AS sites) CROSS JOIN (SELECT unnest([0.5::DOUBLE, 2.0]) AS scale) WHERE r <= 40""")
def g10(s, d):
    genes = A.alignment(s, d).select("gene").distinct()
    number = F.substring("gene", 2, 6).cast("long") * 10000 + F.substring("gene", 9, 4).cast("long")
    return design.design_grid(genes, number, 5, 40, [10, 20], [0.5, 2.0])


@query("G9_penalty_median", f"WITH {A.CELL}, {_VAR}, n AS (SELECT gene, combo_idx, count(*) AS v FROM var GROUP BY ALL) SELECT combo_idx, floor(quantile_cont(v, 0.5))::DOUBLE AS penalty FROM n GROUP BY combo_idx")
def g9(s, d):
    return design.penalties(sites.variable_site_counts(_filled(s, d)))


@query("V1_missing_species", f"WITH {A.ALN}, names AS (SELECT DISTINCT 's_' || l_suppkey AS species FROM lineitem UNION SELECT DISTINCT species FROM aln) SELECT species FROM names WHERE species NOT IN (SELECT species FROM aln)")
def v1(s, d):
    aln = A.alignment(s, d)
    names = A.table(s, d, "lineitem").select(F.concat(F.lit("s_"), F.col("l_suppkey").cast("string")).alias("species")).unionByName(aln.select("species"))
    return validate.missing_species(names, aln)


@query("V6_ragged_genes", f"WITH {A.ALN} SELECT gene, min(n) AS shortest, max(n) AS longest FROM (SELECT gene, CAST(length(rtrim(seq, '-')) AS INT) AS n FROM aln) GROUP BY gene HAVING min(n) <> max(n)")
def v6(s, d):
    return sites.ragged_genes(A.alignment(s, d).withColumn("seq", F.regexp_replace("seq", "-+$", "")))


@query("V7_missing_genes", f"WITH {A.ALN}, o AS (SELECT 'g' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || 's' || lpad(CAST(o_custkey % 7 AS VARCHAR), 4, '0') AS gene FROM orders) SELECT DISTINCT gene FROM o WHERE gene NOT IN (SELECT gene FROM aln)")
def v7(s, d):
    wanted = A.table(s, d, "orders").select(A.gene_name(F.col("o_orderkey"), F.col("o_custkey") % 7).alias("gene"))
    return sites.missing_genes(A.alignment(s, d), wanted)


@query("V8_fully_gapped", f"WITH {A.CELL}, x AS (SELECT gene || '/' || combo_idx AS combo_idx, residue FROM cell) SELECT combo_idx FROM x GROUP BY combo_idx HAVING NOT bool_or(residue <> '-')")
def v8(s, d):
    site = _sites(s, d).withColumn("combo_idx", F.concat_ws("/", "gene", F.col("combo_idx").cast("string")))
    return validate.fully_gapped(site)


@query("S3_limit_genes", f"WITH {A.ALN}, {A.COEF} SELECT gene, species, seq FROM aln WHERE gene IN (SELECT gene FROM coef)")
def s3(s, d):
    return sites.limit_genes(A.alignment(s, d), A.coefficients(s, d)).select("gene", "species", "seq")


@query("S3_limit_genes_all_genes", f"WITH {A.ALN}, {A.ALL_COEF} SELECT gene, species, seq FROM aln WHERE gene IN (SELECT gene FROM coef)")
def s3_all(s, d):
    return sites.limit_genes(A.alignment(s, d), A.all_gene_coefficients(s, d)).select("gene", "species", "seq")


@query("S11_species", f"WITH {A.ALN} SELECT DISTINCT species FROM aln")
def s11(s, d):
    return A.alignment(s, d).select("species").distinct()


@query("J1_restrict", f"WITH {A.ALN}, {A.COMBO} SELECT a.gene, a.species, a.seq, c.combo_idx, c.slot FROM aln a JOIN combo c USING (species)")
def j1(s, d):
    return A.alignment(s, d).join(F.broadcast(A.combos(s).select("combo_idx", "slot", "species")), "species").select("gene", "species", "seq", "combo_idx", "slot")


@query("J5_pairs_present", f"WITH {A.ALN}, {A.COMBO} SELECT a.gene, c.combo_idx, c.slot // 2 AS pair FROM combo c JOIN aln a USING (species) GROUP BY ALL HAVING count(*) = 2")
def j5(s, d):
    m = F.transform("missing", lambda x, i: F.when((i % 2 == 0) & ~x & ~F.get("missing", i + 1), (i / 2).cast("int")))
    return _filled(s, d).select("gene", "combo_idx", F.explode(F.array_compact(m)).alias("pair"))


@query("M1_group_weights", f"""WITH {A.CELL}, {_FEATURE}, v AS (SELECT gene, combo_idx, count(*) AS var_sites FROM var GROUP BY ALL), f AS (SELECT gene, combo_idx, count(*) AS n_features FROM feature GROUP BY ALL)
    SELECT f.combo_idx, f.gene, n_features, var_sites, round(sqrt(n_features), 6) AS w_std, round(sqrt(var_sites), 6) AS w_sqrt, var_sites + 2.0::DOUBLE AS w_penalty FROM f JOIN v USING (gene, combo_idx)""")
def m1(s, d):
    from ..operators.fit import group_weights

    g = _groups(s, d).withColumn("penalty", F.lit(2.0))
    a = group_weights(g, "std").withColumnRenamed("weight", "w_std")
    b = group_weights(a, "sqrt").withColumnRenamed("weight", "w_sqrt")
    out = group_weights(b, "median").withColumnRenamed("weight", "w_penalty").drop("penalty")
    return out.withColumn("w_std", F.round("w_std", 6)).withColumn("w_sqrt", F.round("w_sqrt", 6))


def _groups(s, d):
    return sites.gene_sizes(_filled(s, d))


_GRAD = f"""{_FEATURE}, grad AS (SELECT combo_idx, gene, pos, aa, (bit_count(mask & 85) * 0.5 - bit_count(mask & 170) * 0.5) / 8.0::DOUBLE AS g FROM feature)"""


@query("M2_lambda_scale", f"""WITH {A.CELL}, {_GRAD}, f AS (SELECT gene, combo_idx, sqrt(count(*)) AS w FROM feature GROUP BY ALL), t AS (SELECT combo_idx, max(abs(g)) AS top FROM grad GROUP BY ALL),
    l AS (SELECT unnest([0.1::DOUBLE, 0.5]) AS lambda1), n AS (SELECT combo_idx, lambda1, gene, max(lambda1 * top) AS l1, sqrt(sum(power(greatest(abs(g) - lambda1 * top, 0), 2))) AS norm FROM grad JOIN t USING (combo_idx) CROSS JOIN l GROUP BY ALL)
    SELECT combo_idx, lambda1, lambda2, round(max(l1), 9) AS l1_abs, round(lambda2 * max(norm / w), 9) AS l2_abs FROM n JOIN f USING (gene, combo_idx) CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.9]) AS lambda2) GROUP BY combo_idx, lambda1, lambda2""")
def m2(s, d):
    from ..operators import fit

    f = sites.gene_features(_filled(s, d))
    w = fit.group_weights(_groups(s, d), "std")
    grid = s.createDataFrame([(a, b) for a in (0.1, 0.5) for b in (0.2, 0.9)], "lambda1 double, lambda2 double")
    return fit.lambda_scale(fit.gradient_at_zero(f, A.combos(s)), w, grid)


_PARTLY = {"only_partner": True}


@query("M3_M6_fit_grid")
def m3(s, d):
    """Models of a 3 x 3 grid for each design, with their numbers of genes and penalty."""
    from ..operators import fit

    f, groups, kinds = _features(s, d)
    grid = s.createDataFrame([(a, b) for a in (0.05, 0.2, 0.6) for b in (0.05, 0.2, 0.6)], "lambda1 double, lambda2 double")
    out = fit.fit_grid(f, A.combos(s), fit.group_weights(groups, "std"), grid, kinds=kinds)
    return out.groupBy("combo_idx", "lambda1", "lambda2").agg(F.round(F.max("intercept"), 6).alias("intercept"), F.max("num_genes").alias("num_genes"), F.round(F.sum(F.abs("weight")), 6).alias("penalty"))


def _features(s, d):
    """Features of the partly cancelled alignment, which is made once, its genes' sizes and their distinct masks."""
    from ..sources.tables import checkpointed

    held = checkpointed(sites.feature_lists(_filled(s, d), cancel=_PARTLY))
    return held.select("combo_idx", "gene", F.inline("features")), held.select("combo_idx", "gene", "n_features", "var_sites"), held.select("combo_idx", "gene", "kinds")


def _fitted(s, d, points, penalties=("std",), y=None, **k):
    """Features, design, weights, fitted models and the genes' distinct masks of the partly cancelled alignment."""
    from ..operators import fit

    f, groups, kinds = _features(s, d)
    weights = None
    for kind in penalties:
        part = fit.group_weights(groups.withColumn("penalty", F.lit(float(kind) if kind not in ("std", "sqrt") else 0.0)), kind)
        weights = part if weights is None else weights.unionByName(part)
    combo = A.combos(s) if y is None else A.combos(s).withColumn("y", y)
    grid = s.createDataFrame(points, "lambda1 double, lambda2 double")
    return f, combo, weights, *fit.fit_models(f, combo, weights, grid, y is not None, kinds=kinds, **k), kinds


def _expected(points, penalties, column):
    """A row for each design, penalty and grid point, in which the check holds."""
    values = ", ".join(f"({p}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for p in penalties for a, b in points)
    return f"WITH {A.COMBO} SELECT CAST(combo_idx AS BIGINT) AS combo_idx, penalty, lambda1, lambda2, true AS {column} FROM (SELECT DISTINCT combo_idx FROM combo) CROSS JOIN (VALUES {values}) g(penalty, lambda1, lambda2)"


_KKT = [(0.4, 0.4), (0.6, 0.2), (0.8, 0.8)]
_MODEL_KEY = ["combo_idx", "penalty", "lambda1", "lambda2"]


def _kkt(name: str, y) -> None:
    @query(name, _expected(_KKT, (2.0, 20.0), "optimal"))
    def run(s, d):
        """Models for two gene penalties, and whether each is the least penalised loss: its residuals are joins and sums."""
        from ..operators import fit

        response = y() if y else None
        f, combo, weights, models, coef, kinds = _fitted(s, d, _KKT, (2, 20), response, maxiter=4000)
        r = fit.kkt_residuals(f, combo, weights, models, coef, response is not None, kinds)
        return r.select(*_MODEL_KEY, (F.col("residual") < 1e-3).alias("optimal"))


_kkt("M3_kkt_logistic", None)
_kkt("M3_kkt_continuous", lambda: F.sin(F.col("slot") * 2.5 + 1) + F.col("combo_idx"))

_FEW = [(0.05, 0.05), (0.3, 0.3)]


@query("M3_dealt_genes", _expected(_FEW, (0.0,), "same"))
def m3_dealt(s, d):
    """Genes dealt out over the tasks: models and coefficients are those of a fit in one task."""
    from ..operators import fit

    f, combo, weights, models, coef, kinds = _fitted(s, d, _FEW, maxiter=10)
    grid = models.select("lambda1", "lambda2").distinct()
    models2, coef2 = fit.fit_models(f, combo, weights, grid, maxiter=10, masks_in_task=0, kinds=kinds)
    key = [*_MODEL_KEY, "gene", "pos", "aa"]
    off = coef.join(coef2.withColumnRenamed("weight", "w"), key, "full").withColumn("off", F.abs(F.coalesce("weight", F.lit(1.0)) - F.coalesce("w", F.lit(1.0))))
    worst = off.groupBy(*_MODEL_KEY).agg(F.max("off").alias("off"))
    both = models.join(models2.select(*_MODEL_KEY, F.col("intercept").alias("i"), F.col("rmse").alias("r"), F.col("num_genes").alias("n")), _MODEL_KEY).join(worst, _MODEL_KEY, "left")
    near = (F.abs(F.col("intercept") - F.col("i")) < 1e-8) & (F.abs(F.col("rmse") - F.col("r")) < 1e-8) & (F.col("num_genes") == F.col("n"))
    return both.select(*_MODEL_KEY, (near & (F.coalesce("off", F.lit(0.0)) < 1e-8)).alias("same"))


@query("M6_legacy_rule", _expected(_FEW, (0.0,), "agrees"))
def m6(s, d):
    """The older line search, which takes nearly any step: a model's error is that of its coefficients' hits in the inputs."""
    from ..operators import score

    f, combo, _, models, coef, _ = _fitted(s, d, _FEW, strict=False, maxiter=20)
    run = F.concat_ws("/", "lambda1", "lambda2").alias("run")
    numbered = models.select("combo_idx", run, "intercept")
    hits = score.score_inputs(coef.select("combo_idx", run, "gene", "pos", "aa", "weight"), f, combo)
    again = score.input_rmse(hits, numbered, combo).withColumnRenamed("rmse", "again")
    near = F.abs(F.col("rmse") - F.col("again")) <= 2e-6 * F.greatest(F.lit(1.0), F.abs("rmse"))
    return models.withColumn("run", run).join(again, ["combo_idx", "run"]).select(*_MODEL_KEY, near.alias("agrees"))


@query("M5_empty_models", f"""WITH {A.CELL}, {_FEATURE}, k AS (SELECT gene || '/' || c.combo_idx AS combo_idx FROM genes CROSS JOIN (SELECT DISTINCT combo_idx FROM combo) c)
    SELECT combo_idx, 0.0::DOUBLE AS intercept FROM k WHERE combo_idx NOT IN (SELECT gene || '/' || combo_idx FROM feature)""")
def m5(s, d):
    """Each gene as a model of its own: those without features have the log odds of the classes."""
    from ..operators import fit

    key = F.concat_ws("/", "gene", F.col("combo_idx").cast("string")).alias("combo_idx")
    filled = _filled(s, d)
    f = sites.gene_sizes(filled).select(key)
    y = filled.select(key, F.posexplode("seqs").alias("slot", "x")).withColumn("y", F.when(F.col("slot") % 2 == 0, 1.0).otherwise(-1.0))
    return fit.empty_models(y, f)


def _joined(rows, *key):
    """``(gene, *key, seq)``: sequences of a group of texts, its genes in order. A group is dealt whole, so that what is
    made of it by gene next needs no other shuffle."""
    dealt = rows.select(*key, F.substring("gene", 1, 7).alias("gene"), F.struct("gene", "seq").alias("x")).repartition(*(c for c in key if c == "combo_idx"), "gene")
    return dealt.groupBy("gene", *key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["seq"]), "").alias("seq"))


@query("S1_S6_fasta_round_trip", f"WITH {A.ALN} SELECT 'g' || substr(gene, 2, 6) AS gene, species, sha256(string_agg(seq, '' ORDER BY gene)) AS digest, CAST(sum(length(seq)) AS INT) AS seq_len FROM aln GROUP BY ALL")
def s1(s, d):
    """Alignments of all texts of a group, padded to one size, written as two-line files and read back;
    the padding is taken off again for the comparison."""
    from ..sources import alignments, tables

    aln = A.alignment(s, d)
    whole = _joined(aln, "species").withColumn("n", F.max(F.length("seq")).over(Window.partitionBy("gene")))
    marked = whole.withColumn("species", F.concat_ws(" ", "species", F.length("seq").cast("string")))
    folder = tables.shared_folder(s)
    alignments.write_alignments(marked.select("gene", "species", F.expr("rpad(seq, n, '?')").alias("seq")), folder)
    back = alignments.read_alignments(s, folder)
    n = F.split("species", " ")[1].cast("int")
    return back.select("gene", F.split("species", " ")[0].alias("species"), F.sha2(F.substring("seq", F.lit(1), n), 256).alias("digest"), n.alias("seq_len"))


@query("S2_site_counter_files", f"WITH {A.ALN} SELECT gene, species, sha256(lower(substr(seq, 1, 30)) || replace(substr(seq, 31), '-', '?')) AS digest, 60 AS seq_len FROM aln")
def s2(s, d):
    """Files as the site counter reads them: letters and unknowns as they are, parts of a species' sequence joined."""
    from ..sources import alignments

    first = F.concat(F.lit(">"), "species", F.lit("\n"), F.lower(F.substring("seq", 1, 30)))
    second = F.concat(F.lit("> "), "species", F.lit(" \n"), F.replace(F.substring("seq", 31, 30), F.lit("-"), F.lit("?")))
    text = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    files = A.alignment(s, d).groupBy("gene").agg(F.concat_ws("\n", text(first), text(second)).alias("text")).select(F.concat("gene", F.lit(".fas")).alias("file"), "text")
    return alignments.parse_alignments(files, "site_counter").select("gene", "species", F.sha2("seq", 256).alias("digest"), "seq_len")


_PARTNER = _CANCEL.replace("{partial}", "true") + ", cut AS (" + _JOINED.format(_CANCELLED.format(mp=2, partial="true", out="false")) + ")"


@query("S12_cancelled_files", f"{_PARTNER} SELECT CAST(cut.combo_idx AS BIGINT) AS combo_idx, substr(gene, 1, 7) AS gene, species, sha256(string_agg(seq, '' ORDER BY gene)) AS digest FROM cut JOIN combo ON combo.combo_idx = cut.combo_idx AND combo.slot = cut.slot GROUP BY ALL")
def s12(s, d):
    """Alignments of all texts of a group, cancelled for each design, written as a folder of files a design and read back."""
    from ..sources import alignments, tables

    cut = sites.cancelled_sequences(_filled(s, d), 2, True).join(F.broadcast(A.combos(s).select("combo_idx", "slot", "species")), ["combo_idx", "slot"])
    whole = _joined(cut, "combo_idx", "slot", "species")
    folder = tables.shared_folder(s)
    alignments.write_cancelled(whole, folder)
    return alignments.read_cancelled(s, folder).select("combo_idx", "gene", "species", F.sha2("seq", 256).alias("digest"))


@query("S13_artefacts", f"WITH {A.CELL}, {_FEATURE}, g AS (SELECT combo_idx, gene, count(*) AS n_features FROM feature GROUP BY ALL) SELECT CAST(f.combo_idx AS BIGINT) AS combo_idx, f.gene, pos, aa, mask, n_features FROM feature f JOIN g USING (combo_idx, gene)")
def s13(s, d):
    """Features and groups stored by design: one design is finished, an attempt at both was killed half way, the rest is built."""
    from ..sources import artefacts, tables

    root, settings = tables.shared_folder(s), {"min_count": 2}

    genes = tables.checkpointed(sites.gene_table(A.alignment(s, d)))  # read for each attempt

    def build(designs):
        f = tables.checkpointed(sites.gene_features(sites.with_designs(genes, A.combos(s).filter(F.col("combo_idx").isin(designs)), A.OUTGROUP)))
        return {"feature": f, "gene_group": f.groupBy("combo_idx", "gene").agg(F.count("*").alias("n_features"))}

    first = artefacts.reuse_designs(s, root, settings, [0], build)
    artefacts.write_attempt(s, root, {"feature": first["feature"].withColumn("mask", F.lit(0).cast("long"))})
    both = artefacts.reuse_designs(s, root, settings, [0, 1], build)
    return both["feature"].join(both["gene_group"], ["combo_idx", "gene"]).select("combo_idx", "gene", "pos", "aa", "mask", "n_features")


@query("W9_site_order", f"{_VIEW}, x AS (SELECT * FROM view WHERE score >= 2) SELECT gene, combo_idx, pos, score, CAST(row_number() OVER (PARTITION BY gene, combo_idx ORDER BY score DESC, pos) AS INT) AS place FROM x")
def w9(s, d):
    from ..operators.score import order_sites

    return order_sites(_view(s, d).filter("score >= 2").select("gene", "combo_idx", "pos", "score"))


@query("S5_two_line_check", f"""WITH {A.ALN} SELECT gene AS file, count(*) FILTER (substr(seq, 1, 1) = '-') = 0 AS ok, CASE WHEN count(*) FILTER (substr(seq, 1, 1) = '-') = 0 THEN '' ELSE 'sequence over several lines' END AS reason FROM aln GROUP BY gene""")
def s5(s, d):
    """Genes as texts; sequences that begin with a gap are broken over two lines."""
    from ..sources import alignments

    body = F.when(F.substring("seq", 1, 1) == "-", F.concat(F.substring("seq", 1, 30), F.lit("\n"), F.substring("seq", 31, 30))).otherwise(F.col("seq"))
    files = alignments.to_two_line(A.alignment(s, d).withColumn("seq", body)).select(F.col("gene").alias("file"), F.col("value").alias("text"))
    return alignments.check_two_line(files)


@query("S4_ordered_genes", f"""WITH {A.ALN}, {A.GROUPS}, o AS (SELECT p_partkey, 'g' || lpad(CAST(q AS VARCHAR), 6, '0') || 's' || lpad(CAST(p_partkey // n % m AS VARCHAR), 4, '0') AS gene
  FROM part CROSS JOIN docn JOIN docq ON q = p_partkey % n) SELECT gene, p_partkey AS gene_ord FROM o WHERE gene IN (SELECT gene FROM aln)""")
def s4(s, d):
    from ..sources import alignments

    groups = A.text_groups(s, d)
    p = A.table(s, d, "part").crossJoin(F.broadcast(groups.agg((F.max("q") + 1).alias("n"))))  # one row
    p = p.withColumn("q", F.col("p_partkey") % F.col("n")).join(groups, "q")
    gene = A.gene_name(F.col("q"), F.floor(F.col("p_partkey") / F.col("n")) % F.col("m"))
    name = F.concat(F.lit("dir/sub/"), gene, F.when(F.col("p_partkey") % 2 == 0, ".fas").otherwise(""))
    return alignments.ordered_genes(p.select(F.col("p_partkey").alias("line_no"), name.alias("line")), A.alignment(s, d), [])


@query("S18_site_count_report", f"""WITH {A.SITE}, c AS (SELECT DISTINCT combo_idx FROM combo), g AS (SELECT gene, round(avg(true_n), 6) AS t, round(avg(ctrl_n), 6) AS u, round(avg(true_n) - avg(ctrl_n), 6) AS v, max(cs_n) AS cs FROM counts GROUP BY gene),
l AS (SELECT g.gene, string_agg(CASE WHEN true_n IS NULL THEN 'null' ELSE printf('%.1f', true_n::DOUBLE) END, ', ' ORDER BY c.combo_idx) AS trues FROM g CROSS JOIN c LEFT JOIN counts t ON t.gene = g.gene AND t.combo_idx = c.combo_idx GROUP BY g.gene)
SELECT gene, printf('%.6g', t) AS avg_true, printf('%.6g', u) AS avg_control, printf('%.6g', v) AS diff, CAST(cs AS VARCHAR) AS cs_sites_ge_4, '[' || trues || ']' AS per_combo_true FROM g JOIN l USING (gene)""")
def s18(s, d):
    from ..sources import texts

    counts = _counts(s, d)
    g = sitecount.gene_site_counts(counts).select("gene", "avg_true", "avg_control", "diff", "cs_sites_ge_4")
    return texts.site_count_csv(g.join(sitecount.combo_lists(counts, _N).select("gene", "per_combo_true"), "gene"))
