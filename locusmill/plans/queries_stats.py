"""Queries: tests and estimates (t), linear scoring (x4-x10, x12, x23-x27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.functions import columns as C
from locusmill.functions.distributions import t_two_sided
from locusmill.operators import groups as G, joins as J, linear as L, programs as P, ranks as W, rows as R, stats as S
from locusmill.plans.base import query, r, rounded

_WELCH = """SELECT {k}, n1, n0, round((m1 - m0) / nullif(sqrt(v1 / n1 + v0 / n0), 0), 5) AS t, round((v1 / n1 + v0 / n0) ** 2 / nullif((v1 / n1) ** 2 / nullif(n1 - 1, 0) + (v0 / n0) ** 2 / nullif(n0 - 1, 0), 0), 4) AS df
FROM (SELECT {k}, count({y}) FILTER ({c}) AS n1, count({y}) FILTER (NOT ({c})) AS n0, avg({y}) FILTER ({c}) AS m1, avg({y}) FILTER (NOT ({c})) AS m0, var_samp({y}) FILTER ({c}) AS v1, var_samp({y}) FILTER (NOT ({c})) AS v0 FROM {src} GROUP BY {k}) q"""


def _welch(k: str, y: str, c: str, src: str) -> str:
    return _WELCH.replace("{k}", k).replace("{y}", y).replace("{c}", c).replace("{src}", src)


@query("t1_welch", _welch("lang", "n_chars", "quality = 1", "{classed}"))
def t1(t):
    return S.welch(t.classed, ["lang"], F.col("quality") == 1, "n_chars", p_values=False).select("lang", "n1", "n0", r("t", 5).alias("t"), r("df", 4).alias("df"))


@query("t1_welch_p")
def t1_p(t):
    return S.welch(t.classed, ["lang"], F.col("quality") == 1, "n_chars")


_PEARSON = "SELECT l_suppkey, count(*) AS n, covar_samp(l_quantity, l_extendedprice) / nullif(stddev_samp(l_quantity) * stddev_samp(l_extendedprice), 0) AS r FROM lineitem GROUP BY l_suppkey"


@query("t2_pearson", f"SELECT l_suppkey, n, round(r, 6) AS r, round(r * sqrt((n - 2) / nullif(1 - r * r, 0)), 4) AS t FROM ({_PEARSON}) q")
def t2(t):
    return S.pearson(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice", p_values=False).select("l_suppkey", "n", r("r").alias("r"), r("t", 4).alias("t"))


@query("t2_pearson_p")
def t2_p(t):
    return S.pearson(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice")


@query("t3_row_correlations", "SELECT a.feature AS a, b.feature AS b, round(covar_samp(a.score, b.score) / nullif(stddev_samp(a.score) * stddev_samp(b.score), 0), 5) + 0e0 AS r FROM {cells} a JOIN {cells} b ON a.locus = b.locus AND a.feature < b.feature GROUP BY 1, 2")
def t3(t):
    """All pairs of the few models, over all loci."""
    return rounded(S.row_correlations(t.cells, "feature", "locus", "score"), "r", digits=5)


def _pi0(src: str) -> str:
    return f"""WITH g AS (SELECT round(v / 2e1, 2) AS lam, count(*) FILTER (pvalue > round(v / 2e1, 2)) AS w, count(*) AS m FROM ({src}) s, range(1, 20) g(v) GROUP BY v),
h AS (SELECT *, w / (m * (1 - lam)) AS pi0 FROM g), q AS (SELECT quantile_cont(pi0, 0.1) AS low FROM h),
e AS (SELECT pi0, lam, w / (m * m::DOUBLE * (1 - lam) * (1 - lam)) * (1 - w / m) + (pi0 - low) * (pi0 - low) AS err FROM h, q)
SELECT round(least(pi0, 1e0), 6) AS pi0, round(1 - least(pi0, 1e0), 6) + 0e0 AS pi1 FROM e ORDER BY err, lam LIMIT 1"""


@query("t4_pi0", _pi0("SELECT pvalue FROM {assoc}"))
def t4(t):
    return rounded(S.pi0(t.assoc, "pvalue"), "pi0", "pi1")


@query("t4_pi0_smoothed", f"""WITH w AS (SELECT unnest(range(1, 20)) AS v, unnest({[float(x) for x in S.spline_weights(S.LAMBDAS, 3.0)]}::DOUBLE[]) AS w), g AS (SELECT v, count(*) FILTER (pvalue > round(v / 2e1, 2)) / (count(*) * (1 - round(v / 2e1, 2))) AS pi0 FROM {{assoc}} s, range(1, 20) g(v) GROUP BY v)
SELECT round(greatest(least(sum(w * pi0), 1e0), 0e0), 6) AS pi0, round(1 - greatest(least(sum(w * pi0), 1e0), 0e0), 6) + 0e0 AS pi1 FROM g JOIN w USING (v)""")
def t4_smoothed(t):
    return rounded(S.pi0_smoothed(t.assoc, "pvalue"), "pi0", "pi1")


@query("t5_pi1_truncated", _pi0("SELECT pvalue / max(pvalue) OVER () AS pvalue FROM {set_f} WHERE pvalue <= 5e-1"))
def t5(t):
    return rounded(S.pi0(S.truncated(t.set_f, "pvalue", 0.5), "pvalue"), "pi0", "pi1")


@query("t6_auroc", """WITH c AS (SELECT quality AS y, n_chars AS s FROM {classed}),
v AS (SELECT y, s, CASE WHEN y = 1 THEN (SELECT avg(CASE WHEN o.s < c.s THEN 1 WHEN o.s = c.s THEN 5e-1 ELSE 0 END) FROM c o WHERE o.y = 0) ELSE (SELECT avg(CASE WHEN o.s > c.s THEN 1 WHEN o.s = c.s THEN 5e-1 ELSE 0 END) FROM c o WHERE o.y = 1) END AS place FROM c),
a AS (SELECT avg(place) FILTER (y = 1) AS auc, sqrt(var_samp(place) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(place) FILTER (y = 0) / count(*) FILTER (y = 0)) AS se, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM v)
SELECT round(auc, 6) AS auc, round(se, 6) AS se, round(greatest(auc - 1.959963984540054 * se, 0), 6) AS low, round(least(auc + 1.959963984540054 * se, 1), 6) AS high, n1, n0 FROM a""")
def t6(t):
    return rounded(S.auroc(t.classed, "quality", "n_chars"), "auc", "se", "low", "high")


_FLAGS = "SELECT lang, n_chars, unnest([{'i': 'good', 'm': quality}, {'i': 'toxic', 'm': toxic}, {'i': 'even', 'm': (doc_id % 2 = 0)::INTEGER}]) AS u FROM {classed}"


@query("t7_enrichment_grid", _welch("lang, indicator", "n_chars", "member > 0", f"(SELECT lang, n_chars, u.i AS indicator, u.m AS member FROM ({_FLAGS}) f) g"))
def t7(t):
    rows = t.classed.select("lang", "n_chars", F.col("quality").alias("good"), "toxic", (F.col("doc_id") % 2 == 0).cast("int").alias("even"))
    return S.enrichment_grid(rows, "lang", ["good", "toxic", "even"], "n_chars", p_values=False).select("lang", "indicator", "n1", "n0", r("t", 5).alias("t"), r("df", 4).alias("df"))


@query("t7_enrichment_log_p")
def t7_log_p(t):
    rows = t.classed.select("lang", "n_chars", F.col("quality").alias("good"), "toxic", (F.col("doc_id") % 2 == 0).cast("int").alias("even"))
    grid = S.enrichment_grid(rows, "lang", ["good", "toxic", "even"], "n_chars")
    return rounded(grid.select("lang", "indicator", "t", C.minus_log10(F.col("p")).alias("log_p"), C.minus_log10(F.col("p_greater")).alias("log_p_greater")), "t", "log_p", "log_p_greater")


@query("t8_sign_consistency", f"WITH a AS ({_PEARSON}), b AS ({_PEARSON.replace('l_extendedprice', 'l_tax')}) SELECT count(*) AS n, count_if(sign(a.r) = sign(b.r))::BIGINT AS n_same, round(count_if(sign(a.r) = sign(b.r)) / count(*)::DOUBLE, 6) AS share FROM a JOIN b USING (l_suppkey) WHERE abs(b.r) > 2e-2")
def t8(t):
    a = S.pearson(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice", False).select("l_suppkey", F.col("r").alias("ra"))
    b = S.pearson(t.lineitem, ["l_suppkey"], "l_quantity", "l_tax", False).select("l_suppkey", F.col("r").alias("rb"))
    return rounded(S.sign_consistency(a.join(b, "l_suppkey"), "ra", "rb", F.abs("rb") > 0.02), "share")


@query("t9_over_representation", """WITH q AS (SELECT DISTINCT query, member FROM {asked}), t AS (SELECT DISTINCT term, member FROM {terms}), nn AS (SELECT count(*) AS n FROM part),
k AS (SELECT query, count(*) AS k FROM q GROUP BY query), m AS (SELECT term, count(*) AS m FROM t GROUP BY term),
x AS (SELECT query, term, count(*) AS x FROM q JOIN t USING (member) GROUP BY query, term),
i AS (SELECT query, term, x, k, m, n, unnest(range(x, least(k, m) + 1)) AS i FROM x JOIN k USING (query) JOIN m USING (term), nn),
p AS (SELECT query, term, x, k, m, sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n - m + 1) - lgamma(k - i + 1) - lgamma(n - m - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1))) AS p FROM i WHERE n - m - k + i >= 0 GROUP BY ALL)
SELECT query, term, x, k, m, round(least(p, 1), 6) AS p, round(least(p * (SELECT count(*) FROM m), 1), 5) AS p_adjusted FROM p""")
def t9(t):
    """The stand-in ``asked`` without its DISTINCT, which the operator does."""
    asked = t.sql("SELECT n_name AS query, l_partkey AS member FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey")
    background = t.part.select(F.col("p_partkey").alias("member"))
    out = S.over_representation(asked, t.terms, background)
    return rounded(rounded(out, "p"), "p_adjusted", digits=5)


@query("t10_compared", "SELECT f.gene, round(f.zscore, 6) + 0e0 AS z_a, f.pvalue AS p_a, round(o.zscore, 6) + 0e0 AS z_b, o.pvalue AS p_b, CASE WHEN f.pvalue < 5e-2 AND o.pvalue < 5e-2 THEN 'both' WHEN f.pvalue < 5e-2 THEN 'a' WHEN o.pvalue < 5e-2 THEN 'b' ELSE 'none' END AS found_by FROM {set_f} f JOIN {set_o} o USING (gene)")
def t10(t):
    return rounded(S.compared(t.set_f, t.set_o, "gene", "zscore", "pvalue", 0.05), "z_a", "z_b")


@query("t11_null_distribution", """WITH l AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS key FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY key) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(key || '/11'), key) AS b FROM l),
c AS (SELECT 'observed' AS kind, corr(x, y) AS r FROM l GROUP BY l_suppkey UNION ALL SELECT 'null', corr(p.x, q.y) FROM i p JOIN i q ON p.l_suppkey = q.l_suppkey AND p.a = q.b GROUP BY p.l_suppkey)
SELECT kind, floor(r / 5e-2)::BIGINT AS bin, count(*) AS n FROM c GROUP BY kind, bin""")
def t11(t):
    rows = t.lineitem.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    null = S.permuted(rows, "l_suppkey", "l_quantity", "l_extendedprice", "key", 11)
    real = S.pearson(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice", False)
    both = R.tagged_union({"observed": real, "null": S.pearson(null, ["l_suppkey"], "l_quantity", "l_extendedprice", False)}, "kind")
    return G.counted(both.withColumn("bin", C.bin_number(F.col("r"), 0.05)), "kind", "bin")


@query("t12_guarded_fit")
def t12(t):
    def fit(group):
        if group.x.std() < 0.9:
            raise ValueError("too little spread")
        return {"slope": float((group.x * group.y).mean() / (group.x**2).mean())}

    rows = t.assoc.select("tf", F.col("zscore").alias("x"), (F.col("pvalue") * 1.0).alias("y"))
    return S.guarded(rows, ["tf"], fit, "slope double")


@query("f1_row_closures", "SELECT vec_id, round(list_aggregate(embedding::DOUBLE[], 'max'), 6) AS top, round(list_aggregate(embedding::DOUBLE[], 'min'), 6) AS low FROM embeddings")
def f1(t):
    return t.embeddings.select("vec_id", r(F.array_max("embedding").cast("double")).alias("top"), r(F.array_min("embedding").cast("double")).alias("low"))


@query("f2_group_closures", "SELECT tf, count(*) AS n, round(avg(zscore), 6) + 0e0 AS mean FROM {assoc} GROUP BY tf")
def f2(t):
    return rounded(t.assoc.groupBy("tf").agg(F.count("*").alias("n"), F.avg("zscore").alias("mean")), "mean")


@query("x4_apply_model", "SELECT vec_id, round(embedding[1]::DOUBLE * 2 - embedding[2]::DOUBLE + 5e-1, 6) + 0e0 AS link, round(1 / (1 + exp(-(embedding[1]::DOUBLE * 2 - embedding[2]::DOUBLE + 5e-1))), 6) AS probability FROM embeddings")
def x4(t):
    return rounded(L.evaluated(t.embeddings, "embedding", [2.0, -1.0], 0.5, ["vec_id"]), "link", "probability")


_SCORES = "SELECT vec_id AS row, model, round(sum(x * w), 5) + 0e0 AS score FROM {x_long} JOIN {w_long} USING (feature) GROUP BY vec_id, model"


@query("x5_score_long", _SCORES)
def x5(t):
    return rounded(L.score_long(t.x_long.withColumnRenamed("vec_id", "row"), t.w_long), "score", digits=5)


@query("x5_score_dense", _SCORES)
def x5_dense(t):
    return rounded(L.score_dense(t.embeddings.select(F.col("vec_id").alias("row"), F.col("embedding").alias("values")), t.w_long), "score", digits=5)


@query("x6_complete_cube", """WITH c AS (SELECT l_suppkey % 50 AS locus, l_linenumber AS individual, l_partkey % 40 AS model, count(*) AS n FROM lineitem WHERE l_quantity > 2.5e1 GROUP BY 1, 2, 3),
k AS (SELECT count(DISTINCT individual) AS n FROM c), a AS (SELECT * FROM c WHERE locus IN (SELECT locus FROM c, k GROUP BY locus, k.n HAVING count(DISTINCT individual) = k.n))
SELECT locus, individual, model, n FROM a WHERE model IN (SELECT model FROM a, k GROUP BY model, k.n HAVING count(DISTINCT individual) = k.n)""")
def x6(t):
    cells = G.counted(t.lineitem.where("l_quantity > 25").select((F.col("l_suppkey") % 50).alias("locus"), F.col("l_linenumber").alias("individual"), (F.col("l_partkey") % 40).alias("model")), "locus", "individual", "model")
    return L.complete_cube(cells, "locus", "individual", "model")


_FIT = "SELECT w.gene, d.sample, d.variant, w.weight, CASE WHEN w.eff = 'A' THEN d.dosage WHEN w.ref = 'A' THEN 2 - d.dosage END AS d FROM {dosage} d JOIN {snp_weights} w USING (variant)"


@query("x9_genotype_scores", f"SELECT gene, sample, round(sum(weight * d), 6) + 0e0 AS score FROM ({_FIT}) f WHERE d IS NOT NULL GROUP BY gene, sample")
def x9(t):
    return rounded(L.genotype_scores(t.dosage.withColumn("counted", F.lit("A")), t.snp_weights)[0], "score")


@query("x9_coverage", f"SELECT gene, count(DISTINCT variant) AS n_in_model, (SELECT count(DISTINCT f.variant) FROM ({_FIT}) f WHERE f.gene = w.gene) AS n_used FROM {{snp_weights}} w GROUP BY gene")
def x9_coverage(t):
    return L.genotype_scores(t.dosage.withColumn("counted", F.lit("A")), t.snp_weights)[1]


COVARIANCE = "SELECT a.gene, a.variant AS v1, b.variant AS v2, CASE WHEN a.variant = b.variant THEN 1e0 ELSE 1e0 / (1 + (b.variant - a.variant)) END AS cov FROM {snp_weights} a JOIN {snp_weights} b ON a.gene = b.gene AND a.variant <= b.variant AND b.variant - a.variant < 500"


def covariance(t):
    """The rows of ``COVARIANCE``: variants of one gene that lie less than 500 apart, without the square of a gene."""
    pairs = J.neighbours(t.snp_weights, ["gene"], "variant", 500)
    return pairs.select("gene", F.col("a").alias("v1"), F.col("b").alias("v2"), (1.0 / (1 + (F.col("b") - F.col("a")))).alias("cov"))


@query("x10_association", f"""WITH c AS ({COVARIANCE}), w AS (SELECT gene, variant, weight, CASE WHEN eff = eff_gwas THEN z ELSE -z END AS z FROM {{snp_weights}} JOIN {{snp_z}} USING (variant)),
num AS (SELECT w.gene, count(*) AS n_snps, sum(weight * sqrt(cov) * z) AS num FROM w JOIN c ON c.gene = w.gene AND v1 = variant AND v2 = variant GROUP BY w.gene),
var AS (SELECT c.gene, sum(CASE WHEN v1 = v2 THEN 1 ELSE 2 END * a.weight * b.weight * cov) AS var FROM c JOIN w a ON a.gene = c.gene AND a.variant = v1 JOIN w b ON b.gene = c.gene AND b.variant = v2 GROUP BY c.gene)
SELECT gene, n_snps, round(num / sqrt(CASE WHEN var > 0 THEN var END), 5) + 0e0 AS z FROM num JOIN var USING (gene)""")
def x10(t):
    return rounded(L.association(t.snp_weights, t.snp_z, covariance(t)), "z", digits=5)


RELATIONSHIP_SQL = """d AS (SELECT * FROM {pop_dosage}), s AS (SELECT variant, avg(dosage) AS m, stddev_samp(dosage) AS sd FROM d GROUP BY variant HAVING stddev_samp(dosage) > 0),
z AS (SELECT sample, variant, (dosage - m) / sd AS z FROM d JOIN s USING (variant)),
k AS (SELECT a.sample AS id1, b.sample AS id2, round(sum(a.z * b.z) / (SELECT count(*) FROM s), 6) + 0e0 AS value FROM z a JOIN z b ON a.variant = b.variant AND a.sample <= b.sample GROUP BY 1, 2)"""


@query("x12_relationship", f"WITH {RELATIONSHIP_SQL} SELECT * FROM k")
def x12(t):
    """The samples are the nations, whose number is bounded; every variant counts."""
    return rounded(L.relationship(t.pop_dosage), "value")


@query("x23_ratio_matrix", "SELECT a.l_orderkey, a.l_linenumber, round(a.zscore * a.zscore / nullif(g.z * g.z, 0), 5) AS ratio FROM {assoc} a JOIN (SELECT locus, max(zscore) AS z FROM {assoc} GROUP BY locus) g USING (locus)")
def x23(t):
    gwas = t.assoc.groupBy("locus").agg(F.max("zscore").alias("z"))
    return rounded(L.ratio(t.assoc.withColumnRenamed("zscore", "z"), gwas, "locus").select("l_orderkey", "l_linenumber", "ratio"), "ratio", digits=5)


@query("x24_reordered", "SELECT locus, feature, round(score, 6) + 0e0 AS score, dense_rank() OVER (ORDER BY feature % 3, feature)::BIGINT AS place FROM {cells}")
def x24(t):
    order = R.numbered(t.cells.select("feature").distinct().withColumn("cluster", F.col("feature") % 3), ["cluster", "feature"], "place")
    rows = t.cells.join(F.broadcast(order.select("feature", F.col("place").cast("long").alias("place"))), "feature")
    return rounded(rows.select("locus", "feature", "score", "place"), "score")


@query("x25_compare_runs", "SELECT r_name AS run, count(*) AS n_factors, round(sum(s_acctbal / 1e4), 6) + 0e0 AS total_pve FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def x25(t):
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    runs = t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("run"), F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 1e4).alias("pve"))
    return rounded(P.compared_runs(runs, ["run"]), "total_pve")


@query("x26_train_test_assembly", "SELECT doc_id, split, quality, n_chars FROM (SELECT doc_id, quality, 'test' AS split FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, quality, 'train' FROM labels WHERE doc_id % 5 <> 0) l JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def x26(t):
    truth = t.labels.select("doc_id", "quality")
    split = R.tagged_union({"train": truth.where("doc_id % 5 <> 0"), "test": truth.where("doc_id % 5 = 0")}, "split")
    return R.in_keys(split.join(t.documents.select("doc_id", "n_chars"), "doc_id"), t.labels.where("toxic = 0"), ["doc_id"]).select("doc_id", "split", "quality", "n_chars")


@query("x27_motif_summary", """SELECT coalesce(h.locus, d.locus) AS locus, coalesce(h.tf, d.tf) AS tf, coalesce(n_hits, 0) AS n_hits, round(mean_score, 6) + 0e0 AS mean_score, d.tf IS NOT NULL AS driver FROM
(SELECT locus, tf, count(*) AS n_hits, avg(zscore) AS mean_score FROM {assoc} WHERE zscore > 1 GROUP BY locus, tf) h FULL JOIN (SELECT DISTINCT locus, tf FROM {assoc} WHERE pvalue < 1e-2) d ON h.locus = d.locus AND h.tf = d.tf""")
def x27(t):
    hits = t.assoc.where("zscore > 1").groupBy("locus", "tf").agg(F.count("*").alias("n_hits"), F.avg("zscore").alias("mean_score"))
    drivers = t.assoc.where("pvalue < 0.01").select("locus", "tf").distinct().withColumn("driver", F.lit(True))
    both = J.joined(hits, drivers, {"locus": "locus", "tf": "tf"}, "full")
    return rounded(both.select("locus", "tf", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "mean_score", F.coalesce("driver", F.lit(False)).alias("driver")), "mean_score")


@query("t_student_tail")
def student_tail(t):
    by = W.with_total(t.assoc.groupBy("tf").agg(F.avg("zscore").alias("m"), F.stddev_samp("zscore").alias("s"), F.count("*").alias("n")))
    one = by.withColumn("t", F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")))
    return one.select("tf", "t", t_two_sided(F.col("t"), F.col("n") - 1.0).alias("p"))
