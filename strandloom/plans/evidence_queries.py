"""Short-read junctions, atlases, coverage, scores and comparisons of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import evidence as E
from ..operators import scoring as Z
from . import virtual as V
from .junction_queries import features, junction_census

G = ["contig", "strand", "chain"]
J = ["contig", "strand", "donor", "acceptor"]


def libraries(spark, d):
    """Three libraries' junction rows, from line items."""
    l = V.table(spark, d, "lineitem")
    k = F.col("l_linenumber").cast("long")
    return l.select(
        (F.col("l_partkey") % 3).alias("library"),
        (F.col("l_orderkey") % 5).alias("contig"),
        F.when(F.col("l_suppkey") % 10 == 0, ".").when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        (k * 1000 + F.col("l_suppkey") % 7).alias("donor"),
        (k * 1000 + 500).alias("acceptor"),
        (F.col("l_quantity").cast("long") % 4).alias("uniq"),
        (F.col("l_partkey") % 2).alias("multi"),
        (F.col("l_suppkey") % 40).alias("overhang"),
        F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0).cast("long").alias("annotated"),
    )


_LIB = """lb AS (SELECT l_partkey % 3 AS library, l_orderkey % 5 AS contig, CASE WHEN l_suppkey % 10 = 0 THEN '.' WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_linenumber::BIGINT * 1000 + l_suppkey % 7 AS donor, l_linenumber::BIGINT * 1000 + 500 AS acceptor,
  l_quantity::BIGINT % 4 AS uniq, l_partkey % 2 AS multi, l_suppkey % 40 AS overhang, CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS annotated FROM lineitem),
sm AS (SELECT contig, strand, donor, acceptor, CAST(sum(uniq) AS BIGINT) AS uniq, CAST(sum(multi) AS BIGINT) AS multi, max(overhang) AS overhang, max(annotated)::BIGINT AS annotated, count(DISTINCT library) FILTER (uniq > 0) AS n_libs FROM lb WHERE overhang >= 3 GROUP BY 1, 2, 3, 4)"""


def sj_summed_replicates(spark, d):
    return E.sum_libraries(libraries(spark, d), 3)


def sj_support(spark, d):
    j = V.transcript_junctions(spark).select(*J).distinct()
    return E.junction_support(j, E.sum_libraries(libraries(spark, d), 3)).select(*J, "sr_uniq", "sr_overhang", "sr_n_libs", "sr_supported")


SUPPORT = V.sql("tj", _LIB + """, k AS (SELECT DISTINCT contig, strand, donor, acceptor FROM tj),
x AS (SELECT k.*, coalesce(a.uniq, b.uniq, 0) AS u, coalesce(a.overhang, b.overhang, 0) AS o, coalesce(a.n_libs, 0) AS n FROM k LEFT JOIN sm a USING (contig, strand, donor, acceptor) LEFT JOIN sm b ON b.strand = '.' AND b.contig = k.contig AND b.donor = k.donor AND b.acceptor = k.acceptor)
SELECT contig, strand, donor, acceptor, u AS sr_uniq, o AS sr_overhang, n AS sr_n_libs, u >= 2 AND o >= 10 AND n >= 2 AS sr_supported FROM x""")


def sj_concordance(spark, d):
    c = E.concordance(libraries(spark, d))
    return c.select("considered", "seen_in_one", F.round("expected_in_one", 4).alias("expected_in_one"), F.round("excess", 4).alias("excess"))


CONCORDANCE = "WITH " + _LIB + """, e AS (SELECT contig, strand, donor, acceptor, library, sum(uniq) AS u, max(annotated) AS a FROM lb GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT library, sum(u) / (SELECT sum(u) FROM e) AS p FROM e GROUP BY 1),
k AS (SELECT contig, strand, donor, acceptor, sum(u) AS n, max(a) AS a, count(*) FILTER (u > 0) AS seen FROM e GROUP BY 1, 2, 3, 4 HAVING max(a) = 0 AND sum(u) >= 2),
x AS (SELECT k.*, (SELECT sum(pow(p, n)) FROM p) AS ex FROM k)
SELECT count(*) AS considered, count(*) FILTER (seen = 1) AS seen_in_one, round(sum(ex), 4) AS expected_in_one, round(count(*) FILTER (seen = 1) - sum(ex), 4) AS excess FROM x"""


def junction_offsets(spark, d):
    return E.verify_offsets(junction_census(spark, d), V.transcript_junctions(spark))


OFFSETS = V.sql("rx tj", """j AS (SELECT DISTINCT contig, strand, donor, acceptor FROM rx), k AS (SELECT DISTINCT contig, strand, donor, acceptor FROM tj), o AS (SELECT unnest([-1, 0, 1]) AS o)
SELECT a.o::INT AS d_offset, b.o::INT AS a_offset, count(*) AS hits FROM j, o a, o b WHERE EXISTS (SELECT 1 FROM k WHERE k.contig = j.contig AND k.strand = j.strand AND k.donor = j.donor + a.o AND k.acceptor = j.acceptor + b.o) GROUP BY 1, 2""")


def peaks(spark, d):
    """A peak around some annotated starts and around the suppliers' keys."""
    s = V.table(spark, d, "supplier").select((F.col("s_suppkey") % 5).alias("contig"), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("s_suppkey") * 97 % 9000).alias("start"))
    return s.withColumns({"end": F.col("start") + 60, "rep": F.col("start") + 20}).distinct()


_PEAKS = "pk AS (SELECT DISTINCT s_suppkey % 5 AS contig, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, s_suppkey * 97 % 9000 AS s, s_suppkey * 97 % 9000 + 60 AS e, s_suppkey * 97 % 9000 + 20 AS rep FROM supplier)"


def tss_evidence(spark, d):
    ends = V.reads(spark, d).select(F.col("read_id").alias("id"), "contig", "strand", F.col("tss").alias("pos"))
    return E.start_evidence(ends, peaks(spark, d)).select("id", "in_peak", "rep_distance", "tier")


TSS = V.sql("rd", _PEAKS + """, q AS (SELECT DISTINCT contig, strand, tss FROM rd),
n AS (SELECT q.contig, q.strand, tss, arg_min(rep, (abs(rep - tss), rep)) AS rep, bool_or(s <= tss AND tss < e) AS in_peak FROM q JOIN pk USING (contig, strand) GROUP BY 1, 2, 3)
SELECT read_id AS id, coalesce(in_peak, FALSE) AS in_peak, CASE WHEN strand = '-' THEN rep - tss ELSE tss - rep END AS rep_distance, CASE WHEN abs(rep - tss) <= 100 THEN 'reptss' WHEN in_peak THEN 'peak' ELSE 'none' END AS tier FROM rd LEFT JOIN n USING (contig, strand, tss)""")


def track(spark, d):
    """Signal of 50-base steps, from events: disjoint, with holes."""
    e = V.table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 5).alias("contig"), (F.col("event_id") % 200 * 50).alias("start")).agg(F.count("*").cast("double").alias("value")).where("start % 350 <> 0").withColumn("end", F.col("start") + 50)


def coverage_step(spark, d):
    ends = V.reads(spark, d).select("contig", "strand", F.col("tts").alias("pos")).distinct().withColumn("id", F.concat_ws(":", F.col("contig").cast("string"), "strand", F.col("pos").cast("string")))
    s = E.three_prime_step(ends, track(spark, d), least=1.0, most=0.9)
    return s.select("id", *(F.round(c, 6).alias(c) for c in ("upstream", "downstream", "ratio")), "supported")


STEP = V.sql("rd", """tk AS (SELECT user_id % 5 AS contig, event_id % 200 * 50 AS s, event_id % 200 * 50 + 50 AS e, count(*) AS v FROM events WHERE (event_id % 200 * 50) % 350 <> 0 GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT contig, strand, tts AS pos FROM rd),
w AS (SELECT *, CASE WHEN strand = '-' THEN pos ELSE pos - 100 END AS us, CASE WHEN strand = '-' THEN pos - 100 ELSE pos END AS ds FROM q),
m AS (SELECT w.contig, strand, pos, sum(v * greatest(least(e, us + 100) - greatest(s, us), 0)) FILTER (s < us + 100 AND us < e) / 100 AS u, sum(v * greatest(least(e, ds + 100) - greatest(s, ds), 0)) FILTER (s < ds + 100 AND ds < e) / 100 AS dn FROM w LEFT JOIN tk USING (contig) GROUP BY 1, 2, 3)
SELECT contig || ':' || strand || ':' || pos AS id, round(u, 6) AS upstream, round(dn, 6) AS downstream, round(CASE WHEN u >= 1 THEN coalesce(dn, 0) / u END, 6) AS ratio, CASE WHEN u >= 1 THEN coalesce(dn, 0) / u END <= 0.9 AS supported FROM m""")


def holdout_split(spark, d):
    return junction_census(spark, d).withColumn("held_out", E.held_out()).select(*J, "held_out")


def score_features(spark, d):
    f = features(spark, d)
    decoy = ~F.col("annotated") & F.col("motif_class").isin("antisense", "non_canonical", "semi_canonical")
    return f.select("contig", F.concat_ws(":", "strand", F.col("donor").cast("string"), F.col("acceptor").cast("string")).alias("id"), F.log1p("n_reads").alias("reads"), F.log1p("n_mols").alias("mols"), "min_site_share", F.col("direct_repeat").cast("double").alias("repeat"), (F.col("donor") % 3 != 0).alias("positive"), decoy.alias("decoy"), F.col("annotated").alias("exempt"), (F.col("donor") % 2).alias("stratum"))


def local_fdr(spark, d):
    names = ["reads", "mols", "min_site_share", "repeat"]
    return Z.score(score_features(spark, d), names, least_anchors=10).select("contig", "id", F.round("score", 6).alias("score"), F.round("lfdr", 6).alias("lfdr"), F.round("pi0", 6).alias("pi0"))


def ridge_logistic(spark, d):
    """Score quantiles of each contig: a digest of the fitted model."""
    s = Z.score(score_features(spark, d), ["reads", "min_site_share"], least_anchors=10)
    return s.groupBy("contig").agg(F.count("*").alias("n"), *(F.round(F.percentile("score", q), 6).alias(f"score_p{int(q * 100)}") for q in (0.1, 0.5, 0.9)))


def samples(spark, d):
    """Models of three samples: chains of displaced reads by cell."""
    r = V.reads(spark, d, True)
    m = r.groupBy((F.col("cell") % 3).alias("sample"), *G).agg(F.count("*").alias("support"), F.expr("percentile(tts, 0.5)").cast("long").alias("three"))
    return m.withColumns({"model_id": F.concat_ws("|", F.col("sample").cast("string"), F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain"))), "category": F.when(F.size("chain") > 3, "FSM").otherwise("NIC")})


def structural_match(spark, d):
    return E.structural_match(samples(spark, d)).select("model_id", "structure", "support")


def exact_structures(spark, d):
    """Samples matched by the exact chain alone, for the summaries."""
    s = samples(spark, d)
    return s.withColumn("structure", F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain"))))


def reproducibility_curve(spark, d):
    return E.reproducibility(exact_structures(spark, d), [1, 2, 5, 10, 20]).withColumn("share_in_all", F.round("share_in_all", 6))


_SAMPLES = """xr AS (SELECT read_id, contig, strand, cell % 3 AS sample, count(*) AS n, string_agg(donor || '-' || acceptor, ';' ORDER BY CASE WHEN strand = '+' THEN donor ELSE -donor END) AS xchain FROM rx GROUP BY 1, 2, 3, 4),
ss AS (SELECT sample, contig, strand, xchain, n, count(*) AS support, CAST(trunc(quantile_cont(tts, 0.5)) AS BIGINT) AS three, contig || '|' || strand || '|' || xchain AS structure, CASE WHEN n > 3 THEN 'FSM' ELSE 'NIC' END AS category FROM (SELECT xr.*, rd.tts FROM xr JOIN rd USING (read_id)) GROUP BY 1, 2, 3, 4, 5)"""
CURVE = V.sql("rx rd", _SAMPLES + """, e AS (SELECT structure, sum(support) AS support, count(DISTINCT sample) AS seen FROM ss GROUP BY 1), t AS (SELECT unnest([1, 2, 5, 10, 20]) AS threshold)
SELECT threshold::INT AS threshold, count(*) AS n_structures, count(*) FILTER (seen = 3) AS n_in_all, round(count(*) FILTER (seen = 3) / count(*), 6) AS share_in_all FROM e JOIN t ON support >= threshold GROUP BY 1""")


def category_rollup(spark, d):
    return E.concordance_summary(exact_structures(spark, d)).withColumn("median_spread", F.round("median_spread", 6))


ROLLUP = V.sql("rx rd", _SAMPLES + """, e AS (SELECT structure, min(category) AS category, count(DISTINCT sample) AS seen, max(three) - min(three) AS spread FROM ss GROUP BY 1)
SELECT coalesce(category, 'ALL') AS category, count(*) AS n_structures, count(*) FILTER (seen = 1) AS in_1, count(*) FILTER (seen = 2) AS in_2, count(*) FILTER (seen >= 3) AS in_3, round(quantile_cont(spread, 0.5), 6) AS median_spread FROM e GROUP BY ROLLUP (category)""")


def qc_invariants(spark, d):
    spliced = V.reads(spark, d)
    r = spliced.select("read_id", F.col("n").alias("n_introns"), (F.col("end") - F.col("start")).alias("span"), "contig", "strand", "chain")
    m = r.groupBy(*G).agg(F.max("span").alias("model_span"), F.max("n_introns").alias("model_introns"))
    a = r.join(m, G).select("read_id", F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain"))).alias("model_id"), "model_introns", "model_span")
    mono = V.mono_reads(spark, d).select("read_id", F.lit(0).cast("long").alias("n_introns"), (F.col("end") - F.col("start")).alias("span"))
    loci = V.mono_reads(spark, d).select("read_id", F.concat_ws("|", F.lit("mono"), F.col("contig").cast("string"), "strand").alias("model_id"), F.lit(0).cast("long").alias("model_introns"), F.lit(400).cast("long").alias("model_span"))
    q = E.invariants(r.select("read_id", "n_introns", "span").unionByName(mono), a.unionByName(loci))
    return q.select(*(F.round(c, 6).alias(c) for c in ("mono_mass", "shortest_fraction", "median_log2_span", "median_extra_exons", "unspliced")), "unspliced_assigned", "n_unspliced", "ok_mono", "ok_shortest", "ok_span", "ok_exons", "ok_unspliced")


INVARIANTS = V.sql("rd mr", """r AS (SELECT read_id, n, hi - lo AS span, contig || '|' || strand || '|' || chain AS m FROM rd),
a AS (SELECT r.*, max(span) OVER (PARTITION BY m) AS ms, n AS mi FROM r UNION ALL SELECT read_id, 0, hi - lo, 'mono|' || contig || '|' || strand, 400, 0 FROM mr),
b AS (SELECT *, ms <= min(span) OVER (PARTITION BY m) AS short FROM a),
s AS (SELECT avg((mi = 0)::INT) AS mm, avg(short::INT) AS sf, quantile_cont(log2(ms / greatest(span, 1)), 0.5) AS ml, quantile_cont(mi - n, 0.5) AS me, count(*) FILTER (n = 0) AS ua, avg((n = 0)::INT) AS u, count(*) FILTER (n = 0) AS nu FROM b)
SELECT round(mm, 6) AS mono_mass, round(sf, 6) AS shortest_fraction, round(ml, 6) AS median_log2_span, round(me, 6) AS median_extra_exons, round(u, 6) AS unspliced, ua AS unspliced_assigned, nu AS n_unspliced, mm <= greatest(2 * u, u + 0.02) AS ok_mono, sf < 0.95 AS ok_shortest, abs(ml) < 1 AS ok_span, me >= -1 AS ok_exons, ua >= 0.25 * nu AS ok_unspliced FROM s""")


def name_diagnosis(spark, d):
    """Which column, read which way, holds the reads' names."""
    o = V.orders(spark, d).select("read_name")
    t = V.table(spark, d, "lineitem").select(F.concat(F.lit("r/"), F.col("l_orderkey").cast("string"), F.lit("/ccs/0_"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("r/"), F.col("l_partkey").cast("string")).alias("b"), F.col("l_returnflag").alias("c"))
    return E.name_hits(t, ["a", "b", "c"], o, ["none", "strip_segment", "strip_ccs", "zmw"]).select("column", "mode", "hits")


DIAGNOSIS = r"""WITH o AS (SELECT DISTINCT 'r/' || o_orderkey || '/ccs' AS n FROM orders), t AS (SELECT 'r/' || l_orderkey || '/ccs/0_' || l_partkey AS a, 'r/' || l_partkey AS b FROM lineitem),
s AS (SELECT 'a' AS c, a AS n FROM t UNION ALL SELECT 'b', b FROM t),
m AS (SELECT 'none' AS mode, n AS k FROM o UNION ALL SELECT 'strip_segment', n FROM o UNION ALL SELECT 'strip_ccs', left(n, length(n) - 4) FROM o UNION ALL SELECT 'zmw', left(n, length(n) - 4) FROM o),
x AS (SELECT c, 'none' AS mode, n AS k FROM s UNION ALL SELECT c, 'strip_segment', regexp_replace(n, '/[0-9]+_[0-9]+$', '') FROM s UNION ALL SELECT c, 'strip_ccs', regexp_replace(regexp_replace(n, '/[0-9]+_[0-9]+$', ''), '/ccs$', '') FROM s UNION ALL SELECT c, 'zmw', regexp_replace(n, '^([^/]*/[^/]*)/.*$', '\1') FROM s)
SELECT c AS "column", x.mode, count(*) AS hits FROM x JOIN m ON m.mode = x.mode AND m.k = x.k GROUP BY 1, 2"""


def model_audit(spark, d):
    """Any catalogue against its reads, by class: whether models are their shortest or longest read."""
    r = V.reads(spark, d)
    m = r.groupBy(*G).agg(F.max(F.col("end") - F.col("start")).alias("model_span"))
    a = r.join(m, G).withColumn("span", F.col("end") - F.col("start"))
    each = a.groupBy(*G, "model_span").agg(F.count("*").alias("n"), F.percentile("span", 0.5).alias("median_span"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    by = F.when(F.size("chain") > 3, "long").otherwise("short")
    return each.groupBy(by.alias("class")).agg(F.count("*").alias("n_models"), F.sum("n").alias("n_reads"), F.round(F.percentile("median_span", 0.5), 6).alias("median_span"), F.round(F.avg((F.col("model_span") == F.col("lo")).cast("int")), 6).alias("is_shortest"), F.round(F.avg((F.col("model_span") == F.col("hi")).cast("int")), 6).alias("is_longest"))


AUDIT = V.sql("rd", """e AS (SELECT contig, strand, chain, n, count(*) AS c, quantile_cont(hi - lo, 0.5) AS md, min(hi - lo) AS l, max(hi - lo) AS h FROM rd GROUP BY 1, 2, 3, 4)
SELECT CASE WHEN n > 3 THEN 'long' ELSE 'short' END AS class, count(*) AS n_models, CAST(sum(c) AS BIGINT) AS n_reads, round(quantile_cont(md, 0.5), 6) AS median_span, round(avg((h = l)::INT), 6) AS is_shortest, 1.0::DOUBLE AS is_longest FROM e GROUP BY 1""")


def displaced_chains(spark, d):
    """(chain_id, gene_id, chain): the displaced reads' chains, each with one end moved into its intron by ten times the read's displacement."""
    one = lambda j: F.struct(j["donor"].alias("donor"), j["acceptor"].alias("acceptor"))
    off = lambda j: F.pmod(j["donor"] + 500, F.lit(1000)) - 500
    moved = lambda j: F.struct((j["donor"] - off(j) + F.greatest(off(j), F.lit(0)) * 10).alias("donor"), (j["acceptor"] - off(j) + F.least(off(j), F.lit(0)) * 10).alias("acceptor"))
    g = V.reads(spark, d, True).select("contig", "strand", F.transform(I.genomic(F.col("chain")), moved).alias("chain")).distinct()
    return g.withColumns({"chain_id": F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain"))), "gene_id": F.concat(F.lit("g1."), F.col("contig").cast("string"), F.when(F.col("strand") == "+", "p").otherwise("m")), "chain": F.transform("chain", one)})


def displaced_plan(spark, d):
    """Short reads support a displaced junction when its donor's thousand is 6, and all annotated ones."""
    g = displaced_chains(spark, d)
    t = V.transcripts(spark).withColumn("chain", I.genomic(F.col("chain")))
    known = V.transcript_junctions(spark).select("gene_id", "donor", "acceptor").distinct().withColumn("uniq", F.lit(20))
    own = g.select("gene_id", F.explode("chain").alias("j")).select("gene_id", "j.donor", "j.acceptor").distinct().join(known.select("gene_id", "donor", "acceptor"), ["gene_id", "donor", "acceptor"], "left_anti")
    own = own.withColumn("uniq", F.when(F.floor(F.col("donor") / 1000) == 6, 3).otherwise(0))
    plan = E.displaced_junction_plan(g.select("chain_id", "gene_id", "chain"), t, known.unionByName(own), tol=1)
    return plan.select("chain_id", "tx_id", "n_displaced", "n_swallowed", I.chain_repr(F.col("target")).alias("target"))


DISPLACED = V.sql("rx tx", """xj AS (SELECT read_id, contig, strand, k * 1000 + 10 * greatest(donor - k * 1000, 0) AS d, k * 1000 + 500 + 10 * least(donor - k * 1000, 0) AS a FROM rx),
xc AS (SELECT DISTINCT contig, strand, ds, acs FROM (SELECT read_id, contig, strand, list(d ORDER BY d) AS ds, list(a ORDER BY d) AS acs FROM xj GROUP BY 1, 2, 3)),
pr AS (SELECT xc.*, tx_id, list_sort(ks) AS ks FROM xc JOIN tx USING (contig, strand) WHERE gene_id LIKE 'g1%' AND len(ds) <= len(ks)),
wk AS (SELECT *, 0 AS i, 0 AS r, 0 AS n, 0 AS sw, TRUE AS ok FROM pr UNION ALL
  SELECT contig, strand, ds, acs, tx_id, ks, i + 1, last, n + (NOT same)::INT, sw + CASE WHEN same THEN 0 ELSE last - r - 1 END, ok AND (same OR (ds[i + 1] // 1000 <> 6 AND TRUE)) FROM (
    SELECT *, CASE WHEN same THEN r + 1 ELSE list_min(list_filter(range(r + 1, len(ks) + 1), lambda s: (abs(ds[i + 1] - ks[r + 1] * 1000) <= 1 AND ks[s] * 1000 + 500 - acs[i + 1] BETWEEN 1 AND 30) OR (abs(acs[i + 1] - ks[s] * 1000 - 500) <= 1 AND ds[i + 1] - ks[r + 1] * 1000 BETWEEN 1 AND 30))) END AS last FROM (
      SELECT *, abs(ds[i + 1] - ks[r + 1] * 1000) <= 1 AND abs(acs[i + 1] - ks[r + 1] * 1000 - 500) <= 1 AS same FROM wk WHERE i < len(ds) AND r < len(ks))) WHERE last IS NOT NULL),
dn AS (SELECT contig || '|' || strand || '|' || array_to_string(list_transform(range(1, len(ds) + 1), lambda x: ds[x] || '-' || acs[x]), ';') AS chain_id, tx_id, n, sw, ks FROM wk WHERE i = len(ds) AND r = len(ks) AND n > 0 AND ok),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY n, tx_id) AS place FROM dn)
SELECT chain_id, tx_id, n AS n_displaced, sw AS n_swallowed, array_to_string(list_transform(ks, lambda k: (k * 1000) || '-' || (k * 1000 + 500)), ';') AS target FROM rk2 WHERE place = 1""", recursive=True)


QUERIES = {
    "sj_summed_replicates": (sj_summed_replicates, "WITH " + _LIB + " SELECT * FROM sm"),
    "sj_support": (sj_support, SUPPORT),
    "sj_concordance": (sj_concordance, CONCORDANCE),
    "junction_offsets": (junction_offsets, OFFSETS),
    "tss_evidence": (tss_evidence, TSS),
    "coverage_step": (coverage_step, STEP),
    "holdout_split": (holdout_split, None),
    "local_fdr": (local_fdr, None),
    "ridge_logistic": (ridge_logistic, None),
    "structural_match": (structural_match, None),
    "reproducibility_curve": (reproducibility_curve, CURVE),
    "category_rollup": (category_rollup, ROLLUP),
    "qc_invariants": (qc_invariants, INVARIANTS),
    "name_diagnosis": (name_diagnosis, DIAGNOSIS),
    "model_audit": (model_audit, AUDIT),
    "displaced_plan": (displaced_plan, DISPLACED),
}
