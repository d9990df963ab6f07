"""Models of each exact chain: similarity, structural classes, fragments, consolidation, tiers, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import models as M
from . import virtual as V
from .lineage import cut

G = ["contig", "strand", "chain"]


def models(spark, d):
    """One model for each chain: its farthest 5' and most distal 3' end."""
    plus = F.col("strand") == "+"
    g = V.reads(spark, d).groupBy(*G).agg(
        F.count("*").alias("n_reads"),
        F.count_distinct("cell", "umi").alias("n_mols"),
        F.when(plus, F.min("tss")).otherwise(F.max("tss")).alias("five"),
        F.when(plus, F.max("tts")).otherwise(F.min("tts")).alias("three"),
    )
    return g.withColumns({"model_id": F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain"))), "exons": I.build_exons(F.col("chain"), F.col("strand"), F.col("five"), F.col("three")), "support": I.support(F.col("n_mols"), F.col("n_reads"))})


def transcripts(spark):
    t = V.transcripts(spark)
    return t.withColumn("tx_len", I.exonic_length(I.build_exons(F.col("chain"), F.col("strand"), F.col("tss"), F.col("tts"))))


def retained_introns(spark, d):
    """Annotated introns of the locus that lie within one exon of a model, with 10 bases to either side."""
    m = models(spark, d)
    t = V.transcript_junctions(spark).groupBy("contig", "strand").agg(F.array_sort(F.collect_set(F.struct("donor", "acceptor"))).alias("js"))
    kept = I.retained_introns(F.col("exons"), F.col("js"), 10)
    return m.join(F.broadcast(t), ["contig", "strand"]).select("model_id", F.size(kept).cast("long").alias("n_retained"), I.chain_repr(kept).alias("retained"))


RETAINED = V.sql("mx tj", """j AS (SELECT DISTINCT contig, strand, donor, acceptor FROM tj),
x AS (SELECT model_id, contig, strand, unnest(es) AS s, unnest(ee) AS e FROM mx),
h AS (SELECT DISTINCT model_id, donor, acceptor FROM x JOIN j USING (contig, strand) WHERE s <= donor - 10 AND e >= acceptor + 10)
SELECT mx.model_id, count(donor) AS n_retained, coalesce(string_agg(donor || '-' || acceptor, ';' ORDER BY donor), '') AS retained FROM mx LEFT JOIN h USING (model_id) GROUP BY 1""")


def similarity_score_top1(spark, d):
    m = models(spark, d)
    t = transcripts(spark)
    genes = t.select("contig", "strand", "gene_id").distinct()
    one = m.join(F.broadcast(genes), ["contig", "strand"]).where(F.col("gene_id").startswith("g1"))
    s = M.similarity(one, t)
    return s.select("model_id", "tx_id", F.round("score", 6).alias("score"), *(F.col(c).cast("long").alias(c) for c in ("n_shared", "n_model_only", "n_ref_only", "n_retained", "d5", "d3", "n_equally_close")), M.describe().alias("difference"))


SIMILARITY = V.sql("mx tx", """t AS (SELECT *, least(tss, tts) AS tlo, greatest(tss, tts) AS thi FROM tx WHERE gene_id LIKE 'g1%'),
p AS (SELECT model_id, tx_id, t.rank, mx.strand, thi - tlo - 500 * len(t.ks) AS tx_len, len(list_intersect(mx.ks, t.ks)) AS sh, list_filter(mx.ks, lambda k: NOT list_contains(t.ks, k)) AS mo, list_filter(t.ks, lambda k: NOT list_contains(mx.ks, k)) AS ro, es, ee, five, three, tss, tts FROM mx JOIN t USING (contig, strand)),
q AS (SELECT *, len(mo) AS nm, len(ro) AS nr, len(list_filter(ro, lambda k: len(list_filter(range(1, len(es) + 1), lambda i: es[i] <= k * 1000 - 10 AND ee[i] >= k * 1000 + 510)) > 0)) AS nt, CASE WHEN strand = '-' THEN tss - five ELSE five - tss END AS d5, CASE WHEN strand = '-' THEN tts - three ELSE three - tts END AS d3 FROM p),
r AS (SELECT *, 2.0 * sh - 3.0 * nm - (nr - nt) - 0.5 * nt AS score FROM q),
w AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY score DESC, abs(d3), abs(d5), rank, tx_len DESC, tx_id) AS place, rank() OVER (PARTITION BY model_id ORDER BY score DESC, abs(d3), abs(d5)) AS tie FROM r),
z AS (SELECT *, count(*) FILTER (tie = 1) OVER (PARTITION BY model_id) AS n_equally_close FROM w)
SELECT model_id, tx_id, CAST(score AS DOUBLE) AS score, sh AS n_shared, nm AS n_model_only, nr AS n_ref_only, nt AS n_retained, d5, d3, n_equally_close,
  concat_ws(';', CASE WHEN nm > 0 THEN '+' || nm || 'jxn' END, CASE WHEN nr - nt > 0 THEN '-' || (nr - nt) || 'jxn' END, CASE WHEN nt > 0 THEN nt || 'IR' END, CASE WHEN d5 <> 0 THEN 'd5=' || CASE WHEN d5 > 0 THEN '+' ELSE '' END || d5 END, CASE WHEN d3 <> 0 THEN 'd3=' || CASE WHEN d3 > 0 THEN '+' ELSE '' END || d3 END) AS difference FROM z WHERE place = 1""")


def sqanti_class(spark, d):
    # half of the annotation is hidden, so that all classes occur
    t = V.transcripts(spark).where("(rank <> 0 OR contig = 0) AND contig < 4")
    j = t.select("contig", "strand", F.explode("chain").alias("j")).select("contig", "strand", "j.donor", "j.acceptor").where("contig <> 2")
    out = M.structural_class(models(spark, d), t, j)
    return out.select("model_id", "category", "subcategory", *(F.col(c).cast("long").alias(c) for c in ("miss5", "miss3", "novel_sites", "novel_combinations")))


SQANTI = V.sql("mx tx", """t AS (SELECT * FROM tx WHERE (rank <> 0 OR contig = 0) AND contig < 4),
jn AS (SELECT DISTINCT contig, strand, unnest(ks) AS k FROM t WHERE contig <> 2),
p AS (SELECT model_id, mx.strand, mx.ks AS a, t.ks AS b, es, ee FROM mx JOIN t USING (contig, strand)),
o AS (SELECT *, list_min(list_filter(range(0, greatest(len(b) - len(a), 0) + 1), lambda i: len(a) < len(b) AND b[i + 1:i + len(a)] = a)) AS k, list_filter(b, lambda x: NOT list_contains(a, x)) AS miss, len(list_intersect(a, b)) = len(a) AND len(a) < len(b) AS sub FROM p),
q AS (SELECT *, list_filter(miss, lambda x: x > a[1] AND x < a[-1]) AS inner_, len(list_filter(miss, lambda x: x < a[1])) AS l, len(list_filter(miss, lambda x: x > a[-1])) AS r FROM o),
s AS (SELECT *, sub AND len(inner_) > 0 AND len(list_filter(inner_, lambda x: len(list_filter(range(1, len(es) + 1), lambda i: es[i] <= x * 1000 AND ee[i] >= x * 1000 + 500)) = 0)) = 0 AS ir FROM q),
f AS (SELECT model_id, bool_or(a = b) AS fsm, min({'all': len(b) - len(a), 'm5': CASE WHEN strand = '+' THEN k ELSE len(b) - len(a) - k END, 'm3': CASE WHEN strand = '+' THEN len(b) - len(a) - k ELSE k END}) FILTER (k IS NOT NULL) AS ism,
  min({'all': l + r, 'm5': CASE WHEN strand = '+' THEN l ELSE r END, 'm3': CASE WHEN strand = '+' THEN r ELSE l END}) FILTER (ir) AS ir FROM s GROUP BY 1),
n AS (SELECT model_id, count(*) FILTER (jn.k IS NULL) AS ns FROM (SELECT model_id, contig, strand, unnest(ks) AS k FROM mx) m LEFT JOIN jn USING (contig, strand, k) GROUP BY 1)
SELECT model_id, CASE WHEN fsm THEN 'FSM' WHEN ism IS NOT NULL OR ir IS NOT NULL THEN 'ISM' WHEN ns = 0 THEN 'NIC' ELSE 'NNC' END AS category,
  CASE WHEN fsm THEN NULL WHEN ism IS NOT NULL THEN CASE WHEN ism.m5 > 0 AND ism.m3 > 0 THEN 'internal_fragment' WHEN ism.m5 > 0 THEN '3prime_fragment' ELSE '5prime_fragment' END WHEN ir IS NOT NULL THEN 'intron_retention' WHEN ns = 0 THEN 'combination_of_known_junctions' ELSE 'at_least_one_novel_splicesite' END AS subcategory,
  CASE WHEN fsm THEN NULL ELSE coalesce(ism.m5, ir.m5) END AS miss5, CASE WHEN fsm THEN NULL ELSE coalesce(ism.m3, ir.m3) END AS miss3, ns AS novel_sites, 0::BIGINT AS novel_combinations FROM mx LEFT JOIN f USING (model_id) LEFT JOIN n USING (model_id)""")


def subchain_offsets(spark, d):
    m = models(spark, d).select("model_id", "contig", "strand", I.genomic(F.col("chain")).alias("a"))
    t = V.transcripts(spark).select("tx_id", "contig", "strand", I.genomic(F.col("chain")).alias("b"))
    k = I.subchain_offsets(F.col("a"), F.col("b"), 5)
    return m.join(F.broadcast(t), ["contig", "strand"]).withColumn("k", k).where(F.size("k") > 0).select("model_id", "tx_id", F.array_join("k", ",").alias("offsets"))


OFFSETS = V.sql("md tx", """p AS (SELECT model_id, tx_id, md.ks AS a, tx.ks AS b FROM md JOIN tx USING (contig, strand) WHERE len(md.ks) < len(tx.ks)),
o AS (SELECT model_id, tx_id, list_filter(range(0, len(b) - len(a) + 1), lambda i: b[i + 1:i + len(a)] = a) AS k FROM p)
SELECT model_id, tx_id, array_to_string(k, ',') AS offsets FROM o WHERE len(k) > 0""")


def with_category(spark, d):
    """A model of an annotated chain with few reads is FSM and protected."""
    known = V.transcripts(spark).where("rank < 3").select(*G).distinct().withColumn("k", F.lit(True))
    return models(spark, d).join(known, G, "left").withColumn("category", F.when(F.col("k"), "FSM").otherwise("NIC"))


def containers(spark, d):
    return M.fragments(with_category(spark, d))


def subchain_container(spark, d):
    return containers(spark, d)


_CONTAINER = """kc AS (SELECT DISTINCT contig, strand, ks FROM tx WHERE rank < 3),
pc AS (SELECT a.model_id, b.model_id AS container, b.n_mols AS cs, b.lo AS blo, b.hi AS bhi FROM mx a JOIN mx b ON a.contig = b.contig AND a.strand = b.strand AND len(a.ks) < len(b.ks) AND b.n_mols >= 2 * greatest(a.n_mols, 1)
  WHERE len(list_filter(range(0, len(b.ks) - len(a.ks) + 1), lambda i: b.ks[i + 1:i + len(a.ks)] = a.ks AND a.lo >= b.es[i + 1] - 50 AND a.hi <= b.ee[i + len(a.ks) + 1] + 50)) > 0
  AND NOT EXISTS (SELECT 1 FROM kc WHERE kc.contig = a.contig AND kc.strand = a.strand AND kc.ks = a.ks)),
fc AS (SELECT model_id, arg_min(container, (-cs, blo, -bhi, container)) AS container FROM pc GROUP BY 1)"""
CONTAINER = V.sql("mx tx", _CONTAINER + " SELECT model_id, container FROM fc")


def container_resolution(spark, d):
    return M.surviving_targets(containers(spark, d))


RESOLUTION = V.sql("mx tx", _CONTAINER + """, w AS (SELECT model_id, container, container AS target, 1 AS n FROM fc UNION ALL SELECT w.model_id, w.container, fc.container, n + 1 FROM w JOIN fc ON w.target = fc.model_id)
SELECT model_id, container, arg_max(target, n) AS target FROM w GROUP BY 1, 2""", recursive=True)


def folded_counts(spark, d):
    """Reads and molecules of the surviving models after their fragments' reads moved in: none are lost."""
    to = container_resolution(spark, d).select("model_id", "target")
    r = V.reads(spark, d).withColumn("model_id", F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain"))))
    moved = r.join(to, "model_id", "left").withColumn("root", F.coalesce("target", "model_id"))
    return moved.groupBy("root").agg(F.count("*").alias("n_reads"), F.count_distinct("cell", "umi").alias("n_mols"), F.count_distinct("cell").alias("n_cells"))


FOLDED = V.sql("mx tx rd", _CONTAINER + """, w AS (SELECT model_id, container AS target, 1 AS n FROM fc UNION ALL SELECT w.model_id, fc.container, n + 1 FROM w JOIN fc ON w.target = fc.model_id),
t AS (SELECT model_id, arg_max(target, n) AS target FROM w GROUP BY 1)
SELECT coalesce(target, r.m) AS root, count(*) AS n_reads, count(DISTINCT (cell, umi)) AS n_mols, count(DISTINCT cell) AS n_cells FROM (SELECT *, contig || '|' || strand || '|' || chain AS m FROM rd) r LEFT JOIN t ON r.m = t.model_id GROUP BY 1""", recursive=True)


def end3_consolidation(spark, d):
    from .end_queries import variants

    v = variants(spark, d).withColumns({"support": I.support(F.col("n_mols"), F.col("n_reads")), "tx_len": F.col("n_reads"), "start": F.col("three"), "five": F.lit(0).cast("long")})
    return M.consolidate_ends(v, G, 200).groupBy("representative").agg(F.count("*").alias("n_models"), F.sum("n_reads").alias("n_reads"))


CONSOLIDATION = V.sql("rd", """v3 AS (SELECT contig, strand, chain, tts // 120 AS bin, count(*) AS n, count(DISTINCT (cell, umi)) AS m, min(tts) AS three FROM rd GROUP BY 1, 2, 3, 4),
f AS (SELECT *, contig || '|' || strand || '|' || chain || '|' || bin AS id, (NOT (bin % 5 = 0 AND contig = 0))::INT AS a FROM v3),
g AS (SELECT contig, strand, chain, count(*) AS k, list(id ORDER BY a, m DESC, n DESC, three, id) AS ids, list(three ORDER BY a, m DESC, n DESC, three, id) AS ts, list(n ORDER BY a, m DESC, n DESC, three, id) AS ns FROM f GROUP BY 1, 2, 3),
w AS (SELECT *, 1 AS i, list_transform(ids, lambda x: 0) AS own FROM g UNION ALL SELECT * EXCLUDE (i, own), i + 1, CASE WHEN own[i] <> 0 THEN own ELSE list_transform(range(1, k + 1), lambda j: CASE WHEN own[j] = 0 AND abs(ts[j] - ts[i]) <= 200 THEN i ELSE own[j] END) END FROM w WHERE i <= k),
x AS (SELECT ids, own, ns, unnest(range(1, k + 1)) AS j FROM w WHERE i = k + 1)
SELECT ids[own[j]] AS representative, count(*) AS n_models, CAST(sum(ns[j]) AS BIGINT) AS n_reads FROM x GROUP BY 1""", recursive=True)


def gene_dominance(spark, d):
    from .chain_queries import marked

    g = marked(spark, d).withColumn("model_id", F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain"))))
    return M.gene_dominance(g.where("gene_id IS NOT NULL")).select("model_id", "gene_id", "place", "n_in_gene", "runner_up", "sole", "dominant")


def _dominance() -> str:
    from .chain_queries import _GENES

    return V.sql("gr tj", _GENES + """, r AS (SELECT contig || '|' || strand || '|' || chain AS model_id, gene_id, support, CAST(row_number() OVER (PARTITION BY gene_id ORDER BY support DESC, contig || '|' || strand || '|' || chain) AS INT) AS place, count(*) OVER (PARTITION BY gene_id) AS n_in_gene FROM gg WHERE gene_id IS NOT NULL),
q AS (SELECT *, max(support) FILTER (place = 2) OVER (PARTITION BY gene_id) AS runner_up FROM r)
SELECT model_id, gene_id, place, n_in_gene, runner_up, n_in_gene = 1 AS sole, place = 1 AND n_in_gene > 1 AND support > coalesce(runner_up, 0) AS dominant FROM q""")


def end3_tier(spark, d):
    """Of each part, read as a model's evidence; null where a number is divisible by 7."""
    p = V.table(spark, d, "part")
    x = F.col("p_partkey")
    opinion = lambda c: F.when(x % 7 != 0, c)
    e = p.select(
        x.alias("id"),
        opinion(F.col("p_size") % 10 == 0).alias("at_polya_site"),
        opinion((x % 100) / 100).alias("nontemplated_share"),
        opinion(x % 20).alias("tail_excess"),
        (x % 6 == 0).alias("internal_priming"),
        (F.col("p_size") % 3 == 0).alias("motif_found"),
        opinion((x % 30 - 10) / 100).alias("dse_contrast"),
        opinion((x % 25).cast("double")).alias("dispersion"),
        opinion(x % 11 == 0).alias("step_supported"),
        F.lit(None).cast("double").alias("terminal_lfdr"),
        (x % 13 == 0).alias("sole"),
        (x % 17 == 0).alias("dominant"),
    )
    return e.select("id", M.end3_tier().alias("tier"))


TIER = """WITH e AS (SELECT p_partkey AS x, p_size AS z FROM part)
SELECT x AS id, CASE WHEN x % 7 <> 0 AND z % 10 = 0 THEN 'atlas' WHEN x % 7 <> 0 AND (x % 100) / 100 >= 0.5 AND x % 20 >= 8 AND x % 6 <> 0 THEN 'nontemplated'
WHEN x % 7 <> 0 AND z % 3 = 0 AND (x % 30 - 10) / 100 >= 0.1 AND x % 25 <= 12 AND x % 6 <> 0 THEN 'composition' WHEN x % 7 <> 0 AND x % 11 = 0 THEN 'short_read' WHEN x % 13 = 0 OR x % 17 = 0 THEN 'gene_dominant' END AS tier FROM e"""


def gene_structure(spark):
    """(gene_id, n_mono, n_multi, exons, islands, introns), some rows for each gene."""
    from ..operators.joins import interval_union
    from .junction_queries import tx_exons
    from pyspark.sql import Window

    t = V.transcripts(spark).groupBy("gene_id").agg(F.count_if(F.size("chain") == 0).alias("n_mono"), F.count_if(F.size("chain") > 0).alias("n_multi"))
    x = tx_exons(spark)
    exons = x.groupBy("gene_id").agg(F.collect_set(F.struct("s", "e")).alias("exons"))
    u = interval_union(x.select("gene_id", "contig", "strand", "s", "e"), ["gene_id", "contig", "strand"])
    w = Window.partitionBy("gene_id").orderBy("s")
    u = u.withColumn("next", F.lead("s").over(w)).groupBy("gene_id").agg(F.collect_list(F.struct("s", "e")).alias("islands"), F.collect_list(F.when(F.col("next").isNotNull(), F.struct(F.col("e").alias("s"), F.col("next").alias("e")))).alias("introns"))
    return t.join(exons, "gene_id").join(u, "gene_id")


def monoexon_class(spark, d):
    from .junction_queries import gene_assignment_max_overlap

    m = cut(V.mono_reads(spark, d))
    r = m.join(gene_assignment_max_overlap(spark, d, m).select("read_id", "gene_id"), "read_id")
    genes = gene_structure(spark).withColumn("n_mono", F.when(F.col("gene_id").startswith("g2.3"), 1).otherwise(F.col("n_mono"))).withColumn("n_multi", F.when(F.col("gene_id").startswith("g2.4"), 0).otherwise(F.col("n_multi")))
    return M.monoexon_class(r.select(F.col("read_id").alias("model_id"), "gene_id", F.col("start").alias("s"), F.col("end").alias("e")), F.broadcast(genes))  # a row for each gene


def _mono() -> str:
    from .junction_queries import _EXONS

    return V.sql("mr tx", _EXONS + """,
h AS (SELECT read_id, gene_id, sum(least(hi, e) - greatest(lo, s)) AS bp FROM mr JOIN un USING (contig, strand) WHERE lo < e AND s < hi GROUP BY 1, 2),
b AS (SELECT read_id, arg_min(gene_id, (-bp, gene_id)) AS gene_id FROM h GROUP BY 1),
z AS (SELECT mr.read_id, lo, hi, gene_id FROM mr LEFT JOIN b USING (read_id)),
iv AS (SELECT gene_id, e AS s, lead(s) OVER (PARTITION BY gene_id ORDER BY s) AS e FROM un),
k AS (SELECT z.*, EXISTS (SELECT 1 FROM xs WHERE xs.gene_id = z.gene_id AND xs.s <= lo AND hi <= xs.e) AS within, coalesce((SELECT sum(greatest(least(hi, un.e) - greatest(lo, un.s), 0)) FROM un WHERE un.gene_id = z.gene_id), 0) AS ex, coalesce((SELECT sum(greatest(least(hi, iv.e) - greatest(lo, iv.s), 0)) FROM iv WHERE iv.gene_id = z.gene_id AND iv.e IS NOT NULL), 0) AS ir FROM z)
SELECT read_id AS model_id, gene_id, CASE WHEN gene_id IS NULL THEN 'X' WHEN gene_id LIKE 'g2.4%' THEN 'A' WHEN gene_id LIKE 'g2.3%' THEN 'B' WHEN within THEN 'D' WHEN ir >= 10 AND ex >= 10 THEN 'C' ELSE 'E' END AS class FROM k""")


def monoexon_clusters(spark, d):
    return M.cluster_single_exons(V.mono_reads(spark, d)).groupBy("contig", "strand", "peak", "part").agg(F.count("*").alias("n_reads"), F.min("start").alias("start"), F.max("end").alias("end"))


def id_assignment(spark, d):
    from .chain_queries import marked

    g = marked(spark, d).where("gene_id IS NOT NULL").withColumn("key", I.chain_repr(F.col("chain")))
    return M.assign_ids(g, ["contig", "first_read", "strand", "key"]).select("contig", "strand", F.col("key").alias("chain"), "model_name")


def _ids() -> str:
    from .chain_queries import _GENES

    return V.sql("gr tj", _GENES + " SELECT contig, strand, chain, 'M.' || gene_id || '.' || row_number() OVER (PARTITION BY gene_id ORDER BY contig, first_read, strand, chain) AS model_name FROM gg WHERE gene_id IS NOT NULL")


def abundance_norm(spark, d):
    return M.abundance(models(spark, d)).select("model_id", F.round("read_share", 9).alias("read_share"), F.round("mol_share", 9).alias("mol_share"))


ABUNDANCE = V.sql("md", "SELECT model_id, round(n_reads / sum(n_reads) OVER (), 9) AS read_share, round(n_mols / sum(n_mols) OVER (), 9) AS mol_share FROM md")

QUERIES = {
    "retained_introns": (retained_introns, RETAINED),
    "similarity_score_top1": (similarity_score_top1, SIMILARITY),
    "sqanti_class": (sqanti_class, SQANTI),
    "subchain_offsets": (subchain_offsets, OFFSETS),
    "subchain_container": (subchain_container, CONTAINER),
    "container_resolution": (container_resolution, RESOLUTION),
    "folded_counts": (folded_counts, FOLDED),
    "end3_consolidation": (end3_consolidation, CONSOLIDATION),
    "gene_dominance": (gene_dominance, _dominance()),
    "end3_tier": (end3_tier, TIER),
    "monoexon_class": (monoexon_class, _mono()),
    "monoexon_clusters": (monoexon_clusters, None),
    "id_assignment": (id_assignment, _ids()),
    "abundance_norm": (abundance_norm, ABUNDANCE),
}
