"""Junction census, curation, snapping; nearest sites, genes and interval unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import joins as J
from ..operators import junctions as N
from . import virtual as V
from .lineage import cut


def records(spark, d, displaced=False):
    return V.read_junctions(spark, d, displaced).join(V.orders(spark, d), "read_id")


def junction_census(spark, d):
    return N.census(records(spark, d, True))


_CENSUS = "jc AS (SELECT contig, strand, donor, acceptor, count(*) AS n_reads, count(DISTINCT (cell, umi)) AS n_mols, count(DISTINCT cell) AS n_cells FROM rx GROUP BY 1, 2, 3, 4)"
CENSUS = V.sql("rx", _CENSUS + " SELECT * FROM jc")


def site_shares(spark, d):
    s = N.site_shares(junction_census(spark, d))
    return s.select(*N.KEY, *(F.round(c, 6).alias(c) for c in ("donor_share", "acceptor_share", "min_site_share")))


_SHARES = _CENSUS + ", js AS (SELECT *, n_reads / sum(n_reads) OVER (PARTITION BY contig, strand, donor) AS donor_share, n_reads / sum(n_reads) OVER (PARTITION BY contig, strand, acceptor) AS acceptor_share FROM jc)"
SHARES = V.sql("rx", _SHARES + " SELECT contig, strand, donor, acceptor, round(donor_share, 6) AS donor_share, round(acceptor_share, 6) AS acceptor_share, round(least(donor_share, acceptor_share), 6) AS min_site_share FROM js")


def features(spark, d):
    """Junctions with motif, repeat, library count and score made from their coordinates."""
    s = N.site_shares(junction_census(spark, d))
    known = V.transcript_junctions(spark).select(*N.KEY).distinct().withColumn("a", F.lit(True))
    # every second contig's annotation is left out, so that there are novel junctions
    s = s.join(known, N.KEY, "left").withColumn("annotated", F.col("a").isNotNull() & (F.col("contig") % 2 == 0)).drop("a")
    x = F.col("donor") % 7
    motif = F.when(x == 0, "GC-AG").when(x == 1, "CT-AC").when(x == 2, "AA-TT").otherwise("GT-AG")
    return s.withColumns({"motif_class": S.motif_class(motif), "direct_repeat": (F.col("acceptor") % 11).cast("int"), "sr_n_libs": (F.col("donor") % 3).cast("int"), "lfdr": F.when(F.col("donor") % 13 == 0, F.lit(None)).otherwise((F.col("donor") % 13) / 100)})


def junction_curation_reasons(spark, d):
    return N.curate(features(spark, d)).select(*N.KEY, "n_reads", "n_mols", "annotated", "motif_class", "keep", "drop_reason")


_FEATURES = _SHARES + """,
kn AS (SELECT DISTINCT contig, strand, donor, acceptor, TRUE AS a FROM tj),
jf AS (SELECT js.*, least(donor_share, acceptor_share) AS min_share, a IS NOT NULL AND contig % 2 = 0 AS annotated, CASE donor % 7 WHEN 0 THEN 'semi_canonical' WHEN 1 THEN 'antisense' WHEN 2 THEN 'non_canonical' ELSE 'canonical' END AS motif_class, acceptor % 11 AS rep, donor % 3 AS libs, CASE WHEN donor % 13 <> 0 THEN (donor % 13) / 100 END AS lfdr FROM js LEFT JOIN kn USING (contig, strand, donor, acceptor)),
jr AS (SELECT *, CASE WHEN annotated THEN NULL WHEN n_mols < 3 THEN 'low_molecules' WHEN n_reads < 5 THEN 'low_reads' WHEN min_share < 0.001 THEN 'minor_at_both_sites'
  WHEN NOT (motif_class = 'canonical' OR (motif_class = 'semi_canonical' AND (libs >= 2 OR n_reads >= 50))) THEN 'motif_class_not_allowed_for_novel' WHEN rep >= 8 THEN 'rt_switch_repeat' WHEN lfdr > 0.05 THEN 'lfdr' END AS drop_reason FROM jf)"""
CURATION = V.sql("rx tj", _FEATURES + " SELECT contig, strand, donor, acceptor, n_reads, n_mols, annotated, motif_class, drop_reason IS NULL AS keep, drop_reason FROM jr")


def read_status_antijoin(spark, d):
    return N.read_status(records(spark, d, True), N.curate(features(spark, d)))


STATUS = V.sql("rx tj", _FEATURES + " SELECT read_id, count(*) AS n_junctions, bool_and(drop_reason IS NULL) AS ok FROM rx JOIN jr USING (contig, strand, donor, acceptor) GROUP BY read_id")


def curation_summary(spark, d):
    return N.curate(features(spark, d)).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome"), "annotated").agg(F.count("*").alias("n_junctions"), F.sum("n_reads").alias("n_reads"), F.round(F.percentile("n_mols", 0.5), 6).alias("median_mols"))


SUMMARY = V.sql("rx tj", _FEATURES + " SELECT coalesce(drop_reason, 'kept') AS outcome, annotated, count(*) AS n_junctions, CAST(sum(n_reads) AS BIGINT) AS n_reads, round(quantile_cont(n_mols, 0.5), 6) AS median_mols FROM jr GROUP BY 1, 2")


def nearest_site_snap(spark, d):
    points = records(spark, d, True).select("contig", "strand", F.col("donor").alias("pos")).distinct()
    sites = V.transcript_junctions(spark).where("donor <> 3000").select("contig", "strand", F.col("donor").alias("site"))
    return J.nearest_within(points, sites, ["contig", "strand"], 5)


SNAP = V.sql("rx tj", """p AS (SELECT DISTINCT contig, strand, donor AS pos FROM rx), s AS (SELECT DISTINCT contig, strand, donor AS site FROM tj WHERE donor <> 3000),
b AS (SELECT contig, strand, pos, arg_min(site, (abs(site - pos), site)) AS site FROM p JOIN s USING (contig, strand) WHERE abs(site - pos) <= 5 GROUP BY ALL) SELECT contig, strand, pos, site FROM p LEFT JOIN b USING (contig, strand, pos)""")


def splice_site_snap_map(spark, d):
    ann = V.transcript_junctions(spark).where("contig % 2 = 0")
    j = cut(junction_census(spark, d).select(*N.KEY, "n_reads"))  # junctions, not reads: read by every later step
    return N.snap_map(j, ann, "donor").withColumn("site", F.lit("donor")).unionByName(N.snap_map(j, ann, "acceptor").withColumn("site", F.lit("acceptor")))


SNAP_MAP = V.sql("rx tj", """c AS (SELECT contig, strand, 'donor' AS site, donor AS pos, count(*) AS n FROM rx GROUP BY ALL UNION ALL SELECT contig, strand, 'acceptor', acceptor, count(*) FROM rx GROUP BY ALL),
a AS (SELECT DISTINCT contig, strand, 'donor' AS site, donor AS known FROM tj WHERE contig % 2 = 0 UNION SELECT contig, strand, 'acceptor', acceptor FROM tj WHERE contig % 2 = 0),
b AS (SELECT contig, strand, site, pos, arg_min(known, (abs(known - pos), known)) AS dest FROM c JOIN a USING (contig, strand, site) WHERE abs(known - pos) <= 5 GROUP BY ALL),
g AS (SELECT contig, strand, site, count(*) AS k, list(pos ORDER BY n DESC, pos) AS ps FROM c ANTI JOIN b USING (contig, strand, site, pos) GROUP BY ALL),
w AS (SELECT *, 1 AS i, []::BIGINT[] AS seeds, []::BIGINT[] AS dests FROM g UNION ALL SELECT contig, strand, site, k, ps, i + 1, CASE WHEN t = ps[i] THEN list_append(seeds, t) ELSE seeds END, list_append(dests, t) FROM (SELECT *, CASE WHEN ps[i] - list_max(list_filter(seeds, lambda s: s < ps[i])) <= 5 THEN list_max(list_filter(seeds, lambda s: s < ps[i])) WHEN list_min(list_filter(seeds, lambda s: s > ps[i])) - ps[i] <= 5 THEN list_min(list_filter(seeds, lambda s: s > ps[i])) ELSE ps[i] END AS t FROM w WHERE i <= k))
SELECT contig, strand, site, pos, dest AS "to" FROM b UNION ALL SELECT contig, strand, site, ps[j], dests[j] FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM w WHERE i = k + 1)""", recursive=True)


def nearest_tts_signed(spark, d):
    """Of each spliced read's 3' end, along the transcript; negative if it lies upstream of the annotated one."""
    r = V.reads(spark, d).select("read_id", "contig", "strand", F.col("tts").alias("pos"))
    near = J.nearest_any(r, V.transcripts(spark).select("contig", "strand", F.col("tts").alias("site")), ["contig", "strand"])
    return near.select("read_id", "site", F.when(F.col("strand") == "-", F.col("site") - F.col("pos")).otherwise(F.col("pos") - F.col("site")).alias("signed_distance"))


TTS = V.sql("rd tc", """p AS (SELECT DISTINCT contig, strand, tts FROM rd), s AS (SELECT DISTINCT contig, strand, tts AS site FROM tc),
b AS (SELECT p.contig, p.strand, p.tts, arg_min(site, (abs(site - tts), site)) AS site FROM p JOIN s USING (contig, strand) GROUP BY ALL)
SELECT read_id, site, CASE WHEN strand = '-' THEN site - tts ELSE tts - site END AS signed_distance FROM rd JOIN b USING (contig, strand, tts)""")


def tx_exons(spark):
    from ..functions.intervals import build_exons

    t = V.transcripts(spark)
    return t.select("tx_id", "gene_id", "contig", "strand", "rank", F.explode(build_exons(F.col("chain"), F.col("strand"), F.col("tss"), F.col("tts"))).alias("x")).select("tx_id", "gene_id", "contig", "strand", "rank", "x.s", "x.e")


_EXONS = """xs AS (SELECT tx_id, gene_id, contig, strand, unnest(list_prepend(least(tss, tts), list_transform(ks, lambda k: k * 1000 + 500))) AS s, unnest(list_append(list_transform(ks, lambda k: k * 1000), greatest(tss, tts))) AS e FROM tx),
ix AS (SELECT gene_id, contig, strand, s, e, CASE WHEN s > max(e) OVER (PARTITION BY gene_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT gene_id, contig, strand, s, e FROM xs)),
iy AS (SELECT *, sum(fresh) OVER (PARTITION BY gene_id ORDER BY s, e) AS island FROM ix),
un AS (SELECT gene_id, contig, strand, min(s) AS s, max(e) AS e FROM iy GROUP BY gene_id, contig, strand, island)"""


def interval_union_islands(spark, d):
    """Islands that the reads' spans cover, of each strand and cell."""
    r = V.reads(spark, d).select("contig", "strand", "cell", F.col("start").alias("s"), F.col("end").alias("e"))
    m = V.mono_reads(spark, d).select("contig", "strand", "cell", F.col("start").alias("s"), F.col("end").alias("e"))
    return J.interval_union(r.unionByName(m), ["contig", "strand", "cell"])


ISLANDS = V.sql("rd mr", """z AS (SELECT contig, strand, cell, lo AS s, hi AS e FROM rd UNION SELECT contig, strand, cell, lo, hi FROM mr),
y AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY contig, strand, cell ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM z),
x AS (SELECT *, sum(fresh) OVER (PARTITION BY contig, strand, cell ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM y)
SELECT contig, strand, cell, min(s) AS s, max(e) AS e FROM x GROUP BY contig, strand, cell, island""")


def constitutive_introns(spark, d):
    """Gaps between a gene's exon islands: intronic in all of its transcripts."""
    from pyspark.sql import Window

    islands = J.interval_union(tx_exons(spark).select("gene_id", "contig", "strand", "s", "e"), ["gene_id", "contig", "strand"])
    w = Window.partitionBy("gene_id").orderBy("s")
    return islands.select("gene_id", "contig", "strand", F.col("e").alias("s"), F.lead("s").over(w).alias("e")).where("e IS NOT NULL")


CONSTITUTIVE = V.sql("tx", _EXONS + ", nx AS (SELECT gene_id, contig, strand, e AS s, lead(s) OVER (PARTITION BY gene_id ORDER BY s) AS e FROM un) SELECT * FROM nx WHERE e IS NOT NULL")


def gene_assignment_max_overlap(spark, d, reads=None):
    """Of each single-exon read: the gene whose exons it overlaps most; ties to the first id; none without overlap.

    reads: mono_reads(), kept, where the caller has them; each call of it sorts all line items' keys anew.
    """
    r = (cut(V.mono_reads(spark, d)) if reads is None else reads).select("read_id", "contig", "strand", F.col("start").alias("s"), F.col("end").alias("e"))
    u = J.interval_union(tx_exons(spark).select("gene_id", "contig", "strand", "s", "e"), ["gene_id", "contig", "strand"]).select("gene_id", "contig", "strand", F.col("s").alias("rs"), F.col("e").alias("re"))
    hit = J.interval_join(r, F.broadcast(u), ["contig", "strand"], 4096)  # the annotation's size; reads of a hot bin stay where they are
    bp = F.least("e", "re") - F.greatest("s", "rs")
    sums = hit.groupBy("read_id", "gene_id").agg(F.sum(bp).alias("bp"))
    best = sums.groupBy("read_id").agg(F.min(F.struct(-F.col("bp"), F.col("gene_id"))).alias("b"), F.count("*").alias("n_genes"))
    return r.select("read_id").join(best, "read_id", "left").select("read_id", F.col("b.gene_id").alias("gene_id"), (-F.col("b.col1")).alias("overlap_bp"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


GENE = V.sql("mr tx", _EXONS + """,
h AS (SELECT read_id, gene_id, sum(least(hi, e) - greatest(lo, s)) AS bp FROM mr JOIN un USING (contig, strand) WHERE lo < e AND s < hi GROUP BY 1, 2),
b AS (SELECT read_id, arg_min(gene_id, (-bp, gene_id)) AS gene_id, max(bp) AS bp, count(*) AS n FROM h GROUP BY 1)
SELECT read_id, gene_id, CAST(bp AS BIGINT) AS overlap_bp, coalesce(n, 0) AS n_genes FROM mr LEFT JOIN b USING (read_id)""")


def gaps(spark, d):
    """Deletions inside reads, from line items: each discounted line leaves one."""
    l = V.table(spark, d, "lineitem").where("l_discount >= 0.08")
    g = l.select(F.col("l_orderkey").alias("read_id"), ((F.col("l_suppkey") % 9 + 1) * 1000).cast("long").alias("donor"), (F.col("l_partkey") % 4 * 250 + 500).cast("long").alias("w")).distinct()
    g = g.join(V.orders(spark, d).select("read_id", "contig", "strand"), "read_id")
    return g.select("read_id", "contig", "strand", "donor", (F.col("donor") + F.col("w")).alias("acceptor"), S.motif_class(F.when(F.col("w") % 500 == 0, "GT-AG").otherwise("GT-AT")).alias("motif_class"))


def gap_promotion(spark, d):
    return N.promote_gaps(gaps(spark, d), V.transcript_junctions(spark).where("contig % 2 = 0"))


_GAPS = """gp AS (SELECT DISTINCT l_orderkey AS read_id, (l_suppkey % 9 + 1) * 1000 AS donor, l_partkey % 4 * 250 + 500 AS w FROM lineitem WHERE l_discount >= 0.08),
gq AS (SELECT read_id, contig, strand, donor, donor + w AS acceptor, w % 500 = 0 AS canonical FROM gp JOIN od USING (read_id)),
gk AS (SELECT DISTINCT contig, strand, donor, acceptor, TRUE AS a FROM tj WHERE contig % 2 = 0),
gm AS (SELECT contig, strand, donor, acceptor, count(*) AS n, bool_or(canonical) AS c FROM gq WHERE acceptor - donor <= 5000 GROUP BY 1, 2, 3, 4),
pr AS (SELECT contig, strand, donor, acceptor, n FROM gm LEFT JOIN gk USING (contig, strand, donor, acceptor) WHERE a OR (n >= 3 AND c))"""
PROMOTION = V.sql("od tj", _GAPS + " SELECT * FROM pr")


def gap_promoted_chains(spark, d):
    from ..functions.intervals import chain_repr

    g = gaps(spark, d)
    chains = V.reads(spark, d).select("read_id", "contig", "strand", "chain")
    return N.add_promoted(chains, g, gap_promotion(spark, d)).groupBy("contig", "strand", chain_repr(F.col("chain")).alias("chain")).agg(F.count("*").alias("n_reads"))


PROMOTED = V.sql("od tj rj", _GAPS + """,
al AS (SELECT read_id, contig, strand, donor, acceptor FROM rj UNION SELECT gq.read_id, contig, strand, donor, acceptor FROM gq JOIN pr USING (contig, strand, donor, acceptor) WHERE gq.read_id IN (SELECT read_id FROM rj)),
ch AS (SELECT read_id, contig, strand, string_agg(donor || '-' || acceptor, ';' ORDER BY CASE WHEN strand = '+' THEN donor ELSE -donor END, CASE WHEN strand = '+' THEN acceptor ELSE -acceptor END) AS chain FROM al GROUP BY 1, 2, 3)
SELECT contig, strand, chain, count(*) AS n_reads FROM ch GROUP BY 1, 2, 3""")


def unexplained_gap_reads(spark, d):
    return N.unexplained(gaps(spark, d), records(spark, d))


UNEXPLAINED = V.sql("od tj rj", _GAPS + " SELECT DISTINCT read_id FROM gq WHERE (contig, donor, acceptor) NOT IN (SELECT (contig, donor, acceptor) FROM rj)")


def read_gate_reasons(spark, d):
    """The first failing gate of each alignment, counted; alignments are line items."""
    l = V.table(spark, d, "lineitem")
    a = l.select(
        (F.col("l_returnflag") == "R").alias("secondary"),
        (F.col("l_linestatus") == "F").alias("supplementary"),
        (F.col("l_partkey") % 60).alias("mapq"),
        (1 - F.col("l_discount") * 2).alias("coverage"),
        (1 - F.col("l_tax")).alias("identity"),
        (F.col("l_suppkey") * 7 % 300).alias("clip5"),
        F.lit(0).alias("clip3"),
    )
    return a.groupBy(F.coalesce(N.gate(a), F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("n"))


GATES = """SELECT CASE WHEN l_returnflag = 'R' THEN 'secondary' WHEN l_linestatus = 'F' THEN 'supplementary' WHEN 1 - l_discount * 2 < 0.9 THEN 'coverage' WHEN 1 - l_tax < 0.95 THEN 'identity'
WHEN l_suppkey * 7 % 300 > 200 THEN 'clip5' ELSE 'admitted' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1"""


def gate_diagnostics(spark, d):
    l = V.table(spark, d, "lineitem").select((1 - F.col("l_discount") * 2).alias("c"), (1 - F.col("l_tax")).alias("i"), (F.col("l_suppkey") * 7 % 300).alias("k"))
    p = F.percentile
    return l.agg(*(F.round(p("c", q / 100), 6).alias(f"coverage_p{q}") for q in (1, 5, 10, 25, 50)), *(F.round(p("i", q / 100), 6).alias(f"identity_p{q}") for q in (1, 5, 50)), F.round(p("k", 0.5), 6).alias("clip5_median"), F.round(p("k", 0.9), 6).alias("clip5_p90"))


DIAGNOSTICS = "SELECT " + ", ".join([f"round(quantile_cont(1 - l_discount * 2, {q / 100}), 6) AS coverage_p{q}" for q in (1, 5, 10, 25, 50)] + [f"round(quantile_cont(1 - l_tax, {q / 100}), 6) AS identity_p{q}" for q in (1, 5, 50)] + ["round(quantile_cont(l_suppkey * 7 % 300, 0.5), 6) AS clip5_median", "round(quantile_cont(l_suppkey * 7 % 300, 0.9), 6) AS clip5_p90"]) + " FROM lineitem"

QUERIES = {
    "junction_census": (junction_census, CENSUS),
    "site_shares": (site_shares, SHARES),
    "junction_curation_reasons": (junction_curation_reasons, CURATION),
    "curation_summary": (curation_summary, SUMMARY),
    "read_status_antijoin": (read_status_antijoin, STATUS),
    "nearest_site_snap": (nearest_site_snap, SNAP),
    "splice_site_snap_map": (splice_site_snap_map, SNAP_MAP),
    "nearest_tts_signed": (nearest_tts_signed, TTS),
    "interval_union_islands": (interval_union_islands, ISLANDS),
    "constitutive_introns": (constitutive_introns, CONSTITUTIVE),
    "gene_assignment_max_overlap": (gene_assignment_max_overlap, GENE),
    "gap_promotion": (gap_promotion, PROMOTION),
    "gap_promoted_chains": (gap_promoted_chains, PROMOTED),
    "unexplained_gap_reads": (unexplained_gap_reads, UNEXPLAINED),
    "read_gate_reasons": (read_gate_reasons, GATES),
    "gate_diagnostics": (gate_diagnostics, DIAGNOSTICS),
}
