"""Chain grouping, candidates and suffixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import chain_repr
from ..operators import chains as C
from . import virtual as V
from .lineage import cut

R = chain_repr


def groups(spark, d):
    return C.assign_genes(C.annotate(C.chain_groups(V.reads(spark, d)), V.transcripts(spark)), V.transcript_junctions(spark))


def marked(spark, d):
    """Candidates flagged; thresholds on novel chains as in production."""
    return cut(C.mark_candidates(groups(spark, d)))  # groups, not reads: read by every later step


def with_tss(df, spark, d):
    """tss_evidence: the group's farthest-upstream read begins within 100 bases of an annotated start."""
    sites = V.transcripts(spark).groupBy("contig", "strand").agg(F.collect_set("tss").alias("sites"))  # some sites per contig: the annotation's size
    near = df.join(F.broadcast(sites), ["contig", "strand"], "left")
    return near.withColumn("tss_evidence", F.coalesce(F.exists("sites", lambda s: F.abs(s - F.col("five")) <= 100), F.lit(False))).drop("sites", "five")


def chain_groups(spark, d):
    g = C.annotate(C.chain_groups(V.reads(spark, d)), V.transcripts(spark))
    return g.select("contig", "strand", R(F.col("chain")).alias("chain"), "n_reads", "n_mols", "n_cells", "first_read", F.array_join("tx_ids", ",").alias("tx_ids"), "annotated")


CHAIN_GROUPS = V.sql("gr", "SELECT contig, strand, chain, n_reads, n_mols, n_cells, first_read, tx_ids, annotated FROM gr")

_GENES = """gj AS (SELECT DISTINCT contig, strand, gene_id, donor || '-' || acceptor AS j FROM tj),
gx AS (SELECT contig, strand, chain, unnest(string_split(chain, ';')) AS j FROM gr),
gv AS (SELECT contig, strand, chain, gene_id, count(*) AS v FROM gx JOIN gj USING (contig, strand, j) GROUP BY ALL),
gb AS (SELECT contig, strand, chain, arg_min(gene_id, (-v, gene_id)) AS near_gene FROM gv GROUP BY ALL),
gg AS (SELECT gr.*, coalesce(tx_gene, near_gene) AS gene_id FROM gr LEFT JOIN gb USING (contig, strand, chain)),
gs AS (SELECT *, CASE WHEN gene_id IS NOT NULL THEN support / sum(support) OVER (PARTITION BY gene_id) END AS share FROM gg),
gc AS (SELECT *, annotated OR (n_mols >= 3 AND n_reads >= 5 AND coalesce(share, 1) >= 0.01) AS candidate FROM gs),
sp AS (SELECT a.contig, a.strand, a.chain, b.chain AS parent FROM gc a JOIN gc b ON a.contig = b.contig AND a.strand = b.strand AND b.n > a.n AND suffix(b.chain, ';' || a.chain))"""
_MAX = _GENES + """,
cp AS (SELECT sp.* FROM sp JOIN gc a USING (contig, strand, chain) JOIN gc b ON b.contig = sp.contig AND b.strand = sp.strand AND b.chain = sp.parent WHERE a.candidate AND b.candidate),
mp AS (SELECT * FROM cp WHERE NOT EXISTS (SELECT 1 FROM cp q WHERE q.contig = cp.contig AND q.strand = cp.strand AND q.chain = cp.parent))"""


def candidate_chains(spark, d):
    return marked(spark, d).select("contig", "strand", R(F.col("chain")).alias("chain"), "gene_id", "support", F.round("share", 6).alias("share"), "annotated", "candidate")


CANDIDATES = V.sql("gr tj", _GENES + " SELECT contig, strand, chain, gene_id, support, round(share, 6) AS share, annotated, candidate FROM gc")


def suffix_pairs(spark, d):
    g = C.chain_groups(V.reads(spark, d))
    return C.suffix_pairs(g, g).select("contig", "strand", R(F.col("chain")).alias("chain"), R(F.col("parent")).alias("parent"))


SUFFIX_PAIRS = V.sql("gr tj", _GENES + " SELECT contig, strand, chain, parent FROM sp")


def maximal_parents(spark, d):
    return C.maximal_parents(marked(spark, d).where("candidate")).select("contig", "strand", R(F.col("chain")).alias("chain"), R(F.col("parent")).alias("parent"))


MAXIMAL = V.sql("gr tj", _MAX + " SELECT contig, strand, chain, parent FROM mp")


def resolved(spark, d, groups=None):
    """Decisions on the candidates; groups: marked()'s, where the caller has them already."""
    g = marked(spark, d) if groups is None else groups
    return C.resolve_suffixes(with_tss(g.where("candidate"), spark, d))


def suffix_resolution_class(spark, d):
    return resolved(spark, d).select(
        "contig", "strand", R(F.col("chain")).alias("chain"), "n_parents", F.round("eff_n_parents", 6).alias("eff_n_parents"), F.round("ratio", 6).alias("ratio"), "tss_evidence", "merge_class", R(F.col("target")).alias("target")
    )


_RESOLVE = _MAX + """,
fv AS (SELECT contig, strand, chain, CASE WHEN strand = '+' THEN min(tss) ELSE max(tss) END AS five FROM rd GROUP BY contig, strand, chain),
te AS (SELECT fv.contig, fv.strand, fv.chain, bool_or(abs(tc.tss - five) <= 100) AS tss_evidence FROM fv JOIN tc USING (contig, strand) GROUP BY ALL),
pf AS (SELECT mp.*, greatest(g.support, 1) AS ps, g.annotated AS pa, g.first_read AS pr FROM mp JOIN gc g ON g.contig = mp.contig AND g.strand = mp.strand AND g.chain = mp.parent),
pg AS (SELECT contig, strand, chain, count(*) AS n_parents, max(ps) AS top_support, max(ps) / sum(ps) AS top_share, sum(ps) * sum(ps) / sum(ps * ps) AS eff, arg_min(parent, (-ps, pr)) AS top_parent, arg_min(parent, (-ps, pr)) FILTER (pa) AS ann_parent, count(*) FILTER (pa) AS na FROM pf GROUP BY ALL),
rk AS (SELECT pg.*, gc.support / top_support AS ratio, tss_evidence, CASE WHEN annotated THEN 'annotated_kept' WHEN na > 0 AND tss_evidence THEN 'alt_tss_kept' WHEN na = 1 THEN 'truncation_of_annotated_parent' WHEN na > 1 THEN 'truncation_of_annotated_parents_ambiguous'
  WHEN gc.support / top_support >= 3 THEN 'dominant_kept' WHEN gc.support / top_support <= 0.33 AND (n_parents = 1 OR top_share >= 0.9) THEN 'debris' ELSE 'ambiguous' END AS merge_class FROM pg JOIN gc USING (contig, strand, chain) JOIN te USING (contig, strand, chain)),
rs AS (SELECT *, CASE WHEN merge_class LIKE 'truncation%' THEN ann_parent WHEN merge_class = 'debris' THEN top_parent END AS target FROM rk)"""
RESOLUTION = V.sql("gr tj tc rd", _RESOLVE + " SELECT contig, strand, chain, n_parents, round(eff, 6) AS eff_n_parents, round(ratio, 6) AS ratio, tss_evidence, merge_class, target FROM rs")


def subthreshold_rehome(spark, d):
    g = marked(spark, d)  # once: each call of it reads and groups all reads
    return C.rehome(g, resolved(spark, d, g)).select("contig", "strand", R(F.col("chain")).alias("chain"), "n_reads", "n_parents", "merge_class", R(F.col("target")).alias("target"))


_REHOME = _RESOLVE + """,
sv AS (SELECT * FROM gc WHERE candidate AND NOT EXISTS (SELECT 1 FROM rs WHERE rs.contig = gc.contig AND rs.strand = gc.strand AND rs.chain = gc.chain AND target IS NOT NULL)),
lp AS (SELECT sp.*, greatest(sv.support, 1) AS ps, sv.annotated AS pa, sv.first_read AS pr FROM sp JOIN sv ON sv.contig = sp.contig AND sv.strand = sp.strand AND sv.chain = sp.parent),
lg AS (SELECT contig, strand, chain, count(*) AS n_parents, max(ps) / sum(ps) AS top_share, arg_min(parent, (-ps, pr)) AS top_parent, arg_min(parent, (-ps, pr)) FILTER (pa) AS ann_parent, count(*) FILTER (pa) AS na FROM lp GROUP BY ALL),
lh AS (SELECT gc.contig, gc.strand, gc.chain, n_reads, n_parents, top_parent, ann_parent, CASE WHEN n_parents IS NULL THEN 'dropped_no_parent' WHEN n_parents = 1 OR top_share >= 0.9 THEN 'subthreshold_merge' WHEN na = 1 THEN 'subthreshold_annotated_parent' ELSE 'dropped_ambiguous' END AS merge_class FROM gc LEFT JOIN lg USING (contig, strand, chain) WHERE NOT candidate)"""
REHOME = V.sql("gr tj tc rd", _REHOME + " SELECT contig, strand, chain, n_reads, n_parents, merge_class, CASE WHEN merge_class = 'subthreshold_merge' THEN top_parent WHEN merge_class = 'subthreshold_annotated_parent' THEN ann_parent END AS target FROM lh")


def exact_chain_fraction(spark, d):
    """Of the reads that a chain ends up with, the share that had it from the start."""
    g = marked(spark, d)
    merged = resolved(spark, d, g)
    mapping = C.rehome(g, merged).select(*C.KEY, "target").unionByName(merged.select(*C.KEY, "target"))
    folded = C.fold(V.reads(spark, d).select("read_id", *C.KEY), mapping)
    return folded.groupBy("contig", "strand", "root").agg(F.count("*").alias("n_reads"), F.round(F.avg((F.col("chain") == F.col("root")).cast("int")), 6).alias("exact_fraction"), F.count_distinct("chain").alias("n_chains")).withColumn("root", R(F.col("root")))


EXACT = V.sql("gr tj tc rd", _REHOME + """,
mm AS (SELECT contig, strand, chain, target FROM rs WHERE target IS NOT NULL UNION ALL SELECT contig, strand, chain, CASE WHEN merge_class = 'subthreshold_merge' THEN top_parent ELSE ann_parent END FROM lh WHERE merge_class LIKE 'subthreshold%')
SELECT contig, strand, coalesce(target, chain) AS root, count(*) AS n_reads, round(avg(CASE WHEN target IS NULL THEN 1 ELSE 0 END), 6) AS exact_fraction, count(DISTINCT chain) AS n_chains FROM rd LEFT JOIN mm USING (contig, strand, chain) GROUP BY ALL""")

QUERIES = {
    "chain_groups": (chain_groups, CHAIN_GROUPS),
    "candidate_chains": (candidate_chains, CANDIDATES),
    "suffix_pairs": (suffix_pairs, SUFFIX_PAIRS),
    "maximal_parents": (maximal_parents, MAXIMAL),
    "suffix_resolution_class": (suffix_resolution_class, RESOLUTION),
    "subthreshold_rehome": (subthreshold_rehome, REHOME),
    "exact_chain_fraction": (exact_chain_fraction, EXACT),
}
