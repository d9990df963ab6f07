"""Ends against transcripts and regions; terminal evidence; evaluation of junctions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import junctions as N
from ..operators import regions as R
from . import virtual as V
from .evidence_queries import track
from .junction_queries import _FEATURES, features
from .model_queries import models


def transcripts(spark):
    t = V.transcripts(spark).withColumn("exons", I.build_exons(F.col("chain"), F.col("strand"), F.col("tss"), F.col("tts")))
    return t.withColumns({"tx_len": I.exonic_length(F.col("exons")), "stop_pos": F.when(F.col("rank") < 5, F.when(F.col("strand") == "+", F.col("tts") - 600).otherwise(F.col("tts") + 600))})


def best_transcript_for_ends(spark, d):
    m = models(spark, d).select(F.col("model_id").alias("id"), "contig", "strand", "five", "three")
    return R.best_transcript_for_ends(m, transcripts(spark), ["contig", "strand"])


BEST = V.sql("md tx", """p AS (SELECT model_id AS id, tx_id, abs(three - tts) AS d3, abs(five - tss) AS d5, rank, greatest(tss, tts) - least(tss, tts) - 500 * len(tx.ks) AS n FROM md JOIN tx USING (contig, strand)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d3, d5, rank, n DESC, tx_id) AS k FROM p) SELECT id, tx_id, d3, d5 FROM r WHERE k = 1""")


def end_regions(spark, d):
    m = models(spark, d).select(F.col("model_id").alias("id"), "contig", "strand", "three")
    t = transcripts(spark).where("gene_id LIKE 'g2%'")
    return R.end_regions(m, t, ["contig", "strand"])


REGIONS = V.sql("md tx", """t AS (SELECT contig, strand, CASE WHEN strand = '-' THEN tts ELSE list_max(ks) * 1000 + 500 END AS ts, CASE WHEN strand = '-' THEN list_min(ks) * 1000 ELSE tts END AS te, CASE WHEN rank < 5 THEN CASE WHEN strand = '+' THEN tts - 600 ELSE tts END END AS us, CASE WHEN rank < 5 THEN CASE WHEN strand = '+' THEN tts ELSE tts + 600 END END AS ue FROM tx WHERE gene_id LIKE 'g2%')
SELECT model_id AS id, bool_or(three BETWEEN ts AND te) AS in_terminal_exon, coalesce(bool_or(three BETWEEN us AND ue), FALSE) AS in_utr3 FROM md JOIN t USING (contig, strand) GROUP BY 1""")


def start_class(spark, d):
    m = models(spark, d)
    t = transcripts(spark).where("rank = 0").select("contig", "strand", "tss", F.col("chain").alias("tc"))
    j = m.join(F.broadcast(t), ["contig", "strand"])
    crosses = F.size(I.retained_introns(F.col("exons"), F.col("tc"))) > 0
    return j.select("model_id", R.classify_start(F.col("five"), F.col("tss"), F.col("strand"), crosses).alias("class"))


START = V.sql("mx tx", """t AS (SELECT contig, strand, tss, tx.ks AS tk FROM tx WHERE rank = 0),
p AS (SELECT model_id, CASE WHEN strand = '-' THEN tss - five ELSE five - tss END AS dd, len(list_filter(tk, lambda k: len(list_filter(range(1, len(es) + 1), lambda i: es[i] <= k * 1000 AND ee[i] >= k * 1000 + 500)) > 0)) > 0 AS crosses FROM mx JOIN t USING (contig, strand))
SELECT model_id, CASE WHEN abs(dd) <= 100 THEN 'snapped' WHEN dd < 0 AND crosses THEN 'ir' WHEN dd < 0 THEN 'extended' ELSE 'absorbed' END AS class FROM p""")


def terminal_evidence(spark, d):
    r = V.reads(spark, d).withColumn("tail_len", F.col("read_id") % 29)
    runs = r.select("contig", "strand", "tts").distinct().withColumn("a_run", F.abs(F.col("tts")) % 9)
    out = R.terminal_evidence(r, runs, ["contig", "strand", "chain"])
    return out.select("contig", "strand", I.chain_repr(F.col("chain")).alias("chain"), F.round("median_tail_excess", 6).alias("median_tail_excess"), F.round("nontemplated_share", 6).alias("nontemplated_share"), "n_reads")


TERMINAL = V.sql("rd", "SELECT contig, strand, chain, round(quantile_cont(read_id % 29 - abs(tts) % 9, 0.5), 6) AS median_tail_excess, round(avg((read_id % 29 - abs(tts) % 9 >= 8)::INT), 6) AS nontemplated_share, count(*) AS n_reads FROM rd GROUP BY 1, 2, 3")


def start_ratio(spark, d):
    ends = V.reads(spark, d).select("contig", "strand", F.col("tss").alias("pos")).distinct().withColumn("id", F.concat_ws(":", F.col("contig").cast("string"), "strand", F.col("pos").cast("string")))
    out = R.start_ratio(ends, track(spark, d), least=1.0)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("before", "after", "ratio")), "supported")


RATIO = V.sql("rd", """tk AS (SELECT user_id % 5 AS contig, event_id % 200 * 50 AS s, event_id % 200 * 50 + 50 AS e, count(*) AS v FROM events WHERE (event_id % 200 * 50) % 350 <> 0 GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT contig, strand, tss AS pos FROM rd),
w AS (SELECT *, CASE WHEN strand = '-' THEN pos ELSE pos - 100 END AS us, CASE WHEN strand = '-' THEN pos - 100 ELSE pos END AS ds FROM q),
m AS (SELECT w.contig, w.strand, pos, sum(v * greatest(least(e, us + 100) - greatest(s, us), 0)) FILTER (s < us + 100 AND us < e) / 100 AS u, sum(v * greatest(least(e, ds + 100) - greatest(s, ds), 0)) FILTER (s < ds + 100 AND ds < e) / 100 AS dn FROM w LEFT JOIN tk USING (contig) GROUP BY 1, 2, 3)
SELECT contig || ':' || strand || ':' || pos AS id, round(u, 6) AS before, round(dn, 6) AS after, round(CASE WHEN dn >= 1 THEN dn / greatest(coalesce(u, 0), 1) END, 6) AS ratio, CASE WHEN dn >= 1 THEN dn / greatest(coalesce(u, 0), 1) END >= 1.5 AS supported FROM m""")


def judged(spark, d):
    return N.curate(features(spark, d)).withColumns({"sr_supported": F.col("sr_n_libs") >= 1, "held_out": F.col("donor") % 2 == 0})


def junction_bands(spark, d):
    return R.by_band(judged(spark, d)).withColumn("supported_share", F.round("supported_share", 6))


BANDS = V.sql("rx tj", _FEATURES + " SELECT annotated, drop_reason IS NULL AS keep, CASE WHEN n_reads >= 200 THEN 200 WHEN n_reads >= 50 THEN 50 WHEN n_reads >= 10 THEN 10 WHEN n_reads >= 5 THEN 5 WHEN n_reads >= 2 THEN 2 ELSE 1 END AS band, count(*) AS n, CAST(sum(n_reads) AS BIGINT) AS n_reads, round(avg((libs >= 1)::INT), 6) AS supported_share FROM jr GROUP BY 1, 2, 3")


def held_out_recall(spark, d):
    out = R.held_out_recall(judged(spark, d))
    return out.select("kind", "n", *(F.round(c, 6).alias(c) for c in out.columns if c.startswith("share")))


RECALL = V.sql("rx tj", _FEATURES + " SELECT CASE WHEN libs >= 1 AND donor % 2 = 0 THEN 'held_out' WHEN libs >= 1 THEN 'fitted' ELSE 'unsupported' END AS kind, count(*) AS n, round(avg((lfdr <= 0.01)::INT), 6) AS share_at_0_01, round(avg((lfdr <= 0.05)::INT), 6) AS share_at_0_05, round(avg((lfdr <= 0.1)::INT), 6) AS share_at_0_1 FROM jr WHERE lfdr IS NOT NULL GROUP BY 1")

QUERIES = {
    "best_transcript_for_ends": (best_transcript_for_ends, BEST),
    "end_regions": (end_regions, REGIONS),
    "start_class": (start_class, START),
    "terminal_evidence": (terminal_evidence, TERMINAL),
    "start_ratio": (start_ratio, RATIO),
    "junction_bands": (junction_bands, BANDS),
    "held_out_recall": (held_out_recall, RECALL),
}
