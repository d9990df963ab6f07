"""3' peaks, 5' percentiles, weights and what becomes of terminal variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.intervals import chain_repr
from ..operators import ends as E
from ..operators import molecules as M
from . import virtual as V

G = ["contig", "strand", "chain"]


def named(df):
    return df.withColumn("chain", chain_repr(F.col("chain")))


def five_prime_p90(spark, d):
    r = V.reads(spark, d)
    three = r.groupBy(*G).agg(F.when(F.col("strand") == "+", F.max("tts")).otherwise(F.min("tts")).alias("three"))
    out = E.five_prime(r.join(three, G), G)
    return named(out).withColumn("extension", F.round("extension", 6))


P90 = V.sql("rd", """t AS (SELECT contig, strand, chain, CASE WHEN strand = '+' THEN max(tts) ELSE min(tts) END AS three FROM rd GROUP BY contig, strand, chain),
p AS (SELECT contig, strand, chain, three, round(quantile_cont(abs(tss - three), 0.9), 6) AS x FROM rd JOIN t USING (contig, strand, chain) GROUP BY 1, 2, 3, 4)
SELECT contig, strand, chain, three, round(x, 6) AS extension, CAST(trunc(CASE WHEN strand = '-' THEN three + x ELSE three - x END) AS BIGINT) AS five FROM p""")


def weighted(spark, d):
    return M.molecule_weights(V.reads(spark, d), G)


def molecule_weights(spark, d):
    return weighted(spark, d).select("read_id", F.round("weight", 6).alias("weight"))


WEIGHTS = V.sql("rd", "SELECT read_id, round(1 / count(*) OVER (PARTITION BY contig, strand, chain, cell, umi), 6) AS weight FROM rd")


def weighted_median_3p(spark, d):
    return named(E.weighted_median(E.histogram(V.reads(spark, d), G), G))


MEDIAN = V.sql("rd", """h AS (SELECT contig, strand, chain, tts AS pos, count(*) AS w FROM rd GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY contig, strand, chain ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY contig, strand, chain) AS t FROM h)
SELECT contig, strand, chain, min(pos) AS median FROM c WHERE c >= t / 2 GROUP BY 1, 2, 3""")


def dispersion(spark, d):
    r = V.reads(spark, d)
    far = r.groupBy(*G).agg(F.when(F.col("strand") == "+", F.min("tss")).otherwise(F.max("tss")).alias("five"))
    out = named(E.dispersion(r.join(far, G).withColumn("offset5", F.abs(F.col("tss") - F.col("five"))), G))
    return out.select(*G, *(F.round(c, 4).alias(c) for c in ("dispersion", "offset5_p10", "offset5_p50", "offset5_p90")))


DISPERSION = V.sql("rd", """f AS (SELECT contig, strand, chain, CASE WHEN strand = '+' THEN min(tss) ELSE max(tss) END AS five FROM rd GROUP BY contig, strand, chain)
SELECT contig, strand, chain, round(stddev_pop(tts), 4) AS dispersion, round(quantile_cont(abs(tss - five), 0.1), 4) AS offset5_p10, round(quantile_cont(abs(tss - five), 0.5), 4) AS offset5_p50, round(quantile_cont(abs(tss - five), 0.9), 4) AS offset5_p90 FROM rd JOIN f USING (contig, strand, chain) GROUP BY 1, 2, 3""")


def range_mass_peak_seed(spark, d):
    return named(E.peak_seed(E.histogram(V.reads(spark, d), G), G, 30))


SEED = V.sql("rd", """h AS (SELECT contig, strand, chain, tts AS pos, count(*) AS w FROM rd GROUP BY ALL),
m AS (SELECT *, sum(w) OVER (PARTITION BY contig, strand, chain ORDER BY pos RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS mass FROM h)
SELECT contig, strand, chain, arg_min(pos, (-mass, pos)) AS pos, CAST(max(mass) AS DOUBLE) AS mass FROM m GROUP BY 1, 2, 3""")


def clustered(spark, d):
    return E.cluster_ends(E.histogram(weighted(spark, d), G, weight=F.col("weight")), G, 30)


def peak_clusters_3p(spark, d):
    return named(clustered(spark, d).groupBy(*G, "label", "peak").agg(F.round(F.sum("w"), 6).alias("mass"), F.min("pos").alias("lo"), F.max("pos").alias("hi")))


def unweighted_peaks(spark, d):
    return E.cluster_ends(E.histogram(V.reads(spark, d), G), G, 30)


# Peaks by a recursive query: each round claims the densest window of each group.
CLUSTERS_BY_READS = V.sql("rd", """h AS (SELECT contig, strand, chain, tts AS pos, count(*) AS w FROM rd GROUP BY ALL),
a AS (SELECT contig, strand, chain, list({'p': pos, 'w': w} ORDER BY pos) AS l FROM h GROUP BY 1, 2, 3),
r AS (SELECT contig, strand, chain, l, 0 AS label, NULL::BIGINT AS centre FROM a
  UNION ALL
  SELECT contig, strand, chain, list_filter(l, lambda y: abs(y.p - b.pos) > 30), label + 1, b.pos FROM (
    SELECT *, list_extract(list_sort(list_transform(l, lambda x: {'m': -list_sum(list_transform(list_filter(l, lambda y: abs(y.p - x.p) <= 30), lambda y: y.w)), 'pos': x.p})), 1) AS b FROM r WHERE len(l) > 0))
SELECT contig, strand, chain, label - 1 AS label, centre FROM r WHERE label > 0""", recursive=True)


def peak_centres_by_reads(spark, d):
    """The same clusters told by their claiming positions, of read counts."""
    from pyspark.sql import Window

    c = unweighted_peaks(spark, d)
    mass = F.sum("w").over(Window.partitionBy(*G, "label").orderBy("pos").rangeBetween(-30, 30))
    lo, hi = F.min("pos").over(Window.partitionBy(*G, "label")), F.max("pos").over(Window.partitionBy(*G, "label"))
    best = c.withColumns({"m": mass, "lo": lo, "hi": hi}).where("hi - pos <= 30 AND pos - lo <= 30")
    return named(best.groupBy(*G, "label").agg(F.min(F.struct(-F.col("m"), F.col("pos"))).alias("b"))).select(*G, F.col("label").cast("int").alias("label"), F.col("b.pos").alias("centre"))


def umi_directional(spark, d):
    return named(M.collapse_umis(V.reads(spark, d), G).groupBy(*G).agg(F.count("*").alias("n_mols"), F.sum("n").alias("n_reads")))


def molecule_matrix(spark, d):
    counts = M.exact_counts(V.reads(spark, d).withColumn("model_id", F.concat_ws("|", F.col("contig").cast("string"), "strand", chain_repr(F.col("chain")))), ["model_id"]).groupBy("model_id", "cell").agg(F.count("*").alias("n"))
    return M.matrix(counts).select("row", "col", "n")


MATRIX = V.sql("rd", """c AS (SELECT contig || '|' || strand || '|' || chain AS model_id, cell, count(DISTINCT umi) AS n FROM rd GROUP BY 1, 2)
SELECT CAST(dense_rank() OVER (ORDER BY model_id) AS INT) AS row, CAST(dense_rank() OVER (ORDER BY cell) AS INT) AS col, n FROM c""")


def tail_evidence(spark, d):
    r = weighted(spark, d).withColumn("tail_len", F.col("read_id") % 17)
    return named(E.tail_evidence(r, G)).select(*G, F.round("tail_share", 6).alias("tail_share"), "n_tail", F.round("median_tail", 6).alias("median_tail"))


TAILS = V.sql("rd", """t AS (SELECT *, read_id % 17 AS l, 1 / count(*) OVER (PARTITION BY contig, strand, chain, cell, umi) AS w FROM rd)
SELECT contig, strand, chain, round(coalesce(sum(w) FILTER (l >= 8), 0) / sum(w), 6) AS tail_share, count(*) FILTER (l >= 8) AS n_tail, round(quantile_cont(l, 0.5), 6) AS median_tail FROM t GROUP BY 1, 2, 3""")


def variants(spark, d):
    """Reads' 3' ends in three bins of a chain are its variants; evidence comes from their counts."""
    r = V.reads(spark, d).withColumn("bin", F.floor(F.col("tts") / 120))
    v = r.groupBy(*G, "bin").agg(F.count("*").alias("n_reads"), F.count_distinct("cell", "umi").alias("n_mols"), F.min("tts").alias("three"), F.stddev_pop("tts").alias("dispersion"))
    return v.withColumns(
        {
            "model_id": F.concat_ws("|", F.col("contig").cast("string"), "strand", chain_repr(F.col("chain")), F.col("bin").cast("string")),
            "end_annotated": (F.col("bin") % 5 == 0) & (F.col("contig") == 0),
            "at_polya_site": F.col("n_reads") % 4 == 0,
            "step_supported": F.when(F.col("n_reads") % 3 == 0, F.col("n_reads") % 2 == 0),
            "dispersion": F.round(F.col("dispersion") * 4, 6),
        }
    )


def terminal_prune(spark, d):
    return named(E.prune_terminal(variants(spark, d), G)).select("model_id", "three", "n_reads", "absorbed_into", F.round("candidate_share", 6).alias("candidate_share"), "tier")


PRUNE = V.sql("rd", """v3 AS (SELECT contig, strand, chain, tts // 120 AS bin, count(*) AS n_reads, count(DISTINCT (cell, umi)) AS m, min(tts) AS three, round(stddev_pop(tts) * 4, 6) AS disp FROM rd GROUP BY 1, 2, 3, 4),
f AS (SELECT *, contig || '|' || strand || '|' || chain || '|' || bin AS model_id, CASE WHEN strand = '-' THEN three ELSE -three END AS pos, bin % 5 = 0 AND contig = 0 AS fx, n_reads % 4 = 0 OR n_reads % 6 = 0 OR disp <= 12 AS er FROM v3),
g AS (SELECT contig, strand, chain, count(*) AS n, bool_or(fx OR er) AS held, list(model_id ORDER BY pos, model_id) AS ids, list(pos ORDER BY pos, model_id) AS ats, list(m ORDER BY pos, model_id) AS ms, list(fx ORDER BY pos, model_id) AS fs, list(er ORDER BY pos, model_id) AS es, list(n_reads ORDER BY pos, model_id) AS ns, list(three ORDER BY pos, model_id) AS ts FROM f GROUP BY 1, 2, 3),
w AS (SELECT *, 1 AS i, []::BIGINT[] AS into_ FROM g UNION ALL SELECT * EXCLUDE (i, into_), i + 1, list_append(into_, CASE WHEN fs[i] OR es[i] THEN 0 ELSE coalesce(list_sort(list_transform(list_filter(range(1, i), lambda j: into_[j] = 0 AND ats[i] - ats[j] BETWEEN 1 AND 5000 AND CASE WHEN held THEN fs[j] OR es[j] ELSE ms[j] >= 2 * ms[i] END), lambda j: {'m': -ms[j], 'j': j}))[1].j, 0) END) FROM w WHERE i <= n),
x AS (SELECT *, unnest(range(1, n + 1)) AS j FROM w WHERE i = n + 1),
y AS (SELECT *, ms[j] + coalesce(list_sum(list_transform(list_filter(range(1, n + 1), lambda k: into_[k] = j), lambda k: ms[k])), 0) AS m, into_[j] = 0 AND es[j] AND NOT fs[j] AS run FROM x),
z AS (SELECT *, CASE WHEN run THEN m / sum(m) FILTER (run) OVER (PARTITION BY contig, strand, chain) END AS share FROM y)
SELECT ids[j] AS model_id, ts[j] AS three, ns[j] AS n_reads, CASE WHEN into_[j] > 0 THEN ids[into_[j]] END AS absorbed_into, round(share, 6) AS candidate_share, CASE WHEN into_[j] > 0 THEN NULL WHEN fs[j] THEN 'annotated' WHEN NOT es[j] THEN 'unsupported' WHEN ns[j] % 4 = 0 OR share >= 0.3 THEN 'high' ELSE 'reported' END AS tier FROM z""", recursive=True)


def relative_terms(spark, d):
    return E.relative_terms(variants(spark, d), G).select("model_id", F.round("group_share", 6).alias("group_share"), F.round("ratio_to_dominant", 6).alias("ratio_to_dominant"))


_VARIANTS = "v AS (SELECT contig, strand, chain, tts // 120 - (tts < 0 AND tts % 120 <> 0)::INT AS bin, count(*) AS n_reads, count(DISTINCT (cell, umi)) AS n_mols, min(tts) AS three FROM rd GROUP BY 1, 2, 3, 4)"
RELATIVE = V.sql("rd", _VARIANTS + """, w AS (SELECT *, greatest(n_mols, n_reads, 1) AS x FROM v)
SELECT contig || '|' || strand || '|' || chain || '|' || bin AS model_id, round(x / sum(x) OVER (PARTITION BY contig, strand, chain), 6) AS group_share, round(x / max(x) OVER (PARTITION BY contig, strand, chain), 6) AS ratio_to_dominant FROM w""")


def end3_categories(spark, d):
    """Of each variant: the name of its 3' end."""
    v = variants(spark, d).withColumn("peak", F.col("three"))
    t = V.transcripts(spark)
    own = t.groupBy(*G).agg(F.sort_array(F.collect_set("tts")).alias("chain_ends"))
    gene = t.groupBy("contig", "strand").agg(F.sort_array(F.collect_set("tts")).alias("gene_ends"))
    v = v.join(own, G, "left").join(gene, ["contig", "strand"], "left")
    v = E.relative_terms(v, G).withColumns({"share": F.col("group_share"), "polya": F.col("at_polya_site"), "readthrough": F.col("n_reads") % 5 == 0})
    return E.end3_category(v).select("model_id", "peak", "category", "end")


END3 = V.sql("rd tc", _VARIANTS + """, w AS (SELECT *, greatest(n_mols, n_reads, 1) / sum(greatest(n_mols, n_reads, 1)) OVER (PARTITION BY contig, strand, chain) AS share FROM v),
o AS (SELECT contig, strand, chain, bin, arg_min(tc.tts, (abs(tc.tts - three), tc.tts)) AS e, min(abs(tc.tts - three)) AS dist FROM w JOIN tc USING (contig, strand, chain) GROUP BY ALL),
g AS (SELECT w.contig, w.strand, w.chain, bin, arg_min(tc.tts, (abs(tc.tts - three), tc.tts)) AS ge, min(abs(tc.tts - three)) AS gd FROM w JOIN tc USING (contig, strand) GROUP BY ALL),
z AS (SELECT *, CASE WHEN dist <= 30 THEN 'FSM' WHEN dist IS NULL THEN 'NOVEL' WHEN gd <= 30 THEN 'end3_annotated' WHEN (share < 0.05 OR n_reads % 4 <> 0) AND dist <= 300 THEN 'FSM' WHEN share < 0.05 OR n_reads % 4 <> 0 THEN 'end3_unresolved' WHEN n_reads % 5 = 0 THEN 'READTHROUGH' ELSE 'end3_novel' END AS category FROM w LEFT JOIN o USING (contig, strand, chain, bin) LEFT JOIN g USING (contig, strand, chain, bin))
SELECT contig || '|' || strand || '|' || chain || '|' || bin AS model_id, three AS peak, category, CASE category WHEN 'FSM' THEN e WHEN 'end3_annotated' THEN ge ELSE three END AS "end" FROM z""")


def sequences(spark, d):
    """Made-up sequences: part keys in base 4."""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.substring(F.lit("ACGTAATA"), (F.pmod(F.col("id") * 37 + i * i * (F.col("id") % 11 + 1), F.lit(8)) + 1).cast("int"), F.lit(1)))
    return p.withColumn("seq", F.array_join(digits, ""))


def sequence_features(spark, d):
    s = sequences(spark, d)
    motif = S.polya_motif(F.col("seq"), strict=False)
    return s.select("id", "seq", S.revcomp(F.col("seq")).alias("revcomp"), F.round(S.percent_of(F.col("seq"), "A"), 6).alias("percent_a"), S.longest_run(F.col("seq")).cast("long").alias("longest_a"), S.leading_run(F.col("seq")).cast("long").alias("leading_a"), motif["motif"].alias("motif"), motif["dist"].cast("long").alias("dist"))


_MOTIF = lambda pick: "CASE " + " ".join(f"WHEN len(list_filter(range(1, 36), lambda i: substr(seq, i, 6) = '{m}' AND 41 - i BETWEEN 10 AND 40)) > 0 THEN {pick(m)}" for m in S.HEXAMERS) + " END"
SEQUENCES = f"""WITH s AS (SELECT p_partkey AS id, array_to_string(list_transform(range(0, 40), lambda i: substr('ACGTAATA', CAST((p_partkey * 37 + i * i * (p_partkey % 11 + 1)) % 8 + 1 AS INT), 1)), '') AS seq FROM part)
SELECT id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp, round(100.0 * (length(seq) - length(replace(seq, 'A', ''))) / length(seq), 6) AS percent_a,
  list_max(list_transform(regexp_split_to_array(seq, '[^A]'), lambda x: length(x))) AS longest_a, length(regexp_extract(seq, '^(A*)', 1)) AS leading_a, {_MOTIF(lambda m: f"'{m}'")} AS motif,
  {_MOTIF(lambda m: f"41 - list_min(list_filter(range(1, 36), lambda i: substr(seq, i, 6) = '{m}' AND 41 - i BETWEEN 10 AND 40))")} AS dist FROM s"""

QUERIES = {
    "five_prime_p90": (five_prime_p90, P90),
    "molecule_weights": (molecule_weights, WEIGHTS),
    "weighted_median_3p": (weighted_median_3p, MEDIAN),
    "dispersion": (dispersion, DISPERSION),
    "range_mass_peak_seed": (range_mass_peak_seed, SEED),
    "peak_clusters_3p": (peak_clusters_3p, None),
    "peak_centres_by_reads": (peak_centres_by_reads, CLUSTERS_BY_READS),
    "umi_directional": (umi_directional, V.sql("rd mo", "SELECT contig, strand, chain, n_mols, n_reads FROM (SELECT contig, strand, chain, count(*) AS n_reads FROM rd GROUP BY 1, 2, 3) JOIN mo USING (contig, strand, chain)")),
    "molecule_matrix": (molecule_matrix, MATRIX),
    "tail_evidence": (tail_evidence, TAILS),
    "terminal_prune": (terminal_prune, PRUNE),
    "relative_terms": (relative_terms, RELATIVE),
    "end3_categories": (end3_categories, END3),
    "sequence_features": (sequence_features, SEQUENCES),
}
