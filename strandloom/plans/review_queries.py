"""Reviews of a catalogue: single exons, second pass, budgets, reports, levels of scoring, regions, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import sequence as S
from ..operators import chains as C
from ..operators import ends as E
from ..operators import evidence as X
from ..operators import levels as L
from ..operators import models as M
from ..operators import regions as R
from ..operators import reports as P
from ..operators import secondpass as B
from ..operators import singles as O
from ..sources import alignments as A
from . import virtual as V
from .end_queries import _VARIANTS, sequences, variants
from .evidence_queries import _LIB, libraries, track
from .junction_queries import _EXONS, tx_exons
from .model_queries import models, transcripts

G = ["contig", "strand", "chain"]
_GENE = "'g1.' || contig || CASE WHEN strand = '+' THEN 'p' ELSE 'm' END"
_TRACK = "tk AS (SELECT user_id % 5 AS contig, event_id % 200 * 50 AS s, event_id % 200 * 50 + 50 AS e, count(*) AS v FROM events WHERE (event_id % 200 * 50) % 350 <> 0 GROUP BY 1, 2, 3)"


def gene():
    return F.concat(F.lit("g1."), F.col("contig").cast("string"), F.when(F.col("strand") == "+", "p").otherwise("m"))


# --- alignments ------------------------------------------------------------------------------------


def alignments(spark, d):
    """Reads as alignments: their exons as matches, some with an insertion or a short deletion in the first."""
    x = F.col("exons")
    first = F.element_at(x, 1)["e"] - F.element_at(x, 1)["s"]
    head = F.when(F.col("read_id") % 3 == 0, F.concat(F.lit("7S10M2I"), (first - 10).cast("string"), F.lit("M"))).when(F.col("read_id") % 3 == 1, F.concat(F.lit("10="), F.lit("5D"), (first - 15).cast("string"), F.lit("X"))).otherwise(F.concat(first.cast("string"), F.lit("M")))
    rest = F.transform(F.sequence(F.lit(2), F.size(x)), lambda i: F.concat((F.get(x, i - 1)["s"] - F.get(x, i - 2)["e"]).cast("string"), F.lit("N"), (F.get(x, i - 1)["e"] - F.get(x, i - 1)["s"]).cast("string"), F.lit("M")))
    r = V.reads(spark, d).withColumn("exons", I.build_exons(F.col("chain"), F.col("strand"), F.col("tss"), F.col("tts")))
    return r.select("read_id", "read_name", "contig", F.col("start").alias("pos"), F.concat(head, F.array_join(rest, "")).alias("cigar"), F.when(F.col("read_id") % 10 == 0, 256).otherwise(0).alias("flag"))


def exon_blocks(spark, d):
    b = A.exon_blocks(A.operations(F.col("cigar")), F.col("pos"))
    return alignments(spark, d).select("read_id", F.array_join(F.transform(b, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ";").alias("blocks"))


BLOCKS = V.sql("rd rk", "SELECT read_id, array_to_string(list_transform(range(1, len(ks) + 2), lambda i: CASE WHEN i = 1 THEN lo ELSE ks[i - 1] * 1000 + 500 END || '-' || CASE WHEN i > len(ks) THEN hi ELSE ks[i] * 1000 END), ';') AS blocks FROM rd JOIN rk USING (read_id)")


def exon_histogram(spark, d):
    return A.exon_histogram(alignments(spark, d), most=5)


HISTOGRAM = V.sql("rd", "SELECT CAST(least(n + 1, 5) AS INT) AS n_exons, count(*) AS n FROM rd WHERE read_id % 10 <> 0 GROUP BY 1")


def read_summary(spark, d):
    none = F.array().cast("array<struct<donor:bigint,acceptor:bigint>>")
    return P.read_summary(V.reads(spark, d).select("chain").unionAll(V.mono_reads(spark, d).select(none.alias("chain"))))


SUMMARY = V.sql("rd mr", "SELECT a + b AS reads, b AS mono_exonic_reads, a AS spliced_reads, CAST(j AS BIGINT) AS junction_records FROM (SELECT count(*) AS a, sum(n) AS j FROM rd), (SELECT count(*) AS b FROM mr)")


# --- intervals, names and attributes -----------------------------------------------------------------


def interval_terms(spark, d):
    """Of each model: ends, length, span, the terminal exon, exonic bases from the middle on, and its overlap with the locus' second transcript."""
    m = models(spark, d)
    t = V.transcripts(spark).where("tx_id LIKE 't2.%'").select("contig", "strand", F.least("tss", "tts").alias("ts"), F.greatest("tss", "tts").alias("te"))
    x, s = F.col("exons"), F.col("strand")
    mid = F.floor((F.element_at(x, 1)["s"] + F.element_at(x, -1)["e"]) / 2)
    last = I.terminal_exon(x, s)
    lo, hi = F.element_at(x, 1)["s"], F.element_at(x, -1)["e"]
    return m.join(t, ["contig", "strand"]).select("model_id", I.tss_of(x, s).alias("tss"), I.tts_of(x, s).alias("tts"), I.exonic_length(x).alias("length"), I.span(x).alias("span"), last["s"].alias("last_s"), last["e"].alias("last_e"), I.exonic_bases_downstream(x, s, mid).alias("downstream"), I.overlap(lo, hi, F.col("ts"), F.col("te")).alias("shared"), I.reciprocal(lo, hi, F.col("ts"), F.col("te"), 0.5).alias("reciprocal"))


TERMS = V.sql("mx tx", """t AS (SELECT contig, strand, least(tss, tts) AS ts, greatest(tss, tts) AS te FROM tx WHERE tx_id LIKE 't2.%'),
w AS (SELECT mx.*, ts, te, es[1] AS a, ee[-1] AS b, (es[1] + ee[-1] - ((es[1] + ee[-1]) % 2 + 2) % 2) // 2 AS mid, greatest(least(ee[-1], te) - greatest(es[1], ts), 0) AS shared FROM mx JOIN t USING (contig, strand))
SELECT model_id, CASE WHEN strand = '-' THEN b ELSE a END AS tss, CASE WHEN strand = '-' THEN a ELSE b END AS tts, CAST(list_sum(list_transform(range(1, len(es) + 1), lambda i: ee[i] - es[i])) AS BIGINT) AS length, b - a AS span, CASE WHEN strand = '-' THEN es[1] ELSE es[-1] END AS last_s, CASE WHEN strand = '-' THEN ee[1] ELSE ee[-1] END AS last_e,
  CAST(list_sum(list_transform(range(1, len(es) + 1), lambda i: CASE WHEN strand = '-' THEN greatest(least(ee[i], mid) - es[i], 0) ELSE greatest(ee[i] - greatest(es[i], mid), 0) END)) AS BIGINT) AS downstream, shared, shared > 0 AND shared >= 0.5 * (b - a) AND shared >= 0.5 * (te - ts) AS reciprocal FROM w""")


def retained_intron_rank(spark, d):
    """The first intron of the locus' longest transcript that a model reads through."""
    t = V.transcripts(spark).where("rank = 0").select("contig", "strand", F.col("chain").alias("tc"))
    m = models(spark, d).join(t, ["contig", "strand"])
    kept = I.retained_introns(F.col("exons"), F.col("tc"))
    return m.select("model_id", I.retained_intron_rank(F.col("tc"), kept).alias("place"), I.retained_intron_rank(F.slice("tc", 1, 3), kept).alias("place_in_first_three"))


RANK = V.sql("mx tx", """t AS (SELECT contig, strand, CASE WHEN strand = '-' THEN list_reverse_sort(tx.ks) ELSE list_sort(tx.ks) END AS tk FROM tx WHERE rank = 0),
w AS (SELECT model_id, tk, list_filter(tk, lambda k: len(list_filter(range(1, len(es) + 1), lambda i: es[i] <= k * 1000 AND ee[i] >= k * 1000 + 500)) > 0) AS kept FROM mx JOIN t USING (contig, strand))
SELECT model_id, CASE WHEN len(kept) = 0 THEN -1 ELSE list_position(tk, kept[1]) - 1 END::BIGINT AS place, CASE WHEN len(kept) = 0 THEN -1 ELSE least(list_position(tk, kept[1]) - 1, 3) END::BIGINT AS place_in_first_three FROM w""")


def oriented_windows(spark, d):
    s = sequences(spark, d).withColumn("strand", F.when(F.col("id") % 2 == 0, "+").otherwise("-"))
    down, up = S.oriented_window(F.col("id"), F.col("strand"), 5, 30), S.oriented_window(F.col("id"), F.col("strand"), -40, 0)
    return s.select("id", down["s"].alias("down_s"), down["e"].alias("down_e"), up["s"].alias("up_s"), up["e"].alias("up_e"), S.oriented_sequence(F.col("seq"), F.col("strand")).alias("seq"), F.round(S.contrast(S.oriented_sequence(F.col("seq"), F.col("strand"))), 6).alias("contrast"))


_SEQ = "sq AS (SELECT p_partkey AS id, array_to_string(list_transform(range(0, 40), lambda i: substr('ACGTAATA', CAST((p_partkey * 37 + i * i * (p_partkey % 11 + 1)) % 8 + 1 AS INT), 1)), '') AS q FROM part)"
WINDOWS = f"""WITH {_SEQ}, o AS (SELECT id, CASE WHEN id % 2 = 0 THEN q ELSE reverse(translate(q, 'ACGT', 'TGCA')) END AS seq FROM sq)
SELECT id, greatest(CASE WHEN id % 2 = 0 THEN id + 5 ELSE id - 30 END, 0) AS down_s, greatest(CASE WHEN id % 2 = 0 THEN id + 30 ELSE id - 5 END, 0) AS down_e, greatest(CASE WHEN id % 2 = 0 THEN id - 40 ELSE id END, 0) AS up_s, greatest(CASE WHEN id % 2 = 0 THEN id ELSE id + 40 END, 0) AS up_e, seq,
  round((len(list_filter(string_split(seq, ''), lambda c: c IN ('G', 'T'))) - len(list_filter(string_split(seq, ''), lambda c: c = 'A'))) / 40.0, 6) AS contrast FROM o"""


def gtf_attributes(spark, d):
    """Attributes of made-up annotation lines, in both forms, and what follows from them."""
    from ..sources.text import attribute

    x = F.col("p_partkey")
    tag = lambda c, t: F.when(c, F.lit(f' tag "{t}";')).otherwise("")
    gtf = F.concat(F.lit('gene_id "G'), (x % 50).cast("string"), F.lit('"; transcript_id "T'), x.cast("string"), F.lit('.1"; transcript_type "'), F.when(x % 3 == 0, "protein_coding").when(x % 3 == 1, "retained_intron").otherwise("lncRNA"), F.lit('";'), tag(x % 4 == 0, "basic"), tag(x % 12 == 0, "MANE_Select"), tag(x % 10 == 0, "Ensembl_canonical"))
    gff = F.concat(F.lit("ID=T"), x.cast("string"), F.lit(";gene_id=G"), (x % 50).cast("string"), F.lit(";note=a b"))
    tags = F.regexp_extract_all(gtf, F.lit('tag "([^"]*)"'), F.lit(1))
    contig = F.concat(F.when(x % 2 == 0, "chr").otherwise(""), F.when(x % 7 == 0, "M").when(x % 7 == 1, "MT").otherwise((x % 23).cast("string")))
    return V.table(spark, d, "part").select(x.alias("id"), attribute(gtf, "gene_id").alias("gene_id"), attribute(gtf, "transcript_id").alias("tx_id"), attribute(gff, "gene_id").alias("gff_gene"), attribute(gff, "ID").alias("gff_id"), attribute(gtf, "havana").alias("none"), S.canonical_rank(tags, attribute(gtf, "transcript_type")).alias("rank"), S.norm_contig(contig).alias("contig"))


ATTRIBUTES = """SELECT p_partkey AS id, 'G' || p_partkey % 50 AS gene_id, 'T' || p_partkey || '.1' AS tx_id, 'G' || p_partkey % 50 AS gff_gene, 'T' || p_partkey AS gff_id, NULL::VARCHAR AS "none",
CASE WHEN p_partkey % 12 = 0 THEN 0 WHEN p_partkey % 10 = 0 THEN 1 WHEN p_partkey % 3 = 0 AND p_partkey % 4 = 0 THEN 2 WHEN p_partkey % 4 = 0 THEN 3 WHEN p_partkey % 3 = 1 THEN 8 ELSE 5 END AS rank, CASE WHEN p_partkey % 7 < 2 THEN 'MT' ELSE CAST(p_partkey % 23 AS VARCHAR) END AS contig FROM part"""


def umi_neighbours(spark, d):
    """UMIs of four bases: how many of a cell's others are one base away."""
    base = lambda k: F.substring(F.lit("ACGT"), (F.floor(F.col("p_partkey") * 7 / 4**k) % 4 + 1).cast("int"), F.lit(1))
    u = V.table(spark, d, "part").select((F.col("p_size") % 5).cast("long").alias("cell"), F.concat(*(base(k) for k in range(4))).alias("umi")).distinct()
    near = u.select("cell", F.col("umi").alias("of"), F.explode(S.umi_neighbours(F.col("umi"))).alias("umi"))
    return u.join(near, ["cell", "umi"]).groupBy("cell", F.col("of").alias("umi")).agg(F.count("*").alias("n"))


NEIGHBOURS = """WITH u AS (SELECT DISTINCT CAST(p_size % 5 AS BIGINT) AS cell, substr('ACGT', CAST(p_partkey * 7 % 4 + 1 AS INT), 1) || substr('ACGT', CAST(p_partkey * 7 // 4 % 4 + 1 AS INT), 1) || substr('ACGT', CAST(p_partkey * 7 // 16 % 4 + 1 AS INT), 1) || substr('ACGT', CAST(p_partkey * 7 // 64 % 4 + 1 AS INT), 1) AS umi FROM part)
SELECT a.cell, a.umi, count(*) AS n FROM u a JOIN u b ON a.cell = b.cell AND hamming(a.umi, b.umi) = 1 GROUP BY 1, 2"""


# --- chains and groups -------------------------------------------------------------------------------


def junction_info(spark, d):
    k = V.transcript_junctions(spark).where("contig % 2 = 0 AND donor <> 2000").select("contig", "strand", "donor", "acceptor").distinct()
    k = k.select("*", (F.col("donor") % 2000 == 0).alias("annotated"), F.when(F.col("donor") != 3000, F.col("donor") / 10000).alias("posterior"), (F.col("donor") == 5000).alias("decoy"))
    g = C.junction_info(C.chain_groups(V.reads(spark, d)), k)
    return g.select("contig", "strand", I.chain_repr(F.col("chain")).alias("chain"), "n_novel_junctions", "n_decoy_junctions", F.round("min_posterior", 6).alias("min_posterior"), F.round("share_annotated", 6).alias("share_annotated"))


INFO = V.sql("md", """j AS (SELECT contig, strand, chain, unnest(ks) AS k FROM md),
f AS (SELECT *, contig % 2 = 0 AND k <> 2 AS there, contig % 2 = 0 AND k <> 2 AND k % 2 = 0 AS a FROM j)
SELECT contig, strand, chain, count(*) FILTER (NOT a) AS n_novel_junctions, count(*) FILTER (there AND k = 5) AS n_decoy_junctions, round(min(CASE WHEN a THEN 1 WHEN NOT there THEN 0 WHEN k = 3 THEN 1 ELSE k / 10 END), 6) AS min_posterior, round(avg(a::INT), 6) AS share_annotated FROM f GROUP BY 1, 2, 3""")


def group_chains(spark, d):
    """Member chains of each last junction."""
    r = V.reads(spark, d).withColumn("root", F.slice("chain", -1, 1))
    return R.group_chains(r).select("contig", "strand", I.chain_repr(F.col("root")).alias("root"), I.chain_repr(F.col("chain")).alias("chain"), "n_reads")


GROUP_CHAINS = V.sql("rd", "SELECT contig, strand, list_last(string_split(chain, ';')) AS root, chain, count(*) AS n_reads FROM rd GROUP BY 1, 2, 3, 4")


def dedupe_by_exons(spark, d):
    """Models of coarse ends, some of equal exons."""
    m = models(spark, d).withColumns({"exons": F.transform("exons", lambda x: F.struct((F.floor(x["s"] / 1000) * 1000).alias("s"), (F.floor(x["e"] / 1000) * 1000).alias("e"))), "n_cells": F.col("n_reads") % 7, "flags": F.array(F.concat(F.lit("f"), (F.col("n_reads") % 3).cast("string")), F.lit("all"))})
    m = m.withColumn("exons", F.slice("exons", 1, 2))
    out = M.dedupe(m)
    return out.select("model_id", "n_reads", "n_mols", "n_cells", F.array_join("flags", ",").alias("flags"))


DEDUPE = V.sql("mx", """w AS (SELECT *, list_transform(es[1:2], lambda x: x - ((x % 1000) + 1000) % 1000) AS a, list_transform(ee[1:2], lambda x: x - ((x % 1000) + 1000) % 1000) AS b FROM mx)
SELECT min(model_id) AS model_id, CAST(sum(n_reads) AS BIGINT) AS n_reads, CAST(sum(n_mols) AS BIGINT) AS n_mols, max(n_reads % 7) AS n_cells, 'all,' || string_agg(DISTINCT 'f' || n_reads % 3, ',' ORDER BY 'f' || n_reads % 3) AS flags FROM w GROUP BY contig, strand, a, b""")


# --- ends --------------------------------------------------------------------------------------------


def categorised(spark, d):
    return variants(spark, d).withColumns({"category": F.when(F.col("bin") % 3 == 0, "FSM").when(F.col("bin") % 3 == 1, "end3_novel").otherwise("end3_unresolved"), "mass": F.col("n_mols")})


_CATEGORISED = _VARIANTS + ", cv AS (SELECT *, contig || '|' || strand || '|' || chain || '|' || bin AS model_id, CASE ((bin % 3) + 3) % 3 WHEN 0 THEN 'FSM' WHEN 1 THEN 'end3_novel' ELSE 'end3_unresolved' END AS category FROM v)"


def variant_budget(spark, d):
    v = categorised(spark, d).withColumn("category", F.when(F.col("bin") % 3 == 0, "FSM").when(F.pmod("bin", F.lit(3)) == 1, "end3_novel").otherwise("end3_unresolved"))
    shown = E.within_budget(v, ["contig", "strand"], most=3, emit_unresolved=True)
    return shown.select("model_id", "category")


BUDGET = V.sql("rd", _CATEGORISED + """, w AS (SELECT *, sum((category <> 'FSM')::INT) OVER (PARTITION BY contig, strand ORDER BY n_mols DESC, model_id ROWS UNBOUNDED PRECEDING) AS place FROM cv)
SELECT model_id, category FROM w WHERE category = 'FSM' OR place <= 3""")


def readthrough(spark, d):
    """Models of the first gene whose 3' end lies in an exon of the second, past the first gene's end (which is cut to half of it here)."""
    m = models(spark, d).select(F.col("model_id").alias("id"), "contig", "strand", "three", gene().alias("gene_id"))
    x = tx_exons(spark).select("gene_id", "contig", "strand", F.col("s").alias("rs"), F.col("e").alias("re"))
    genes = V.transcripts(spark).groupBy("gene_id").agg(F.min(F.least("tss", "tts")).alias("start"), F.floor(F.max(F.greatest("tss", "tts")) / 2).alias("stop"))
    return R.readthrough_gene(m, genes, x).select("id", "readthrough")


READTHROUGH = V.sql("mx tx", _EXONS + f""", g AS (SELECT gene_id, min(least(tss, tts)) AS a, max(greatest(tss, tts)) // 2 AS b FROM tx GROUP BY 1),
m AS (SELECT model_id AS id, contig, strand, three, {_GENE} AS gene_id FROM mx),
h AS (SELECT id, min(xs.gene_id) AS readthrough FROM m JOIN g USING (gene_id) JOIN xs ON xs.contig = m.contig AND xs.strand = m.strand AND xs.gene_id <> m.gene_id AND xs.s <= three AND three < xs.e WHERE three < a OR three >= b GROUP BY 1)
SELECT id, readthrough FROM m LEFT JOIN h USING (id)""")


def nearest_parent(spark, d):
    m = models(spark, d).select(F.col("model_id").alias("id"), gene().alias("gene_id"), "three")
    return R.nearest_parent(m, transcripts(spark)).select("id", "parent")


PARENT = V.sql("md tx", f"SELECT model_id AS id, arg_min(tx_id, (abs(three - tts), rank, tx_id)) AS parent FROM (SELECT model_id, three, {_GENE} AS gene_id FROM md) JOIN tx USING (gene_id) GROUP BY 1")


def continuity(spark, d):
    m = models(spark, d).select(F.col("model_id").alias("id"), "contig", "exons")
    return X.continuity(m, track(spark, d)).select("id", F.round("coverage", 6).alias("coverage"))


CONTINUITY = V.sql("mx", _TRACK + """, x AS (SELECT model_id, contig, unnest(es) AS a, unnest(ee) AS b FROM mx),
h AS (SELECT model_id, a, b, sum(v * (least(b, e) - greatest(a, s))) AS t FROM x JOIN tk ON tk.contig = x.contig AND s < b AND a < e GROUP BY 1, 2, 3),
c AS (SELECT model_id, sum(t) / sum(b - a) AS coverage FROM h GROUP BY 1)
SELECT model_id AS id, round(coverage, 6) AS coverage FROM mx LEFT JOIN c USING (model_id)""")


# --- single exons and the second pass ------------------------------------------------------------------


def clusters(spark, d):
    """Single-exon clusters made of parts; null where a number is divisible by 7."""
    x, z = F.col("p_partkey"), F.col("p_size")
    opinion = lambda c: F.when(x % 7 != 0, c)
    s = x % 8 * 1000 + x % 450
    return V.table(spark, d, "part").select(
        x.alias("id"),
        F.when(x % 11 != 0, F.concat(F.lit("g1."), (x % 5).cast("string"), F.when(x % 2 == 0, "p").otherwise("m"))).alias("gene_id"),
        s.alias("s"),
        (s + 100 + x % 400).alias("e"),
        (s + x % 500).alias("three"),
        (z % 15).cast("long").alias("n_reads"),
        (z % 6).cast("long").alias("n_mols"),
        (z % 5).cast("long").alias("n_cells"),
        (x % 10 / 10).alias("in_terminal"),
        (x % 9 / 10).alias("in_utr3"),
        opinion((x % 25).cast("double")).alias("dispersion"),
        opinion(x % 1200).alias("d_site"),
        opinion(x % 900 - 450).alias("d_tts"),
        (x % 3 == 0).alias("motif_found"),
        (x % 13 == 0).alias("internal_priming"),
        opinion(x % 5 == 0).alias("polya_supported"),
        (x % 100 / 100).alias("tail_share"),
        opinion(x % 4 < 2).alias("step_supported"),
    )


def spliced(spark, d):
    m = models(spark, d)
    return m.select(gene().alias("gene_id"), "model_id", F.element_at("exons", 1)["s"].alias("s"), F.element_at("exons", -1)["e"].alias("e"), "three", F.col("model_id").alias("place"))


def monoexon_rules(spark, d):
    return O.judge(clusters(spark, d), spliced(spark, d)).select("id", "category", "outcome", "target", "rescued", "tier")


MONOEXON = V.sql("mx", f"""c AS (SELECT p_partkey AS x, p_size AS z, CASE WHEN p_partkey % 11 <> 0 THEN 'g1.' || p_partkey % 5 || CASE WHEN p_partkey % 2 = 0 THEN 'p' ELSE 'm' END END AS gene_id, p_partkey % 8 * 1000 + p_partkey % 450 AS s FROM part),
k AS (SELECT *, s + 100 + x % 400 AS e, s + x % 500 AS three, x % 7 <> 0 AS o, CASE WHEN gene_id IS NULL THEN 'monoexon_intergenic' WHEN greatest(x % 10 / 10, x % 9 / 10) >= 0.5 THEN 'monoexon_3UTR' ELSE 'monoexon_internal' END AS category FROM c),
f AS (SELECT *, o AND gene_id IS NOT NULL AND abs(x % 900 - 450) <= 100 AS ann, o AND x % 1200 <= 100 AS site, o AND x % 3 = 0 AND x % 25 <= 12 AS tight FROM k),
sp AS (SELECT {_GENE} AS gene_id, model_id, es[1] AS ms, ee[-1] AS me, three AS m3 FROM mx),
h AS (SELECT x, min(model_id) FILTER (ms <= s AND me >= e) AS inside, arg_min(model_id, (-(least(e, me) - greatest(s, ms)), model_id)) FILTER (least(e, me) - greatest(s, ms) >= 0.5 * (e - s)) AS over_, arg_min(model_id, (abs(m3 - three), model_id)) FILTER (abs(m3 - three) <= 100) AS ends_ FROM f JOIN sp USING (gene_id) WHERE category = 'monoexon_3UTR' GROUP BY 1),
w AS (SELECT f.*, inside, over_, ends_, category = 'monoexon_3UTR' AND NOT (ann OR site OR tight) AS open_ FROM f LEFT JOIN h USING (x)),
y AS (SELECT *, open_ AND inside IS NOT NULL AS r1, open_ AND o AND x % 4 >= 2 AND over_ IS NOT NULL AS r2, category = 'monoexon_3UTR' AND ends_ IS NOT NULL AS r3, category <> 'monoexon_3UTR' AS needs, o AND x % 5 = 0 AS tailed, x % 100 / 100 >= 0.3 AND z % 5 >= 3 AS saved FROM w),
q AS (SELECT *, CASE WHEN r1 THEN 'demoted_fragment' WHEN r2 THEN 'sr_continuation' WHEN r3 THEN 'demoted_fragment' WHEN z % 15 < CASE WHEN gene_id IS NULL THEN 10 ELSE 5 END OR (z % 6 > 0 AND z % 6 < 3) THEN 'low_support' WHEN x % 13 = 0 THEN 'internal_priming' WHEN needs AND NOT tailed AND NOT saved THEN 'no_polya' ELSE 'kept' END AS outcome FROM y)
SELECT x AS id, category, outcome, CASE WHEN r1 THEN inside WHEN r2 THEN over_ WHEN r3 THEN ends_ END AS target, outcome = 'kept' AND needs AND NOT tailed AS rescued, CASE WHEN outcome = 'kept' THEN CASE WHEN ann THEN 'annotated' WHEN site THEN 'high' WHEN tight THEN 'reported' ELSE 'unsupported' END END AS tier FROM q""")


def catalogue(spark, d):
    """Spliced models and single-exon ones of every class; some genes have no spliced model or no transcript."""
    x = F.col("p_partkey")
    mono = V.table(spark, d, "part").select(
        F.concat(F.lit("s"), x.cast("string")).alias("model_id"),
        F.when(x % 6 == 5, F.lit(None)).otherwise(F.concat(F.when(x % 4 == 0, "g2.").when(x % 4 == 1, "gz.").otherwise("g1."), (x % 5).cast("string"), F.when(x % 2 == 0, "p").otherwise("m"))).alias("gene_id"),
        F.lit(1).alias("n_exons"),
        F.col("p_size").cast("long").alias("support"),
        F.concat(F.lit("s"), x.cast("string")).alias("place"),
        F.substring(F.lit("ABCDEX"), (x % 6 + 1).cast("int"), F.lit(1)).alias("class"),
    )
    m = models(spark, d).select("model_id", gene().alias("gene_id"), (F.size("chain") + 1).alias("n_exons"), "support", F.col("model_id").alias("place"), F.lit(None).cast("string").alias("class"))
    return m.unionByName(mono)


def second_pass_singles(spark, d):
    return B.replace_single_exons(catalogue(spark, d), transcripts(spark))


_SINGLES = f"""mo1 AS (SELECT 's' || p_partkey AS model_id, CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE CASE p_partkey % 4 WHEN 0 THEN 'g2.' WHEN 1 THEN 'gz.' ELSE 'g1.' END || p_partkey % 5 || CASE WHEN p_partkey % 2 = 0 THEN 'p' ELSE 'm' END END AS gene_id, substr('ABCDEX', CAST(p_partkey % 6 + 1 AS INT), 1) AS class FROM part),
bs AS (SELECT {_GENE} AS gene_id, arg_min(model_id, (-n_mols, model_id)) AS best FROM md GROUP BY 1),
cn AS (SELECT gene_id, arg_min(tx_id, (rank, -(greatest(tss, tts) - least(tss, tts) - 500 * len(ks)), tx_id)) AS canon FROM tx GROUP BY 1),
dj AS (SELECT model_id, gene_id, class, best, canon, class IN ('C', 'D', 'E') AS rm FROM mo1 LEFT JOIN bs USING (gene_id) LEFT JOIN cn USING (gene_id)),
de AS (SELECT model_id, gene_id, class, CASE WHEN class = 'X' OR NOT rm THEN 'kept' WHEN best IS NOT NULL OR canon IS NOT NULL THEN 'replaced' ELSE 'removed' END AS action, CASE WHEN class = 'X' THEN 'intergenic_out_of_scope' WHEN NOT rm THEN 'gene_admits_monoexonic_isoforms' WHEN best IS NOT NULL THEN 'infer_from=data' WHEN canon IS NOT NULL THEN 'infer_from=reference' ELSE 'no_reference_transcript' END AS reason, CASE WHEN rm AND best IS NOT NULL THEN 'data' WHEN rm AND canon IS NOT NULL THEN 'reference' END AS source, CASE WHEN rm AND best IS NOT NULL THEN best WHEN rm AND canon IS NOT NULL THEN 'INFERRED|' || gene_id || '|' || canon END AS target FROM dj)"""
SINGLES = V.sql("md tx", _SINGLES + " SELECT model_id, gene_id, class, action, reason, source, target FROM de")


def inferred_models(spark, d):
    t = transcripts(spark)
    out = B.inferred_models(B.replace_single_exons(catalogue(spark, d), t), t.withColumn("exons", I.build_exons(F.col("chain"), F.col("strand"), F.col("tss"), F.col("tts"))))
    return out.select("model_id", "gene_id", "contig", "strand", "n_absorbed", F.size("exons").alias("n_exons"), "category")


INFERRED = V.sql("md tx", _SINGLES + " SELECT target AS model_id, gene_id, contig, strand, n_absorbed, CAST(len(ks) + 1 AS INT) AS n_exons, 'INFERRED' AS category FROM (SELECT target, count(*) AS n_absorbed FROM de WHERE source = 'reference' GROUP BY 1) JOIN tx ON target = 'INFERRED|' || gene_id || '|' || tx_id")


def best_spliced_of_gene(spark, d):
    return B.best_spliced(catalogue(spark, d))


BEST = V.sql("md", f"SELECT {_GENE} AS gene_id, arg_min(model_id, (-n_mols, model_id)) AS best FROM md GROUP BY 1")


def ended(spark, d):
    v = categorised(spark, d).withColumns({"gene_id": F.when(F.col("n_reads") % 9 != 0, gene()), "support": F.col("n_mols"), "place": F.col("model_id")})
    return v.withColumn("category", F.when(F.pmod("bin", F.lit(3)) == 1, "end3_novel").when(F.pmod("bin", F.lit(3)) == 0, "FSM").otherwise("end3_unresolved"))


def second_pass_ends(spark, d):
    tier = F.when(F.col("n_reads") % 4 == 0, "atlas")
    return B.filter_ends(ended(spark, d), tier, ("end3_novel", "end3_unresolved"))


ENDS = V.sql("rd", _CATEGORISED + f""", m AS (SELECT *, CASE WHEN n_reads % 9 <> 0 THEN {_GENE} END AS gene_id, CASE WHEN category <> 'FSM' THEN CASE WHEN n_reads % 4 = 0 THEN 'atlas' ELSE 'none' END END AS tier FROM cv),
k AS (SELECT * FROM m WHERE tier IS DISTINCT FROM 'none'), bc AS (SELECT contig, strand, chain, arg_min(model_id, (-n_mols, model_id)) AS c FROM k GROUP BY ALL), bg AS (SELECT gene_id, arg_min(model_id, (-n_mols, model_id)) AS g FROM k WHERE gene_id IS NOT NULL GROUP BY 1)
SELECT model_id, 'kept' AS action, tier, NULL::VARCHAR AS target FROM k UNION ALL SELECT model_id, 'removed', tier, coalesce(c, g) FROM m LEFT JOIN bc USING (contig, strand, chain) LEFT JOIN bg USING (gene_id) WHERE tier = 'none'""")


def second_pass_dominance(spark, d):
    return B.dominance(ended(spark, d)).select("model_id", "sole", "dominant")


DOMINANCE = V.sql("rd", _CATEGORISED + f""", m AS (SELECT *, CASE WHEN n_reads % 9 <> 0 THEN {_GENE} END AS gene_id FROM cv),
r AS (SELECT model_id, gene_id, n_mols, count(*) OVER (PARTITION BY gene_id) AS n, row_number() OVER (PARTITION BY gene_id ORDER BY n_mols DESC) AS p FROM m WHERE gene_id IS NOT NULL),
t AS (SELECT gene_id, max(n_mols) FILTER (p = 1) AS top, coalesce(max(n_mols) FILTER (p = 2), 0) AS nxt, max(n) AS n FROM r GROUP BY 1)
SELECT model_id, coalesce(n = 1, FALSE) AS sole, coalesce(n_mols = top AND top > 0 AND (nxt = 0 OR top >= nxt), FALSE) AS dominant FROM m LEFT JOIN t USING (gene_id)""")


# --- structural classes --------------------------------------------------------------------------------


def single_transcripts(spark):
    """The annotation and, on three contigs, single-exon transcripts."""
    t = V.transcripts(spark).withColumn("exons", I.build_exons(F.col("chain"), F.col("strand"), F.col("tss"), F.col("tts"))).select("contig", "strand", "tx_id", "rank", "exons").where("contig < 4 AND rank <> 0")
    own = spark.createDataFrame([(c, s, f"s{k}.{c}{s}", 4, [(k * 1000 + 550, k * 1000 + 1000)]) for c in range(3) for s in "+-" for k in (2, 5)], "contig long, strand string, tx_id string, rank int, exons array<struct<s:bigint,e:bigint>>")
    return t.unionByName(own)


def single_exon_class(spark, d):
    m = V.mono_reads(spark, d).select(F.col("read_id").alias("model_id"), "contig", "strand", F.col("start").alias("s"), F.col("end").alias("e"))
    return M.single_exon_class(m, single_transcripts(spark))


SINGLE_CLASS = V.sql("mr tx", """t AS (SELECT contig, strand, tx_id, rank, list_prepend(least(tss, tts), list_transform(list_sort(ks), lambda k: k * 1000 + 500)) AS es, list_append(list_transform(list_sort(ks), lambda k: k * 1000), greatest(tss, tts)) AS ee FROM tx WHERE contig < 4 AND rank <> 0
  UNION ALL SELECT c, s, 's' || k || '.' || c || s, 4, [k * 1000 + 550], [k * 1000 + 1000] FROM (SELECT unnest(range(0, 3)) AS c), (SELECT unnest(['+', '-']) AS s), (SELECT unnest([2, 5]) AS k)),
p AS (SELECT read_id, lo, hi, tx_id, rank, es, ee, len(list_filter(range(1, len(es) + 1), lambda i: es[i] < hi AND lo < ee[i])) > 0 AS touches, len(list_filter(range(1, len(es) + 1), lambda i: es[i] <= lo AND hi <= ee[i])) > 0 AS within, len(es) = 1 AND least(hi, ee[-1]) - greatest(lo, es[1]) >= 0.5 * (hi - lo) AND least(hi, ee[-1]) - greatest(lo, es[1]) >= 0.5 * (ee[-1] - es[1]) AS whole FROM mr JOIN t USING (contig, strand)),
b AS (SELECT read_id, bool_or(whole) AS f, bool_or(within) AS i, arg_min(tx_id, (rank, tx_id)) AS "primary" FROM p WHERE touches GROUP BY 1)
SELECT read_id AS model_id, CASE WHEN f THEN 'FSM' WHEN i THEN 'ISM' WHEN f IS NOT NULL THEN 'genic' ELSE 'intergenic' END AS category, "primary" FROM mr LEFT JOIN b USING (read_id)""")


def fusion_genes(spark, d):
    x = tx_exons(spark).where("contig < 3").select("gene_id", "contig", "strand", F.col("s").alias("rs"), F.col("e").alias("re")).distinct()
    return M.fusions(models(spark, d).select("model_id", "contig", "strand", "exons"), x).select("model_id", F.array_join("genes", ",").alias("genes"), "fusion")


FUSIONS = V.sql("mx tx", _EXONS + """, h AS (SELECT model_id, string_agg(DISTINCT gene_id, ',' ORDER BY gene_id) AS genes, count(DISTINCT gene_id) > 1 AS fusion FROM (SELECT model_id, contig, strand, unnest(es) AS a, unnest(ee) AS b FROM mx) m JOIN xs USING (contig, strand) WHERE contig < 3 AND a < e AND s < b GROUP BY 1)
SELECT model_id, coalesce(genes, '') AS genes, coalesce(fusion, FALSE) AS fusion FROM mx LEFT JOIN h USING (model_id)""")


def terminal_classes(spark, d):
    v = ended(spark, d)
    return v.select("model_id", M.terminal_class(F.col("category"), F.col("n_reads") % 5 == 0, F.col("n_reads") % 4 == 0, F.when(F.col("n_reads") % 2 == 0, True)).alias("terminal_class"), M.fsm_subcategory(F.col("category")).alias("subcategory"))


TERMINAL = V.sql("rd", _CATEGORISED + " SELECT model_id, CASE WHEN n_reads % 5 = 0 THEN CASE WHEN category = 'FSM' THEN 'reference_end' ELSE 'alt_end_annotated' END WHEN n_reads % 4 = 0 THEN 'alt_end_atlas' WHEN n_reads % 2 = 0 THEN 'truncated_exonic' ELSE 'unresolved' END AS terminal_class, CASE category WHEN 'FSM' THEN 'reference_match' WHEN 'end3_novel' THEN 'alternative_3end' ELSE '' END AS subcategory FROM cv")


# --- reports and names -----------------------------------------------------------------------------------


def labelled(spark, d):
    n = F.col("n_reads")
    return models(spark, d).withColumns({"category": F.element_at(F.array(*map(F.lit, ["FSM", "NIC", "NNC", "IR", "READTHROUGH", "end3_novel"])), (n % 6 + 1).cast("int")), "gene_id": F.when(n % 8 != 0, gene()), "lfdr": F.when(n % 3 != 0, (n % 10) / 100), "associated_tx": F.when(n % 4 != 0, "t"), "n_equally_close": n % 3, "shift": F.when(n % 5 != 0, (n % 500) - 250), "refused": n % 7 == 0, "tail_share": F.when(n % 2 == 0, (n % 10) / 10)})


_LABELLED = "lm AS (SELECT *, n_reads AS n, ['FSM', 'NIC', 'NNC', 'IR', 'READTHROUGH', 'end3_novel'][n_reads % 6 + 1] AS category, CASE WHEN n_reads % 8 <> 0 THEN " + _GENE + " ELSE '?' END AS g FROM md)"


def novel_burden(spark, d):
    out = P.novel_burden(labelled(spark, d))
    return out.select(*(F.round(c, 6).alias(c) if c.startswith("share") else c for c in out.columns))


NOVEL = V.sql("md", _LABELLED + """, gn AS (SELECT count(*) AS a, coalesce(max(c), 0) AS b FROM (SELECT g, count(*) AS c FROM lm WHERE n % 6 IN (1, 2) GROUP BY 1))
SELECT count(*) AS n_models, count(*) FILTER (n % 6 IN (1, 2)) AS n_novel_models, round(count(*) FILTER (n % 6 IN (1, 2)) / count(*), 6) AS share_models_novel, round(coalesce(sum(n) FILTER (n % 6 IN (1, 2)), 0) / sum(n), 6) AS share_reads_novel, count(*) FILTER (n % 6 IN (1, 2) AND n % 3 <> 0 AND n % 10 <= 5) AS novel_at_lfdr_0_05, count(*) FILTER (n % 6 IN (1, 2) AND n % 3 <> 0 AND n % 10 <= 1) AS novel_at_lfdr_0_01,
  count(*) FILTER (n % 6 = 3) AS n_ir, count(*) FILTER (n % 6 = 4) AS n_readthrough, 0::BIGINT AS n_end3_annotated, count(*) FILTER (n % 6 = 5) AS n_end3_novel, 0::BIGINT AS n_end5_alt, 0::BIGINT AS n_end5_extended, count(*) FILTER (n % 4 = 0) AS without_associated_tx, count(*) FILTER (n % 3 > 1) AS ambiguous_association, any_value(a) AS genes_with_novel_models, any_value(b) AS max_novel_models_in_one_gene FROM lm, gn""")


def three_prime_report(spark, d):
    out = P.three_prime(labelled(spark, d), max_fallback=200, unresolved="IR")
    return out.select(*(F.round(c, 6).alias(c) if c.startswith("median") else c for c in out.columns))


THREE = V.sql("md", _LABELLED + """, s AS (SELECT *, CASE WHEN n % 5 <> 0 THEN abs(n % 500 - 250) ELSE 0 END AS sh, CASE WHEN n % 2 = 0 THEN n % 10 / 10 ELSE 0 END AS tl FROM lm)
SELECT count(*) FILTER (sh > 0) AS models_moved, round(coalesce(quantile_cont(sh, 0.5) FILTER (sh > 0), 0), 6) AS median_shift, max(sh) AS max_shift, count(*) FILTER (n % 6 = 3) AS unresolved_models, count(*) FILTER (n % 7 = 0) AS fallback_refused, count(*) FILTER (tl >= 0.3) AS models_with_tails, round(quantile_cont(tl, 0.5), 6) AS median_tail_share, max(sh) > 200 AS past_the_bound FROM s""")


def second_pass_counts(spark, d):
    return P.decision_counts(B.replace_single_exons(catalogue(spark, d), transcripts(spark)), catalogue(spark, d).select("model_id", F.col("support").alias("n_reads")))


COUNTS = V.sql("md tx", _SINGLES + " SELECT action, reason, count(*) AS n_models, CAST(sum(p_size) AS BIGINT) AS n_reads FROM de JOIN part ON model_id = 's' || p_partkey GROUP BY 1, 2")


def top_models_of_class(spark, d):
    m = models(spark, d).select("model_id", "n_reads", F.when(F.size("chain") > 3, "long").otherwise("short").alias("class"))
    return P.top_models(m, 10).select("class", "place", "model_id", "n_reads")


TOP = V.sql("md", "w AS (SELECT CASE WHEN len(ks) > 3 THEN 'long' ELSE 'short' END AS class, model_id, n_reads FROM md), r AS (SELECT class, CAST(row_number() OVER (PARTITION BY class ORDER BY n_reads DESC, model_id) AS INT) AS place, model_id, n_reads FROM w) SELECT * FROM r WHERE place <= 10")


def catalogue_against_reads(spark, d):
    """Models held against the reads that they own."""
    r = V.reads(spark, d)
    key = F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain")))
    m = models(spark, d).select("model_id", I.span(F.col("exons")).alias("span"), F.when(F.col("n_reads") % 4 == 0, 1).otherwise(F.size("exons")).alias("n_exons"))
    out = P.step_mismatch(r.select(key.alias("model_id"), (F.col("end") - F.col("start")).alias("span"), (F.col("n") + 1).alias("n_exons")), m)
    return out.withColumn("median_span", F.round("median_span", 6))


AGAINST = V.sql("mx rd", """e AS (SELECT contig || '|' || strand || '|' || chain AS model_id, count(*) AS n_reads, quantile_cont(hi - lo, 0.5) AS ms, min(hi - lo) AS l, max(hi - lo) AS h FROM rd GROUP BY 1)
SELECT model_id, e.n_reads, round(ms, 6) AS median_span, ee[-1] - es[1] AS model_span, ee[-1] - es[1] <= l AS is_min, ee[-1] - es[1] >= h AS is_max, mx.n_reads % 4 = 0 AS mono_mismatch FROM mx JOIN e USING (model_id)""")


def name_safety(spark, d):
    from .evidence_queries import name_diagnosis

    return X.safe_modes(name_diagnosis(spark, d))


def _name_safety() -> str:
    from .evidence_queries import DIAGNOSIS

    return f'WITH h AS ({DIAGNOSIS}) SELECT *, hits > 1.2 * coalesce(max(hits) FILTER (mode = \'none\') OVER (PARTITION BY "column"), max(hits) FILTER (mode <> \'zmw\') OVER (PARTITION BY "column"), 0) AS unsafe FROM h'


def sj_agreement(spark, d):
    """Whether the short-read tables' annotated junctions are the annotation's."""
    known = V.transcript_junctions(spark).select("contig", "strand", "donor", "acceptor")
    return X.agreement(libraries(spark, d), known).withColumn("agreement", F.round("agreement", 6))


AGREEMENT = V.sql("tj", _LIB + """, o AS (SELECT DISTINCT contig, strand, donor, acceptor FROM lb WHERE annotated > 0), k AS (SELECT DISTINCT contig, strand, donor, acceptor FROM tj),
f AS (SELECT a, b, count(*) AS h FROM o, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b) WHERE (contig, strand, donor + a, acceptor + b) IN (SELECT (contig, strand, donor, acceptor) FROM k) GROUP BY 1, 2),
z AS (SELECT arg_max(a, (h, -abs(a) - abs(b), a, b)) AS ba, arg_max(b, (h, -abs(a) - abs(b), a, b)) AS bb, coalesce(sum(h) FILTER (a = 0 AND b = 0), 0) AS n FROM f)
SELECT (SELECT count(*) FROM o) AS n_annotated, CAST(n AS BIGINT) AS n_agreeing, CAST(ba AS INT) AS best_d_offset, CAST(bb AS INT) AS best_a_offset, round(n / greatest((SELECT count(*) FROM o), 1), 6) AS agreement, n >= 0.8 * (SELECT count(*) FROM o) AND (SELECT count(*) FROM o) > 0 AS ok FROM z""")


# --- levels of scoring -------------------------------------------------------------------------------------


def _rounded(df, key, names):
    return df.select(key, *(F.round(F.col(c).cast("double"), 6).alias(c) for c in names), "positive", "decoy", "exempt", F.col("stratum").cast("long").alias("stratum"))


def chain_level(spark, d):
    n = F.col("n_reads")
    m = models(spark, d).withColumns({"n_cells": n % 9, "gene_share": n / 100, "n_introns": F.size("chain"), "dist_ann_tts": F.when(n % 5 != 0, n % 300 - 150), "dist_ann_tss": n % 50, "polya_evidence": n % 2 == 0, "cage_support": F.when(n % 4 == 0, 1.0), "annotated": n % 6 == 0, "n_decoy_junctions": F.when(n % 10 == 0, 1), "n_novel_junctions": n % 4})
    return _rounded(L.chains(m), "model_id", L.CHAIN)


_LOGIT = lambda x: f"round(ln(least(greatest({x}, 1e-4), 1 - 1e-4) / (1 - least(greatest({x}, 1e-4), 1 - 1e-4))), 6)"
CHAIN_LEVEL = V.sql("md", f"""w AS (SELECT *, n_reads AS n FROM md)
SELECT model_id, round(log10(1.0 + n_mols), 6) AS log_support, round(log10(1.0 + n % 9), 6) AS log_cells, round(log10(n / n_mols), 6) AS log_reads_per_mol, {_LOGIT('n / 100')} AS logit_gene_share, round(log10(1.0 + len(ks)), 6) AS log_n_introns, CASE WHEN n % 5 <> 0 THEN round(log10(1.0 + abs(n % 300 - 150)), 6) ELSE 0.0 END AS log_dist_ann_tts, round(log10(1.0 + n % 50), 6) AS log_dist_ann_tss, (n % 2 = 0)::INT::DOUBLE AS polya_evidence, (n % 4 = 0)::INT::DOUBLE AS cage_support,
  n % 6 = 0 AS positive, n % 6 <> 0 AND (n % 10 = 0 OR n_mols <= 2) AS decoy, n % 6 = 0 AS exempt, least(n % 4, 2) AS stratum FROM w""")


def terminal_level(spark, d):
    n = F.col("n_reads")
    v = variants(spark, d).withColumns({"n_cells": n % 9, "dispersion": F.when(n % 7 != 0, (n % 40).cast("double")), "chain_share": n / 20, "ratio_to_dominant": F.when(n % 3 != 0, n / 5), "tail_share": F.when(n % 2 == 0, n % 10 / 10), "tail_len": n % 60, "motif_found": n % 3 == 0, "sr_step": F.when(n % 5 == 0, 0.25), "end_annotated": n % 8 == 0, "at_polya_site": F.when(n % 9 == 0, True), "percent_a": n % 100 * 1.0, "n_peaks": n % 6})
    return _rounded(L.ends(v), "model_id", L.TERMINAL)


TERMINAL_LEVEL = V.sql("rd", _VARIANTS + f""", w AS (SELECT *, contig || '|' || strand || '|' || chain || '|' || bin AS model_id, n_reads AS n FROM v)
SELECT model_id, CASE WHEN n % 7 <> 0 THEN round(log10(1.0 + n % 40), 6) ELSE 0.0 END AS log_dispersion, round(log10(1.0 + n_mols), 6) AS log_support, round(log10(1.0 + n % 9), 6) AS log_cells, {_LOGIT('n / 20')} AS logit_chain_share, CASE WHEN n % 3 <> 0 THEN round(log10(least(greatest(n / 5, 1e-3), 1e3)), 6) ELSE 0.0 END AS log_ratio_to_dominant, CASE WHEN n % 2 = 0 THEN round(n % 10 / 10, 6) ELSE 0.0 END AS tail_share, round(log10(1.0 + n % 60), 6) AS log_tail_len, (n % 3 = 0)::INT::DOUBLE AS motif_found, CASE WHEN n % 5 = 0 THEN 0.25 ELSE 0.0 END AS sr_step,
  n % 8 = 0 OR n % 9 = 0 AS positive, n % 8 <> 0 AND n % 9 <> 0 AND n % 100 >= 40 AS decoy, n % 8 = 0 AS exempt, CASE WHEN n % 6 <= 1 THEN 0 WHEN n % 6 <= 3 THEN 1 ELSE 2 END::BIGINT AS stratum FROM w""")


def junction_level(spark, d):
    from .junction_queries import features

    f = features(spark, d).withColumns({"donor_share": F.col("min_site_share"), "acceptor_share": F.col("n_reads") / 200, "intron_len": F.col("acceptor") - F.col("donor"), "dist_ann_donor": F.when(F.col("n_reads") % 5 != 0, F.col("donor") % 7), "dist_ann_acceptor": F.col("acceptor") % 11, "sr_anchor": F.when(F.col("n_reads") % 9 == 0, True), "sr_supported": F.col("n_reads") % 4 == 0, "n_sites_annotated": F.col("donor") % 3})
    f = f.withColumn("id", F.concat_ws("|", *(F.col(c).cast("string") for c in ("contig", "strand", "donor", "acceptor"))))
    return _rounded(L.junctions(f, rescue=True), "id", L.JUNCTION)


def _junction_level() -> str:
    from .junction_queries import _FEATURES

    return V.sql("rx tj", _FEATURES + f""", w AS (SELECT *, n_reads AS n, motif_class IN ('antisense', 'non_canonical', 'semi_canonical') OR coalesce(rep, 0) >= 10 AS suspect FROM jr)
SELECT contig || '|' || strand || '|' || donor || '|' || acceptor AS id, round(log10(1.0 + CASE WHEN n_mols > 0 THEN n_mols ELSE n END), 6) AS log_support, round(log10(1.0 + n_cells), 6) AS log_cells, round(CASE WHEN n_mols > 0 THEN log10(n / n_mols) ELSE 0 END, 6) AS log_reads_per_mol, {_LOGIT('min_share')} AS logit_donor_share, {_LOGIT('n / 200')} AS logit_acceptor_share, round(log10(1.0 + acceptor - donor), 6) AS log_intron_len, least(coalesce(rep, 0), 20)::DOUBLE AS direct_repeat, (motif_class = 'canonical')::INT::DOUBLE AS is_canonical, (motif_class = 'semi_canonical')::INT::DOUBLE AS is_semi_canonical, CASE WHEN n % 5 <> 0 THEN round(log10(1.0 + donor % 7), 6) ELSE 0.0 END AS log_dist_ann_donor, round(log10(1.0 + acceptor % 11), 6) AS log_dist_ann_acceptor,
  annotated OR n % 9 = 0 AS positive, NOT annotated AND n % 4 <> 0 AND suspect AS decoy, annotated OR n % 4 = 0 AS exempt, donor % 3 AS stratum FROM w""")


QUERIES = {
    "exon_blocks": (exon_blocks, BLOCKS),
    "exon_histogram": (exon_histogram, HISTOGRAM),
    "read_summary": (read_summary, SUMMARY),
    "interval_terms": (interval_terms, TERMS),
    "retained_intron_rank": (retained_intron_rank, RANK),
    "oriented_windows": (oriented_windows, WINDOWS),
    "gtf_attributes": (gtf_attributes, ATTRIBUTES),
    "umi_neighbours": (umi_neighbours, NEIGHBOURS),
    "junction_info": (junction_info, INFO),
    "group_chains": (group_chains, GROUP_CHAINS),
    "dedupe_by_exons": (dedupe_by_exons, DEDUPE),
    "variant_budget": (variant_budget, BUDGET),
    "readthrough": (readthrough, READTHROUGH),
    "nearest_parent": (nearest_parent, PARENT),
    "continuity": (continuity, CONTINUITY),
    "monoexon_rules": (monoexon_rules, MONOEXON),
    "second_pass_singles": (second_pass_singles, SINGLES),
    "inferred_models": (inferred_models, INFERRED),
    "best_spliced_of_gene": (best_spliced_of_gene, BEST),
    "second_pass_ends": (second_pass_ends, ENDS),
    "second_pass_dominance": (second_pass_dominance, DOMINANCE),
    "single_exon_class": (single_exon_class, SINGLE_CLASS),
    "fusion_genes": (fusion_genes, FUSIONS),
    "terminal_classes": (terminal_classes, TERMINAL),
    "novel_burden": (novel_burden, NOVEL),
    "three_prime_report": (three_prime_report, THREE),
    "second_pass_counts": (second_pass_counts, COUNTS),
    "top_models_of_class": (top_models_of_class, TOP),
    "catalogue_against_reads": (catalogue_against_reads, AGAINST),
    "name_safety": (name_safety, _name_safety()),
    "sj_agreement": (sj_agreement, AGREEMENT),
    "chain_level": (chain_level, CHAIN_LEVEL),
    "terminal_level": (terminal_level, TERMINAL_LEVEL),
    "junction_level": (junction_level, _junction_level()),
}
