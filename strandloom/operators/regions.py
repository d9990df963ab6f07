"""Ends against annotated transcripts and regions, terminal evidence, and how a run's junctions fared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import flanks, signed_offset
from .evidence import mean_signal


def best_transcript_for_ends(ends: DataFrame, transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """ends(id, keys, five, three) with the key's transcript of the nearest 3' end, then 5' end, rank, length (longest) and id.

    Hot keys are no concern: transcripts of a key are few, and each end takes the minimum over them.
    """
    t = transcripts.select(*keys, "tx_id", "tss", "tts", "rank", "tx_len")
    d3, d5 = F.abs(F.col("three") - F.col("tts")), F.abs(F.col("five") - F.col("tss"))
    best = ends.join(t, keys).groupBy("id").agg(F.min(F.struct(d3.alias("d3"), d5.alias("d5"), "rank", (-F.col("tx_len")).alias("len"), "tx_id")).alias("b"))
    return ends.select("id").join(best, "id", "left").select("id", F.col("b.tx_id").alias("tx_id"), F.col("b.d3").alias("d3"), F.col("b.d5").alias("d5"))


def end_regions(ends: DataFrame, transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """ends(id, keys, strand, three) with in_terminal_exon and in_utr3: whether a transcript of the key has the end in its last exon, or beyond its stop.

    transcripts(keys, strand, exons, stop_pos).
    """
    last = F.when(F.col("strand") == "-", F.element_at("exons", 1)).otherwise(F.element_at("exons", -1))
    far = F.when(F.col("strand") == "-", last["s"]).otherwise(last["e"])
    t = transcripts.select(*keys, last["s"].alias("ts"), last["e"].alias("te"), F.least("stop_pos", far).alias("us"), F.greatest("stop_pos", far).alias("ue"), F.col("stop_pos").isNotNull().alias("coding"))
    at = F.col("three")
    hit = ends.join(t, keys).groupBy("id").agg(F.max((at >= F.col("ts")) & (at <= F.col("te"))).alias("in_terminal_exon"), F.max(F.col("coding") & (at >= F.col("us")) & (at <= F.col("ue"))).alias("in_utr3"))
    return ends.select("id").join(hit, "id", "left").select("id", F.coalesce("in_terminal_exon", F.lit(False)).alias("in_terminal_exon"), F.coalesce("in_utr3", F.lit(False)).alias("in_utr3"))


def classify_start(five: Column, tss: Column, strand: Column, crosses_junction: Column, near: int = 100) -> Column:
    """What a model's 5' end is to its parent's: snapped, ir (it runs back across a junction), extended, or absorbed (downstream)."""
    d = signed_offset(five, tss, strand)
    return F.when(F.abs(d) <= near, "snapped").when((d < 0) & crosses_junction, "ir").when(d < 0, "extended").otherwise("absorbed")


def terminal_evidence(reads: DataFrame, runs: DataFrame, keys: list[str], excess: int = 8) -> DataFrame:
    """Tails beyond what the genome explains. reads(keys, contig, strand, tts, tail_len), runs(contig, strand, tts, a_run): each position's A-run is looked up once."""
    r = reads.join(runs, ["contig", "strand", "tts"], "left").withColumn("x", F.col("tail_len") - F.coalesce("a_run", F.lit(0)))
    return r.groupBy(*keys).agg(F.percentile("x", 0.5).alias("median_tail_excess"), F.avg((F.col("x") >= excess).cast("int")).alias("nontemplated_share"), F.count("*").alias("n_reads"))


def start_ratio(ends: DataFrame, track: DataFrame, window: int = 100, least: float = 3.0, enough: float = 1.5) -> DataFrame:
    """ends(id, contig, strand, pos) with ratio (signal after over before, from one up) and supported; null where too little was measured after."""
    w = ends.withColumn("w", flanks(F.col("pos"), F.col("strand"), window))
    side = lambda k, s, e: w.select(F.concat(F.lit(k), F.col("id").cast("string")).alias("id"), "contig", F.col(s).alias("s"), F.col(e).alias("e"))
    means = mean_signal(side("u", "w.us", "w.ue").unionByName(side("d", "w.ds", "w.de")), track)
    wide = means.groupBy(F.expr("substring(id, 2)").alias("_id")).agg(F.max(F.when(F.col("id").startswith("u"), F.col("mean"))).alias("before"), F.max(F.when(F.col("id").startswith("d"), F.col("mean"))).alias("after"))
    out = ends.withColumn("_id", F.col("id").cast("string")).join(wide, "_id", "left").drop("_id")
    ratio = F.when(F.col("after") >= least, F.col("after") / F.greatest(F.coalesce("before", F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("ratio", ratio).withColumn("supported", F.col("ratio") >= enough)


BANDS = [1, 2, 5, 10, 50, 200]


def by_band(junctions: DataFrame) -> DataFrame:
    """junctions(annotated, keep, n_reads, sr_supported) by class and band of reads: how many, and the share that short reads support."""
    band = F.lit(None).cast("int")
    for low in BANDS:
        band = F.when(F.col("n_reads") >= low, low).otherwise(band)
    return junctions.groupBy("annotated", "keep", band.alias("band")).agg(F.count("*").alias("n"), F.sum("n_reads").alias("n_reads"), F.avg(F.col("sr_supported").cast("int")).alias("supported_share"))


def held_out_recall(junctions: DataFrame, cuts: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """junctions(held_out, sr_supported, lfdr) to a row for each kind: shares at or under each cut; null lfdr is left out."""
    kind = F.when(F.col("sr_supported") & F.col("held_out"), "held_out").when(F.col("sr_supported"), "fitted").otherwise("unsupported")
    return junctions.where("lfdr IS NOT NULL").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), *(F.avg((F.col("lfdr") <= c).cast("int")).alias(f"share_at_{str(c).replace('.', '_')}") for c in cuts))


def group_chains(folded: DataFrame) -> DataFrame:
    """folded(contig, strand, root, chain) to the member chains of each root and their reads."""
    return folded.groupBy("contig", "strand", "root", "chain").agg(F.count("*").alias("n_reads"))


def readthrough_gene(ends: DataFrame, genes: DataFrame, exons: DataFrame) -> DataFrame:
    """ends(id, gene_id, contig, strand, three) with readthrough: another gene of the strand in whose exons an end lies that is past its own gene (ties: the first id).

    genes(gene_id, start, stop), exons(gene_id, contig, strand, rs, re). Ends without a gene run into none.
    """
    from .joins import interval_join

    past = ends.where("gene_id IS NOT NULL").join(genes.select("gene_id", "start", "stop"), "gene_id").where((F.col("three") < F.col("start")) | (F.col("three") >= F.col("stop")))
    points = past.select("id", "contig", "strand", F.col("gene_id").alias("_own"), F.col("three").alias("s"), (F.col("three") + 1).alias("e"))
    hit = interval_join(points, exons.select("gene_id", "contig", "strand", "rs", "re"), ["contig", "strand"], 16_384).where("gene_id <> _own").groupBy("id").agg(F.min("gene_id").alias("readthrough"))
    return ends.join(hit, "id", "left")


def nearest_parent(ends: DataFrame, transcripts: DataFrame) -> DataFrame:
    """ends(id, gene_id, three) with parent: the gene's transcript of the nearest 3' end, then of least rank, then id."""
    t = transcripts.select("gene_id", "tx_id", "tts", "rank")
    best = ends.join(t, "gene_id").groupBy("id").agg(F.min_by("tx_id", F.struct(F.abs(F.col("three") - F.col("tts")), F.col("rank"), F.col("tx_id"))).alias("parent"))
    return ends.join(best, "id", "left")


def end_owners(transcripts: DataFrame, tol: int = 0) -> DataFrame:
    """(gene_id, site, owners): the transcripts of each annotated 3' end of a gene."""
    site = F.col("tts") if not tol else F.floor(F.col("tts") / tol) * tol
    return transcripts.groupBy("gene_id", site.alias("site")).agg(F.array_sort(F.collect_set("tx_id")).alias("owners"))
