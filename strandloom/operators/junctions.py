"""Splice junctions: census, promotion of deletions, snapping, shares, curation and what reads keep."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import oriented
from .joins import nearest_within, runs_by_gap

KEY = ["contig", "strand", "donor", "acceptor"]


def census(records: DataFrame) -> DataFrame:
    """records(contig, strand, donor, acceptor, cell, umi) to reads, exact distinct molecules and cells of each junction; unknown ones aren't counted."""
    known = F.col("cell").isNotNull() & F.col("umi").isNotNull()
    return records.groupBy(*KEY).agg(
        F.count("*").alias("n_reads"),
        F.count_distinct(F.when(known, F.struct("cell", "umi"))).alias("n_mols"),
        F.count_distinct("cell").alias("n_cells"),
    )


def site_shares(junctions: DataFrame, n: str = "n_reads") -> DataFrame:
    """junctions with donor_share, acceptor_share and min_site_share."""
    at = lambda site: F.col(n) / F.sum(n).over(Window.partitionBy("contig", "strand", site))
    out = junctions.withColumns({"donor_share": at("donor"), "acceptor_share": at("acceptor")})
    return out.withColumn("min_site_share", F.least("donor_share", "acceptor_share"))


def promote_gaps(gaps: DataFrame, annotated: DataFrame, min_reads: int = 3, max_len: int = 5000) -> DataFrame:
    """(contig, strand, donor, acceptor) of deletions that are junctions: annotated, or frequent with a canonical motif.

    gaps(read_id, contig, strand, donor, acceptor, motif_class).
    """
    counted = gaps.where(F.col("acceptor") - F.col("donor") <= max_len).groupBy(*KEY).agg(F.count("*").alias("n"), F.max((F.col("motif_class") == "canonical").cast("int")).alias("canonical"))
    known = annotated.select(*KEY).distinct().withColumn("annotated", F.lit(True))
    return counted.join(known, KEY, "left").where("annotated OR (n >= %d AND canonical = 1)" % min_reads).select(*KEY, "n")


def add_promoted(chains: DataFrame, gaps: DataFrame, promoted: DataFrame) -> DataFrame:
    """chains(read_id, contig, strand, chain) with their promoted gaps sorted in."""
    extra = gaps.join(promoted.select(*KEY), KEY, "left_semi").groupBy("read_id").agg(F.collect_set(F.struct("donor", "acceptor")).alias("x"))
    both = F.array_union("chain", F.coalesce("x", F.array().cast("array<struct<donor:bigint,acceptor:bigint>>")))
    return chains.join(extra, "read_id", "left").withColumn("chain", oriented(both, F.col("strand"))).drop("x")


def unexplained(gaps: DataFrame, junctions: DataFrame) -> DataFrame:
    """Reads with a gap that is no junction of the data, on either strand."""
    return gaps.join(junctions.select("contig", "donor", "acceptor").distinct(), ["contig", "donor", "acceptor"], "left_anti").select("read_id").distinct()


def seed_sites(support: list[tuple[int, int]], tol: int) -> dict[int, int]:
    """Sites (position, reads) to seeds: by falling reads, each takes a seed within tol, its left neighbour first, or becomes one."""
    seeds: list[int] = []
    out = {}
    for pos, _ in sorted(support, key=lambda x: (-x[1], x[0])):
        i = bisect.bisect_left(seeds, pos)
        near = [seeds[j] for j in (i - 1, i) if 0 <= j < len(seeds) and abs(seeds[j] - pos) <= tol]
        out[pos] = near[0] if near else pos
        if not near:
            seeds.insert(i, pos)
    return out


def snap_map(junctions: DataFrame, annotated: DataFrame, site: str, tol: int = 5) -> DataFrame:
    """(contig, strand, pos, to) for donors or acceptors: annotated sites first, then the data's own seeds.

    The seeds' order matters, so a stretch of sites is one Python group; sites more than tol from any
    other begin a new one, and such stretches are short, whatever the contig's length.
    """
    counted = junctions.groupBy("contig", "strand", F.col(site).alias("pos")).agg(F.sum("n_reads").alias("n"))
    known = nearest_within(counted, annotated.select("contig", "strand", F.col(site).alias("site")), ["contig", "strand"], tol)
    rest = runs_by_gap(known.where("site IS NULL"), ["contig", "strand"], "pos", tol)

    def seed(pdf: pd.DataFrame) -> pd.DataFrame:
        to = seed_sites(list(zip(pdf["pos"], pdf["n"], strict=True)), tol)
        return pdf[["contig", "strand", "pos"]].assign(to=pdf["pos"].map(to))

    seeded = rest.groupBy("contig", "strand", "_run").applyInPandas(seed, rest.select("contig", "strand", "pos").schema.add("to", "long"))
    return known.where("site IS NOT NULL").select("contig", "strand", "pos", F.col("site").alias("to")).unionByName(seeded)


def apply_snap(records: DataFrame, donors: DataFrame, acceptors: DataFrame) -> DataFrame:
    out = records
    for site, to in (("donor", donors), ("acceptor", acceptors)):
        out = out.join(to.select("contig", "strand", F.col("pos").alias(site), "to"), ["contig", "strand", site], "left").withColumn(site, F.coalesce("to", site)).drop("to")
    return out


def curate(
    features: DataFrame,
    min_umis: int = 3,
    min_reads: int = 5,
    min_share: float = 0.001,
    min_libraries: int = 2,
    conditional_reads: int = 50,
    repeat_len: int = 8,
    max_lfdr: float = 0.05,
    rescue: bool = False,
) -> DataFrame:
    """features with drop_reason (null: kept) and keep; the first reason holds. Annotated junctions are always kept.

    A null lfdr, repeat or library count is no opinion and never rejects.
    """
    use = features.agg((F.coalesce(F.max("n_mols"), F.lit(0)) > 0).alias("use_mols"))
    allowed = F.col("motif_class").isin("canonical", "unknown") | ((F.col("motif_class") == "semi_canonical") & ((F.coalesce("sr_n_libs", F.lit(0)) >= min_libraries) | (F.col("n_reads") >= conditional_reads)))
    # The reasons' names.
    reason = (
        F.when(F.col("annotated"), F.lit(None))
        .when(F.col("use_mols") & (F.col("n_mols") < min_umis), "low_molecules")
        .when(F.col("n_reads") < min_reads, "low_reads")
        .when(F.col("min_site_share") < min_share, "minor_at_both_sites")
        .when(~allowed, "motif_class_not_allowed_for_novel")
        .when(F.coalesce("direct_repeat", F.lit(0)) >= repeat_len, "rt_switch_repeat")
        .when(F.coalesce("lfdr", F.lit(0.0)) > max_lfdr, "lfdr")
    )
    out = features.join(F.broadcast(use)).withColumn("drop_reason", reason).drop("use_mols").withColumn("keep", F.col("drop_reason").isNull())
    if rescue:
        saved = ~F.col("keep") & F.coalesce("sr_supported", F.lit(False))
        out = out.withColumn("drop_reason", F.when(saved, "rescued_by_short_reads").otherwise(F.col("drop_reason"))).withColumn("keep", F.col("keep") | saved)
    return out


def read_status(records: DataFrame, curated: DataFrame) -> DataFrame:
    """(read_id, n_junctions, ok): whether all of a read's junctions are kept."""
    bad = curated.where(~F.col("keep")).select(*KEY).withColumn("bad", F.lit(1))
    return records.join(bad, KEY, "left").groupBy("read_id").agg(F.count("*").alias("n_junctions"), F.max("bad").isNull().alias("ok"))


def gate(alignments: DataFrame, min_coverage: float = 0.9, min_identity: float = 0.95, max_5p_clip: int = 200, min_mapq: int = 0, max_3p_clip: int | None = None) -> Column:
    """The first reason that keeps an alignment out, as a Column over (secondary, supplementary, mapq, coverage, identity, clip5, clip3); null if admitted."""
    # The reasons' names.
    return (
        F.when(F.col("secondary"), "secondary")
        .when(F.col("supplementary"), "supplementary")
        .when(F.col("mapq") < min_mapq, "mapq")
        .when(F.col("coverage") < min_coverage, "coverage")
        .when(F.col("identity") < min_identity, "identity")
        .when(F.col("clip5") > max_5p_clip, "clip5")
        .when(F.lit(max_3p_clip is not None) & (F.col("clip3") > (max_3p_clip or 0)), "clip3")
    )
