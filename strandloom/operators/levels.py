"""Design columns, anchors and strata of the three levels that scoring.score is fitted on: junctions, chains, 3' ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The features of each level.
JUNCTION = ["log_support", "log_cells", "log_reads_per_mol", "logit_donor_share", "logit_acceptor_share", "log_intron_len", "direct_repeat", "is_canonical", "is_semi_canonical", "log_dist_ann_donor", "log_dist_ann_acceptor"]
CHAIN = ["log_support", "log_cells", "log_reads_per_mol", "logit_gene_share", "log_n_introns", "log_dist_ann_tts", "log_dist_ann_tss", "polya_evidence", "cage_support"]
TERMINAL = ["log_dispersion", "log_support", "log_cells", "logit_chain_share", "log_ratio_to_dominant", "tail_share", "log_tail_len", "motif_found", "sr_step"]


def _log(x: Column | str) -> Column:
    return F.coalesce(F.log10(1.0 + (F.col(x) if isinstance(x, str) else x)), F.lit(0.0))


def _logit(x: str) -> Column:
    p = F.least(F.greatest(F.col(x).cast("double"), F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.coalesce(F.log(p / (1 - p)), F.lit(0.0))


def _flag(x: str) -> Column:
    return F.coalesce(F.col(x).cast("boolean"), F.lit(False))


def _support() -> dict[str, Column]:
    mols, reads = F.coalesce("n_mols", F.lit(0)), F.col("n_reads")
    return {"log_support": _log(F.when(mols > 0, mols).otherwise(reads)), "log_cells": _log("n_cells"), "log_reads_per_mol": F.when(mols > 0, F.log10(reads / mols)).otherwise(0.0)}


def junctions(f: DataFrame, rescue: bool = False) -> DataFrame:
    """f with JUNCTION columns, positive, decoy, exempt and stratum.

    f(n_reads, n_mols, n_cells, donor_share, acceptor_share, intron_len, direct_repeat, motif_class,
    dist_ann_donor, dist_ann_acceptor, annotated, sr_anchor, sr_supported, n_sites_annotated). Decoys are
    novel, unsupported by short reads and of a motif or repeat that artefacts have.
    """
    suspect = F.col("motif_class").isin("antisense", "non_canonical", "semi_canonical") | (F.coalesce("direct_repeat", F.lit(0)) >= 10)
    return f.withColumns(
        _support()
        | {
            "logit_donor_share": _logit("donor_share"),
            "logit_acceptor_share": _logit("acceptor_share"),
            "log_intron_len": _log("intron_len"),
            "positive": _flag("annotated") | _flag("sr_anchor"),
            "decoy": ~_flag("annotated") & ~_flag("sr_supported") & suspect,
            "exempt": _flag("annotated") | (_flag("sr_supported") & F.lit(rescue)),
            "stratum": F.col("n_sites_annotated").cast("int"),
            "direct_repeat": F.least(F.coalesce("direct_repeat", F.lit(0)).cast("double"), F.lit(20.0)),
            "is_canonical": (F.col("motif_class") == "canonical").cast("double"),
            "is_semi_canonical": (F.col("motif_class") == "semi_canonical").cast("double"),
            "log_dist_ann_donor": _log("dist_ann_donor"),
            "log_dist_ann_acceptor": _log("dist_ann_acceptor"),
        }
    )


def chains(f: DataFrame, decoy_support: int = 2) -> DataFrame:
    """f with CHAIN columns, positive, decoy, exempt and stratum (0, 1, more novel junctions).

    f(n_reads, n_mols, n_cells, gene_share, n_introns, dist_ann_tts, dist_ann_tss, polya_evidence,
    cage_support, annotated, n_decoy_junctions, n_novel_junctions).
    """
    mols = F.coalesce("n_mols", F.lit(0))
    support = F.when(mols > 0, mols).otherwise(F.col("n_reads"))
    number = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    return f.withColumns(
        _support()
        | {
            "logit_gene_share": _logit("gene_share"),
            "log_n_introns": _log("n_introns"),
            "log_dist_ann_tts": _log(F.abs("dist_ann_tts")),
            "log_dist_ann_tss": _log(F.abs("dist_ann_tss")),
            "positive": _flag("annotated"),
            "decoy": ~_flag("annotated") & ((F.coalesce("n_decoy_junctions", F.lit(0)) > 0) | (support <= decoy_support)),
            "exempt": _flag("annotated"),
            "stratum": F.least("n_novel_junctions", F.lit(2)).cast("int"),
            "polya_evidence": number("polya_evidence"),
            "cage_support": number("cage_support"),
        }
    )


def ends(f: DataFrame, decoy_percent_a: float = 40.0) -> DataFrame:
    """f with TERMINAL columns, positive, decoy, exempt and stratum (1, 2 to 3, more peaks of the chain).

    f(n_reads, n_mols, n_cells, dispersion, chain_share, ratio_to_dominant, tail_share, tail_len, motif_found,
    sr_step, end_annotated, at_polya_site, percent_a, n_peaks). What tells the anchors is no feature.
    """
    clip = lambda x, lo, hi: F.least(F.greatest(F.coalesce(F.col(x).cast("double"), F.lit(1.0)), F.lit(lo)), F.lit(hi))
    known = _flag("end_annotated") | _flag("at_polya_site")
    peaks = F.coalesce("n_peaks", F.lit(1))
    number = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    return f.withColumns(
        _support()
        | {
            "log_dispersion": _log(F.abs("dispersion")),
            "logit_chain_share": _logit("chain_share"),
            "log_ratio_to_dominant": F.log10(clip("ratio_to_dominant", 1e-3, 1e3)),
            "positive": known,
            "decoy": ~known & (F.coalesce("percent_a", F.lit(0.0)) >= decoy_percent_a),
            "exempt": _flag("end_annotated"),
            "stratum": F.when(peaks <= 1, 0).when(peaks <= 3, 1).otherwise(2),
            "tail_share": number("tail_share"),
            "log_tail_len": _log("tail_len"),
            "motif_found": number("motif_found"),
            "sr_step": number("sr_step"),
        }
    )


def report(scored: DataFrame, key: str = "contig") -> DataFrame:
    """(key, stratum, n_positive, n_decoy, fitted, pi0) of scoring.score's result."""
    return scored.groupBy(key, "stratum").agg(F.count_if("positive").alias("n_positive"), F.count_if("decoy").alias("n_decoy"), F.count_if(F.col("score").isNotNull()).alias("n_scored"), F.max("pi0").alias("pi0")).withColumn("fitted", F.col("n_scored") > 0)
