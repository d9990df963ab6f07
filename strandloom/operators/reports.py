"""Reports over a catalogue, and checks that a run makes before it trusts its inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Categories that count as novel, and those that are counted beside them.
NOVEL, BESIDE = ("NIC", "NNC"), ("IR", "READTHROUGH", "end3_annotated", "end3_novel", "end5_alt", "end5_extended")


def read_summary(reads: DataFrame) -> DataFrame:
    """One row: reads, unspliced ones, spliced ones and junctions in all. reads(chain)."""
    n = F.size("chain")
    return reads.agg(F.count("*").alias("reads"), F.count_if(n == 0).alias("mono_exonic_reads"), F.count_if(n > 0).alias("spliced_reads"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("junction_records"))


def novel_burden(models: DataFrame) -> DataFrame:
    """One row: how much novelty was called. models(category, gene_id, n_reads, lfdr, associated_tx, n_equally_close)."""
    novel = F.col("category").isin(*NOVEL)
    genes = models.where(novel).groupBy(F.coalesce("gene_id", F.lit("?")).alias("g")).agg(F.count("*").alias("n")).agg(F.count("*").alias("genes_with_novel_models"), F.coalesce(F.max("n"), F.lit(0)).alias("max_novel_models_in_one_gene"))
    at = lambda cut: F.count_if(novel & (F.col("lfdr") <= cut))
    total = models.agg(
        F.count("*").alias("n_models"),
        F.count_if(novel).alias("n_novel_models"),
        (F.count_if(novel) / F.count("*")).alias("share_models_novel"),
        (F.sum(F.when(novel, F.col("n_reads")).otherwise(0)) / F.greatest(F.sum("n_reads"), F.lit(1))).alias("share_reads_novel"),
        at(0.05).alias("novel_at_lfdr_0_05"),
        at(0.01).alias("novel_at_lfdr_0_01"),
        *(F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in BESIDE),
        F.count_if(F.col("associated_tx").isNull()).alias("without_associated_tx"),
        F.count_if(F.col("n_equally_close") > 1).alias("ambiguous_association"),
    )
    return total.join(F.broadcast(genes))  # a row each


def three_prime(models: DataFrame, max_fallback: int = 300, min_tail_share: float = 0.3, unresolved: str = "end3_unresolved") -> DataFrame:
    """One row: how far annotation moved 3' ends off their reads, and how many have tails. models(category, shift, refused, tail_share)."""
    shift = F.abs(F.coalesce("shift", F.lit(0)))
    out = models.agg(
        F.count_if(shift > 0).alias("models_moved"),
        F.coalesce(F.percentile(F.when(shift > 0, shift), 0.5), F.lit(0.0)).alias("median_shift"),
        F.coalesce(F.max(shift), F.lit(0)).alias("max_shift"),
        F.count_if(F.col("category") == unresolved).alias("unresolved_models"),
        F.count_if(F.coalesce("refused", F.lit(False))).alias("fallback_refused"),
        F.count_if(F.coalesce("tail_share", F.lit(0.0)) >= min_tail_share).alias("models_with_tails"),
        F.percentile(F.coalesce("tail_share", F.lit(0.0)), 0.5).alias("median_tail_share"),
    )
    return out.withColumn("past_the_bound", F.col("max_shift") > max_fallback)


def decision_counts(decisions: DataFrame, models: DataFrame) -> DataFrame:
    """(action, reason, n_models, n_reads) of a second pass. decisions(model_id, action, reason), models(model_id, n_reads)."""
    return decisions.join(models.select("model_id", "n_reads"), "model_id").groupBy("action", "reason").agg(F.count("*").alias("n_models"), F.sum("n_reads").alias("n_reads"))


def top_models(counts: DataFrame, n: int = 25) -> DataFrame:
    """counts(model_id, class, n_reads): the n models of most reads in each class, by id on ties."""
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n_reads"), "model_id"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def sample_reads(assigned: DataFrame, models: DataFrame, most: int = 300) -> DataFrame:
    """At most `most` reads of each of the models(model_id), by a hash of the name, so that it is no head of a file."""
    mine = assigned.join(models.select("model_id").distinct(), "model_id", "left_semi")
    return mine.withColumn("_p", F.row_number().over(Window.partitionBy("model_id").orderBy(F.xxhash64("read_name"), "read_name"))).where(F.col("_p") <= most).drop("_p")


def step_mismatch(spans: DataFrame, model_spans: DataFrame) -> DataFrame:
    """(model_id, n_reads, median_span, model_span, is_min, is_max, mono_mismatch): a catalogue held against its reads.

    spans(model_id, span, n_exons), model_spans(model_id, span, n_exons). mono_mismatch: a single-exon model of mostly spliced reads.
    """
    r = spans.groupBy("model_id").agg(F.count("*").alias("n_reads"), F.percentile("span", 0.5).alias("median_span"), F.min("span").alias("lo"), F.max("span").alias("hi"), F.percentile("n_exons", 0.5).alias("median_exons"))
    m = model_spans.select("model_id", F.col("span").alias("model_span"), F.col("n_exons").alias("model_exons"))
    out = m.join(r, "model_id")
    return out.select("model_id", "n_reads", "median_span", "model_span", (F.col("model_span") <= F.col("lo")).alias("is_min"), (F.col("model_span") >= F.col("hi")).alias("is_max"), ((F.col("model_exons") == 1) & (F.col("median_exons") > 1)).alias("mono_mismatch"))


class NameMismatch(RuntimeError):
    """Reads and the UMI table name molecules differently."""


def check_names(reads: DataFrame, least: float = 0.5, probe: int = 2000) -> float:
    """The share of the first `probe` reads that have a molecule; NameMismatch under `least`. reads(read_name, cell)."""
    r = reads.limit(probe).agg(F.count("*").alias("n"), F.count("cell").alias("hit"), F.min("read_name").alias("example")).first()
    share = r["hit"] / r["n"] if r["n"] else 1.0
    if share < least:
        raise NameMismatch(f"only {share:.1%} of read names are in the UMI table, such as {r['example']}; see molecules.normalise")
    return share
