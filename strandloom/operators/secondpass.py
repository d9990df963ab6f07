"""The second pass over a catalogue: single-exon models of genes that have none, and novel 3' ends without evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REMOVED_CLASSES = ("C", "D", "E")


def best_spliced(models: DataFrame) -> DataFrame:
    """(gene_id, best): the best-supported spliced model of each gene, the first in place on ties."""
    m = models.where((F.col("n_exons") > 1) & F.col("gene_id").isNotNull())
    return m.groupBy("gene_id").agg(F.min_by("model_id", F.struct(-F.col("support"), F.col("place"))).alias("best"))


def canonical(transcripts: DataFrame) -> DataFrame:
    """(gene_id, canonical): each gene's transcript of least rank, then greatest length, then id."""
    return transcripts.groupBy("gene_id").agg(F.min_by("tx_id", F.struct(F.col("rank"), -F.col("tx_len"), F.col("tx_id"))).alias("canonical"))


def replace_single_exons(models: DataFrame, transcripts: DataFrame, remove: tuple[str, ...] = REMOVED_CLASSES, keep_intergenic: bool = True, from_data: bool = True) -> DataFrame:
    """(model_id, gene_id, class, action, reason, source, target) of each model with a class: what is done with it and why.

    models(model_id, gene_id, n_exons, support, place, class: null for spliced ones), transcripts(gene_id,
    tx_id, rank, tx_len). Classes that are removed give their reads to their gene's best spliced model of
    the catalogue as it was, else to a model inferred from the gene's canonical transcript; without one
    they are removed. A join by gene on each side; reads follow by the mapping to target.
    """
    m = models.where(F.col("class").isNotNull()).select("model_id", "gene_id", "class").join(best_spliced(models), "gene_id", "left").join(canonical(transcripts), "gene_id", "left")
    best = F.col("best") if from_data else F.lit(None).cast("string")
    judged = F.col("class").isin(*remove)
    action = F.when(F.col("class") == "X", F.lit("kept" if keep_intergenic else "removed")).when(~judged, "kept").when(best.isNotNull() | F.col("canonical").isNotNull(), "replaced").otherwise("removed")
    # The reasons' names.
    reason = F.when(F.col("class") == "X", F.lit("intergenic_out_of_scope" if keep_intergenic else "intergenic_policy=remove")).when(~judged, "gene_admits_monoexonic_isoforms").when(best.isNotNull(), "infer_from=data").when(F.col("canonical").isNotNull(), "infer_from=reference").otherwise("no_reference_transcript")
    source = F.when(F.col("action") == "replaced", F.when(best.isNotNull(), "data").otherwise("reference"))
    out = m.withColumns({"action": action, "reason": reason}).withColumn("source", source)
    target = F.when(F.col("source") == "data", best).when(F.col("source") == "reference", F.concat(F.lit("INFERRED|"), F.col("gene_id"), F.lit("|"), F.col("canonical")))
    return out.select("model_id", "gene_id", "class", "action", "reason", "source", target.alias("target"))


def inferred_models(decisions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One model of category INFERRED for each target that is a reference transcript, with the number of models that it absorbed; transcripts(gene_id, tx_id, ..)."""
    wanted = decisions.where("source = 'reference'").groupBy("target").agg(F.count("*").alias("n_absorbed"))
    named = transcripts.withColumn("target", F.concat(F.lit("INFERRED|"), F.col("gene_id"), F.lit("|"), F.col("tx_id")))
    return named.join(wanted, "target").withColumnRenamed("target", "model_id").withColumn("category", F.lit("INFERRED"))


def dominance(models: DataFrame, ratio: float = 1.0) -> DataFrame:
    """models(model_id, gene_id, support) with sole and dominant within their gene; a model without a gene is neither.

    Dominant: of the best support, which is above 0 and at least ratio times the next one's (a tie is one's own next).
    """
    ranked = F.sort_array(F.collect_list("support"), False)
    top = models.where("gene_id IS NOT NULL").groupBy("gene_id", "support").agg(F.count("*").alias("n"))
    # two supports at most decide, so a gene's models needn't meet
    by = top.groupBy("gene_id").agg(F.sum("n").alias("_n"), F.max(F.struct("support", "n")).alias("_t"), F.slice(ranked, 2, 1).alias("_next"))
    runner = F.when(F.col("_t.n") > 1, F.col("_t.support")).otherwise(F.get("_next", F.lit(0)))
    by = by.select("gene_id", "_n", F.col("_t.support").alias("_top"), F.coalesce(runner, F.lit(0)).alias("_runner"))
    out = models.join(by, "gene_id", "left")
    best = (F.col("support") == F.col("_top")) & (F.col("_top") > 0) & ((F.col("_runner") == 0) | (F.col("_top") >= ratio * F.col("_runner")))
    return out.withColumns({"sole": F.coalesce(F.col("_n") == 1, F.lit(False)), "dominant": F.coalesce(best, F.lit(False))}).drop("_n", "_top", "_runner")


def filter_ends(models: DataFrame, tier: Column, judged: tuple[str, ...] = ("end3_novel",)) -> DataFrame:
    """(model_id, action, tier, target) of each model: those of a judged category without a tier are removed.

    models(model_id, gene_id, contig, strand, chain, support, place, category, ..), tier: an expression over
    them, such as models.end3_tier(). A removed model's reads go to the best-supported survivor of its
    chain, else of its gene (ties: the first in place), else they are unassigned (null).
    """
    m = models.withColumn("_tier", F.when(F.col("category").isin(*judged), F.coalesce(tier, F.lit("none"))))
    gone = F.coalesce(F.col("_tier") == "none", F.lit(False))
    kept, dropped = m.where(~gone), m.where(gone)
    best = F.min_by("model_id", F.struct(-F.col("support"), F.col("place")))
    chain = kept.groupBy("contig", "strand", "chain").agg(best.alias("_chain"))
    gene = kept.where("gene_id IS NOT NULL").groupBy("gene_id").agg(best.alias("_gene"))
    moved = dropped.join(chain, ["contig", "strand", "chain"], "left").join(gene, "gene_id", "left").select("model_id", F.lit("removed").alias("action"), F.col("_tier").alias("tier"), F.coalesce("_chain", "_gene").alias("target"))
    return kept.select("model_id", F.lit("kept").alias("action"), F.col("_tier").alias("tier"), F.lit(None).cast("string").alias("target")).unionByName(moved)
