"""Single-exon models: which clusters of unspliced reads stand, and where the reads of the others go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of categories, outcomes and tiers.
UTR3, INTERNAL, INTERGENIC = "monoexon_3UTR", "monoexon_internal", "monoexon_intergenic"


def judge(
    clusters: DataFrame,
    spliced: DataFrame,
    min_reads: int = 5,
    min_umis: int = 3,
    intergenic_reads: int = 10,
    max_3p_diff: int = 100,
    most_dispersion: float = 12.0,
    min_tail_share: float = 0.3,
    rescue_cells: int = 3,
) -> DataFrame:
    """clusters with category, outcome (kept, or why not), target, rescued and tier.

    clusters(id, gene_id, s, e, three, n_reads, n_mols, n_cells, in_terminal, in_utr3 (shares), dispersion,
    d_site, d_tts (distances, null if there is none), motif_found, internal_priming, polya_supported,
    tail_share, step_supported), spliced(gene_id, model_id, s, e, three, place): the spliced models in the
    order that breaks ties. A 3' UTR cluster is a fragment of a spliced model that it lies in, or that
    short reads show to go on, unless it ends at a known site; and of one that ends where it ends. Its reads
    go to that model (target). The rest needs support, no internal priming, and evidence of a tail.
    """
    c = clusters.withColumns(
        {
            "category": F.when(F.col("gene_id").isNull(), INTERGENIC).when(F.greatest("in_terminal", "in_utr3") >= 0.5, UTR3).otherwise(INTERNAL),
            "_ann": F.col("gene_id").isNotNull() & F.coalesce(F.abs("d_tts") <= max_3p_diff, F.lit(False)),
            "_site": F.coalesce(F.abs("d_site") <= max_3p_diff, F.lit(False)),
            "_tight": F.coalesce("motif_found", F.lit(False)) & F.coalesce(F.col("dispersion") <= most_dispersion, F.lit(False)),
        }
    )
    # a gene's models are one row, in the order that breaks ties: a cluster is never multiplied by them
    m = spliced.where("gene_id IS NOT NULL").groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("place", "model_id", F.col("s").alias("ms"), F.col("e").alias("me"), F.col("three").alias("m3")))).alias("_models"))
    shared = lambda x: F.least(F.col("e"), x["me"]) - F.greatest(F.col("s"), x["ms"])
    near = lambda x: F.abs(x["m3"] - F.col("three"))
    chosen = lambda test, by: F.array_min(F.transform(F.filter("_models", test), lambda x: F.struct(by(x).alias("o"), x["place"].alias("place"), x["model_id"].alias("model_id"))))["model_id"]
    c = c.join(m, "gene_id", "left").withColumn("_models", F.when(F.col("category") == UTR3, F.col("_models")))
    c = c.withColumns(
        {
            "_inside": F.get(F.filter("_models", lambda x: (x["ms"] <= F.col("s")) & (x["me"] >= F.col("e"))), F.lit(0))["model_id"],
            "_over": chosen(lambda x: shared(x) >= 0.5 * (F.col("e") - F.col("s")), lambda x: -shared(x)),
            "_ends": chosen(lambda x: near(x) <= max_3p_diff, near),
        }
    ).drop("_models")
    open_end = (F.col("category") == UTR3) & ~(F.col("_ann") | F.col("_site") | F.col("_tight"))
    contained = open_end & F.col("_inside").isNotNull()
    goes_on = open_end & ~F.coalesce("step_supported", F.lit(True)) & F.col("_over").isNotNull()
    same_end = (F.col("category") == UTR3) & F.col("_ends").isNotNull()
    needs = F.col("category") != UTR3
    rescued = F.coalesce((F.col("tail_share") >= min_tail_share) & (F.col("n_cells") >= rescue_cells), F.lit(False))
    tailed = F.coalesce("polya_supported", F.lit(False))
    least = F.when(F.col("category") == INTERGENIC, intergenic_reads).otherwise(min_reads)
    outcome = (
        F.when(contained, "demoted_fragment")
        .when(goes_on, "sr_continuation")
        .when(same_end, "demoted_fragment")
        .when((F.col("n_reads") < least) | ((F.col("n_mols") > 0) & (F.col("n_mols") < min_umis)), "low_support")
        .when(F.coalesce("internal_priming", F.lit(False)), "internal_priming")
        .when(needs & ~tailed & ~rescued, "no_polya")
        .otherwise("kept")
    )
    target = F.when(contained, F.col("_inside")).when(goes_on, F.col("_over")).when(same_end, F.col("_ends"))
    kept = F.col("outcome") == "kept"
    c = c.withColumns({"outcome": outcome, "target": target})
    c = c.withColumns({"rescued": kept & needs & ~tailed, "tier": F.when(kept, F.when(F.col("_ann"), "annotated").when(F.col("_site"), "high").when(F.col("_tight"), "reported").otherwise("unsupported"))})
    return c.drop("_ann", "_site", "_tight", "_inside", "_over", "_ends")


def polya_rule(atlas_hit, motif_found, percent_a, has_atlas, most_a: float = 60.0):
    """(internal_priming, polya_supported) of a 3' end."""
    from .ends import polya_evidence

    return F.coalesce(percent_a >= most_a, F.lit(False)), polya_evidence(atlas_hit, motif_found, percent_a, has_atlas, most_a=most_a)
