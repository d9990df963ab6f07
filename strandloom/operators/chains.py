"""Groups of reads with equal intron chains: support, candidates, suffix resolution, re-homing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import proper_suffixes, support
from .molecules import support_counts

KEY = ["contig", "strand", "chain"]


def chain_groups(reads: DataFrame, merge: bool = True) -> DataFrame:
    """reads(contig, strand, chain, cell, umi, read_id, and tss if there) to one row for each exact chain; mono-exonic reads stay out.

    Arrays of structs are legal keys, so reads meet in one aggregate with partial sums before the shuffle.
    n_mols counts molecules after directional merging of UMIs, as everywhere; five is the farthest 5' end.
    """
    extra = [F.min("read_id").alias("first_read")]
    if "tss" in reads.columns:
        extra += [F.min("tss").alias("_lo"), F.max("tss").alias("_hi")]
    out = support_counts(reads.where(F.size("chain") > 0), KEY, *extra, merge=merge)
    if "tss" in reads.columns:
        out = out.withColumn("five", F.when(F.col("strand") == "-", F.col("_hi")).otherwise(F.col("_lo"))).drop("_lo", "_hi")
    return out


def annotate(groups: DataFrame, transcripts: DataFrame) -> DataFrame:
    """groups with tx_ids, tx_gene and annotated, by the exact chain."""
    known = transcripts.groupBy(*KEY).agg(F.sort_array(F.collect_list("tx_id")).alias("tx_ids"), F.min("gene_id").alias("tx_gene"))
    return groups.join(known, KEY, "left").withColumns({"annotated": F.col("tx_ids").isNotNull(), "support": support(F.col("n_mols"), F.col("n_reads"))})


def assign_genes(groups: DataFrame, transcript_junctions: DataFrame) -> DataFrame:
    """groups with gene_id: that of the exact chain, else the gene that shares most junctions (ties: the first id)."""
    genes = transcript_junctions.select("contig", "strand", "donor", "acceptor", F.col("gene_id").alias("g")).distinct()
    exploded = groups.select(*KEY, F.explode("chain").alias("j")).select(*KEY, "j.donor", "j.acceptor")
    votes = exploded.join(genes, ["contig", "strand", "donor", "acceptor"]).groupBy(*KEY, "g").agg(F.count("*").alias("v"))
    best = votes.groupBy(*KEY).agg(F.min_by("g", F.struct(-F.col("v"), F.col("g"))).alias("near_gene"))
    return groups.join(best, KEY, "left").withColumn("gene_id", F.coalesce("tx_gene", "near_gene")).drop("near_gene")


def mark_candidates(groups: DataFrame, min_umis: int = 3, min_reads: int = 5, min_share: float = 0.01, max_lfdr: float | None = None) -> DataFrame:
    """groups with share (of its gene's support) and candidate; annotated chains always are.

    max_lfdr: novel chains of a higher lfdr are none; null is no opinion.
    """
    share = F.col("support") / F.sum("support").over(Window.partitionBy("gene_id"))
    share = F.when(F.col("gene_id").isNotNull(), share)
    enough = (F.lit(True) if max_lfdr is None else F.coalesce(F.col("lfdr") <= max_lfdr, F.lit(True))) & (F.col("n_reads") >= min_reads) & (F.coalesce(F.col("share"), F.lit(1.0)) >= min_share)
    use = groups.agg((F.coalesce(F.max("n_mols"), F.lit(0)) > 0).alias("use_mols"))  # one row: a count of a counted table
    out = groups.withColumn("share", share).join(F.broadcast(use))
    return out.withColumn("candidate", F.col("annotated") | (enough & (~F.col("use_mols") | (F.col("n_mols") >= min_umis)))).drop("use_mols")


def suffix_pairs(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(contig, strand, chain, parent): each parent chain of which a child's chain is a proper suffix.

    All proper suffixes of each parent are listed, which makes it an equi-join on the chain.
    """
    tails = parents.select("contig", "strand", F.col("chain").alias("parent"), F.explode(proper_suffixes(F.col("chain"))).alias("chain"))
    return children.select(*KEY).join(tails, KEY)


def maximal_parents(candidates: DataFrame) -> DataFrame:
    """(contig, strand, chain, parent): parents among the candidates that are no suffix of a further parent."""
    pairs = suffix_pairs(candidates, candidates)
    inner = pairs.select("contig", "strand", F.col("chain").alias("parent")).distinct()
    # a parent's own parent is a parent of the child too, so being a suffix of anything rules it out
    return pairs.join(inner, ["contig", "strand", "parent"], "left_anti").select(*KEY, "parent")


def _with_parents(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each child: its parents' number, best support and shares, and the best and only annotated ones."""
    facts = groups.select("contig", "strand", F.col("chain").alias("parent"), F.greatest("support", F.lit(1)).alias("ps"), F.col("annotated").alias("pa"), F.col("first_read").alias("pf"))
    top = F.struct(-F.col("ps"), F.col("pf"))
    return pairs.join(facts, ["contig", "strand", "parent"]).groupBy(*KEY).agg(
        F.count("*").alias("n_parents"),
        F.max("ps").alias("top_support"),
        (F.max("ps") / F.sum("ps")).alias("top_share"),
        (F.sum("ps") * F.sum("ps") / F.sum(F.col("ps") * F.col("ps"))).alias("eff_n_parents"),
        F.min_by("parent", top).alias("top_parent"),
        F.min(F.when(F.col("pa"), F.struct((-F.col("ps")).alias("s"), F.col("pf").alias("f"), F.col("parent").alias("p")))).alias("ann"),
        F.count_if("pa").alias("n_annotated_parents"),
    )


def resolve_suffixes(groups: DataFrame, debris: float = 0.33, dominant: float = 3.0) -> DataFrame:
    """(contig, strand, chain, merge_class, target, ..) for each candidate that is a suffix of others.

    groups: candidates with support, annotated, first_read and tss_evidence (boolean). Targets are
    maximal parents, which are a suffix of nothing, so merges end there: no components are needed.
    """
    facts = _with_parents(maximal_parents(groups), groups).join(groups.select(*KEY, "support", "annotated", "tss_evidence", "n_reads"), KEY)
    ratio = F.col("support") / F.col("top_support")
    ann = F.col("n_annotated_parents")
    # The classes' names.
    kind = (
        F.when(F.col("annotated"), "annotated_kept")
        .when((ann > 0) & F.col("tss_evidence"), "alt_tss_kept")
        .when(ann == 1, "truncation_of_annotated_parent")
        .when(ann > 1, "truncation_of_annotated_parents_ambiguous")
        .when(ratio >= dominant, "dominant_kept")
        .when((ratio <= debris) & ((F.col("n_parents") == 1) | (F.col("top_share") >= 0.9)), "debris")
        .otherwise("ambiguous")
    )
    facts = facts.withColumns({"ratio": ratio, "merge_class": kind})
    target = F.when(F.col("merge_class").startswith("truncation"), F.col("ann.p")).when(F.col("merge_class") == "debris", F.col("top_parent"))
    return facts.withColumn("target", target).drop("ann", "top_parent")


def rehome(groups: DataFrame, resolved: DataFrame) -> DataFrame:
    """(contig, strand, chain, merge_class, target) for each group that is no candidate.

    It joins a surviving candidate that it is a suffix of, if one is alone, holds 90 % of their support
    or is the only annotated one; else its reads are left unassigned.
    """
    merged = resolved.where(F.col("target").isNotNull()).select(*KEY)
    surviving = groups.where("candidate").join(merged, KEY, "left_anti")
    lost = groups.where(~F.col("candidate"))
    facts = _with_parents(suffix_pairs(lost, surviving), surviving)
    out = lost.select(*KEY, "n_reads").join(facts, KEY, "left")
    sole = (F.col("n_parents") == 1) | (F.col("top_share") >= 0.9)
    kind = (
        F.when(F.col("n_parents").isNull(), "dropped_no_parent")
        .when(sole, "subthreshold_merge")
        .when(F.col("n_annotated_parents") == 1, "subthreshold_annotated_parent")
        .otherwise("dropped_ambiguous")
    )
    out = out.withColumn("merge_class", kind)
    return out.withColumn("target", F.when(F.col("merge_class") == "subthreshold_merge", F.col("top_parent")).when(F.col("merge_class") == "subthreshold_annotated_parent", F.col("ann.p"))).drop("ann", "top_parent")


def fold(read_chain: DataFrame, mapping: DataFrame) -> DataFrame:
    """read_chain(read_id, contig, strand, chain) with root: its chain's target where it has one. Reads are never lost."""
    return read_chain.join(mapping.where(F.col("target").isNotNull()).select(*KEY, "target"), KEY, "left").withColumn("root", F.coalesce("target", "chain")).drop("target")


def positional_genes(groups: DataFrame, exons: DataFrame) -> DataFrame:
    """groups whose gene_id is null with the gene of whose exons their chain's span covers most (ties: the first id).

    exons(gene_id, contig, strand, s, e).
    """
    from .joins import interval_join, interval_union

    lost = groups.where("gene_id IS NULL").select(*KEY, F.array_min(F.transform("chain", lambda j: j["donor"])).alias("s"), F.array_max(F.transform("chain", lambda j: j["acceptor"])).alias("e"))
    islands = interval_union(exons, ["gene_id", "contig", "strand"]).select(F.col("gene_id").alias("g"), "contig", "strand", F.col("s").alias("rs"), F.col("e").alias("re"))
    # a base to either side: the exons that the outer junctions border
    hit = interval_join(lost, islands, ["contig", "strand"], 65_536, 1).groupBy(*KEY, "g").agg(F.sum(F.least("e", "re") - F.greatest("s", "rs")).alias("bp"))
    best = hit.groupBy(*KEY).agg(F.min_by("g", F.struct(-F.col("bp"), F.col("g"))).alias("near_gene"))
    return groups.join(best, KEY, "left").withColumn("gene_id", F.coalesce("gene_id", "near_gene")).drop("near_gene")


def junction_info(groups: DataFrame, curated: DataFrame) -> DataFrame:
    """groups(contig, strand, chain, ..) with n_novel_junctions, n_decoy_junctions, min_posterior and share_annotated.

    curated(contig, strand, donor, acceptor, annotated, posterior, decoy). A junction that isn't there is
    novel with posterior 0; a novel one without a posterior has 1.
    """
    facts = curated.select("contig", "strand", "donor", "acceptor", F.col("annotated").alias("_a"), F.col("posterior").alias("_p"), F.col("decoy").alias("_d"))
    j = groups.select(*KEY, F.explode("chain").alias("j")).select(*KEY, "j.donor", "j.acceptor").join(facts, ["contig", "strand", "donor", "acceptor"], "left")
    known = F.coalesce("_a", F.lit(False))
    info = j.groupBy(*KEY).agg(
        F.count_if(~known).alias("n_novel_junctions"),
        F.count_if(~known & F.coalesce("_d", F.lit(False))).alias("n_decoy_junctions"),
        F.min(F.when(known, 1.0).when(F.col("_a").isNull(), 0.0).otherwise(F.coalesce("_p", F.lit(1.0)))).alias("min_posterior"),
        (F.count_if(known) / F.count("*")).alias("share_annotated"),
    )
    return groups.join(info, KEY, "left")
