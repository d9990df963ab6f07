"""A run: alignments and annotation to a catalogue of models, read assignments and counts, as one chain of DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, dump
from ..functions import intervals as I
from ..operators import chains as C
from ..operators import evidence as X
from ..operators import junctions as N
from ..operators import models as M
from ..operators import molecules as U
from ..operators import regions as R
from ..operators import reports as P
from ..sources import alignments as A
from ..sources import text as T
from . import stages as S
from .lineage import cut


class GateError(RuntimeError):
    """So many alignments were kept out that the input is likely not what it should be."""


def admit(alignments: DataFrame, cfg: Config) -> DataFrame:
    """Admitted primary alignments; the reason of each other one can be counted from N.gate()."""
    g = cfg.gates
    a = A.admitted_columns(alignments, g.min_intron, g.coverage_excludes_3p_clip, g.max_intron).where(~F.col("contig").isin(*cfg.exclude_contigs))
    if cfg.contigs:
        a = a.where(F.col("contig").isin(*cfg.contigs))
    a = a.withColumn("reason", N.gate(a, g.min_coverage, g.min_identity, g.max_5p_clip, g.min_mapq, g.max_3p_clip))
    n = a.agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNotNull()).alias("out")).first()
    if n["n"] >= g.min_reads_for_check and n["out"] > g.max_rejected * n["n"]:
        raise GateError(f"{n['out']} of {n['n']} alignments fail the gates")
    return a.where("reason IS NULL").drop("reason")


def build(reads: DataFrame, transcripts: DataFrame, cfg: Config, evidence: S.Evidence = S.Evidence()) -> dict[str, DataFrame]:
    """reads(read_id, read_name, contig, strand, chain, gaps, tail_len, tss, tts, start, end, cell, umi), transcripts(..) to models, assigned, junctions, merges, audits.

    Reads keep to one table; what is decided on groups reaches them by mappings.
    """
    j, c = cfg.junctions, cfg.chains
    none = F.array().cast("array<struct<donor:bigint,acceptor:bigint>>")
    reads = reads if "gaps" in reads.columns else reads.withColumn("gaps", none)
    reads = reads if "tail_len" in reads.columns else reads.withColumn("tail_len", F.lit(0))
    known = transcripts.select("tx_id", "gene_id", "contig", "strand", F.explode("chain").alias("x")).select("tx_id", "gene_id", "contig", "strand", "x.donor", "x.acceptor")
    reads = cut(S.with_gaps(reads, known, evidence, cfg))
    spliced = reads.where(F.size("chain") > 0)
    records = spliced.select("read_id", "contig", "strand", "cell", "umi", F.explode("chain").alias("x")).select("read_id", "contig", "strand", "cell", "umi", "x.donor", "x.acceptor")
    raw = cut(N.census(records))
    moved = N.apply_snap(records, N.snap_map(raw, known, "donor", j.tolerance), N.snap_map(raw, known, "acceptor", j.tolerance))
    features = S.junction_features(cut(N.census(moved)), known, evidence, cfg)
    curated = cut(N.curate(features, j.min_umis, j.min_reads, j.min_share, j.conditional_libraries, j.conditional_reads, j.repeat_len, j.max_lfdr, j.rescue))
    good = N.read_status(moved, curated).where("ok").select("read_id")
    chain = moved.join(good, "read_id", "left_semi").groupBy("read_id").agg(F.collect_set(F.struct("donor", "acceptor")).alias("js"))
    kept = cut(spliced.drop("chain").join(chain, "read_id").withColumn("chain", I.oriented(F.col("js"), F.col("strand"))).drop("js"))

    exons = transcripts.select("gene_id", "contig", "strand", F.explode("exons").alias("x")).select("gene_id", "contig", "strand", "x.s", "x.e")
    groups = C.positional_genes(C.assign_genes(C.annotate(C.chain_groups(kept, cfg.molecules.hamming > 0), transcripts), known), exons)
    groups = C.mark_candidates(groups, c.min_umis, c.min_reads, c.min_share)
    sites = transcripts.groupBy("contig", "strand").agg(F.collect_set("tss").alias("sites"))
    groups = cut(groups.join(sites, ["contig", "strand"], "left").withColumn("tss_evidence", F.coalesce(F.exists("sites", lambda s: F.abs(s - F.col("five")) <= c.tss_distance), F.lit(False))).drop("sites", "five"))
    resolved = cut(C.resolve_suffixes(groups.where("candidate"), c.debris_ratio, c.dominant_ratio))
    lost = C.rehome(groups, resolved)
    mapping = cut(resolved.select(*C.KEY, "merge_class", "target").unionByName(lost.select(*C.KEY, "merge_class", "target")))
    gone = mapping.where("target IS NULL AND merge_class LIKE 'dropped%'").select(*C.KEY)
    rooted = cut(C.fold(kept.join(gone, C.KEY, "left_anti"), mapping).withColumnRenamed("chain", "own_chain").withColumnRenamed("root", "chain"))
    models, folds = S.end_models(rooted, groups, transcripts, evidence, cfg, _has_umis(reads))

    columns = ["read_id", "read_name", "contig", "strand", "start", "end", "tss", "tts", "cell", "umi", "model_id"]
    folds, rejected = folds.select(*columns), None
    if cfg.monoexon.enabled:
        single, moved_in, rejected = S.single_exons(reads.where(F.size("chain") == 0), models, transcripts, evidence, cfg)
        models = models.unionByName(single, allowMissingColumns=True)
        folds = cut(folds.unionByName(moved_in.select(*columns)))
        models = _recount(models, folds, cfg)
    p = cfg.posthoc
    if p.enabled:
        keys = C.KEY
        near = M.consolidate_ends(models.withColumn("end_annotated", F.coalesce("end_annotated", F.lit(False))).where(F.size("chain") > 0), keys, p.end3_tolerance, p.end5_window).select("model_id", "representative")
        folds = cut(folds.join(near, "model_id", "left").withColumn("model_id", F.coalesce("representative", "model_id")).drop("representative"))
        models = _recount(models, folds, cfg)
        to = M.surviving_targets(cut(M.fragments(models, p.subchain_ratio, p.subchain_fuzzy, p.subchain_slack, p.protected))).select("model_id", "target")
        folds = cut(folds.join(to, "model_id", "left").withColumn("model_id", F.coalesce("target", "model_id")).drop("target"))
        models = _recount(models, folds, cfg)
    audit = None
    if cfg.secondpass.enabled:
        models, to, audit = S.second_pass(models, transcripts, cfg)
        folds = cut(folds.join(to.withColumn("_moved", F.lit(True)), "model_id", "left").withColumn("model_id", F.when(F.col("_moved"), F.col("target")).otherwise(F.col("model_id"))).drop("target", "_moved").where("model_id IS NOT NULL"))
        models = _recount(models, folds, cfg)
    models = M.assign_ids(models, ["contig", "start", "model_id"])
    assigned = cut(reads.select("read_id", "read_name", "start", "end", "cell", "umi").join(folds.select("read_id", "model_id"), "read_id", "left").join(models.select("model_id", "model_name"), "model_id", "left"))
    members = R.group_chains(rooted.select("contig", "strand", F.col("chain").alias("root"), F.col("own_chain").alias("chain")))
    out = {"models": cut(M.abundance(models)), "assigned": assigned, "junctions": curated, "merges": mapping, "group_chains": members}
    return out | ({"single_exons_rejected": rejected} if rejected is not None else {}) | ({"second_pass": audit} if audit is not None else {})


def _has_umis(reads: DataFrame) -> bool:
    return bool(reads.where("umi IS NOT NULL").limit(1).count())


def _recount(models: DataFrame, folds: DataFrame, cfg: Config) -> DataFrame:
    """models that still have reads, with their counts from the reads they now hold."""
    n = U.support_counts(folds, ["model_id"], merge=cfg.molecules.hamming > 0)
    return cut(models.drop("n_reads", "n_mols", "n_cells", "support").join(n, "model_id").withColumn("support", I.support(F.col("n_mols"), F.col("n_reads"))))


def run(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    """Read the inputs, build, and write GTF, tables and the matrix under cfg.out."""
    cfg.check()
    read = A.read_bam if cfg.alignments.endswith(".bam") else A.read_sam
    alignments = admit(read(spark, cfg.alignments), cfg)
    reads = alignments.withColumn("read_id", F.xxhash64("read_name", "contig", "pos", "cigar"))
    if cfg.umis:
        reads = U.attach(reads, T.read_umis(spark, cfg.umis), cfg.molecules.normalise)
    else:
        reads = reads.withColumns({"cell": F.lit(None).cast("string"), "umi": F.lit(None).cast("string")})
    reads = reads.select("read_id", "read_name", "contig", "strand", "chain", "gaps", "tail_len", "tss", "tts", "start", "end", "cell", "umi")
    reads = cut(reads)
    if cfg.umis:
        P.check_names(reads)
    transcripts = cut(T.annotation(T.read_gtf(spark, cfg.annotation, list(cfg.contigs) or None)))
    evidence = S.Evidence(
        cut(T.read_fasta(spark, cfg.genome)) if cfg.genome else None,
        T.read_star(spark, list(cfg.junction_tables)) if cfg.junction_tables else None,
        cut(T.read_polya_bed(spark, cfg.polya_sites)) if cfg.polya_sites else None,
        cut(T.read_bedgraph(spark, list(cfg.coverage_tracks))) if cfg.coverage_tracks else None,
    )
    if evidence.short_reads is not None:
        known = transcripts.select("contig", "strand", F.explode("chain").alias("x")).select("contig", "strand", "x.donor", "x.acceptor")
        a = X.agreement(evidence.short_reads, known).first()
        if cfg.strict and a.n_annotated and not a.ok:
            raise RuntimeError(f"only {a.agreement:.1%} of the short-read tables' annotated junctions are in the annotation; most match at offsets ({a.best_d_offset}, {a.best_a_offset})")
    out = build(reads, transcripts, cfg, evidence)
    write(spark, out, reads, cfg)
    return out


def write(spark: SparkSession, out: dict[str, DataFrame], reads: DataFrame, cfg: Config) -> None:
    """GTF, tables, matrix, audits and reports under cfg.out; in a strict run an invariant that doesn't hold is an error after they are written."""
    models, assigned = out["models"], out["assigned"]
    repr_ = lambda df: df.select(*(I.chain_repr(F.col(c)).alias(c) if c in ("chain", "target", "root") and dict(df.dtypes)[c].startswith("array") else c for c in df.columns))
    T.write_gtf(models, f"{cfg.out}/models.gtf")
    T.write_table(models.select("model_name", "gene_id", "contig", "strand", I.chain_repr(F.col("chain")).alias("chain"), "five", "three", "category", "tier", "tx_len", "n_reads", "n_mols", "n_cells", "read_share", "mol_share", "dispersion", "tail_share", "at_polya_site", "internal_priming", M.terminal_class(F.col("category"), F.col("end_annotated"), F.col("at_polya_site"), F.col("internal_priming")).alias("terminal_class"), M.fsm_subcategory(F.col("category")).alias("subcategory")), f"{cfg.out}/models.tsv")
    T.write_table(T.read_stat(assigned), f"{cfg.out}/read_stat.tsv")
    T.write_table(T.group_members(assigned).select("model_name", "names"), f"{cfg.out}/group.tsv")
    T.write_table(out["junctions"].select(*N.KEY, "n_reads", "n_mols", "n_cells", "annotated", "motif_class", "min_site_share", "sr_supported", "lfdr", "keep", "drop_reason"), f"{cfg.out}/junctions.tsv")
    for name in ("merges", "group_chains", "single_exons_rejected", "second_pass"):
        if name in out:
            T.write_table(repr_(out[name]), f"{cfg.out}/{name}.tsv")
    if cfg.umis:
        counts = U.collapse_umis(assigned.where("model_name IS NOT NULL").withColumnRenamed("model_name", "m"), ["m"]).groupBy(F.col("m").alias("model_id"), "cell").agg(F.count("*").alias("n"))
        T.write_matrix(U.matrix(counts), f"{cfg.out}/matrix")
    checks = invariants(out, reads).first().asDict()
    facts = {"reads": P.read_summary(reads).first().asDict(), "invariants": checks, "novelty": P.novel_burden(models.withColumns({"lfdr": F.lit(None).cast("double"), "associated_tx": F.when(F.col("end_annotated"), F.col("model_id")), "n_equally_close": F.lit(1)})).first().asDict(), "three_prime": P.three_prime(models.withColumn("refused", F.lit(False)), cfg.ends.max_fallback, cfg.ends.min_tail_share).first().asDict()}
    if "second_pass" in out:
        facts["second_pass"] = [r.asDict() for r in out["second_pass"].groupBy("stage", "action", "reason").agg(F.count("*").alias("n_models")).orderBy("stage", "action", "reason").collect()]
    broken = sorted(k for k, v in checks.items() if k.startswith("ok_") and v is False)
    lines = ["# Catalogue", ""] + [f"- {group}.{k}: {v}" for group, values in facts.items() if isinstance(values, dict) for k, v in values.items()] + ["", "All invariants hold." if not broken else "Broken: " + ", ".join(broken)]
    for name, text in (("qc.json", json.dumps(facts, indent=2, default=str)), ("qc.md", "\n".join(lines)), ("config.json", dump(cfg))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{cfg.out}/{name}")
    if broken and cfg.strict:
        raise RuntimeError("invariants that don't hold: " + ", ".join(broken))


def invariants(out: dict[str, DataFrame], reads: DataFrame) -> DataFrame:
    m = out["models"].select("model_id", F.size("chain").alias("model_introns"), I.span(F.col("exons")).alias("model_span"))
    a = out["assigned"].where("model_id IS NOT NULL").select("read_id", "model_id").join(m, "model_id")
    return X.invariants(reads.select("read_id", F.size("chain").alias("n_introns"), (F.col("end") - F.col("start")).alias("span")), a)
