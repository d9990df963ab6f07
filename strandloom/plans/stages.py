"""The stages of a run, each from tables to tables: junction features, 3' ends, single exons, the second pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import intervals as I
from ..functions import sequence as S
from ..operators import chains as C
from ..operators import ends as E
from ..operators import evidence as X
from ..operators import joins as J
from ..operators import junctions as N
from ..operators import levels as L
from ..operators import models as M
from ..operators import molecules as U
from ..operators import regions as R
from ..operators import scoring as Z
from ..operators import secondpass as B
from ..operators import singles as O
from ..sources.text import fetch
from .lineage import cut


@dataclass(frozen=True)
class Evidence:
    """What a run may know besides reads and annotation; None where it wasn't given."""

    genome: DataFrame | None = None  # (contig, chunk, seq)
    short_reads: DataFrame | None = None  # rows of junction tables
    polya_sites: DataFrame | None = None  # (contig, strand, site)
    track: DataFrame | None = None  # (contig, start, end, value)


def _bases(rows: DataFrame, genome: DataFrame, window, name: str) -> DataFrame:
    """rows(id, contig, ..) with the bases of a window: struct(s, e)."""
    at = rows.select("id", "contig", window["s"].alias("s"), window["e"].alias("e"))
    return rows.join(fetch(at, genome).select("id", F.col("seq").alias(name)), "id", "left")


def with_motifs(junctions: DataFrame, genome: DataFrame | None) -> DataFrame:
    """junctions(N.KEY, ..) with motif_class and direct_repeat; unknown without a genome."""
    if genome is None:
        return junctions.withColumns({"motif_class": F.lit("unknown"), "direct_repeat": F.lit(None).cast("int")})
    rows = junctions.withColumn("id", F.concat_ws("|", *(F.col(c).cast("string") for c in N.KEY)))
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    d, a = F.col("donor"), F.col("acceptor")
    rows = _bases(_bases(rows, genome, span(d, d + 2), "_first"), genome, span(a - 2, a), "_last")
    rows = _bases(_bases(rows, genome, span(d - 20, d), "_before"), genome, span(a - 20, a), "_inside")
    minus = F.col("strand") == "-"
    first = F.when(minus, S.revcomp(F.col("_last"))).otherwise(F.col("_first"))
    last = F.when(minus, S.revcomp(F.col("_first"))).otherwise(F.col("_last"))
    known = (F.length("_first") == 2) & (F.length("_last") == 2)
    motif = F.when(known, S.motif_class(S.splice_motif(first, last, a - d))).otherwise("unknown")
    return rows.withColumns({"motif_class": motif, "direct_repeat": S.direct_repeat_len(F.col("_before"), F.col("_inside"))}).drop("id", "_first", "_last", "_before", "_inside")


def with_gaps(spliced: DataFrame, known: DataFrame, evidence: Evidence, cfg: Config) -> DataFrame:
    """Reads whose deletions that are junctions have been sorted into their chains. spliced(.., gaps)."""
    g = spliced.select("read_id", "contig", "strand", F.explode("gaps").alias("x")).select("read_id", "contig", "strand", "x.donor", "x.acceptor")
    distinct = with_motifs(g.select(*N.KEY).distinct(), evidence.genome).select(*N.KEY, "motif_class")
    promoted = cut(N.promote_gaps(g.join(distinct, N.KEY), known, cfg.junctions.min_gap_reads, cfg.junctions.max_gap_len))
    return N.add_promoted(spliced.drop("gaps"), g, promoted)


def junction_features(census: DataFrame, known: DataFrame, evidence: Evidence, cfg: Config) -> DataFrame:
    """census with shares, motif, repeat, short-read support and lfdr: what N.curate decides on."""
    j = cfg.junctions
    sites = known.select(*N.KEY).distinct()
    f = N.site_shares(census).join(sites.withColumn("annotated", F.lit(True)), N.KEY, "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))
    f = with_motifs(f, evidence.genome)
    if evidence.short_reads is None:
        f = f.withColumns({"sr_n_libs": F.lit(None).cast("long"), "sr_supported": F.lit(False)})
    else:
        f = X.junction_support(f, X.sum_libraries(evidence.short_reads), j.min_sr_reads, j.min_sr_overhang, j.min_sr_libraries)
    if not cfg.scoring.enabled:
        return f.withColumn("lfdr", F.lit(None).cast("double"))
    for site in ("donor", "acceptor"):
        near = J.nearest_any(f.select("contig", "strand", F.col(site).alias("pos")).distinct(), sites.select("contig", "strand", F.col(site).alias("site")), ["contig", "strand"])
        f = f.join(near.select("contig", "strand", F.col("pos").alias(site), F.abs(F.col("pos") - F.col("site")).alias(f"dist_ann_{site}")), ["contig", "strand", site], "left")
    f = f.withColumns({"intron_len": F.col("acceptor") - F.col("donor"), "n_sites_annotated": sum(F.coalesce((F.col(f"dist_ann_{s}") == 0).cast("int"), F.lit(0)) for s in ("donor", "acceptor")), "id": F.concat_ws(":", "strand", F.col("donor").cast("string"), F.col("acceptor").cast("string"))})
    f = f.withColumn("sr_anchor", F.col("sr_supported") & ~X.held_out(j.holdout_share))
    scored = Z.score(L.junctions(f, j.rescue).select("contig", "id", *L.JUNCTION, "positive", "decoy", "exempt", "stratum"), L.JUNCTION, "contig", cfg.scoring.min_anchors, cfg.scoring.l2, cfg.scoring.bins, cfg.scoring.smooth)
    return f.join(scored.select("contig", "id", "lfdr"), ["contig", "id"], "left").drop("id")


def end_evidence(ends: DataFrame, evidence: Evidence, cfg: Config) -> DataFrame:
    """ends(id, contig, strand, three) with at_polya_site, d_site, motif_found, percent_a, contrast, internal_priming, polya, step_supported."""
    at = cut(ends.select("id", "contig", "strand", F.col("three").alias("pos")))
    out = at
    if evidence.polya_sites is not None:
        near = J.nearest_any(at, evidence.polya_sites, ["contig", "strand"]).select("id", (F.col("pos") - F.col("site")).alias("d_site"))
        out = out.join(near, "id", "left")
    else:
        out = out.withColumn("d_site", F.lit(None).cast("long"))
    if evidence.genome is not None:
        s = F.col("strand")
        up, down = S.oriented_window(F.col("pos"), s, -40, 0), S.oriented_window(F.col("pos"), s, 0, 20)
        out = _bases(_bases(_bases(out, evidence.genome, up, "_up"), evidence.genome, down, "_down"), evidence.genome, S.oriented_window(F.col("pos"), s, 5, 30), "_dse")
        out = out.withColumns({"motif_found": S.polya_motif(S.oriented_sequence(F.col("_up"), s)).isNotNull(), "percent_a": S.percent_of(S.oriented_sequence(F.col("_down"), s), "A"), "contrast": S.contrast(S.oriented_sequence(F.col("_dse"), s))}).drop("_up", "_down", "_dse")
    else:
        out = out.withColumns({"motif_found": F.lit(None).cast("boolean"), "percent_a": F.lit(None).cast("double"), "contrast": F.lit(None).cast("double")})
    if evidence.track is not None:
        step = X.three_prime_step(at, evidence.track, cfg.coverage.window, cfg.coverage.max_downstream_ratio, cfg.coverage.min_coverage)
        out = out.join(step.select("id", F.col("supported").alias("step_supported")), "id", "left")
    else:
        out = out.withColumn("step_supported", F.lit(None).cast("boolean"))
    site = F.coalesce(F.abs("d_site") <= cfg.ends.peak_window, F.lit(False))
    blind = evidence.genome is None and evidence.polya_sites is None  # nothing to judge by
    polya = F.lit(True) if blind else E.polya_evidence(site, F.col("motif_found"), F.col("percent_a"), F.lit(evidence.polya_sites is not None), most_a=cfg.monoexon.max_percent_a)
    out = out.withColumns({"at_polya_site": site, "polya": polya, "internal_priming": F.coalesce(F.col("percent_a") >= cfg.monoexon.max_percent_a, F.lit(False))})
    return ends.join(out.drop("contig", "strand", "pos"), "id", "left")


# Categories from the strongest claim on a 3' coordinate to the weakest.
END_ORDER = ["FSM", "end3_annotated", "end3_novel", "READTHROUGH", "NIC", "NNC", "end5_novel", "end3_unresolved"]


def end_models(rooted: DataFrame, groups: DataFrame, transcripts: DataFrame, evidence: Evidence, cfg: Config, umis: bool) -> tuple[DataFrame, DataFrame]:
    """Reads of each chain to (models, folds(read_id, model_id)): peaks, their categories, the budget, absorption, 5' ends."""
    e, t = cfg.ends, cfg.terminal
    key = [*C.KEY, "three"]
    peaks = E.cluster_ends(E.histogram(rooted, C.KEY), C.KEY, e.peak_window).select(*C.KEY, F.col("pos").alias("tts"), "peak")
    ended = rooted.join(peaks, [*C.KEY, "tts"])
    gate = E.peak_gate(U.support_counts(ended, [*C.KEY, "peak"], merge=cfg.molecules.hamming > 0), C.KEY, transcripts.select(*C.KEY, F.col("tts").alias("end")), e.min_reads, e.min_umis if umis else 0, e.peak_window)
    ended = cut(ended.join(gate.select(*C.KEY, "peak", "to"), [*C.KEY, "peak"]).drop("peak").withColumnRenamed("to", "three"))

    shape = U.support_counts(ended, key, merge=cfg.molecules.hamming > 0).join(E.tail_evidence(U.molecule_weights(ended, key), key, e.min_tail_len), key)
    shape = shape.join(groups.select(*C.KEY, "gene_id"), C.KEY).withColumn("id", F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain")), F.col("three").cast("string")))
    own = transcripts.groupBy(*C.KEY).agg(F.sort_array(F.collect_set("tts")).alias("chain_ends"))
    gene = transcripts.groupBy("gene_id").agg(F.sort_array(F.collect_set("tts")).alias("gene_ends"), F.min(F.least("tss", "tts")).alias("start"), F.max(F.greatest("tss", "tts")).alias("stop"))
    shape = end_evidence(shape.join(own, C.KEY, "left").join(gene.select("gene_id", "gene_ends"), "gene_id", "left"), evidence, cfg)
    exons = transcripts.select("gene_id", "contig", "strand", F.explode("exons").alias("x")).select("gene_id", "contig", "strand", F.col("x.s").alias("rs"), F.col("x.e").alias("re")).distinct()
    past = R.readthrough_gene(shape.select("id", "gene_id", "contig", "strand", "three"), gene.select("gene_id", "start", "stop"), exons).select("id", F.col("readthrough").isNotNull().alias("readthrough"))
    shape = E.relative_terms(shape.join(past, "id"), C.KEY).withColumns({"peak": F.col("three"), "share": F.col("group_share"), "polya": F.col("polya") | (F.col("tail_share") >= e.min_tail_share)})
    named = cut(E.end3_category(shape, e.peak_window, e.min_share, e.max_fallback).withColumnRenamed("end", "site"))
    junctions = transcripts.select("contig", "strand", F.explode("chain").alias("x")).select("contig", "strand", "x.donor", "x.acceptor")
    chains = named.where("category = 'NOVEL'").select(*C.KEY).distinct().withColumns({"model_id": I.chain_repr(F.col("chain")), "exons": I.build_exons(F.col("chain"), F.col("strand"), F.lit(None).cast("long"), F.lit(None).cast("long"))})
    chains = chains.withColumn("model_id", F.concat_ws("|", F.col("contig").cast("string"), "strand", "model_id"))
    kinds = M.structural_class(chains, transcripts, junctions, cfg.posthoc.subchain_fuzzy).select("model_id", F.when(F.col("category") == "ISM", "end5_novel").when(F.col("category") == "FSM", "NIC").otherwise(F.col("category")).alias("kind"))
    named = named.withColumn("model_id", F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain")))).join(kinds, "model_id", "left")
    named = named.withColumn("category", F.when(F.col("category") == "NOVEL", F.coalesce("kind", F.lit("NNC"))).otherwise(F.col("category"))).drop("model_id", "kind")

    # peaks that come to one coordinate are one model, of the strongest category among them
    order = F.array_position(F.array(*map(F.lit, END_ORDER)), F.col("category"))
    merged = named.groupBy(*C.KEY, "site").agg(F.min(F.struct(order.alias("o"), "category")).alias("c"), F.first("gene_id").alias("gene_id"), *(F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("at_polya_site", "step_supported", "motif_found")), F.min("internal_priming").alias("internal_priming"), F.max("contrast").alias("contrast"), F.max("tail_share").alias("tail_share"), F.max(F.abs(F.col("site") - F.col("three"))).alias("shift"))
    merged = merged.withColumns({"category": F.col("c.category"), "three": F.col("site"), "model_id": F.concat_ws("|", F.col("contig").cast("string"), "strand", I.chain_repr(F.col("chain")), F.col("site").cast("string"))}).drop("c", "site")
    folds = cut(ended.withColumnRenamed("three", "peak").join(named.select(*C.KEY, "peak", "site"), [*C.KEY, "peak"]).withColumnRenamed("site", "three").drop("peak"))
    counted = U.support_counts(folds, key, merge=cfg.molecules.hamming > 0).join(folds.groupBy(*key).agg(F.stddev_pop("tts").alias("dispersion")), key)
    models = cut(merged.join(counted, key).withColumn("mass", I.support(F.col("n_mols"), F.col("n_reads"))))

    shown = E.within_budget(models, C.KEY, e.max_variants, emit_unresolved=e.emit_unresolved).select("model_id").withColumn("_shown", F.lit(True))
    models = models.join(shown, "model_id", "left").withColumn("end_annotated", F.col("category").isin("FSM", "end3_annotated"))
    pruned = E.prune_terminal(models.where("_shown"), C.KEY, t.max_dispersion, t.max_distance, t.sibling_ratio, t.min_candidate_share).select("model_id", "absorbed_into", "tier")
    # reads of what isn't emitted go to the chain's best-supported model that is, else to none
    best = models.where("_shown").join(pruned.where("absorbed_into IS NULL").select("model_id"), "model_id", "left_semi").groupBy(*C.KEY).agg(F.min_by("model_id", F.struct(-F.col("mass"), "model_id")).alias("_best"))
    models = cut(models.join(pruned, "model_id", "left").join(best, C.KEY, "left"))
    to = models.select(*key, F.when(F.col("_shown").isNull(), F.col("_best")).otherwise(F.coalesce("absorbed_into", "model_id")).alias("to"))
    folds = cut(folds.join(to, key).withColumnRenamed("to", "model_id").where("model_id IS NOT NULL"))
    kept = models.where("_shown AND absorbed_into IS NULL").drop("n_reads", "n_mols", "n_cells", "mass", "dispersion", "_shown", "absorbed_into", "_best")
    again = U.support_counts(folds, ["model_id"], merge=cfg.molecules.hamming > 0).join(folds.groupBy("model_id").agg(F.stddev_pop("tts").alias("dispersion")), "model_id")
    ends5 = E.five_prime(folds.drop("three").join(kept.select("model_id", "three"), "model_id"), ["model_id", "strand"], e.percentile).select("model_id", "five")
    models = start_ends(kept.join(again, "model_id").join(ends5, "model_id"), transcripts, cfg)
    return cut(finished(models)), folds


def start_ends(models: DataFrame, transcripts: DataFrame, cfg: Config) -> DataFrame:
    """models(.., five) of annotated chains with the 5' end and category that their transcripts give them: near or downstream ends take the parent's; others extend it, or retain an intron."""
    starts = transcripts.groupBy(*C.KEY).agg(F.collect_set(F.struct("tss")).alias("_starts"))
    introns = transcripts.groupBy("gene_id").agg(F.array_distinct(F.flatten(F.collect_list("chain"))).alias("_introns"))
    m = models.join(starts, C.KEY, "left").join(introns, "gene_id", "left")
    near = F.array_min(F.transform("_starts", lambda s: F.struct(F.abs(s["tss"] - F.col("five")).alias("d"), s["tss"].alias("tss"))))["tss"]
    m = m.withColumn("_tss", near)
    crosses = F.size(I.retained_introns(I.build_exons(F.col("chain"), F.col("strand"), F.col("five"), F.col("three")), F.coalesce("_introns", F.array().cast("array<struct<donor:bigint,acceptor:bigint>>")))) > 0
    kind = F.when(F.col("_tss").isNotNull(), R.classify_start(F.col("five"), F.col("_tss"), F.col("strand"), crosses, cfg.ends.max_5p_diff))
    m = m.withColumn("_start", kind)
    m = m.withColumn("five", F.when(F.col("_start").isin("snapped", "absorbed"), F.col("_tss")).otherwise(F.col("five")))
    whole = F.col("category") == "FSM"
    return m.withColumn("category", F.when(whole & (F.col("_start") == "ir"), "IR").when(whole & (F.col("_start") == "extended"), "end5_extended").otherwise(F.col("category"))).drop("_starts", "_introns", "_tss", "_start")


def finished(models: DataFrame) -> DataFrame:
    """models with exons, support, length and start by their chain, ends and counts."""
    m = models.withColumn("exons", I.build_exons(F.col("chain"), F.col("strand"), F.col("five"), F.col("three")))
    return m.withColumns({"support": I.support(F.col("n_mols"), F.col("n_reads")), "tx_len": I.exonic_length(F.col("exons")), "start": F.element_at("exons", 1)["s"]})


def genes_of_spans(spans: DataFrame, exons: DataFrame) -> DataFrame:
    """spans(id, contig, strand, s, e) with gene_id: the gene of whose exons a span covers most (ties: the first id)."""
    islands = J.interval_union(exons, ["gene_id", "contig", "strand"]).select("gene_id", "contig", "strand", F.col("s").alias("rs"), F.col("e").alias("re"))
    hit = J.interval_join(spans.select("id", "contig", "strand", "s", "e"), islands, ["contig", "strand"], 65_536).groupBy("id", "gene_id").agg(F.sum(F.least("e", "re") - F.greatest("s", "rs")).alias("bp"))
    best = hit.groupBy("id").agg(F.min_by("gene_id", F.struct(-F.col("bp"), F.col("gene_id"))).alias("gene_id"))
    return spans.join(best, "id", "left")


def gene_structure(transcripts: DataFrame) -> DataFrame:
    """(gene_id, n_mono, n_multi, exons, islands, introns): what M.monoexon_class asks of a gene."""
    n = transcripts.groupBy("gene_id").agg(F.count_if(F.size("chain") == 0).alias("n_mono"), F.count_if(F.size("chain") > 0).alias("n_multi"), F.array_distinct(F.flatten(F.collect_list("exons"))).alias("exons"))
    x = transcripts.select("gene_id", "contig", "strand", F.explode("exons").alias("x")).select("gene_id", "contig", "strand", "x.s", "x.e")
    u = J.interval_union(x, ["gene_id", "contig", "strand"]).withColumn("next", F.lead("s").over(Window.partitionBy("gene_id").orderBy("s")))
    u = u.groupBy("gene_id").agg(F.collect_list(F.struct("s", "e")).alias("islands"), F.collect_list(F.when(F.col("next").isNotNull(), F.struct(F.col("e").alias("s"), F.col("next").alias("e")))).alias("introns"))
    return n.join(u, "gene_id")


def single_exons(reads: DataFrame, models: DataFrame, transcripts: DataFrame, evidence: Evidence, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unspliced reads to (models, folds(read_id, model_id), rejected): clusters that stand, and where the reads of fragments go."""
    m = cfg.monoexon
    merge = cfg.molecules.hamming > 0
    clustered = M.cluster_single_exons(reads.drop("chain"), m.peak_window, m.min_overlap).withColumn("id", F.concat_ws("|", F.lit("mono"), F.col("contig").cast("string"), "strand", F.col("peak").cast("string"), F.col("part").cast("string")))
    clustered = cut(clustered)
    key = ["id", "contig", "strand"]
    c = U.support_counts(clustered, key, merge=merge).join(clustered.groupBy(*key).agg(F.percentile("tts", 0.5).cast("long").alias("three"), F.stddev_pop("tts").alias("dispersion")), key)
    c = c.join(E.tail_evidence(U.molecule_weights(clustered, key), key, cfg.ends.min_tail_len), key)
    five = E.five_prime(clustered.join(c.select("id", "three"), "id"), key, cfg.ends.percentile).select("id", "five")
    c = c.join(five, "id").withColumns({"s": F.least("five", "three"), "e": F.greatest("five", "three")}).where("e > s")
    exons = transcripts.select("gene_id", "contig", "strand", F.explode("exons").alias("x")).select("gene_id", "contig", "strand", "x.s", "x.e")
    c = cut(end_evidence(genes_of_spans(c, exons), evidence, cfg))
    last = F.when(F.col("strand") == "-", F.element_at("exons", 1)).otherwise(F.element_at("exons", -1))
    far = F.when(F.col("strand") == "-", last["s"]).otherwise(last["e"])
    t = transcripts.select("gene_id", "tts", last["s"].alias("ls"), last["e"].alias("le"), F.least("stop_pos", far).alias("us"), F.greatest("stop_pos", far).alias("ue"))
    size = F.col("e") - F.col("s")
    share = lambda a, b: F.coalesce(F.max(I.overlap(F.col("s"), F.col("e"), F.col(a), F.col(b)) / size), F.lit(0.0))
    regions = c.select("id", "gene_id", "s", "e", "three").join(t, "gene_id").groupBy("id").agg(share("ls", "le").alias("in_terminal"), share("us", "ue").alias("in_utr3"), F.min(F.abs(F.col("three") - F.col("tts"))).alias("d_tts"))
    c = c.join(regions, "id", "left").withColumns({"in_terminal": F.coalesce("in_terminal", F.lit(0.0)), "in_utr3": F.coalesce("in_utr3", F.lit(0.0)), "polya_supported": F.col("polya")})
    spliced = models.select("gene_id", "model_id", F.element_at("exons", 1)["s"].alias("s"), F.element_at("exons", -1)["e"].alias("e"), "three", F.struct(-F.col("support"), "model_id").alias("place"))
    judged = cut(O.judge(c, spliced, m.min_reads, m.min_umis, m.intergenic_reads, cfg.ends.max_5p_diff, cfg.terminal.max_dispersion, cfg.ends.min_tail_share))
    chain = F.array().cast("array<struct<donor:bigint,acceptor:bigint>>")
    new = finished(judged.where("outcome = 'kept'").withColumn("chain", chain)).withColumnRenamed("id", "model_id")
    to = judged.select("id", F.when(F.col("outcome") == "kept", F.col("id")).otherwise(F.col("target")).alias("model_id")).where("model_id IS NOT NULL")
    rejected = judged.where("outcome <> 'kept'").select("id", "contig", "strand", "s", "e", "category", "gene_id", "n_reads", "n_mols", "n_cells", "percent_a", "internal_priming", "motif_found", "tail_share", "outcome", "target")
    return new, clustered.join(to, "id").drop("id", "peak", "part"), rejected


def second_pass(models: DataFrame, transcripts: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """models to (models with inferred ones, mapping(model_id, target; a null target: no model), audit(model_id, stage, action, reason, target))."""
    p = cfg.secondpass
    m = models.withColumns({"n_exons": F.size("exons"), "place": F.col("model_id")})
    single = m.where("n_exons = 1").select("model_id", "gene_id", F.element_at("exons", 1)["s"].alias("s"), F.element_at("exons", 1)["e"].alias("e"))
    classes = M.monoexon_class(single, gene_structure(transcripts), p.min_intron_overlap).select("model_id", "class")
    first = cut(B.replace_single_exons(m.join(classes, "model_id", "left"), transcripts, p.remove_classes))
    wanted = B.inferred_models(first, transcripts).select("model_id", "gene_id", "contig", "strand", "chain", F.col("tss").alias("five"), F.col("tts").alias("three"), "exons", "category", "tx_len", F.element_at("exons", 1)["s"].alias("start"))
    left = m.join(first.where("action <> 'kept'").select("model_id"), "model_id", "left_anti")
    ruled = B.dominance(left, p.dominance_ratio)
    ruled = ruled.withColumns({"nontemplated_share": F.lit(None).cast("double"), "tail_excess": F.lit(None).cast("double"), "dse_contrast": F.col("contrast"), "terminal_lfdr": F.lit(None).cast("double")})
    second = cut(B.filter_ends(ruled, M.end3_tier(p.min_tail_excess, p.min_nontemplated, p.min_contrast, p.max_dispersion)))
    audit = first.select("model_id", F.lit("single_exons").alias("stage"), "action", "reason", "target").unionByName(second.where("tier IS NOT NULL").select("model_id", F.lit("ends").alias("stage"), "action", F.concat(F.lit("tier="), F.col("tier")).alias("reason"), "target"))
    mapping = first.where("action <> 'kept'").select("model_id", "target").unionByName(second.where("action = 'removed'").select("model_id", "target"))
    kept = left.join(second.where("action = 'kept'").select("model_id"), "model_id", "left_semi").select(*models.columns)
    return kept.unionByName(wanted, allowMissingColumns=True), cut(mapping), cut(audit)
