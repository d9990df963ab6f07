"""Transcript models against each other and the annotation: similarity, structural classes, fragments, consolidation, tiers, ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..functions.intervals import genomic, overlap, retained_introns, signed_offset, subchain_offsets, subsequence_gaps


def similarity(models: DataFrame, transcripts: DataFrame, flank: int = 10) -> DataFrame:
    """Each model's nearest transcript of its gene.

    models(model_id, gene_id, strand, chain, exons, five, three), transcripts(tx_id, gene_id, chain, tss, tts, rank, tx_len).
    Score: 2 a shared junction, -3 one the model alone has, -1 one the transcript alone has, -0.5 if the
    model reads through it. Then 3' distance, 5' distance, rank, length, id. n_equally_close ties on the first three.
    """
    t = transcripts.select("gene_id", "tx_id", F.col("chain").alias("tc"), "tss", "tts", "rank", "tx_len")
    m = models.join(t, "gene_id")
    shared = F.size(F.array_intersect("chain", "tc"))
    only, missing = F.array_except("chain", "tc"), F.array_except("tc", "chain")
    kept = F.size(retained_introns(F.col("exons"), missing, flank))
    m = m.withColumns(
        {
            "n_shared": shared,
            "n_model_only": F.size(only),
            "n_ref_only": F.size(missing),
            "n_retained": kept,
            "d5": signed_offset(F.col("five"), F.col("tss"), F.col("strand")),
            "d3": signed_offset(F.col("three"), F.col("tts"), F.col("strand")),
        }
    )
    m = m.withColumn("score", 2.0 * F.col("n_shared") - 3.0 * F.col("n_model_only") - (F.col("n_ref_only") - F.col("n_retained")) - 0.5 * F.col("n_retained"))
    first = [F.desc("score"), F.abs("d3"), F.abs("d5")]
    by = Window.partitionBy("model_id")
    ranked = m.withColumns({"place": F.row_number().over(by.orderBy(*first, "rank", F.desc("tx_len"), "tx_id")), "tie": F.rank().over(by.orderBy(*first))})
    ranked = ranked.withColumn("n_equally_close", F.count_if(F.col("tie") == 1).over(by)).where("place = 1")
    return ranked.select("model_id", "tx_id", "score", "n_shared", "n_model_only", "n_ref_only", "n_retained", "d5", "d3", "n_equally_close")


def describe(m: str = "") -> Column:
    """A short text of the difference, such as +1jxn;-2jxn;1IR;d5=-40;d3=+12."""
    c = lambda x: F.col(m + x)
    signed = lambda x: F.concat(F.when(c(x) > 0, "+").otherwise(""), c(x).cast("string"))
    return F.concat_ws(
        ";",
        F.when(c("n_model_only") > 0, F.concat(F.lit("+"), c("n_model_only").cast("string"), F.lit("jxn"))),
        F.when(c("n_ref_only") - c("n_retained") > 0, F.concat(F.lit("-"), (c("n_ref_only") - c("n_retained")).cast("string"), F.lit("jxn"))),
        F.when(c("n_retained") > 0, F.concat(c("n_retained").cast("string"), F.lit("IR"))),
        F.when(c("d5") != 0, F.concat(F.lit("d5="), signed("d5"))),
        F.when(c("d3") != 0, F.concat(F.lit("d3="), signed("d3"))),
    )


def structural_class(models: DataFrame, transcripts: DataFrame, junctions: DataFrame, tol: int = 0) -> DataFrame:
    """Spliced models as FSM, ISM (contiguous, else with an intron retained), NIC or NNC, in that order.

    models(model_id, contig, strand, chain, exons), transcripts(tx_id, contig, strand, chain), both of a
    locus; junctions: the annotation's (contig, strand, donor, acceptor). ISM is told by transcript, never
    over their union; miss5 and miss3 are those of the transcript that lacks least.
    """
    m = models.withColumn("g", genomic(F.col("chain")))
    t = transcripts.select("contig", "strand", "tx_id", genomic(F.col("chain")).alias("tg"))
    # a match of any kind has the model's first intron: that is what models and transcripts meet by
    size = 2 * tol + 1
    first = F.get("g", F.lit(0))
    looked = m.withColumn("_b", F.explode(F.sequence(F.floor((first["donor"] - tol) / size), F.floor((first["donor"] + tol) / size))))
    held = t.select("*", F.explode("tg").alias("_j")).withColumn("_b", F.floor(F.col("_j.donor") / size))
    meets = (F.abs(F.col("_j.donor") - first["donor"]) <= tol) & (F.abs(F.col("_j.acceptor") - first["acceptor"]) <= tol)
    pair = looked.join(held, ["contig", "strand", "_b"]).where(meets)
    near = F.zip_with("g", "tg", lambda a, b: F.coalesce((F.abs(a["donor"] - b["donor"]) <= tol) & (F.abs(a["acceptor"] - b["acceptor"]) <= tol), F.lit(False)))
    equal = (F.size("g") == F.size("tg")) & F.forall(near, lambda x: x)
    offsets = subchain_offsets(F.col("g"), F.col("tg"), tol)
    gaps = subsequence_gaps(F.col("g"), F.col("tg"), tol)
    read_through = (F.size(gaps["internal"]) > 0) & F.forall(gaps["internal"], lambda j: F.exists("exons", lambda x: (x["s"] <= j["donor"]) & (j["acceptor"] <= x["e"])))
    plus = F.col("strand") == "+"
    spare = F.size("tg") - F.size("g")
    tell = lambda left, right: F.struct((left + right).alias("all"), F.when(plus, left).otherwise(right).alias("m5"), F.when(plus, right).otherwise(left).alias("m3"))
    # of several offsets the one that lacks least: they all lack as much, so the least at the 5' end
    contiguous = F.when(F.size(offsets) > 0, F.array_min(F.transform(offsets, lambda k: tell(k, spare - k))))
    retention = F.when(read_through, tell(gaps["miss_left"], gaps["miss_right"]))
    found = pair.select("model_id", "tx_id", equal.alias("fsm"), contiguous.alias("ism"), retention.alias("ir")).groupBy("model_id").agg(
        F.min(F.when(F.col("fsm"), F.col("tx_id"))).alias("fsm_tx"), F.min("ism").alias("ism"), F.min("ir").alias("ir")
    )
    known = junctions.select("contig", "strand", "donor", "acceptor").distinct()
    donors = known.select("contig", "strand", "donor").distinct().withColumn("d_ok", F.lit(True))
    acceptors = known.select("contig", "strand", "acceptor").distinct().withColumn("a_ok", F.lit(True))
    j = m.select("model_id", "contig", "strand", F.explode("g").alias("j")).select("model_id", "contig", "strand", "j.donor", "j.acceptor")
    j = j.join(known.withColumn("j_ok", F.lit(True)), ["contig", "strand", "donor", "acceptor"], "left").join(donors, ["contig", "strand", "donor"], "left").join(acceptors, ["contig", "strand", "acceptor"], "left")
    both = F.coalesce(F.col("d_ok") & F.col("a_ok"), F.lit(False))
    sites = j.groupBy("model_id").agg(F.count_if(~both).alias("novel_sites"), F.count_if(both & F.col("j_ok").isNull()).alias("novel_combinations"))
    out = m.select("model_id").join(found, "model_id", "left").join(sites, "model_id", "left")
    category = F.when(F.col("fsm_tx").isNotNull(), "FSM").when(F.col("ism").isNotNull() | F.col("ir").isNotNull(), "ISM").when(F.col("novel_sites") == 0, "NIC").otherwise("NNC")
    sub = (
        F.when(F.col("fsm_tx").isNotNull(), F.lit(None))
        .when(F.col("ism").isNotNull(), F.when((F.col("ism.m5") > 0) & (F.col("ism.m3") > 0), "internal_fragment").when(F.col("ism.m5") > 0, "3prime_fragment").otherwise("5prime_fragment"))
        .when(F.col("ir").isNotNull(), "intron_retention")
        .when((F.col("novel_sites") == 0) & (F.col("novel_combinations") == 0), "combination_of_known_junctions")
        .when(F.col("novel_sites") == 0, "combination_of_known_splicesites")
        .otherwise("at_least_one_novel_splicesite")
    )
    miss = F.when(F.col("fsm_tx").isNull(), F.coalesce("ism", "ir"))
    return out.select("model_id", category.alias("category"), sub.alias("subcategory"), miss["m5"].alias("miss5"), miss["m3"].alias("miss3"), "novel_sites", "novel_combinations")


def fragments(models: DataFrame, ratio: float = 2.0, fuzzy: int = 5, slack: int = 50, protected: tuple[str, ...] = ("FSM", "INFERRED"), bucket: int = 1000) -> DataFrame:
    """(model_id, container): each unprotected model that is part of a longer one of `ratio` times its support, and the one it goes to.

    models(model_id, contig, strand, chain, exons, support, category). A part's introns stand in the
    container's without a gap, and its ends lie within the exons there, or it is one exon within one
    of the container's. Candidates meet by the bucket of their first intron's start (or of their start).
    """
    m = models.select("model_id", "contig", "strand", "chain", "exons", "support", "category").withColumns({"g": genomic(F.col("chain")), "start": F.element_at("exons", 1)["s"], "end": F.element_at("exons", -1)["e"]})
    c = m.where(F.size("g") > 0).select("contig", "strand", F.col("model_id").alias("container"), F.col("g").alias("cg"), F.col("exons").alias("ce"), F.col("support").alias("cs"), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    fits = (F.col("model_id") != F.col("container")) & (F.col("cs") >= ratio * F.greatest("support", F.lit(1)))
    part = m.where(~F.coalesce("category", F.lit("")).isin(*protected))
    a = part.where(F.size("g") > 0).withColumn("b", F.explode(F.sequence(F.floor((F.col("g")[0]["donor"] - fuzzy) / bucket), F.floor((F.col("g")[0]["donor"] + fuzzy) / bucket))))
    introns = c.select("*", F.posexplode("cg").alias("k", "j")).withColumn("b", F.floor(F.col("j.donor") / bucket))
    n = F.size("g")
    same = F.zip_with("g", F.slice("cg", F.col("k") + 1, n), lambda x, y: F.coalesce((F.abs(x["donor"] - y["donor"]) <= fuzzy) & (F.abs(x["acceptor"] - y["acceptor"]) <= fuzzy), F.lit(False)))
    inside = (F.col("start") >= F.get("ce", F.col("k"))["s"] - slack) & (F.col("end") <= F.get("ce", F.col("k") + n)["e"] + slack)
    spliced = a.join(introns, ["contig", "strand", "b"]).where(fits & (F.size("cg") > n) & (F.abs(F.col("j.donor") - F.col("g")[0]["donor"]) <= fuzzy)).where(F.forall(same, lambda x: x) & inside)
    a1 = part.where(F.size("g") == 0).withColumn("b", F.floor(F.col("start") / bucket))
    exons = c.select("*", F.explode("ce").alias("x")).withColumn("b", F.explode(F.sequence(F.floor((F.col("x.s") - fuzzy) / bucket), F.floor((F.col("x.e") + fuzzy) / bucket))))
    single = a1.join(exons, ["contig", "strand", "b"]).where(fits & (F.col("x.s") - fuzzy <= F.col("start")) & (F.col("end") <= F.col("x.e") + fuzzy))
    cols = ["model_id", "container", "cs", "c_start", "c_end"]
    hits = spliced.select(*cols).unionByName(single.select(*cols))
    return hits.groupBy("model_id").agg(F.min_by("container", F.struct(-F.col("cs"), F.col("c_start"), -F.col("c_end"), F.col("container"))).alias("container"))


def surviving_targets(mapping: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(model_id, container, target): where a chain of containers ends; it is acyclic, as containers have more introns.

    Pointers are doubled: each round halves what is left of every path. One row per folded model.
    """
    now = cut(mapping.select("model_id", "container", F.col("container").alias("target")))
    for _ in range(max_rounds):
        step = now.select(F.col("model_id").alias("target"), F.col("target").alias("next"))
        ahead = now.join(step, "target", "left").select("model_id", "container", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved"))
        ahead = cut(ahead)
        if not ahead.where("moved").limit(1).count():
            return ahead.drop("moved")
        now = ahead.drop("moved")
    raise RuntimeError("containers did not settle")


def consolidate_ends(models: DataFrame, keys: list[str], end3: int = 200, end5: int = -1) -> DataFrame:
    """models(keys, model_id, five, three, end_annotated, support, tx_len, start) with representative.

    By rank (annotated end, support, length, leftmost) each live model takes all live ones of its key
    whose 3' end lies within end3 (and 5' end within end5, unless negative). Models of category INFERRED
    neither take nor are taken. Keys with one model don't go to Python.
    """
    exempt = models.limit(0).withColumn("representative", F.col("model_id"))
    if "category" in models.columns:
        inferred = F.coalesce(F.col("category") == "INFERRED", F.lit(False))
        exempt, models = models.where(inferred).withColumn("representative", F.col("model_id")), models.where(~inferred)
    sized = models.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    alone = sized.where("_n = 1").drop("_n").withColumn("representative", F.col("model_id"))
    many = sized.where("_n > 1").groupBy(*keys).agg(F.collect_list(F.struct("end_annotated", "support", "tx_len", "start", "five", "three", "model_id")).alias("ms"))

    @F.pandas_udf("array<struct<model_id:string,representative:string>>")
    def choose(ms: pd.Series) -> pd.Series:
        out = []
        for group in ms:
            order = sorted(group, key=lambda m: (not m["end_annotated"], -m["support"], -m["tx_len"], m["start"], m["model_id"]))
            three, five = np.array([m["three"] for m in order]), np.array([m["five"] for m in order])
            to = [None] * len(order)
            for i, m in enumerate(order):
                if to[i] is None:
                    near = (np.abs(three - three[i]) <= end3) & ((end5 < 0) | (np.abs(five - five[i]) <= end5))
                    for j in np.flatnonzero(near):
                        to[j] = to[j] or m["model_id"]
                    to[i] = m["model_id"]
            out.append([{"model_id": m["model_id"], "representative": t} for m, t in zip(order, to, strict=True)])
        return pd.Series(out)

    chosen = many.select(F.explode(choose("ms")).alias("c")).select("c.model_id", "c.representative")
    return alone.unionByName(sized.where("_n > 1").drop("_n").join(chosen, "model_id").select(*alone.columns)).unionByName(exempt)


def end3_tier(excess: int = 8, share: float = 0.5, contrast: float = 0.1, most_dispersion: float = 12.0, max_lfdr: float | None = None) -> Column:
    """The strongest evidence that lets a novel 3' end stay, over evidence columns of which null is no opinion; null if none does."""
    unprimed = ~F.coalesce("internal_priming", F.lit(False))
    return (
        F.when(F.coalesce("at_polya_site", F.lit(False)), "atlas")
        .when((F.col("nontemplated_share") >= share) & (F.col("tail_excess") >= excess) & unprimed, "nontemplated")
        .when(F.coalesce("motif_found", F.lit(False)) & (F.col("dse_contrast") >= contrast) & (F.col("dispersion") <= most_dispersion) & unprimed, "composition")
        .when(F.coalesce("step_supported", F.lit(False)), "short_read")
        .when(F.lit(max_lfdr is not None) & (F.col("terminal_lfdr") <= (max_lfdr or 0.0)), "calibrated")
        .when(F.coalesce("sole", F.lit(False)) | F.coalesce("dominant", F.lit(False)), "gene_dominant")
    )


def gene_dominance(models: DataFrame, ratio: float = 1.0) -> DataFrame:
    """models(gene_id, model_id, support) with its rank in the gene, the runner-up's support, sole and dominant (best, over ratio times the next)."""
    by = Window.partitionBy("gene_id")
    place = F.row_number().over(by.orderBy(F.desc("support"), "model_id"))
    second = F.max(F.when(F.col("place") == 2, F.col("support"))).over(by)
    out = models.withColumns({"place": place, "n_in_gene": F.count("*").over(by)}).withColumn("runner_up", second)
    return out.withColumns({"sole": F.col("n_in_gene") == 1, "dominant": (F.col("place") == 1) & (F.col("n_in_gene") > 1) & (F.col("support") > ratio * F.coalesce("runner_up", F.lit(0)))})


def monoexon_class(models: DataFrame, genes: DataFrame, least: int = 10) -> DataFrame:
    """models(model_id, gene_id, s, e) with class.

    genes(gene_id, n_mono, n_multi, exons (distinct, of transcripts), islands (their union), introns (between islands)).
    X no gene, A its gene has no spliced transcript, B it has a single-exon one, D within an annotated exon,
    C over intronic and exonic bases, E the rest.
    """
    j = models.join(genes, "gene_id", "left")
    bases = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + overlap(F.col("s"), F.col("e"), x["s"], x["e"]))
    kind = (
        F.when(F.col("n_multi").isNull(), "X")
        .when(F.col("n_multi") == 0, "A")
        .when(F.col("n_mono") > 0, "B")
        .when(F.exists("exons", lambda x: (x["s"] <= F.col("s")) & (F.col("e") <= x["e"])), "D")
        .when((bases(F.col("introns")) >= least) & (bases(F.col("islands")) >= least), "C")
        .otherwise("E")
    )
    return j.select("model_id", "gene_id", kind.alias("class"))


def cluster_single_exons(reads: DataFrame, window: int = 100, min_share: float = 0.5) -> DataFrame:
    """reads(read_id, contig, strand, start, end, tts) with cluster: peaks of 3' ends, each split where a read covers less than min_share of the shorter of it and the hull so far."""
    from .ends import cluster_ends, histogram

    peaks = cluster_ends(histogram(reads, ["contig", "strand"]), ["contig", "strand"], window).select("contig", "strand", F.col("pos").alias("tts"), "peak")
    spans = reads.join(peaks, ["contig", "strand", "tts"])
    distinct = spans.groupBy("contig", "strand", "peak").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("xs"))

    @F.pandas_udf("array<int>")
    def split(xs: pd.Series) -> pd.Series:
        out = []
        for spans in xs:
            label, hull, labels = 0, None, []
            for x in spans:
                s, e = x["start"], x["end"]
                if hull is None or min(hull[1], e) - max(hull[0], s) < min_share * min(hull[1] - hull[0], e - s):
                    label, hull = label + (hull is not None), (s, e)
                else:
                    hull = (min(hull[0], s), max(hull[1], e))
                labels.append(label)
            out.append(labels)
        return pd.Series(out)

    labels = distinct.withColumn("l", split("xs")).select("contig", "strand", "peak", F.explode(F.arrays_zip("xs", "l")).alias("z"))
    labels = labels.select("contig", "strand", "peak", F.col("z.xs.start").alias("start"), F.col("z.xs.end").alias("end"), F.col("z.l").alias("part"))
    return spans.join(labels, ["contig", "strand", "peak", "start", "end"]).select(*reads.columns, "peak", "part")


def assign_ids(models: DataFrame, order: list[str], prefix: str = "M") -> DataFrame:
    """models(gene_id, ..) with model_name: its gene's name and a number in the given order, the same whatever the partitions."""
    return models.withColumn("model_name", F.concat_ws(".", F.lit(prefix), F.coalesce("gene_id", F.lit("none")), F.row_number().over(Window.partitionBy("gene_id").orderBy(*order)).cast("string")))


def abundance(models: DataFrame) -> DataFrame:
    """models(n_reads, n_mols) with shares of all; totals come from one aggregate, not from a window over all rows."""
    total = models.agg(F.sum("n_reads").alias("_r"), F.sum("n_mols").alias("_m"))
    return models.join(F.broadcast(total)).withColumns({"read_share": F.col("n_reads") / F.col("_r"), "mol_share": F.col("n_mols") / F.col("_m")}).drop("_r", "_m")


def dedupe(models: DataFrame) -> DataFrame:
    """(contig, strand, exons, model_id, n_reads, n_mols, n_cells, flags): models of equal exons as one, of the first id.

    Reads and molecules add up, cells are the larger number, flags are united. A recount from reads follows where molecules must be exact.
    """
    return models.groupBy("contig", "strand", "exons").agg(F.min("model_id").alias("model_id"), F.sum("n_reads").alias("n_reads"), F.sum("n_mols").alias("n_mols"), F.max("n_cells").alias("n_cells"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"))


def single_exon_class(models: DataFrame, transcripts: DataFrame, share: float = 0.5) -> DataFrame:
    """(model_id, category, primary): a single-exon model as FSM (reciprocal overlap with a single-exon transcript), ISM (within a transcript's exon), genic or intergenic.

    models(model_id, contig, strand, s, e), transcripts(contig, strand, tx_id, rank, exons). Pairs are those
    that overlap, by bins; a model without any is intergenic. primary: the least rank, then id.
    """
    from .joins import interval_join

    t = transcripts.select("contig", "strand", "tx_id", "rank", "exons", F.element_at("exons", 1)["s"].alias("rs"), F.element_at("exons", -1)["e"].alias("re"))
    hit = interval_join(models.select("model_id", "contig", "strand", "s", "e"), t, ["contig", "strand"], 65_536)
    touches = F.exists("exons", lambda x: (x["s"] < F.col("e")) & (F.col("s") < x["e"]))
    both = overlap(F.col("s"), F.col("e"), F.col("rs"), F.col("re"))
    whole = (F.size("exons") == 1) & (both >= share * (F.col("e") - F.col("s"))) & (both >= share * (F.col("re") - F.col("rs")))
    within = F.exists("exons", lambda x: (x["s"] <= F.col("s")) & (F.col("e") <= x["e"]))
    best = hit.where(touches).groupBy("model_id").agg(F.max(whole.cast("int")).alias("f"), F.max(within.cast("int")).alias("i"), F.min_by("tx_id", F.struct("rank", "tx_id")).alias("primary"))
    category = F.when(F.col("f") == 1, "FSM").when(F.col("i") == 1, "ISM").when(F.col("f").isNotNull(), "genic").otherwise("intergenic")
    return models.select("model_id").join(best, "model_id", "left").select("model_id", category.alias("category"), "primary")


def fusions(models: DataFrame, gene_exons: DataFrame) -> DataFrame:
    """(model_id, genes, fusion): genes of the strand whose exons a model's exons overlap, and whether that is more than one.

    models(model_id, contig, strand, exons), gene_exons(gene_id, contig, strand, rs, re). FSM and ISM go before it.
    """
    from .joins import interval_join

    x = models.select("model_id", "contig", "strand", F.explode("exons").alias("x")).select("model_id", "contig", "strand", "x.s", "x.e")
    hit = interval_join(x, gene_exons, ["contig", "strand"], 16_384).groupBy("model_id").agg(F.array_sort(F.collect_set("gene_id")).alias("genes"))
    out = models.select("model_id").join(hit, "model_id", "left").withColumn("genes", F.coalesce("genes", F.array().cast("array<string>")))
    return out.withColumn("fusion", F.size("genes") > 1)


def with_fusions(classes: DataFrame, fused: DataFrame) -> DataFrame:
    """structural_class's rows with category fusion where a model that is neither FSM nor ISM spans genes."""
    f = classes.join(fused.select("model_id", "fusion"), "model_id", "left")
    is_fusion = F.coalesce("fusion", F.lit(False)) & ~F.col("category").isin("FSM", "ISM")
    return f.withColumn("subcategory", F.when(is_fusion, "multi-exon").otherwise(F.col("subcategory"))).withColumn("category", F.when(is_fusion, "fusion").otherwise(F.col("category"))).drop("fusion")


def terminal_class(category: Column, end_annotated: Column, at_polya_site: Column, internal_priming: Column) -> Column:
    """Where a model ends, apart from which chain it has."""
    yes = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    return F.when(yes(end_annotated), F.when(category == "FSM", "reference_end").otherwise("alt_end_annotated")).when(yes(at_polya_site), "alt_end_atlas").when(yes(internal_priming), "truncated_exonic").otherwise("unresolved")


# Subcategories of models with a whole annotated chain.
FSM_SUBCATEGORIES = {"FSM": "reference_match", "end3_annotated": "alternative_3end", "end3_novel": "alternative_3end", "end5_alt": "alternative_5end", "end5_extended": "alternative_5end"}


def fsm_subcategory(category: Column) -> Column:
    out = F.lit("")
    for name, sub in FSM_SUBCATEGORIES.items():
        out = F.when(category == name, sub).otherwise(out)
    return out
