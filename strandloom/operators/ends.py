"""Transcript ends: peaks of 3' ends, 5' percentiles, dispersion, tails, pruning of terminal variants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import more_distal, support
from .joins import runs_by_gap


def histogram(reads: DataFrame, keys: list[str], pos: str = "tts", weight: Column | None = None) -> DataFrame:
    """(keys, pos, w): what peaks are made of. A group's Python task gets its distinct positions, never its reads."""
    return reads.groupBy(*keys, F.col(pos).alias("pos")).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("w"))


def weighted_median(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median): the smallest position up to which half of the weight lies."""
    by = Window.partitionBy(*keys)
    run = F.sum("w").over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumns({"c": run, "t": F.sum("w").over(by)}).where("c >= t / 2 - 1e-9").groupBy(*keys).agg(F.min("pos").alias("median"))


def peak_seed(hist: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(keys, pos, mass): the position with most weight within the window; the leftmost on ties."""
    mass = F.sum("w").over(Window.partitionBy(*keys).orderBy("pos").rangeBetween(-window, window))
    return hist.withColumn("mass", mass).groupBy(*keys).agg(F.min(F.struct(-F.round("mass", 9), F.col("pos"))).alias("b")).select(*keys, F.col("b.pos").alias("pos"), (-F.col("b.col1")).alias("mass"))


def greedy_peaks(pos: np.ndarray, weight: np.ndarray, window: int) -> tuple[np.ndarray, list[int], list[float], list[int]]:
    """Labels of sorted distinct positions, and each label's peak (the weighted median of what it claimed), mass and centre.

    Again and again the position with most unclaimed weight within the window (leftmost on ties) claims
    all positions within the window.
    """
    label = np.full(len(pos), -1, np.int64)
    left = weight.astype(float).copy()
    lo, hi = np.searchsorted(pos, pos - window, "left"), np.searchsorted(pos, pos + window, "right")
    peaks: list[int] = []
    masses: list[float] = []
    centres: list[int] = []
    open_ = np.ones(len(pos), bool)
    while open_.any():
        sums = np.r_[0.0, np.cumsum(left)]
        mass = np.where(open_, np.round(sums[hi] - sums[lo], 9), -1)
        k = int(mass.argmax())
        mine = np.arange(lo[k], hi[k])
        mine = mine[open_[mine]]
        run = np.cumsum(left[mine])
        peaks.append(int(pos[mine[min(int(np.searchsorted(run, run[-1] / 2)), len(mine) - 1)]]))
        masses.append(float(mass[k]))
        centres.append(int(pos[k]))
        label[mine] = len(peaks) - 1
        left[mine] = 0
        open_[mine] = False
    return label, peaks, masses, centres


def cluster_ends(hist: DataFrame, keys: list[str], window: int = 30) -> DataFrame:
    """hist(keys, pos, w) with peak (its position) and label (peaks of a key by falling mass when they were chosen).

    Positions over `window` apart can't touch each other's mass or claims, so a key is first cut into
    stretches without such a gap; Python gets one stretch's distinct positions at a time.
    """
    groups = runs_by_gap(hist, keys, "pos", window).groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("h"))

    @F.pandas_udf("array<struct<label:bigint,peak:bigint,mass:double,centre:bigint>>")
    def cluster(pos: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for p, x in zip(pos, w, strict=True):
            label, peaks, masses, centres = greedy_peaks(np.asarray(p, np.int64), np.asarray(x, float), window)
            out.append([{"label": int(i), "peak": peaks[i], "mass": masses[i], "centre": centres[i]} for i in label])
        return pd.Series(out)

    rows = groups.withColumn("c", cluster(F.transform("h", lambda x: x["pos"]), F.transform("h", lambda x: x["w"])))
    rows = rows.select(*keys, F.explode(F.arrays_zip("h", "c")).alias("r"))
    rows = rows.select(*keys, F.col("r.h.pos").alias("pos"), F.col("r.h.w").alias("w"), F.col("r.c.peak").alias("peak"), (-F.col("r.c.mass")).alias("_m"), F.col("r.c.centre").alias("_c"))
    label = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_m", "_c")) - 1
    return rows.withColumn("label", label.cast("long")).select(*keys, "pos", "w", "label", "peak")


def peak_gate(peaks: DataFrame, keys: list[str], annotated: DataFrame | None = None, min_reads: int = 5, min_mols: int = 3, near: int = 30) -> DataFrame:
    """peaks(keys, peak, n_reads, n_mols) with to: itself if supported or near an annotated end of the key, else the nearest such peak; the heaviest if none is."""
    ok = (F.col("n_reads") >= min_reads) & (F.col("n_mols") >= min_mols)
    if annotated is not None:
        ends = annotated.groupBy(*keys).agg(F.collect_set("end").alias("ends"))
        peaks = peaks.join(ends, keys, "left")
        ok = ok | F.coalesce(F.exists("ends", lambda e: F.abs(e - F.col("peak")) <= near), F.lit(False))
    by = Window.partitionBy(*keys)
    flagged = peaks.withColumn("good", ok).withColumns({"any_good": F.max(F.col("good").cast("int")).over(by), "place": F.row_number().over(by.orderBy(F.desc("n_reads"), "peak"))})
    flagged = flagged.withColumn("good", F.when(F.col("any_good") == 1, F.col("good")).otherwise(F.col("place") == 1))
    good = F.collect_list(F.when(F.col("good"), F.col("peak"))).over(by)
    to = F.array_min(F.transform(good, lambda p: F.struct(F.abs(p - F.col("peak")).alias("d"), p.alias("p"))))["p"]
    return flagged.withColumn("to", to).drop("any_good", "place", "ends")


def five_prime(reads: DataFrame, keys: list[str], percent: float = 90.0) -> DataFrame:
    """(keys, three, extension, five): the percentile of the distances from a group's 3' end, cut to whole bases.

    reads(keys, strand in keys, tss, three).
    """
    agg = reads.groupBy(*keys, "three").agg(F.round(F.percentile(F.abs(F.col("tss") - F.col("three")), percent / 100), 6).alias("extension"))
    five = F.when(F.col("strand") == "-", F.col("three") + F.col("extension")).otherwise(F.col("three") - F.col("extension"))
    return agg.withColumn("five", five.cast("long"))


def dispersion(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Population deviation of 3' ends, and quantiles of 5' offsets. reads(keys, tts, offset5)."""
    return reads.groupBy(*keys).agg(F.stddev_pop("tts").alias("dispersion"), *(F.percentile("offset5", q / 100).alias(f"offset5_p{q}") for q in (10, 50, 90)))


def tail_evidence(reads: DataFrame, keys: list[str], min_len: int = 8) -> DataFrame:
    """Weighted share of reads whose tail has min_len bases, their number and the median tail. reads(keys, tail_len, weight)."""
    long = F.col("tail_len") >= min_len
    return reads.groupBy(*keys).agg((F.sum(F.when(long, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("tail_share"), F.count_if(long).alias("n_tail"), F.percentile("tail_len", 0.5).alias("median_tail"))


def polya_evidence(atlas_hit: Column, motif_found: Column, percent_a: Column, has_atlas: Column, require_atlas: bool = True, most_a: float = 60.0) -> Column:
    """An atlas decides alone where there is one and it is required; else atlas or hexamer; never above most_a percent A downstream."""
    either = F.coalesce(atlas_hit, F.lit(False)) | F.coalesce(motif_found, F.lit(False))
    found = F.when(has_atlas & F.lit(require_atlas), F.coalesce(atlas_hit, F.lit(False))).otherwise(either)
    return found & (F.coalesce(percent_a, F.lit(0.0)) < most_a)


def end3_category(peaks: DataFrame, tol: int = 30, min_share: float = 0.05, fallback: int = 300) -> DataFrame:
    """peaks with category and end: chain_ends and gene_ends are arrays of annotated 3' ends (of the chain's and of the gene's transcripts), share, polya and readthrough."""
    near = lambda ends: F.array_min(F.transform(ends, lambda e: F.struct(F.abs(e - F.col("peak")).alias("d"), e.alias("e"))))
    own, gene = near(F.col("chain_ends")), near(F.col("gene_ends"))
    weak = (F.col("share") < min_share) | ~F.col("polya")
    category = (
        F.when(own["d"] <= tol, "FSM")
        .when(F.col("chain_ends").isNull(), "NOVEL")
        .when(gene["d"] <= tol, "end3_annotated")
        .when(weak & (own["d"] <= fallback), "FSM")
        .when(weak, "end3_unresolved")
        .when(F.col("readthrough"), "READTHROUGH")
        .otherwise("end3_novel")
    )
    out = peaks.withColumn("category", category)
    return out.withColumn("end", F.when(F.col("category") == "FSM", own["e"]).when(F.col("category") == "end3_annotated", gene["e"]).otherwise(F.col("peak")))


def relative_terms(models: DataFrame, keys: list[str]) -> DataFrame:
    """models with the share of their group's mass and the ratio to its dominant one, by the larger of molecules and reads."""
    mass = F.greatest("n_mols", "n_reads", F.lit(1))
    by = Window.partitionBy(*keys)
    return models.withColumns({"group_share": mass / F.sum(mass).over(by), "ratio_to_dominant": mass / F.max(mass).over(by)})


def promoted(most_dispersion: float = 12.0) -> Column:
    """Whether a 3' end has earned its place: a catalogued site, a coverage step or a tight peak."""
    return F.coalesce(F.col("at_polya_site"), F.lit(False)) | F.coalesce(F.col("step_supported"), F.lit(False)) | F.coalesce(F.col("dispersion") <= most_dispersion, F.lit(False))


def prune_terminal(models: DataFrame, keys: list[str], most_dispersion: float = 12.0, max_dist: int = 5000, ratio: float = 2.0, min_share: float = 0.3) -> DataFrame:
    """models(keys with strand, model_id, three, n_mols, n_reads, end_annotated, at_polya_site, step_supported, dispersion) with absorbed_into and tier.

    Shares and tiers are taken after absorption, of the support that survivors then hold.
    A shorter variant that earned no place folds into the best-supported more distal sibling that did;
    where none did, into one of `ratio` times its support. A sibling that is itself absorbed is no
    target, which is settled from the most distal end inwards, so this last case is a Python group.
    """
    m = models.withColumns({"mass": support(F.col("n_mols"), F.greatest("n_reads", F.lit(1))).cast("double"), "promoted": promoted(most_dispersion)})
    facts = F.struct(F.when(F.col("strand") == "-", F.col("three")).otherwise(-F.col("three")).alias("at"), "model_id", "mass", F.col("end_annotated").alias("fixed"), F.col("promoted").alias("earned"), F.coalesce("at_polya_site", F.lit(False)).alias("site"))
    groups = m.groupBy(*keys).agg(F.array_sort(F.collect_list(facts)).alias("v"))  # a chain's ends, the most distal first

    @F.pandas_udf("array<struct<into:string,share:double,tier:string>>")
    def judge(variants: pd.Series) -> pd.Series:
        return pd.Series([_absorb(list(v), max_dist, ratio, min_share) for v in variants])

    judged = groups.withColumn("r", judge("v")).select(*keys, F.explode(F.arrays_zip("v", "r")).alias("z"))
    judged = judged.select(*keys, F.col("z.v.model_id").alias("model_id"), F.col("z.r.into").alias("absorbed_into"), F.col("z.r.share").alias("candidate_share"), F.col("z.r.tier").alias("tier"))
    return m.join(judged, [*keys, "model_id"])


def _absorb(variants: list, max_dist: int, ratio: float, min_share: float) -> list[dict]:
    """What becomes of a chain's ends, which come most distal first: absorbed into another, or a tier with a share."""
    mass = [v["mass"] for v in variants]
    held = [v["fixed"] or v["earned"] for v in variants]
    into: list[int | None] = [None] * len(variants)
    for i, v in enumerate(variants):
        if held[i]:
            continue
        able = [j for j in range(i) if into[j] is None and 0 < v["at"] - variants[j]["at"] <= max_dist and (held[j] if any(held) else mass[j] >= ratio * mass[i])]
        if able:
            into[i] = max(able, key=lambda j: (mass[j], -j))
    # shares and tiers are of what is left, with the support that it has taken in
    left = list(mass)
    for i, j in enumerate(into):
        if j is not None:
            left[j] += mass[i]
    running = [into[i] is None and v["earned"] and not v["fixed"] for i, v in enumerate(variants)]
    total = sum(x for x, r in zip(left, running, strict=True) if r)
    out = []
    for i, v in enumerate(variants):
        share = left[i] / total if running[i] and total else None
        tier = None if into[i] is not None else "annotated" if v["fixed"] else "unsupported" if not v["earned"] else "high" if v["site"] or share >= min_share else "reported"
        out.append({"into": None if into[i] is None else variants[into[i]]["model_id"], "share": share, "tier": tier})
    return out


def more_distal_pairs(models: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_id, sibling): siblings whose 3' end lies further along."""
    other = models.select(*keys, F.col("model_id").alias("sibling"), F.col("three").alias("_t"))
    return models.join(other, keys).where(more_distal(F.col("_t"), F.col("three"), F.col("strand"))).select(*keys, "model_id", "sibling")


def within_budget(models: DataFrame, keys: list[str], most: int = 3, novel: tuple[str, ...] = ("end3_novel", "end3_unresolved"), emit_unresolved: bool = False) -> DataFrame:
    """models(keys, model_id, mass, category) that are emitted: of a parent's novel and unresolved ends the `most` of greatest mass, ids breaking ties; unresolved ones only if asked for, and then within the same budget."""
    shown = models if emit_unresolved else models.where(F.col("category") != "end3_unresolved")
    counted = F.col("category").isin(*novel)
    place = F.sum(counted.cast("int")).over(Window.partitionBy(*keys).orderBy(F.desc("mass"), "model_id").rowsBetween(Window.unboundedPreceding, 0))
    return shown.withColumn("_place", place).where(~counted | (F.col("_place") <= most)).drop("_place")


def below_ceiling(models: DataFrame, most: float | None = None, novel: tuple[str, ...] = ("end3_novel",)) -> DataFrame:
    """models without those of novel ends whose terminal_lfdr is over `most`; null is no opinion, and no ceiling keeps all."""
    return models if most is None else models.where(~F.col("category").isin(*novel) | F.coalesce(F.col("terminal_lfdr") <= most, F.lit(True)))
