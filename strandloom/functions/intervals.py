"""Interval, exon and intron-chain expressions.

Coordinates are 0-based and half-open. Exons are arrays of struct(s, e) in genomic order; a chain is an
array of struct(donor, acceptor) in transcript order, so it is reversed on the minus strand and a read
that lost its 5' end is a suffix. All helpers take and return Columns and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gtf_to_exon(start: Column, end: Column) -> Column:
    return F.struct((start - 1).alias("s"), end.alias("e"))


def genomic(chain: Column) -> Column:
    return F.array_sort(chain)


def oriented(junctions: Column, strand: Column) -> Column:
    """Junctions in transcript order."""
    up = F.array_sort(junctions)
    return F.when(strand == "-", F.reverse(up)).otherwise(up)


def exons_to_chain(exons: Column, strand: Column) -> Column:
    n = F.size(exons) - 1
    pairs = F.zip_with(F.slice(exons, F.lit(1), F.greatest(n, F.lit(0))), F.slice(exons, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.struct(a["e"].alias("donor"), b["s"].alias("acceptor")))
    return F.when(strand == "-", F.reverse(pairs)).otherwise(pairs)


def build_exons(chain: Column, strand: Column, tss: Column, tts: Column) -> Column:
    """Exons of a chain between two ends; an end inside its terminal intron is clamped to leave one base."""
    g = F.array_sort(chain)
    lo, hi = F.least(tss, tts), F.greatest(tss, tts)
    n = F.size(g)
    lo = F.when(n > 0, F.least(lo, F.element_at(g, 1)["donor"] - 1)).otherwise(lo)
    hi = F.when(n > 0, F.greatest(hi, F.element_at(g, -1)["acceptor"] + 1)).otherwise(hi)
    starts = F.concat(F.array(lo), F.transform(g, lambda j: j["acceptor"]))
    ends = F.concat(F.transform(g, lambda j: j["donor"]), F.array(hi))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def exonic_length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])


def span(exons: Column) -> Column:
    return F.element_at(exons, -1)["e"] - F.element_at(exons, 1)["s"]


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def total_overlap(a: Column, b: Column) -> Column:
    """Bases that two lists of disjoint intervals share."""
    one = lambda x: F.aggregate(b, F.lit(0).cast("long"), lambda acc, y: acc + overlap(x["s"], x["e"], y["s"], y["e"]))
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + one(x))


def tss_of(exons: Column, strand: Column) -> Column:
    return F.when(strand == "-", F.element_at(exons, -1)["e"]).otherwise(F.element_at(exons, 1)["s"])


def tts_of(exons: Column, strand: Column) -> Column:
    return F.when(strand == "-", F.element_at(exons, 1)["s"]).otherwise(F.element_at(exons, -1)["e"])


def terminal_exon(exons: Column, strand: Column) -> Column:
    return F.when(strand == "-", F.element_at(exons, 1)).otherwise(F.element_at(exons, -1))


def is_suffix(short: Column, long: Column) -> Column:
    """Proper suffix; the empty chain is a suffix of nothing."""
    n = F.size(short)
    return (n > 0) & (n < F.size(long)) & (F.slice(long, -F.greatest(n, F.lit(1)), F.greatest(n, F.lit(1))) == short)


def proper_suffixes(chain: Column) -> Column:
    """All proper, non-empty suffixes; a chain of one junction has none."""
    n = F.size(chain)
    starts = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(chain, k, n - k + 1))


def exonic_bases_downstream(exons: Column, strand: Column, pos: Column) -> Column:
    plus = F.aggregate(exons, F.lit(0).cast("long"), lambda acc, x: acc + F.greatest(x["e"] - F.greatest(x["s"], pos), F.lit(0)))
    minus = F.aggregate(exons, F.lit(0).cast("long"), lambda acc, x: acc + F.greatest(F.least(x["e"], pos) - x["s"], F.lit(0)))
    return F.when(strand == "-", minus).otherwise(plus)


def signed_offset(a: Column, b: Column, strand: Column) -> Column:
    """Of a to b along the transcript: negative if a is upstream."""
    return F.when(strand == "-", b - a).otherwise(a - b)


def chains_equal(a: Column, b: Column, tol: int) -> Column:
    near = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: (F.abs(x["donor"] - y["donor"]) <= tol) & (F.abs(x["acceptor"] - y["acceptor"]) <= tol))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: F.coalesce(x, F.lit(False)))


def subchain_offsets(a: Column, b: Column, tol: int) -> Column:
    """Offsets from 0 at which a stands in b as a contiguous proper part, both in genomic order."""
    n, m = F.size(a), F.size(b)
    offsets = F.when((n > 0) & (n < m), F.sequence(F.lit(0), F.greatest(m - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def fits(k: Column) -> Column:
        near = F.zip_with(a, F.slice(b, k + 1, F.greatest(n, F.lit(0))), lambda x, y: (F.abs(x["donor"] - y["donor"]) <= tol) & (F.abs(x["acceptor"] - y["acceptor"]) <= tol))
        return F.forall(near, lambda x: F.coalesce(x, F.lit(False)))

    return F.filter(offsets, fits)


def subsequence_gaps(a: Column, b: Column, tol: int) -> Column:
    """a as a subsequence of b by greedy matching: struct(internal, miss_left, miss_right), or null if it is none.

    internal holds the junctions of b that are skipped between the first and the last match.
    """
    kind = "struct<i:int,at:array<int>>"
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("at")).cast(kind)

    def step(acc: Column, r: Column) -> Column:
        want = F.get(a, acc["i"])
        j = F.get(b, r)
        hit = F.coalesce((F.abs(want["donor"] - j["donor"]) <= tol) & (F.abs(want["acceptor"] - j["acceptor"]) <= tol), F.lit(False))
        return F.when(hit, F.struct((acc["i"] + 1).alias("i"), F.concat(acc["at"], F.array(r)).alias("at"))).otherwise(acc).cast(kind)

    n, m = F.size(a), F.size(b)
    walked = F.aggregate(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), start, step)
    lo, hi = F.array_min(walked["at"]), F.array_max(walked["at"])
    inner = F.filter(F.transform(b, lambda j, r: F.when((r > lo) & (r < hi) & ~F.array_contains(walked["at"], r), j)), lambda j: j.isNotNull())
    return F.when((n > 0) & (n < m) & (walked["i"] == n), F.struct(inner.alias("internal"), lo.alias("miss_left"), (m - 1 - hi).alias("miss_right")))


def retained_introns(exons: Column, chain: Column, flank: int = 0) -> Column:
    """Junctions of a chain that lie within one exon, with `flank` bases to either side."""
    return F.filter(chain, lambda j: F.exists(exons, lambda x: (x["s"] <= j["donor"] - flank) & (j["acceptor"] + flank <= x["e"])))


def reciprocal(s1: Column, e1: Column, s2: Column, e2: Column, share: float) -> Column:
    both = overlap(s1, e1, s2, e2)
    return (both >= share * (e1 - s1)) & (both >= share * (e2 - s2)) & (both > 0)


def chain_repr(chain: Column) -> Column:
    return F.array_join(F.transform(chain, lambda j: F.concat_ws("-", j["donor"].cast("string"), j["acceptor"].cast("string"))), ";")


def support(n_mols: Column, n_reads: Column) -> Column:
    """Molecules where they are counted, else reads."""
    return F.when(n_mols > 0, n_mols).otherwise(n_reads)


def more_distal(a: Column, b: Column, strand: Column) -> Column:
    return F.when(strand == "-", a < b).otherwise(a > b)


def flanks(pos: Column, strand: Column, window: int) -> Column:
    """Transcript-oriented windows before and after a position: struct(us, ue, ds, de)."""
    left, right = (F.greatest(pos - window, F.lit(0)), pos), (pos, pos + window)
    pick = lambda a, b: F.when(strand == "-", b).otherwise(a)
    return F.struct(pick(left[0], right[0]).alias("us"), pick(left[1], right[1]).alias("ue"), pick(right[0], left[0]).alias("ds"), pick(right[1], left[1]).alias("de"))


def retained_intron_rank(chain: Column, retained: Column) -> Column:
    """Place from 0, from the 5' end, of the first intron of a chain that is retained; the chain's length if none of them is its own, -1 without any."""
    places = F.array_min(F.transform(retained, lambda j: F.coalesce(F.nullif(F.array_position(chain, j), F.lit(0)) - 1, F.size(chain).cast("long"))))
    return F.when(F.size(retained) == 0, F.lit(-1)).otherwise(places).cast("long")
