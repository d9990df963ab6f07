"""Expressions over sequences, motifs, names and UMIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polyadenylation hexamers in order of priority, and the strict set in its own order.
HEXAMERS = ["AATAAA", "ATTAAA", "AGTAAA", "TATAAA", "CATAAA", "GATAAA", "AATATA", "AATACA", "AATAGA", "AAAAAG", "ACTAAA", "AAGAAA"]
STRICT_HEXAMERS = ["AATAAA", "ATTAAA", "TATAAA", "AGTAAA", "CATAAA", "GATAAA"]


def revcomp(s: Column) -> Column:
    return F.reverse(F.translate(F.upper(s), "ACGT", "TGCA"))


def splice_motif(first_two: Column, last_two: Column, length: Column) -> Column:
    """Of an intron's oriented ends; introns under 4 bases have none."""
    return F.when(length < 4, F.lit("NN-NN")).otherwise(F.concat_ws("-", first_two, last_two))


def motif_class(motif: Column) -> Column:
    return (
        F.when(motif == "GT-AG", "canonical")
        .when(motif.isin("GC-AG", "AT-AC"), "semi_canonical")
        .when(motif.isin("CT-AC", "CT-GC", "GT-AT"), "antisense")
        .otherwise("non_canonical")
    )


def direct_repeat_len(before_donor: Column, before_acceptor: Column, most: int = 20) -> Column:
    """Length of the common suffix of two sequences, at most `most`."""
    same = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: (F.length(before_donor) >= k) & (F.length(before_acceptor) >= k) & (F.substring(before_donor, -k, F.lit(1)) == F.substring(before_acceptor, -k, F.lit(1))))
    first = F.array_position(same, False)
    return F.when(first == 0, F.lit(most)).otherwise(first - 1).cast("int")


def percent_of(s: Column, base: str) -> Column:
    """0 to 100; 0 of an empty sequence."""
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(100.0 * (F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))) / F.length(s))


def polya_motif(upstream: Column, strict: bool = True, least: int = 10, most: int = 40) -> Column:
    """The first hexamer in priority with a hit at an allowed distance, at its leftmost such hit: struct(motif, dist), or null.

    The distance runs from the hexamer's first base to the sequence's end.
    """
    n = F.length(upstream)
    first = F.greatest(n - most + 1, F.lit(1))

    def best(motif: str) -> Column:
        at = F.position(F.lit(motif), upstream, first)  # the leftmost from there on; 0 without one
        return F.when((at > 0) & (at <= n - least + 1), F.struct(F.lit(motif).alias("motif"), (n - at + 1).alias("dist")))

    return F.when(n >= 6, F.coalesce(*map(best, STRICT_HEXAMERS if strict else HEXAMERS)))


def leading_run(s: Column, base: str = "A") -> Column:
    return F.length(F.regexp_extract(s, f"^({base}*)", 1))


def longest_run(s: Column, base: str = "A") -> Column:
    return F.array_max(F.transform(F.split(s, f"[^{base}]"), lambda x: F.length(x)))


def normalise_name(name: Column, how: str) -> Column:
    """Read name to join key: none, strip_segment (trailing /start_end), strip_ccs (trailing /ccs), zmw (movie/hole)."""
    if how == "none":
        return name
    if how == "strip_segment":
        return F.regexp_replace(name, r"/[0-9]+_[0-9]+$", "")
    if how == "strip_ccs":
        return F.regexp_replace(F.regexp_replace(name, r"/[0-9]+_[0-9]+$", ""), "/ccs$", "")
    if how == "zmw":
        return F.substring_index(name, "/", 2)
    raise ValueError(f"unknown normalisation {how!r}")


def umi_neighbours(umi: Column) -> Column:
    """All sequences at Hamming distance 1 over ACGT."""
    places = F.sequence(F.lit(1), F.length(umi))
    one = lambda i: F.filter(F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.when(b != F.substring(umi, i, F.lit(1)), F.concat(F.substring(umi, F.lit(1), i - 1), b, F.substring(umi, i + 1, F.length(umi))))), lambda x: x.isNotNull())
    return F.flatten(F.transform(places, one))


def norm_contig(c: Column) -> Column:
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare.isin("M", "MT"), F.lit("MT")).otherwise(bare)


def canonical_rank(tags: Column, kind: Column) -> Column:
    return (
        F.when(F.array_contains(tags, "MANE_Select"), 0)
        .when(F.array_contains(tags, "Ensembl_canonical"), 1)
        .when((kind == "protein_coding") & F.array_contains(tags, "basic"), 2)
        .when(F.array_contains(tags, "basic"), 3)
        .when(kind.isin("nonsense_mediated_decay", "retained_intron", "processed_transcript"), 8)
        .otherwise(5)
    )


def oriented_window(pos: Column, strand: Column, first: int, last: int) -> Column:
    """struct(s, e): the genomic window of the bases from `first` to before `last` beyond a position, counted downstream (negative: upstream)."""
    minus = strand == "-"
    return F.struct(F.greatest(F.when(minus, pos - last).otherwise(pos + first), F.lit(0)).alias("s"), F.greatest(F.when(minus, pos - first).otherwise(pos + last), F.lit(0)).alias("e"))


def oriented_sequence(s: Column, strand: Column) -> Column:
    """A window's bases read along the transcript."""
    return F.when(strand == "-", revcomp(s)).otherwise(F.upper(s))


def contrast(s: Column) -> Column:
    """(G + T - A) as a share of a sequence; null of an empty one."""
    n = lambda b: F.length(s) - F.length(F.replace(s, F.lit(b), F.lit("")))
    return F.when(F.length(s) > 0, (n("G") + n("T") - n("A")) / F.length(s))
