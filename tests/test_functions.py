"""Interval and sequence expressions against plain Python."""

from pyspark.sql import functions as F

from strandloom.functions import intervals as I
from strandloom.functions import sequence as S


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def js(*pairs):
    return F.array(*[F.struct(F.lit(a).cast("long").alias("donor"), F.lit(b).cast("long").alias("acceptor")) for a, b in pairs]).cast("array<struct<donor:bigint,acceptor:bigint>>")


def xs(*pairs):
    return F.array(*[F.struct(F.lit(a).cast("long").alias("s"), F.lit(b).cast("long").alias("e")) for a, b in pairs])


def test_chain_is_in_transcript_order_on_both_strands(spark):
    e = xs((10, 20), (30, 40), (50, 60))
    r = one(spark, p=I.chain_repr(I.exons_to_chain(e, F.lit("+"))), m=I.chain_repr(I.exons_to_chain(e, F.lit("-"))), one=F.size(I.exons_to_chain(xs((1, 2)), F.lit("+"))))
    assert (r.p, r.m, r.one) == ("20-30;40-50", "40-50;20-30", 0)


def test_suffix_rules(spark):
    a, b, none = js((40, 50)), js((20, 30), (40, 50)), js()
    r = one(spark, yes=I.is_suffix(a, b), same=I.is_suffix(b, b), empty=I.is_suffix(none, b), other=I.is_suffix(js((20, 30)), b), n=F.size(I.proper_suffixes(b)), n1=F.size(I.proper_suffixes(a)))
    assert (r.yes, r.same, r.empty, r.other, r.n, r.n1) == (True, False, False, False, 1, 0)


def test_exons_are_rebuilt_and_ends_clamped(spark):
    r = one(spark, x=I.build_exons(js((20, 30), (40, 50)), F.lit("+"), F.lit(10).cast("long"), F.lit(60).cast("long")), y=I.build_exons(js((20, 30)), F.lit("-"), F.lit(25).cast("long"), F.lit(22).cast("long")))
    assert [tuple(e) for e in r.x] == [(10, 20), (30, 40), (50, 60)]
    assert all(e.s < e.e for e in r.y)


def test_lengths_overlaps_and_ends(spark):
    a, b = xs((0, 10), (20, 30)), xs((5, 25))
    r = one(spark, n=I.exonic_length(a), sp=I.span(a), o=I.total_overlap(a, b), t5=I.tss_of(a, F.lit("-")), t3=I.tts_of(a, F.lit("-")), down=I.exonic_bases_downstream(a, F.lit("+"), F.lit(25)), up=I.exonic_bases_downstream(a, F.lit("-"), F.lit(25)), d=I.signed_offset(F.lit(5), F.lit(9), F.lit("-")))
    assert (r.n, r.sp, r.o, r.t5, r.t3, r.down, r.up, r.d) == (20, 30, 10, 30, 0, 5, 15, 4)


def test_subchains_and_gaps(spark):
    ref, part, hop = js((100, 200), (300, 400), (500, 600)), js((302, 399)), js((100, 200), (500, 600))
    r = one(spark, k=I.subchain_offsets(part, ref, 5), k0=I.subchain_offsets(part, ref, 1), g=I.subsequence_gaps(hop, ref, 0), no=I.subsequence_gaps(js((1, 2)), ref, 0), eq=I.chains_equal(js((102, 198)), js((100, 200)), 2), kept=F.size(I.retained_introns(xs((90, 410)), ref, 10)), kept0=F.size(I.retained_introns(xs((90, 410)), ref, 11)))
    assert r.k == [1] and r.k0 == [] and r.no is None and r.eq and r.kept == 2 and r.kept0 == 0
    assert [tuple(j) for j in r.g.internal] == [(300, 400)] and (r.g.miss_left, r.g.miss_right) == (0, 0)


def test_sequences(spark):
    r = one(
        spark,
        rc=S.revcomp(F.lit("aacgt")),
        a=S.percent_of(F.lit("AATA"), "A"),
        none=S.percent_of(F.lit(""), "A"),
        run=S.longest_run(F.lit("CAATAAAG")),
        lead=S.leading_run(F.lit("AACA")),
        rep=S.direct_repeat_len(F.lit("TTACG"), F.lit("GGACG")),
        m=S.motif_class(F.lit("GC-AG")),
        short=S.splice_motif(F.lit("GT"), F.lit("AG"), F.lit(3)),
        zmw=S.normalise_name(F.lit("m/12/ccs/1_2"), "zmw"),
        ccs=S.normalise_name(F.lit("m/12/ccs/1_2"), "strip_ccs"),
        seg=S.normalise_name(F.lit("m/12/ccs/1_2"), "strip_segment"),
        nb=S.umi_neighbours(F.lit("AC")),
        polya=S.polya_motif(F.lit("ATTAAACCCCAATAAACCCCCCCCCC")),
        far=S.polya_motif(F.lit("AATAAACCC")),
    )
    assert (r.rc, r.a, r.none, r.run, r.lead, r.rep, r.m, r.short) == ("ACGTT", 75.0, 0.0, 3, 2, 3, "semi_canonical", "NN-NN")
    assert (r.zmw, r.ccs, r.seg) == ("m/12", "m/12", "m/12/ccs")
    assert sorted(r.nb) == sorted(["CC", "GC", "TC", "AA", "AG", "AT"])
    assert (r.polya.motif, r.polya.dist) == ("AATAAA", 16) and r.far is None


def test_the_entry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=300)
