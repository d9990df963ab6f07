"""Operators on small rows, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import chains as C
from strandloom.operators import ends as E
from strandloom.operators import evidence as X
from strandloom.operators import joins as J
from strandloom.operators import junctions as N
from strandloom.operators import models as M
from strandloom.operators import molecules as U
from strandloom.operators import scoring as Z

CHAIN = "array<struct<donor:bigint,acceptor:bigint>>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_interval_join_meets_each_pair_once(spark):
    rng = random.Random(4)
    a = [(i, 1, s := rng.randrange(5000), s + rng.randrange(1, 900)) for i in range(80)]
    b = [(i, 1, s := rng.randrange(5000), s + rng.randrange(1, 900)) for i in range(80)]
    for slack in (0, 7):
        got = J.interval_join(spark.createDataFrame(a, "i long, k long, s long, e long"), spark.createDataFrame(b, "j long, k long, rs long, re long"), ["k"], 256, slack).select("i", "j")
        assert rows(got) == sorted((x[0], y[0]) for x in a for y in b if x[2] - slack < y[3] and y[2] < x[3] + slack)


@pytest.mark.parametrize("tol", [0, 5])
def test_nearest_within(spark, tol):
    p = [("c", x) for x in range(0, 60, 3)]
    s = [("c", x) for x in (4, 10, 11, 40, 44, 50)]
    got = {r.pos: r.site for r in J.nearest_within(spark.createDataFrame(p, "c string, pos long"), spark.createDataFrame(s, "c string, site long"), ["c"], tol).collect()}
    for _, x in p:
        near = [v for _, v in s if abs(v - x) <= tol]
        assert got[x] == (min(near, key=lambda v: (abs(v - x), v)) if near else None)


def test_nearest_any_over_range_edges(spark):
    rng = random.Random(1)
    p = [("c", rng.randrange(5 << 20)) for _ in range(60)] + [("d", 5)]
    s = [("c", rng.randrange(5 << 20)) for _ in range(9)]
    got = {(r.c, r.pos): r.site for r in J.nearest_any(spark.createDataFrame(p, "c string, pos long"), spark.createDataFrame(s, "c string, site long"), ["c"]).collect()}
    for c, x in p:
        assert got[(c, x)] == (min((v for _, v in s), key=lambda v: (abs(v - x), v)) if c == "c" else None)


def test_interval_union_joins_touching(spark):
    got = J.interval_union(spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 12, 20), ("a", 13, 14), ("b", 1, 2)], "g string, s long, e long"), ["g"])
    assert rows(got.select("g", "s", "e")) == [("a", 0, 9), ("a", 12, 20), ("b", 1, 2)]


def test_umi_merge_is_directional_and_of_depth_one(spark):
    assert U.merge_cell({"AA": 10, "AC": 5, "CC": 3}) == {"AA": "AA", "AC": "AA", "CC": "CC"}
    assert U.merge_cell({"AA": 3, "AC": 3}) == {"AA": "AA", "AC": "AC"}
    assert U.merge_cell({"AA": 1, "AC": 1}) == {"AA": "AA", "AC": "AA"}
    reads = [("k", "c1", "AA")] * 10 + [("k", "c1", "AC")] * 2 + [("k", "c2", "GG"), ("k", None, "TT"), ("k", "c3", None)]
    got = U.collapse_umis(spark.createDataFrame(reads, "k string, cell string, umi string"), ["k"])
    assert rows(got) == [("k", "c1", "AA", 12), ("k", "c2", "GG", 1)]


def groups(spark, spec):
    """spec: {chain as a string of digits: (support, annotated, tss_evidence)}"""
    data = [(1, "+", [(int(k) * 1000, int(k) * 1000 + 500) for k in c], s, s, s, i, a, s, t, "g", True) for i, (c, (s, a, t)) in enumerate(spec.items())]
    return spark.createDataFrame(data, f"contig long, strand string, chain {CHAIN}, n_reads long, n_mols long, n_cells long, first_read long, annotated boolean, support long, tss_evidence boolean, gene_id string, candidate boolean")


def named(df):
    back = lambda c: None if c is None else "".join(str(j.donor // 1000) for j in c)
    return {back(r.chain): (r.merge_class, back(r.target)) for r in df.collect()}


def test_suffix_decisions_in_order(spark):
    got = named(
        C.resolve_suffixes(
            groups(
                spark,
                {
                    "1234": (100, True, False),
                    "234": (500, False, False),
                    "34": (50, False, True),
                    "56": (10, False, False),
                    "6": (40, False, False),
                    "789": (90, False, False),
                    "89": (20, False, False),
                    "9": (80, False, False),
                },
            )
        )
    )
    assert got["234"] == ("truncation_of_annotated_parent", "1234")
    assert got["34"] == ("alt_tss_kept", None)
    assert got["6"] == ("dominant_kept", None)
    assert got["89"] == ("debris", "789")
    assert got["9"] == ("ambiguous", None)
    assert "1234" not in got and "789" not in got


def test_rehoming(spark):
    g = groups(spark, {"12": (50, False, False), "32": (50, False, False), "2": (2, False, False), "45": (9, False, False), "5": (1, False, False), "7": (1, False, False)})
    g = g.withColumn("candidate", F.col("support") > 5)
    got = named(C.rehome(g, C.resolve_suffixes(g.where("candidate"))))
    assert got == {"2": ("dropped_ambiguous", None), "5": ("subthreshold_merge", "45"), "7": ("dropped_no_parent", None)}


def brute_peaks(hist, w):
    left, out = dict(hist), {}
    n = 0
    while left:
        best = max(left, key=lambda p: (sum(x for q, x in left.items() if abs(q - p) <= w), -p))
        for q in [q for q in left if abs(q - best) <= w]:
            out[q] = n
            del left[q]
        n += 1
    return out


def test_greedy_peaks_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        hist = {rng.randrange(300): rng.randrange(1, 9) for _ in range(rng.randrange(1, 40))}
        pos = np.array(sorted(hist))
        label, peaks, _, _ = E.greedy_peaks(pos, np.array([hist[p] for p in pos], float), 15)
        want = brute_peaks(hist, 15)
        assert {int(p): int(x) for p, x in zip(pos, label, strict=True)} == want
        assert len(peaks) == max(want.values()) + 1


def test_weighted_median_and_seed(spark):
    h = spark.createDataFrame([("k", 1, 1.0), ("k", 5, 1.0), ("k", 9, 2.0)], "k string, pos long, w double")
    assert rows(E.weighted_median(h, ["k"])) == [("k", 5)]
    assert rows(E.peak_seed(h, ["k"], 4)) == [("k", 5, 4.0)]


def test_pruning_keeps_what_earned_its_place(spark):
    def variants(*v):
        return spark.createDataFrame([("c", "+", f"m{i}", *x) for i, x in enumerate(v)], "c string, strand string, model_id string, three long, n_mols long, n_reads long, end_annotated boolean, at_polya_site boolean, step_supported boolean, dispersion double")

    got = {r.model_id: (r.absorbed_into, r.tier) for r in E.prune_terminal(variants((1000, 50, 60, True, False, None, 3.0), (900, 90, 95, False, False, None, 40.0), (800, 5, 5, False, False, None, 2.0)), ["c"]).collect()}
    assert got == {"m0": (None, "annotated"), "m1": ("m0", None), "m2": (None, "high")}
    got = {r.model_id: (r.absorbed_into, r.tier) for r in E.prune_terminal(variants((1000, 50, 60, False, False, None, 40.0), (900, 20, 20, False, False, None, 40.0), (800, 30, 30, False, None, None, None)), ["c"]).collect()}
    assert got == {"m0": (None, "unsupported"), "m1": ("m0", None), "m2": (None, "unsupported")}
    got = {r.model_id: (r.absorbed_into, r.candidate_share, r.tier) for r in E.prune_terminal(variants((1000, 10, 10, False, False, None, 3.0), (900, 90, 90, False, False, None, 40.0), (800, 30, 30, False, False, None, 3.0)), ["c"]).collect()}
    assert got["m1"] == ("m0", None, None) and got["m0"][1] == pytest.approx(100 / 130) and got["m2"][1] == pytest.approx(30 / 130)
    assert (got["m0"][2], got["m2"][2]) == ("high", "reported")  # of what is left after absorption


def test_site_seeds_prefer_support_then_left():
    assert N.seed_sites([(100, 9), (103, 5), (110, 8), (106, 1)], 5) == {100: 100, 103: 100, 110: 110, 106: 110}
    assert N.seed_sites([(100, 9), (108, 9), (104, 1)], 5)[104] == 100


def test_snap_map_prefers_annotation(spark):
    j = spark.createDataFrame([(1, "+", 1002, 1500, 9), (1, "+", 5000, 5500, 9), (1, "+", 5003, 5500, 2)], "contig long, strand string, donor long, acceptor long, n_reads long")
    a = spark.createDataFrame([(1, "+", 1000, 1500)], "contig long, strand string, donor long, acceptor long")
    assert rows(N.snap_map(j, a, "donor").select("pos", "to")) == [(1002, 1000), (5000, 5000), (5003, 5000)]


def test_curation_null_is_no_opinion(spark):
    f = spark.createDataFrame([(1, 9, 9, 0.5, False, "unknown", None, None, None), (2, 9, 9, 0.5, False, "canonical", 9, 0, 0.9), (3, 1, 1, 0.0, True, "antisense", 20, 0, 0.9)], "id long, n_mols long, n_reads long, min_site_share double, annotated boolean, motif_class string, direct_repeat int, sr_n_libs int, lfdr double")
    assert {r.id: r.drop_reason for r in N.curate(f).collect()} == {1: None, 2: "rt_switch_repeat", 3: None}


def models(spark, spec):
    data = [(k, 1, "+", [(d, a) for d, a in c], [(s, e) for s, e in x], n, cat) for k, (c, x, n, cat) in spec.items()]
    return spark.createDataFrame(data, f"model_id string, contig long, strand string, chain {CHAIN}, exons array<struct<s:bigint,e:bigint>>, support long, category string")


def test_fragments_and_where_their_reads_go(spark):
    a = ([(1200, 2000), (2100, 3000), (3100, 4000)], [(1000, 1200), (2000, 2100), (3000, 3100), (4000, 4600)])
    m = models(
        spark,
        {
            "whole": (*a, 100, "NIC"),
            "part": ([(2103, 3001)], [(2000, 2103), (3001, 3090)], 40, "NIC"),
            "inner": ([], [(2010, 2090)], 3, "NIC"),
            "fsm": ([(2100, 3000)], [(2000, 2100), (3000, 3090)], 1, "FSM"),
            "early": ([(2100, 3000)], [(1500, 2100), (3000, 3090)], 1, "NIC"),
            "heavy": ([(3100, 4000)], [(3000, 3100), (4000, 4500)], 60, "NIC"),
        },
    )
    got = M.fragments(m)
    assert rows(got) == [("inner", "whole"), ("part", "whole")]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "model_id string, container string")
    assert {r.model_id: r.target for r in M.surviving_targets(chain).collect()} == {"a": "d", "b": "d", "c": "d", "x": "y"}


def test_fragments_match_the_plain_definition(spark):
    rng = random.Random(20)
    spec = {}
    for i in range(70):
        k0, n = rng.randrange(6), rng.randrange(1, 5)
        c = [(1000 * k + 200 + rng.choice([0, 0, 4]), 1000 * (k + 1) + rng.choice([0, 0, -4])) for k in range(k0, k0 + n)]
        lo, hi = c[0][0] - rng.randrange(20, 190), c[-1][1] + rng.randrange(20, 190)
        starts, ends = [lo] + [x[1] for x in c], [x[0] for x in c] + [hi]
        spec[f"m{i:02d}"] = (c, list(zip(starts, ends, strict=True)), rng.randrange(1, 60), "NIC")
    got = dict(rows(M.fragments(models(spark, spec))))

    def holds(b, a):
        (ac, ax, an, _), (bc, bx, bn, _) = spec[a], spec[b]
        return len(ac) < len(bc) and bn >= 2 * an and any(all(abs(x - y) <= 5 for p, q in zip(ac, bc[k : k + len(ac)], strict=True) for x, y in zip(p, q, strict=True)) and ax[0][0] >= bx[k][0] - 50 and ax[-1][1] <= bx[k + len(ac)][1] + 50 for k in range(len(bc) - len(ac) + 1))

    want = {}
    for a in spec:
        if hits := [b for b in spec if holds(b, a)]:
            want[a] = min(hits, key=lambda b: (-spec[b][2], spec[b][1][0][0], -spec[b][1][-1][1], b))
    assert got == want and want


def test_consolidation_by_rank(spark):
    m = spark.createDataFrame([("k", f"m{i}", 0, t, a, s, 100, 0) for i, (t, a, s) in enumerate([(0, False, 50), (150, True, 10), (320, False, 90), (900, False, 5)])] + [("z", "alone", 0, 5, False, 1, 9, 0)], "k string, model_id string, five long, three long, end_annotated boolean, support long, tx_len long, start long")
    assert {r.model_id: r.representative for r in M.consolidate_ends(m, ["k"]).collect()} == {"m0": "m1", "m1": "m1", "m2": "m1", "m3": "m3", "alone": "alone"}


def test_single_exon_clusters_split_by_overlap(spark):
    r = spark.createDataFrame([(1, 1, "+", 0, 1000, 1000), (2, 1, "+", 100, 1010, 1010), (3, 1, "+", 960, 1020, 1020), (4, 1, "+", 3000, 3500, 3500)], "read_id long, contig long, strand string, start long, end long, tts long")
    parts = {x.read_id: (x.peak, x.part) for x in M.cluster_single_exons(r).collect()}
    assert parts[1] == parts[2] and parts[4] != parts[1]


def brute_match(three, sample, tol):
    free, group, n = set(range(len(three))), {}, 0
    while free:
        best = None
        for c in free:
            pick = {}
            for i in free:
                d = abs(three[i] - three[c])
                if d <= tol and (sample[i] not in pick or (d, three[i], i) < pick[sample[i]]):
                    pick[sample[i]] = (d, three[i], i)
            key = (-len(pick), sum(v[0] for v in pick.values()), three[c])
            if best is None or key < best[0]:
                best = (key, [v[2] for v in pick.values()])
        for i in best[1]:
            group[i] = n
            free.discard(i)
        n += 1
    return group


def test_matching_takes_one_model_of_each_sample():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(1, 14)
        three = sorted(rng.choices(range(300), k=n))
        sample = [rng.choice("abc") for _ in range(n)]
        got, want = X.match_models(three, sample, 60), brute_match(three, sample, 60)
        parts = lambda g: {tuple(i for i in range(n) if g[i] == k) for k in set(g[i] for i in range(n))}
        assert parts(got) == parts(want)
        assert all(len({sample[i] for i in p}) == len(p) for p in parts(got))


def test_structures_of_a_table_are_those_of_its_blocks(spark):
    rng = random.Random(12)
    models = [(rng.choice("abc"), f"m{i}", "c", "+", [(100, 200)], rng.randrange(5000)) for i in range(60)]
    got = {r.model_id: r.structure for r in X.structural_match(spark.createDataFrame(models, f"sample string, model_id string, contig string, strand string, chain {CHAIN}, three long"), 80).collect()}
    order = sorted(models, key=lambda m: (m[5], m[0], m[1]))
    want = X.match_models([m[5] for m in order], [m[0] for m in order], 80)
    parts = lambda f: {frozenset(m[1] for j, m in enumerate(order) if f(j) == k) for k in {f(j) for j in range(len(order))}}
    assert parts(lambda j: got[order[j][1]]) == parts(lambda j: want[j])


def test_looser_tolerance_never_makes_more_structures():
    rng = random.Random(8)
    three = sorted(rng.sample(range(2000), 40))
    sample = [rng.choice("ab") for _ in range(40)]
    counts = [len(set(X.match_models(three, sample, t))) for t in (0, 20, 50, 100, 400)]
    assert counts == sorted(counts, reverse=True)


def test_ridge_and_local_fdr():
    rng = np.random.default_rng(0)
    x = np.c_[np.ones(400), rng.normal(size=(400, 2))]
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 1] - 0.5)))).astype(float)
    w = Z.ridge_logistic(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (y - p) - np.r_[0, w[1:]]).max() < 1e-4  # the penalised gradient is zero
    assert Z.falling(np.array([3.0, 1, 2, 0]), np.ones(4)).tolist() == [3, 1.5, 1.5, 0]
    real, fake = rng.normal(3, 1, 500), rng.normal(-1, 1, 500)
    lf, pi0 = Z.local_fdr(np.r_[real, fake], rng.normal(-1, 1, 400))
    assert 0.3 < pi0 < 0.7 and lf[:500].mean() < 0.1 < 0.8 < lf[500:].mean()
    order = np.argsort(np.r_[real, fake])
    assert (np.diff(lf[order]) <= 1e-12).all()
    assert np.isnan(Z.local_fdr(real, fake[:5])[0]).all()


def test_scores_are_null_without_anchors(spark):
    f = spark.createDataFrame([(1, "a", 1.0, True, False, True, 0), (1, "b", 2.0, False, True, False, 0)], "contig long, id string, x double, positive boolean, decoy boolean, exempt boolean, stratum int")
    assert [(r.score, r.lfdr) for r in Z.score(f, ["x"]).collect()] == [(None, None)] * 2


def test_results_do_not_depend_on_partitions(spark):
    from strandloom.plans import chain_queries

    seen = set()
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(rows(chain_queries.suffix_resolution_class(spark, "/root/testdata/sf0.001"))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_sites_merge_across_ranges(spark):
    j = spark.createDataFrame([("c", "+", p, p + 500, n) for p, n in ((999_999, 9), (1_000_001, 3), (1_048_575, 2), (1_048_577, 8), (2_097_150, 1), (2_097_152, 1), (2_097_154, 1))], "contig string, strand string, donor long, acceptor long, n_reads long")
    a = j.limit(0)
    assert rows(N.snap_map(j, a, "donor").select("pos", "to")) == [(999_999, 999_999), (1_000_001, 999_999), (1_048_575, 1_048_577), (1_048_577, 1_048_577), (2_097_150, 2_097_150), (2_097_152, 2_097_150), (2_097_154, 2_097_150)]


def test_runs_by_gap_against_a_walk(spark):
    rng = random.Random(5)
    pos = {k: sorted(rng.sample(range(4000), 300)) for k in "ab"}
    got = {(r.k, r.p): r._run for r in J.runs_by_gap(spark.createDataFrame([(k, p) for k in pos for p in pos[k] * 2], "k string, p long"), ["k"], "p", 12, span=50).collect()}
    for k, ps in pos.items():
        first = ps[0]
        for before, p in zip([ps[0], *ps], ps, strict=False):
            first = p if p - before > 12 else first
            assert got[(k, p)] == first


def test_numbers_follow_the_order(spark):
    values = [f"v{i:04d}" for i in range(500)]
    got = {r.v: r.n for r in J.numbered(spark.createDataFrame([(v,) for v in values * 3], "v string").repartition(7), "v", "n").collect()}
    assert got == {v: i + 1 for i, v in enumerate(values)}


def test_molecules_of_groups_are_those_of_the_matrix(spark):
    rng = random.Random(3)
    reads = [(i, "c", "+", [(100, 200)] if i % 3 else [(100, 200), (300, 400)], rng.choice(["x", "y", None]), rng.choice([None, "AA", "AC", "AT", "GG", "GC", "AAA"]), rng.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(reads, f"read_id long, contig string, strand string, chain {CHAIN}, cell string, umi string, tss long")
    got = {len(r.chain): (r.n_reads, r.n_mols, r.n_cells, r.first_read, r.five) for r in C.chain_groups(df).collect()}
    for n in (1, 2):
        mine = [r for r in reads if len(r[3]) == n]
        mols = 0
        for cell in "xy":
            counts = {}
            for r in mine:
                if r[4] == cell and r[5]:
                    counts[r[5]] = counts.get(r[5], 0) + 1
            mols += len(set(U.merge_cell(counts).values()))
        assert got[n] == (len(mine), mols, 2, min(r[0] for r in mine), min(r[6] for r in mine))
    pair = [(i, "c", "+", [(1, 2)], "x", "AAAA" if i < 10 else "AAAC", 5) for i in range(12)]
    assert C.chain_groups(spark.createDataFrame(pair, df.schema)).first().n_mols == 1


def plain_displaced(chain, reference, tol, most):
    """By the rule, junction by junction: (novel, known, swallowed) or None."""
    r, novel, known = 0, [], []
    for d, a in chain:
        if r >= len(reference):
            return None
        rd, ra = reference[r]
        if abs(d - rd) <= tol and abs(a - ra) <= tol:
            r += 1
            continue
        ends = [s for s in range(r, len(reference)) if (abs(d - rd) <= tol and 0 < reference[s][1] - a <= most) or (abs(a - reference[s][1]) <= tol and 0 < d - rd <= most)]
        if not ends:
            return None
        novel.append((d, a))
        known += reference[r : ends[0] + 1]
        r = ends[0] + 1
    return (novel, known) if r == len(reference) else None


def test_displaced_reading_by_the_rule(spark):
    rng = random.Random(21)
    pairs = []
    for i in range(300):
        at, ref = 100, []
        for _ in range(rng.randrange(1, 6)):
            ref.append((at, at + rng.randrange(60, 200)))
            at = ref[-1][1] + rng.choice([4, 8, 50])
        chain, k = [], 0
        while k < len(ref):
            to = min(len(ref) - 1, k + rng.choice([0, 0, 0, 1, 2]))
            d, a = ref[k][0], ref[to][1]
            kind = rng.randrange(5)
            chain.append((d + (rng.randrange(1, 34) if kind == 0 else rng.randrange(-2, 3) if kind == 1 else 0), a - (rng.randrange(1, 34) if kind == 2 else 0)))
            k = to + 1
        pairs.append((i, chain, ref))
    df = spark.createDataFrame(pairs, f"i int, chain {CHAIN}, reference {CHAIN}")
    got = {r.i: r.x for r in df.select("i", X.displaced(F.col("chain"), F.col("reference"), 2, 30).alias("x")).collect()}
    found = 0
    for i, chain, ref in pairs:
        want = plain_displaced(chain, ref, 2, 30)
        if want is None:
            assert got[i] is None
        else:
            found += bool(want[0])
            assert ([tuple(j) for j in got[i].novel], [tuple(j) for j in got[i].known]) == want
            assert got[i].swallowed == len(want[1]) - len(want[0])
    assert found > 40


def test_displaced_junction(spark):
    # the first chain's second junction jumps over a short exon, with its donor in place
    chains = spark.createDataFrame([("r", "g", [(100, 200), (300, 395)]), ("both", "g", [(100, 200), (312, 395)]), ("k", "g", [(100, 200)]), ("same", "g", [(100, 200), (300, 310), (320, 400)])], f"chain_id string, gene_id string, chain {CHAIN}")
    tx = spark.createDataFrame([("t", "g", [(100, 200), (300, 310), (320, 400)])], f"tx_id string, gene_id string, chain {CHAIN}")
    sj = spark.createDataFrame([("g", 300, 310, 20), ("g", 320, 400, 20), ("g", 300, 395, 0)], "gene_id string, donor long, acceptor long, uniq long")
    plan = X.displaced_junction_plan(chains, tx, sj, tol=3)
    assert [(r.chain_id, r.tx_id, r.n_displaced, r.n_swallowed) for r in plan.collect()] == [("r", "t", 1, 1)]
    for uniq in (sj.withColumn("uniq", F.lit(1).cast("long")), sj.where("acceptor <> 395")):  # support for it, or nobody looked
        assert rows(X.displaced_junction_plan(chains, tx, uniq, tol=3)) == []
    groups = chains.withColumns({"contig": F.lit("c"), "strand": F.lit("+")})
    assert rows(X.substitute(groups, plan)) == [("r", "substituted", "same")]
    assert rows(X.substitute(groups.where("chain_id <> 'same'"), plan)) == []


def test_sole_annotated_agreement_and_continuity(spark):
    j = spark.createDataFrame([("c", "+", 100, 200, 1), ("c", "+", 300, 400, 1), ("c", "+", 500, 600, 0)], "contig string, strand string, donor long, acceptor long, annotated long")
    known = spark.createDataFrame([("c", "+", 100, 200), ("c", "+", 301, 400)], "contig string, strand string, donor long, acceptor long")
    a = X.agreement(j, known).first()
    assert (a.n_annotated, a.n_agreeing, a.agreement, a.ok) == (2, 1, 0.5, False)
    assert X.agreement(j, known.withColumn("donor", F.col("donor") - (F.col("donor") % 100))).first().ok
    track = spark.createDataFrame([("c", 0, 10, 4.0), ("c", 10, 30, 1.0)], "contig string, start long, end long, value double")
    m = spark.createDataFrame([("m", "c", [(0, 10), (20, 30), (900, 950)]), ("n", "c", [(900, 950)])], "id string, contig string, exons array<struct<s:bigint,e:bigint>>")
    assert {r.id: r.coverage for r in X.continuity(m, track).collect()} == {"m": 2.5, "n": None}
    peaks = spark.createDataFrame([("c", "+", 10, 20, 10, "a"), ("c", "+", 10, 20, 10, "b")], "contig string, strand string, start long, end long, rep long, name string")
    names = spark.createDataFrame([("a", 15), ("b", 99)], "name string, rep long")
    assert {r.name: r.rep for r in X.with_representatives(peaks, names).collect()} == {"a": 15, "b": 10}
    hits = spark.createDataFrame([("x", "none", 10), ("x", "zmw", 30), ("y", "zmw", 5), ("z", "strip_ccs", 4), ("z", "zmw", 4)], "column string, mode string, hits long")
    assert {(r.column, r.mode) for r in X.safe_modes(hits).where("unsafe").collect()} == {("x", "zmw"), ("y", "zmw")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_name_hits_counts_before_it_joins(spark):
    # a value that fills a column is one row of a task when names meet; all readings meet in one join
    t = spark.createDataFrame([("r/1/ccs/0_5", "r/1", "N")] * 3 + [("r/1/ccs", None, "N"), ("r/9/ccs/1_2", "r/2", "N")], "a string, b string, c string")
    names = spark.createDataFrame([("r/1/ccs",), ("r/1/ccs",), ("r/2/ccs",), (None,)], "read_name string")
    got = X.name_hits(t, ["a", "b", "c"], names, ["none", "strip_segment", "strip_ccs", "zmw"])
    assert rows(got.select("column", "mode", "hits")) == [("a", "none", 1), ("a", "strip_ccs", 4), ("a", "strip_segment", 4), ("a", "zmw", 4), ("b", "strip_ccs", 4), ("b", "zmw", 4)]
    assert plan_of(got).count("Join ") == 1


def test_each_query_groups_the_reads_once(spark, monkeypatch):
    from strandloom.plans import chain_queries as Q

    g = groups(spark, {"12": (50, False, False), "32": (50, False, False), "2": (2, False, False), "45": (9, False, False), "5": (1, False, False), "7": (1, False, False)}).withColumn("candidate", F.col("support") > 5)
    calls = []
    monkeypatch.setattr(Q, "marked", lambda spark, d: calls.append(1) or g)
    monkeypatch.setattr(Q, "with_tss", lambda df, spark, d: df)
    monkeypatch.setattr(Q.V, "reads", lambda spark, d: g.select(F.col("first_read").alias("read_id"), "contig", "strand", "chain"))
    got = {r.chain: (r.merge_class, r.target) for r in Q.subthreshold_rehome(spark, "").collect()}
    assert got["5000-5500"] == ("subthreshold_merge", "4000-4500;5000-5500") and got["7000-7500"] == ("dropped_no_parent", None)
    assert len(calls) == 1
    got = {r.root: (r.n_reads, r.exact_fraction) for r in Q.exact_chain_fraction(spark, "").collect()}
    assert len(calls) == 2 and got["4000-4500;5000-5500"] == (2, 0.5) and sum(n for n, _ in got.values()) == 6


@pytest.mark.parametrize("strict, least, most", [(True, 10, 40), (False, 10, 40), (False, 6, 12), (False, 0, 99)])
def test_hexamers_by_the_rule(spark, strict, least, most):
    from strandloom.functions import sequence as S

    rng = random.Random(3)
    seqs = ["".join(rng.choice("AAAATTGC") for _ in range(n)) for n in range(60) for _ in range(4)]

    def brute(s):
        for m in S.STRICT_HEXAMERS if strict else S.HEXAMERS:
            for i in range(len(s) - 5):
                if s[i : i + 6] == m and least <= len(s) - i <= most:
                    return m, len(s) - i
        return None

    df = spark.createDataFrame([(s,) for s in [*seqs, None]], "s string").select("s", S.polya_motif(F.col("s"), strict, least, most).alias("m"))
    assert all((r.m and tuple(r.m)) == (None if r.s is None else brute(r.s)) for r in df.collect())
    assert "lambda" not in plan_of(df)  # no walk over positions in array functions, which run a node at a time


def test_single_exon_rules_meet_a_gene_in_one_row(spark):
    from strandloom.operators import singles as O

    fields = {"d_site": "long", "d_tts": "long", "dispersion": "double", "motif_found": "boolean", "internal_priming": "boolean", "polya_supported": "boolean", "tail_share": "double", "step_supported": "boolean"}
    data = [(1, "g", 120, 180, 180, 0.9), (2, "g", 380, 480, 480, 0.9), (3, "g", 900, 950, 1010, 0.9), (4, "g", 120, 180, 180, 0.1), (5, None, 120, 180, 180, 0.9), (6, "x", 120, 180, 180, 0.9)]
    c = spark.createDataFrame([(*r, 20, 5, 4) for r in data], "id long, gene_id string, s long, e long, three long, in_terminal double, n_reads long, n_mols long, n_cells long").withColumns({"in_utr3": F.lit(0.0), **{k: F.lit(None).cast(t) for k, t in fields.items()}})
    c = c.withColumn("step_supported", F.col("id") != 2)
    m = spark.createDataFrame([("g", "b", 100, 400, 400, 2), ("g", "a", 110, 420, 420, 3), ("g", "z", 0, 460, 1000, 1), ("g", "n", 500, 1000, 1020, 4), (None, "u", 100, 400, 180, 0)], "gene_id string, model_id string, s long, e long, three long, place long")
    got = O.judge(c, m)
    assert {r.id: (r.category, r.outcome, r.target) for r in got.collect()} == {
        1: ("monoexon_3UTR", "demoted_fragment", "z"),
        2: ("monoexon_3UTR", "sr_continuation", "z"),
        3: ("monoexon_3UTR", "demoted_fragment", "n"),
        4: ("monoexon_internal", "no_polya", None),
        5: ("monoexon_intergenic", "no_polya", None),
        6: ("monoexon_3UTR", "kept", None),
    }
    assert plan_of(got).count("Join ") == 1  # a gene's models as one row: nothing is grouped back by cluster


def test_single_exon_reads_are_found_once(spark, monkeypatch):
    from strandloom.plans import junction_queries as Q
    from strandloom.plans import model_queries as MQ

    r = spark.range(1, 3).select(F.col("id").alias("read_id"), (F.col("id") * 0).alias("contig"), F.lit("+").alias("strand"), F.when(F.col("id") == 1, 1600).otherwise(90_000).cast("long").alias("start"), F.when(F.col("id") == 1, 1900).otherwise(90_100).cast("long").alias("end"))
    monkeypatch.setattr(Q.V, "mono_reads", lambda spark, d: r)
    classes = MQ.monoexon_class(spark, "")
    assert rows(classes.select("model_id", "gene_id", "class"))[0][:2] == (1, "g1.0p") and "Range (" not in plan_of(classes)
    got = Q.gene_assignment_max_overlap(spark, "")
    assert rows(got.select("read_id", "gene_id", "overlap_bp")) == [(1, "g1.0p", 300), (2, None, None)]
    assert "strategy=broadcast" in plan_of(got)


def test_snap_map_reads_the_junctions_once(spark, monkeypatch):
    from strandloom.plans import junction_queries as Q

    census = spark.range(4).select((F.col("id") * 0 + 1).alias("contig"), F.lit("+").alias("strand"), (F.col("id") * 3 + 1000).alias("donor"), (F.col("id") * 3 + 1500).alias("acceptor"), (F.col("id") + 1).alias("n_reads"))
    monkeypatch.setattr(Q, "junction_census", lambda spark, d: census)
    got = Q.splice_site_snap_map(spark, "")
    assert "Range (" not in plan_of(got)
    assert rows(got.where("site = 'donor'").select("pos", "to")) == [(1000, 1003), (1003, 1003), (1006, 1009), (1009, 1009)]
