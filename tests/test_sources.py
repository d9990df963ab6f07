"""Formats, settings and a whole run on planted reads."""

import gzip
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom import cli, config
from strandloom.operators import junctions as N
from strandloom.operators.molecules import merge_cell
from strandloom.plans import catalogue
from strandloom.sources import alignments as A
from strandloom.sources import text as T

GTF = "\n".join(
    ["# a comment"]
    + [f'chr1\tx\texon\t{s}\t{e}\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N"; transcript_type "protein_coding"; tag "basic"; tag "MANE_Select";' for s, e in ((1001, 1200), (2001, 2200), (3001, 3500))]
    + ['chr1\tx\tCDS\t1101\t1200\t.\t+\t0\tgene_id "G1"; transcript_id "T1";', 'chr1\tx\tCDS\t2001\t2100\t.\t+\t0\tgene_id "G1"; transcript_id "T1";', 'chr1\tx\tgene\t1001\t3500\t.\t+\t.\tgene_id "G1";']
    + [f'chr2\tx\texon\t{s}\t{e}\t.\t-\t.\tgene_id "G2"; transcript_id "T2";' for s, e in ((101, 200), (301, 400))]
)


def put(path, text):
    path.write_text(text)
    return str(path)


def test_gtf(spark, tmp_path):
    with gzip.open(tmp_path / "a.gtf.gz", "wt") as f:
        f.write(GTF)
    t = {r.tx_id: r for r in T.annotation(T.read_gtf(spark, str(tmp_path / "a.gtf.gz"))).collect()}
    a, b = t["T1"], t["T2"]
    assert [tuple(x) for x in a.chain] == [(1200, 2000), (2200, 3000)] and (a.tss, a.tts, a.tx_len, a.rank) == (1000, 3500, 900, 0)
    assert (a.start_pos, a.stop_pos, a.utr3_len) == (1100, 2100, 600)
    assert (b.tss, b.tts, b.rank, b.stop_pos) == (400, 100, 5, None)
    assert {r.tx_id for r in T.annotation(T.read_gtf(spark, str(tmp_path / "a.gtf.gz"), ["chr2"])).collect()} == {"T2"}


def test_fasta_and_windows(spark, tmp_path):
    rng = random.Random(2)
    seq = {c: "".join(rng.choice("ACGTacgt") for _ in range(n)) for c, n in (("chr1", 500), ("chr2", 30))}
    p = put(tmp_path / "g.fa", "".join(f">{c} more\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for c, s in seq.items()))
    g = T.read_fasta(spark, p, 64)
    w = [(i, c, s, s + n) for i, (c, s, n) in enumerate([("chr1", 0, 10), ("chr1", 60, 140), ("chr1", 490, 40), ("chr2", 5, 5), ("chr1", -5, 9), ("none", 0, 5)])]
    got = {r.id: r.seq for r in T.fetch(spark.createDataFrame(w, "id long, contig string, s long, e long"), g, 64).collect()}
    assert got == {i: seq.get(c, "")[max(0, s) : max(0, e)].upper() for i, c, s, e in w}


def test_star_bed_cage_bedgraph_umis(spark, tmp_path):
    a = put(tmp_path / "a.tab", "1\t1201\t2000\t1\t1\t1\t40\t3\t30\n1\t4001\t4500\t0\t0\t0\t12\t1\t25\n")
    b = put(tmp_path / "b.tab", "1\t1201\t2000\t1\t1\t1\t2\t0\t12\n")
    j = T.read_star(spark, [a, b])
    assert {(r.strand, r.donor, r.acceptor, r.motif, r.uniq) for r in j.collect()} == {("+", 1200, 2000, "GT-AG", 40), (".", 4000, 4500, "non_canonical", 12), ("+", 1200, 2000, "GT-AG", 2)}
    bed = put(tmp_path / "p.bed", "track x\n#c\n1\t10\t20\tn\t0\t+\n1\t10\t20\tn\t0\t-\n1\t10\t20\tm\t0\t+\n")
    assert sorted((r.strand, r.site) for r in T.read_polya_bed(spark, bed).collect()) == [("+", 20), ("-", 10)]
    cage = put(tmp_path / "c.bed", "chr1\t1000\t1060\ta\t5\t+\t1020\t1021\t0\nchr1\t5000\t5040\tb\t9\t-\nchr1\t9\t20\tc\t1\t+\t50\t51\t0\n")
    assert sorted((r.start, r.rep) for r in T.read_cage_bed(spark, cage, 2).collect()) == [(1000, 1020), (5000, 5039)]
    g = put(tmp_path / "g.bg", "1\t0\t50\t2\n1\t0\t50\t3\n")
    assert [tuple(r) for r in T.read_bedgraph(spark, g).collect()] == [("1", 0, 50, 5.0)]
    u = put(tmp_path / "u.tsv", "cell_barcode\tumi\tread_name\nC1\tACGT\tr1\nC2\n")
    assert [tuple(r) for r in T.read_umis(spark, u).collect()] == [("r1", "C1", "ACGT")]


SAM = "@HD\tVN:1.6\n" + "\n".join(
    [
        "r1\t0\tchr1\t1001\t60\t5S200M800N200M800N500M12S\t*\t0\t0\t" + "C" * 5 + "G" * 900 + "A" * 10 + "CC" + "\t*\tNM:i:0",
        "r2\t16\tchr2\t101\t60\t8S100M100N100M\t*\t0\t0\t" + "T" * 8 + "G" * 200 + "\t*\tNM:i:50",
        "r3\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*",
        "r4\t256\tchr1\t1001\t60\t50M30D50M\t*\t0\t0\t" + "G" * 100 + "\t*\tNM:i:30",
    ]
)


def test_sam_columns_and_gates(spark, tmp_path):
    rows = A.admitted_columns(A.read_sam(spark, put(tmp_path / "a.sam", SAM)))
    got = {r.read_name: r for r in rows.withColumn("reason", N.gate(rows)).collect()}
    a, b, c = got["r1"], got["r2"], got["r4"]
    assert set(got) == {"r1", "r2", "r4"}
    assert [tuple(x) for x in a.chain] == [(1200, 2000), (2200, 3000)] and (a.start, a.end, a.clip5, a.clip3, a.tail_len) == (1000, 3500, 5, 12, 10)
    assert a.reason is None and a.coverage == pytest.approx(900 / 905)
    assert (b.strand, b.tss, b.tts, b.tail_len, b.reason) == ("-", 400, 100, 8, "identity") and [tuple(x) for x in b.chain] == [(200, 300)]
    assert c.reason == "secondary" and [tuple(x) for x in c.gaps] == [(1050, 1080)] and list(c.chain) == []


def bgzf(data):
    out = b""
    for i in [*range(0, len(data), 100), None]:
        part = b"" if i is None else data[i : i + 100]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam_agrees_with_sam(spark, tmp_path):
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2)
    for n in (b"chr1\0", b"chr2\0"):
        raw += struct.pack("<i", len(n)) + n + struct.pack("<i", 10_000)
    for line in SAM.split("\n")[1:]:
        f = line.split("\t")
        cigar = [] if f[5] == "*" else [(int(n), A._OPS.index(o)) for n, o in __import__("re").findall(r"(\d+)([MIDNSHP=X])", f[5])]
        codes = [A._BASES.index(b) for b in f[9]] + [0]
        nm = next((int(x[5:]) for x in f[11:] if x.startswith("NM")), None)
        body = struct.pack("<iiBBHHHiiii", {"*": -1, "chr1": 0, "chr2": 1}[f[2]], int(f[3]) - 1, len(f[0]) + 1, int(f[4]), 0, len(cigar), int(f[1]), len(f[9]), -1, -1, 0)
        body += f[0].encode() + b"\0" + struct.pack(f"<{len(cigar)}I", *(n << 4 | o for n, o in cigar)) + bytes(a << 4 | b for a, b in zip(codes[: len(f[9]) : 2], codes[1::2], strict=False)) + b"\xff" * len(f[9])
        body += b"XXZhello\0" + (b"" if nm is None else b"NMC" + bytes([nm]))
        raw += struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(bgzf(raw))
    want = sorted(tuple(r) for r in A.read_sam(spark, put(tmp_path / "a.sam", SAM)).collect())
    assert sorted(tuple(r) for r in A.read_bam(spark, str(tmp_path / "a.bam")).collect()) == want
    spark.dataSource.register(A.BamSource)
    assert sorted(tuple(r) for r in spark.read.format("bam").option("path", str(tmp_path)).load().collect()) == want


def test_settings(tmp_path):
    cfg = config.override(config.override(config.Config(), "chains.min_reads", "3"), "junctions.rescue", "true")
    assert (cfg.chains.min_reads, cfg.junctions.rescue) == (3, True)
    p = tmp_path / "c.json"
    p.write_text(config.dump(cfg))
    assert config.load(str(p)) == cfg
    for bad in ({"nonsense": 1}, {"chains": {"nonsense": 1}}):
        with pytest.raises(ValueError, match="nonsense"):
            config.from_dict(bad)
    with pytest.raises(ValueError, match="min_coverage"):
        config.override(cfg, "gates.min_coverage", "7").check()
    assert cli.main(["config", "--set", "chains.min_reads=x"]) == 2
    assert cli.main(["config"]) == 0


def plant(tmp_path):
    """25 whole reads of T1, 30 truncated ones, 12 of a new exon skip, 2 of a false junction, 20 of T2 on minus, 12 unspliced ones of no gene, 6 within T1's last exon."""
    lines, umis, n = ["@HD\tVN:1.6"], ["cell_barcode\tumi\tread_name"], 0

    def add(times, flag, contig, pos, cigar, size):
        nonlocal n
        for _ in range(times):
            lines.append(f"q{n}\t{flag}\t{contig}\t{pos}\t60\t{cigar}\t*\t0\t0\t{'G' * size}\t*\tNM:i:0")
            umis.append(f"C{n % 4}\t{''.join('ACGT'[n // 4**k % 4] for k in range(8))}\tq{n}")
            n += 1

    add(25, 0, "chr1", 1001, "200M800N200M800N500M", 900)
    add(30, 0, "chr1", 2050, "151M800N500M", 651)
    add(12, 0, "chr1", 1001, "200M1800N500M", 700)
    add(2, 0, "chr1", 1001, "237M763N200M800N500M", 937)
    add(20, 16, "chr2", 101, "100M100N100M", 200)
    add(12, 0, "chr1", 9001, "300M", 300)
    add(6, 0, "chr1", 3051, "300M", 300)
    return put(tmp_path / "r.sam", "\n".join(lines)), put(tmp_path / "u.tsv", "\n".join(umis)), put(tmp_path / "a.gtf", GTF)


def test_a_run_finds_what_was_planted(spark, tmp_path):
    sam, umis, gtf = plant(tmp_path)
    cfg = config.Config(alignments=sam, annotation=gtf, umis=umis, out=str(tmp_path / "out"))
    out = catalogue.run(spark, cfg)
    got = {(r.contig, len(r.chain), r.category): (r.n_reads, r.n_mols) for r in out["models"].collect()}
    # many planted UMIs are neighbours of each other, and count as one molecule everywhere
    def molecules(*numbers):
        cells = {}
        for n in numbers:
            cells.setdefault(n % 4, {})["".join("ACGT"[n // 4**k % 4] for k in range(8))] = 1
        return sum(len(set(merge_cell(x).values())) for x in cells.values())

    assert got == {("chr1", 2, "FSM"): (61, molecules(*range(55), *range(101, 107))), ("chr1", 1, "NIC"): (12, molecules(*range(55, 67))), ("chr2", 1, "FSM"): (20, molecules(*range(69, 89))), ("chr1", 0, "monoexon_intergenic"): (12, molecules(*range(89, 101)))}
    assigned = out["assigned"].groupBy(F.col("model_name").isNull().alias("none")).count().collect()
    assert {r["none"]: r["count"] for r in assigned} == {False: 105, True: 2}
    checks = catalogue.invariants(out, A.admitted_columns(A.read_sam(spark, sam)).withColumn("read_id", F.xxhash64("read_name", "contig", "pos", "cigar"))).first()
    assert checks.ok_mono and checks.ok_span and checks.ok_exons
    back = T.annotation(T.read_gtf(spark, f"{cfg.out}/models.gtf"))
    assert {tuple(tuple(j) for j in r.chain) for r in back.collect()} == {tuple(tuple(j) for j in r.chain) for r in out["models"].collect()}
    head = spark.read.text(f"{cfg.out}/matrix/matrix").collect()
    assert head[0].value.startswith("%%MatrixMarket") and sum(int(r.value.split()[2]) for r in head[2:]) == sum(n for _, n in got.values()) < 105
    table = spark.read.csv(f"{cfg.out}/models.tsv", sep="\t", header=True)
    assert table.count() == 4 and {"read_share", "tier", "terminal_class"} <= set(table.columns)
    qc = json.loads(spark.read.text(f"{cfg.out}/qc.json", wholetext=True).first().value)
    assert qc["reads"] == {"reads": 107, "mono_exonic_reads": 18, "spliced_reads": 89, "junction_records": 116} and qc["novelty"]["n_novel_models"] == 1
    rejected = spark.read.csv(f"{cfg.out}/single_exons_rejected.tsv", sep="\t", header=True).collect()
    assert [(x.outcome, x.n_reads) for x in rejected] == [("demoted_fragment", "6")]
    facts = cli.audit(spark, sam, f"{cfg.out}/models.gtf", f"{cfg.out}/read_stat.tsv")
    assert facts["n_mono_mismatch"] == 0 and facts["n_with_several"] == 0 and facts["n_inspected"] == 4 and facts["exons_per_read"] == {1: 18, 2: 62, 3: 27}
    assert cli.diagnose(spark, umis, sam)["use"] == {"column": "read_name", "mode": "none"}
    cli.index_umis(spark, umis, "none", str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 107
    same = cli.compare(spark, [f"{cfg.out}/models.gtf"] * 1 + [gtf], 100).collect()
    assert {r.category for r in same} >= {"ALL"}


def test_gates_that_refuse_nearly_all_stop_the_run(spark, tmp_path):
    sam, umis, gtf = plant(tmp_path)
    cfg = config.from_dict({"alignments": sam, "annotation": gtf, "gates": {"min_coverage": 1.0, "min_reads_for_check": 10, "min_mapq": 61}})
    with pytest.raises(catalogue.GateError):
        catalogue.admit(A.read_sam(spark, sam), cfg)


def test_settings_dump_is_json():
    assert json.loads(config.dump(config.Config()))["posthoc"]["end3_tolerance"] == 200


def test_every_setting_is_read():
    import dataclasses
    import re
    from pathlib import Path

    folder = Path(catalogue.__file__).parent
    code = "".join((folder / f).read_text() for f in ("catalogue.py", "stages.py"))

    def leaves(kind):
        for f in dataclasses.fields(kind):
            inner = f.default_factory if f.default_factory is not dataclasses.MISSING and dataclasses.is_dataclass(f.default_factory) else None
            yield from leaves(inner) if inner else [f.name]

    assert [n for n in leaves(config.Config) if not re.search(rf"\.{n}\b", code)] == []


def test_lines_that_are_no_rows_fail(spark, tmp_path):
    bad = put(tmp_path / "bad.gtf", GTF + "\nchr1\tx\texon\tten\t20\t.\t+\t.\tgene_id \"G\";")
    with pytest.raises(Exception, match="malformed line"):
        T.read_gtf(spark, bad).collect()
    with pytest.raises(Exception, match="malformed line"):
        T.read_gtf(spark, bad).select("contig").collect()
    bed = put(tmp_path / "a.bed", "track name=x\nchr1\t10\t20\nchr1\t10\t20\tn\t0\t-\n")
    assert sorted(tuple(x) for x in T.read_polya_bed(spark, bed).collect()) == [("chr1", "+", 20), ("chr1", "-", 10)]
    graph = put(tmp_path / "a.bg", "track type=bedGraph\nchr1\t0\t10\t1.5\nchr1\t0\t10\t1\n")
    assert [tuple(x) for x in T.read_bedgraph(spark, graph).collect()] == [("chr1", 0, 10, 2.5)]


def test_stages_with_a_genome(spark, tmp_path):
    from strandloom.plans import stages as S

    left, right = "A" * 20, "C" * 20
    intron = "GT" + "T" * 56 + "AG"
    fasta = put(tmp_path / "g.fa", f">c\n{left}{intron}{right}{'G' * 40}\n")
    genome = T.read_fasta(spark, fasta)
    j = spark.createDataFrame([("c", "+", 20, 80), ("c", "-", 20, 80), ("c", "+", 22, 80)], "contig string, strand string, donor long, acceptor long")
    got = {(r.strand, r.donor): (r.motif_class, r.direct_repeat) for r in S.with_motifs(j, genome).collect()}
    assert got == {("+", 20): ("canonical", 0), ("-", 20): ("antisense", 0), ("+", 22): ("non_canonical", 0)}
    assert {r.motif_class for r in S.with_motifs(j, None).collect()} == {"unknown"}
    e = S.end_evidence(spark.createDataFrame([("a", "c", "+", 100), ("b", "c", "-", 20)], "id string, contig string, strand string, three long"), S.Evidence(genome=genome), config.Config()).collect()
    assert {r.id: (r.percent_a, r.internal_priming) for r in e} == {"a": (0.0, False), "b": (0.0, False)}


def test_the_second_pass_on_a_catalogue(spark):
    from strandloom.plans import stages as S

    chain = "array<struct<donor:bigint,acceptor:bigint>>"
    tx = spark.createDataFrame([("t", "g", "c", "+", [(200, 300)], [(100, 200), (300, 400)], 100, 400, 0, 200), ("u", "h", "c", "+", [(1200, 1300)], [(1100, 1200), (1300, 1400)], 1100, 1400, 0, 200)], f"tx_id string, gene_id string, contig string, strand string, chain {chain}, exons array<struct<s:bigint,e:bigint>>, tss long, tts long, rank int, tx_len long")
    rows = [("m", "g", [(200, 300)], [(100, 200), (300, 390)], "FSM", 9), ("s", "g", [], [(310, 380)], "monoexon_internal", 3), ("r", "h", [], [(1110, 1190)], "monoexon_internal", 4), ("x", None, [], [(5000, 5100)], "monoexon_intergenic", 5), ("n", "g", [(200, 300)], [(100, 200), (300, 350)], "end3_novel", 2)]
    m = spark.createDataFrame([(i, g, "c", "+", ch, ex, k, n, n, 1, ex[-1][1], ex[0][1], True, False, False, False, 50.0, None) for i, g, ch, ex, k, n in rows], f"model_id string, gene_id string, contig string, strand string, chain {chain}, exons array<struct<s:bigint,e:bigint>>, category string, support long, n_reads long, n_cells long, three long, five long, end_annotated boolean, at_polya_site boolean, motif_found boolean, internal_priming boolean, dispersion double, contrast double").withColumn("step_supported", F.lit(None).cast("boolean"))
    kept, mapping, audit = S.second_pass(m, tx, config.Config())
    assert {r.model_id: r.category for r in kept.collect()} == {"m": "FSM", "x": "monoexon_intergenic", "INFERRED|h|u": "INFERRED"}
    assert {r.model_id: r.target for r in mapping.collect()} == {"s": "m", "r": "INFERRED|h|u", "n": "m"}
    assert {(r.model_id, r.stage, r.action, r.reason) for r in audit.collect()} == {("s", "single_exons", "replaced", "infer_from=data"), ("r", "single_exons", "replaced", "infer_from=reference"), ("x", "single_exons", "kept", "intergenic_out_of_scope"), ("n", "ends", "removed", "tier=none")}
