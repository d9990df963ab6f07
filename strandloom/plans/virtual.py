"""Genomic tables as projections of the star-schema tables, as DataFrames and as SQL.

An order is a read, its distinct line numbers are introns, and customers, suppliers and events supply
positions, cells and signals. The annotation is a fixed small set of chains on each contig and strand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import oriented

#: (name, intron numbers, canonical rank, gene)
TRANSCRIPTS = [("t1", [1, 2, 3, 4, 5, 6, 7], 0, "g1"), ("t2", [1, 2, 4, 7], 1, "g1"), ("t3", [3, 5, 6], 2, "g2"), ("t4", [2, 3, 4, 5], 3, "g1"), ("t5", [1, 3], 5, "g2"), ("t6", [5, 6, 7], 8, "g2"), ("t7", [4], 3, "g1")]
STRANDS = {"+": "p", "-": "m"}


def annotation_rows() -> list[tuple]:
    """(tx_id, gene_id, contig, strand, rank, introns, tss, tts)"""
    rows = []
    for contig in range(5):
        for strand, s in STRANDS.items():
            for name, ks, rank, gene in TRANSCRIPTS:
                lo, hi = min(ks) * 1000 - 250, max(ks) * 1000 + 900
                tss, tts = (lo, hi) if strand == "+" else (hi, lo)
                rows.append((f"{name}.{contig}{s}", f"{gene}.{contig}{s}", contig, strand, rank, ks, tss, tts))
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_junctions(spark: SparkSession, sf_dir: str, displaced: bool = False) -> DataFrame:
    """(read_id, k, donor, acceptor); some by up to 2 bases if displaced."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").cast("long").alias("k")).agg(F.min("l_suppkey").alias("s"))
    jit = F.when(F.col("s") % 4 == 0, F.floor(F.col("s") / 4) % 5 - 2).otherwise(0) if displaced else F.lit(0)
    return lines.select("read_id", "k", (F.col("k") * 1000 + jit).cast("long").alias("donor"), (F.col("k") * 1000 + 500 + jit).cast("long").alias("acceptor"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    base = lambda x: F.substring(F.lit("ACGT"), (x + 1).cast("int"), F.lit(1))
    return o.select(
        F.col("o_orderkey").alias("read_id"),
        F.concat(F.lit("r/"), F.col("o_orderkey").cast("string"), F.lit("/ccs")).alias("read_name"),
        F.col("o_custkey").alias("c"),
        (F.col("o_custkey") % 5).cast("long").alias("contig"),
        F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("o_custkey") % 40).cast("long").alias("cell"),
        F.concat(base(F.floor(F.col("o_orderkey") % 16 / 4)), base(F.col("o_orderkey") % 4)).alias("umi"),
    )


def reads(spark: SparkSession, sf_dir: str, displaced: bool = False) -> DataFrame:
    """Spliced reads: read_id, contig, strand, cell, umi, n, chain, tss, tts, start, end. One shuffle by read."""
    spliced = read_junctions(spark, sf_dir, displaced).groupBy("read_id").agg(F.collect_list(F.struct("donor", "acceptor")).alias("js"), F.min("k").alias("k0"), F.max("k").alias("k1"))
    r = orders(spark, sf_dir).join(spliced, "read_id")
    off3, off5 = (F.col("c") % 3) * 120 + F.col("read_id") % 11, F.col("c") % 200
    plus = F.col("strand") == "+"
    r = r.withColumns(
        {
            "chain": oriented(F.col("js"), F.col("strand")),
            "n": F.size("js").cast("long"),
            "tss": F.when(plus, F.col("k0") * 1000 - 300 + off5).otherwise(F.col("k1") * 1000 + 800 - off5).cast("long"),
            "tts": F.when(plus, F.col("k1") * 1000 + 800 + off3).otherwise(F.col("k0") * 1000 - 600 + off3).cast("long"),
        }
    )
    return r.select("read_id", "read_name", "contig", "strand", "cell", "umi", "n", "chain", "tss", "tts", F.least("tss", "tts").alias("start"), F.greatest("tss", "tts").alias("end"))


def mono_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads without a junction: (read_id, contig, strand, cell, umi, start, end, tts)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"))
    m = orders(spark, sf_dir).join(lines, "read_id", "left_anti")
    start = ((F.col("read_id") % 7 + 1) * 1000 + 600).cast("long")
    m = m.withColumns({"start": start, "end": start + 300 + F.col("c") % 200})
    return m.select("read_id", "contig", "strand", "cell", "umi", "start", "end", F.when(F.col("strand") == "+", F.col("end")).otherwise(F.col("start")).alias("tts"))


def transcripts(spark: SparkSession) -> DataFrame:
    """The annotation: 70 rows whatever the input. tx_id, gene_id, contig, strand, rank, chain, tss, tts."""
    rows = spark.createDataFrame(annotation_rows(), "tx_id string, gene_id string, contig long, strand string, rank int, ks array<long>, tss long, tts long")
    js = F.transform("ks", lambda k: F.struct((k * 1000).alias("donor"), (k * 1000 + 500).alias("acceptor")))
    return rows.withColumn("chain", oriented(js, F.col("strand"))).drop("ks")


def transcript_junctions(spark: SparkSession) -> DataFrame:
    return transcripts(spark).select("tx_id", "gene_id", "contig", "strand", F.explode("chain").alias("j")).select("tx_id", "gene_id", "contig", "strand", "j.donor", "j.acceptor")


def _values() -> str:
    return ", ".join(f"('{t}', '{g}', {c}::BIGINT, '{s}', {r}, {ks}::BIGINT[], {a}::BIGINT, {b}::BIGINT)" for t, g, c, s, r, ks, a, b in annotation_rows())


_CHAIN = "string_agg(donor || '-' || acceptor, ';' ORDER BY CASE WHEN strand = '+' THEN donor ELSE -donor END)"

#: CTEs that SQL begins with, by name; sql() picks those a query names.
CTES = {
    "ln": "SELECT l_orderkey AS read_id, CAST(l_linenumber AS BIGINT) AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2",
    "od": "SELECT o_orderkey AS read_id, 'r/' || o_orderkey || '/ccs' AS read_name, o_custkey AS c, o_custkey % 5 AS contig, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_custkey % 40 AS cell, substr('ACGT', CAST((o_orderkey % 16) // 4 + 1 AS INT), 1) || substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS umi FROM orders",
    "rj": "SELECT od.*, k, k * 1000 AS donor, k * 1000 + 500 AS acceptor FROM od JOIN ln USING (read_id)",
    "rx": "SELECT od.*, k, k * 1000 + j AS donor, k * 1000 + 500 + j AS acceptor FROM od JOIN (SELECT *, CASE WHEN s % 4 = 0 THEN (s // 4) % 5 - 2 ELSE 0 END AS j FROM ln) USING (read_id)",
    "r0": f"SELECT read_id, contig, strand, cell, umi, c, count(*) AS n, min(k) AS k0, max(k) AS k1, {_CHAIN} AS chain FROM rj GROUP BY 1, 2, 3, 4, 5, 6",
    "rd": "SELECT *, least(tss, tts) AS lo, greatest(tss, tts) AS hi FROM (SELECT *, CASE WHEN strand = '+' THEN k0 * 1000 - 300 + c % 200 ELSE k1 * 1000 + 800 - c % 200 END AS tss, CASE WHEN strand = '+' THEN k1 * 1000 + 800 + (c % 3) * 120 + read_id % 11 ELSE k0 * 1000 - 600 + (c % 3) * 120 + read_id % 11 END AS tts FROM r0)",
    "mr": "SELECT *, CASE WHEN strand = '+' THEN hi ELSE lo END AS tts FROM (SELECT *, (read_id % 7 + 1) * 1000 + 600 AS lo, (read_id % 7 + 1) * 1000 + 900 + c % 200 AS hi FROM od WHERE read_id NOT IN (SELECT read_id FROM ln))",
    "tx": f"SELECT * FROM (VALUES {_values()}) v(tx_id, gene_id, contig, strand, rank, ks, tss, tts)",
    "tj": "SELECT * EXCLUDE (ks), k * 1000 AS donor, k * 1000 + 500 AS acceptor FROM (SELECT *, unnest(ks) AS k FROM tx)",
    "tc": f"SELECT tx_id, gene_id, contig, strand, rank, tss, tts, count(*) AS n, {_CHAIN} AS chain FROM tj GROUP BY ALL",
    "uc": "SELECT contig, strand, chain, cell, list(umi ORDER BY n DESC, umi) AS us, list(n ORDER BY n DESC, umi) AS ns FROM (SELECT contig, strand, chain, cell, umi, count(*) AS n FROM rd GROUP BY ALL) GROUP BY ALL",
    "um": "SELECT *, 1 AS i, list_transform(us, lambda u: 0) AS own FROM uc WHERE len(us) > 1 UNION ALL SELECT contig, strand, chain, cell, us, ns, i + 1, CASE WHEN own[i] <> 0 THEN own ELSE list_transform(range(1, len(us) + 1), lambda j: CASE WHEN j = i OR (own[j] = 0 AND hamming(us[i], us[j]) = 1 AND ns[i] >= 2 * ns[j] - 1) THEN i ELSE own[j] END) END FROM um WHERE i <= len(us)",
    "mo": "SELECT contig, strand, chain, CAST(sum(m) AS BIGINT) AS n_mols FROM (SELECT contig, strand, chain, len(list_distinct(own)) AS m FROM um WHERE i = len(us) + 1 UNION ALL SELECT contig, strand, chain, 1 FROM uc WHERE len(us) = 1) GROUP BY ALL",
    "cg": "SELECT * FROM (SELECT contig, strand, chain, n, count(*) AS n_reads, count(DISTINCT cell) AS n_cells, min(read_id) AS first_read FROM rd GROUP BY 1, 2, 3, 4) JOIN mo USING (contig, strand, chain)",
    "ct": "SELECT contig, strand, chain, string_agg(tx_id, ',' ORDER BY tx_id) AS tx_ids, min(gene_id) AS tx_gene FROM tc GROUP BY 1, 2, 3",
    "rk": "SELECT read_id, list(k ORDER BY k) AS ks FROM rj GROUP BY 1",
    "md": "SELECT contig || '|' || strand || '|' || chain AS model_id, *, least(five, three) AS lo, greatest(five, three) AS hi, list_transform(ks, lambda k: k * 1000) AS ds, list_transform(ks, lambda k: k * 1000 + 500) AS acs FROM (SELECT contig, strand, chain, ks, count(*) AS n_reads, count(DISTINCT (cell, umi)) AS n_mols, CASE WHEN strand = '+' THEN min(tss) ELSE max(tss) END AS five, CASE WHEN strand = '+' THEN max(tts) ELSE min(tts) END AS three FROM rd JOIN rk USING (read_id) GROUP BY contig, strand, chain, ks)",
    "mx": "SELECT *, list_prepend(lo, acs) AS es, list_append(ds, hi) AS ee FROM md",
    "gr": "SELECT cg.*, tx_ids, tx_gene, tx_ids IS NOT NULL AS annotated, n_mols AS support FROM cg LEFT JOIN ct USING (contig, strand, chain)",
}
_NEEDS = {"rj": ["od", "ln"], "rx": ["od", "ln"], "r0": ["rj"], "rd": ["r0"], "mr": ["od", "ln"], "tj": ["tx"], "tc": ["tj"], "uc": ["rd"], "um": ["uc"], "mo": ["um"], "cg": ["rd", "mo"], "ct": ["tc"], "gr": ["cg", "ct"], "rk": ["rj"], "md": ["rd", "rk"], "mx": ["md"]}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """A query over the named CTEs and those they need. body: more CTEs and the SELECT, or the SELECT alone."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    ctes = ", ".join(f"{n} AS {'' if n == 'um' else 'MATERIALIZED '}({CTES[n]})" for n in wanted)
    body = body.strip()
    head = f"WITH {'RECURSIVE ' * (recursive or 'um' in wanted)}{ctes}"
    return f"{head} {body}" if body.upper().startswith("SELECT") else f"{head}, {body}"
