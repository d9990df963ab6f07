"""Alignments: SAM text by Spark's reader, BAM by a Python data source, and what CIGARs tell."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_name string, flag int, contig string, pos long, mapq int, cigar string, seq string, nm int"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped records of SAM text; pos is 0-based."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = spark.read.text(path).where(~F.col("value").startswith("@"))
    nm = F.regexp_extract("value", "\tNM:i:([0-9]+)", 1)
    return rows.select(at(0).alias("read_name"), at(1).try_cast("int").alias("flag"), at(2).alias("contig"), (at(3).try_cast("long") - 1).alias("pos"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"), F.when(nm != "", nm).try_cast("int").alias("nm")).where("contig <> '*' AND flag % 8 < 4")


def bgzf_blocks(data: bytes) -> Iterator[bytes]:
    """The decompressed members of a BGZF stream."""
    at = 0
    while at + 18 <= len(data):
        extra = struct.unpack_from("<H", data, at + 10)[0]
        size, field = 0, at + 12
        while field < at + 12 + extra:
            a, b, n = data[field], data[field + 1], struct.unpack_from("<H", data, field + 2)[0]
            if (a, b) == (66, 67):
                size = struct.unpack_from("<H", data, field + 4)[0] + 1
            field += 4 + n
        if not size:
            raise ValueError("no BGZF block")
        yield zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
        at += size


_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"


def bam_records(data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA for the mapped records of a BAM file's bytes."""
    raw = b"".join(bgzf_blocks(data))
    if raw[:4] != b"BAM\1":
        raise ValueError("no BAM file")
    at = 8 + struct.unpack_from("<i", raw, 4)[0]
    names = []
    n, at = struct.unpack_from("<i", raw, at)[0], at + 4
    for _ in range(n):
        size = struct.unpack_from("<i", raw, at)[0]
        names.append(raw[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at < len(raw):
        size = struct.unpack_from("<i", raw, at)[0]
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", raw, at + 4)
        p = at + 36
        name = raw[p : p + l_name - 1].decode()
        p += l_name
        cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", raw, p))
        p += 4 * n_cigar
        packed = raw[p : p + (l_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        p += (l_seq + 1) // 2 + l_seq
        if ref >= 0 and not flag & 4:
            yield name, flag, names[ref], pos, mapq, cigar or "*", seq or "*", _nm(raw, p, at + 4 + size)
        at += 4 + size


_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def _nm(raw: bytes, at: int, end: int) -> int | None:
    while at < end:
        tag, kind = raw[at : at + 2], chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            at = raw.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(raw[at])] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            if tag == b"NM":
                return struct.unpack_from("<" + {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}[kind], raw, at)[0]
            at += _SIZES[kind]
    return None


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """BAM files on any file system Spark reads: each file is a task. Large inputs are best cut by contig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for row in bam_records(data):
                    rows.append(row)
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


class BamSource(DataSource):
    """spark.read.format("bam").option("path", folder or file): local files by name, one partition for each."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options)


class _BamReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        p = Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(p.glob("*.bam")) if p.is_dir() else [p])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from bam_records(f.read())


def operations(cigar: Column) -> Column:
    """array<struct<n, op, at>>: lengths, operations, and reference bases used before each."""
    pairs = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.expr("1").alias("k"), F.regexp_extract(x, "^([0-9]+)", 1).cast("long").alias("n"), F.substring(x, -1, F.lit(1)).alias("op")))
    kind = "struct<at:bigint,ops:array<struct<n:bigint,op:string,at:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<n:bigint,op:string,at:bigint>>").alias("ops")).cast(kind)
    step = lambda acc, x: F.struct((acc["at"] + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0)).alias("at"), F.concat(acc["ops"], F.array(F.struct(x["n"].alias("n"), x["op"].alias("op"), acc["at"].alias("at")))).alias("ops")).cast(kind)
    return F.aggregate(pairs, start, step)["ops"]


def introns(ops: Column, pos: Column, least: int = 20, most: int = 500_000) -> Column:
    return F.transform(F.filter(ops, lambda x: (x["op"] == "N") & (x["n"] >= least) & (x["n"] <= most)), lambda x: F.struct((pos + x["at"]).alias("donor"), (pos + x["at"] + x["n"]).alias("acceptor")))


def deletions(ops: Column, pos: Column, least: int = 20) -> Column:
    return F.transform(F.filter(ops, lambda x: (x["op"] == "D") & (x["n"] >= least)), lambda x: F.struct((pos + x["at"]).alias("donor"), (pos + x["at"] + x["n"]).alias("acceptor")))


def admitted_columns(alignments: DataFrame, least: int = 20, exclude_3p_clip: bool = True, most: int = 500_000) -> DataFrame:
    """Alignments with strand, ends, chain, gaps, clips, coverage, identity and tail, for gates and grouping."""
    a = alignments.withColumn("ops", operations(F.col("cigar")))
    total = lambda *kinds: F.aggregate(F.filter("ops", lambda x: x["op"].isin(*kinds)), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    clip = lambda xs: F.aggregate(F.filter(xs, lambda x: x["op"].isin("S", "H")), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    minus = F.col("flag").bitwiseAND(16) != 0
    left, right = clip(F.slice("ops", 1, 2)), clip(F.slice("ops", F.greatest(F.size("ops") - 1, F.lit(1)), F.lit(2)))
    a = a.withColumns(
        {
            "strand": F.when(minus, "-").otherwise("+"),
            "secondary": F.col("flag").bitwiseAND(256) != 0,
            "supplementary": F.col("flag").bitwiseAND(2048) != 0,
            "start": F.col("pos"),
            "end": F.col("pos") + total("M", "D", "N", "=", "X"),
            "clip5": F.when(minus, right).otherwise(left),
            "clip3": F.when(minus, left).otherwise(right),
            "aligned": total("M", "I", "=", "X"),
            "columns": total("M", "I", "D", "=", "X"),
            "query": total("M", "I", "S", "H", "=", "X"),
        }
    )
    js = introns(F.col("ops"), F.col("pos"), least, most)
    soft = F.when(minus, F.when(F.col("ops")[0]["op"] == "S", F.expr("left(seq, cast(ops[0].n AS INT))"))).otherwise(F.when(F.element_at("ops", -1)["op"] == "S", F.expr("right(seq, cast(element_at(ops, -1).n AS INT))")))
    tail = F.when(minus, F.reverse(F.translate(soft, "ACGT", "TGCA"))).otherwise(soft)
    base = F.col("query") - (F.col("clip3") if exclude_3p_clip else F.lit(0))
    return a.withColumns(
        {
            "chain": F.when(minus, F.reverse(js)).otherwise(js),
            "gaps": deletions(F.col("ops"), F.col("pos"), least),
            "coverage": F.least(F.col("aligned") / F.greatest(base, F.lit(1)), F.lit(1.0)),
            "identity": F.when(F.col("nm").isNull(), F.lit(1.0)).otherwise(1 - F.col("nm") / F.greatest("columns", F.lit(1))),
            "tail_len": F.coalesce(F.length(F.regexp_extract(tail, "^(A*)", 1)), F.lit(0)),
            "tail_frac": F.coalesce((F.length(F.substring(tail, 1, 60)) - F.length(F.replace(F.substring(tail, 1, 60), F.lit("A"), F.lit("")))) / F.length(F.substring(tail, 1, 60)), F.lit(0.0)),
            "tss": F.when(minus, F.col("end")).otherwise(F.col("start")),
            "tts": F.when(minus, F.col("start")).otherwise(F.col("end")),
        }
    ).drop("ops", "aligned", "columns", "query")


def exon_blocks(ops: Column, pos: Column) -> Column:
    """array<struct<s, e>>: reference stretches between introns; insertions and clips take none, deletions are part of one."""
    covers = F.filter(ops, lambda x: x["op"].isin("M", "D", "=", "X"))
    kind = "array<struct<s:bigint,e:bigint>>"
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] == pos + x["at"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), (pos + x["at"] + x["n"]).alias("e"))))).otherwise(F.concat(acc, F.array(F.struct((pos + x["at"]).alias("s"), (pos + x["at"] + x["n"]).alias("e"))))).cast(kind)
    return F.aggregate(covers, F.array().cast(kind), step)


def primary(alignments: DataFrame) -> DataFrame:
    """Neither secondary nor supplementary."""
    return alignments.where((F.col("flag").bitwiseAND(256) == 0) & (F.col("flag").bitwiseAND(2048) == 0))


def exon_histogram(alignments: DataFrame, least: int = 20, most: int = 20) -> DataFrame:
    """(n_exons, n): exons per primary alignment told from its CIGAR, those of `most` and more together."""
    n = 1 + F.size(introns(operations(F.col("cigar")), F.col("pos"), least, 1 << 40))
    return primary(alignments).groupBy(F.least(n, F.lit(most)).alias("n_exons")).agg(F.count("*").alias("n"))


def read_names(alignments: DataFrame) -> DataFrame:
    return primary(alignments).select("read_name").distinct()
