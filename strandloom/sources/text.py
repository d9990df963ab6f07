"""Text formats, read by Spark's own text and CSV sources: any file system, gzip included, split where it can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.intervals import exons_to_chain
from ..functions.sequence import canonical_rank

JUNCTION_MOTIFS = ["non_canonical", "GT-AG", "CT-AC", "GC-AG", "CT-GC", "AT-AC", "GT-AT"]


def tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False) -> DataFrame:
    """Rows of tab-separated text. A line with a value that isn't of its column's type, or with too few, fails the query that reads it: none is lost."""
    rows = spark.read.csv(path, schema=schema + ", _broken string", sep="\t", header=header, comment="#", quote="", mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    typed = [F.col(c).cast("string") for c, t in rows.dtypes if t != "string"]
    # a reader converts the columns that are asked for; this asks for all that can be malformed
    good = F.col("_broken").isNull() & (F.size(F.array(F.lit(""), *typed)) > 0)
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.substring("_broken", 1, 200)))
    return rows.select(*(F.when(good, F.col(c)).otherwise(bad.cast(t)).alias(c) for c, t in rows.dtypes if c != "_broken"))


def attribute(attrs: Column, name: str) -> Column:
    """The first value of a GTF (name "value") or GFF3 (name=value) attribute; null if there is none."""
    value = F.regexp_extract(attrs, rf'(?:^|[; ]){name}(?: "([^"]*)"| ?=([^;]*)| ([^";]+))', 1)
    other = F.regexp_extract(attrs, rf"(?:^|[; ]){name}=([^;]*)", 1)
    return F.when(value != "", value).when(other != "", other)


def read_gtf(spark: SparkSession, path: str, contigs: list[str] | None = None, features: tuple[str, ...] = ("exon", "CDS", "stop_codon")) -> DataFrame:
    """Rows of a GTF or GFF: contig, feature, s, e (0-based, half-open), strand and the attributes in use."""
    rows = tsv(spark, path, "contig string, source string, feature string, start long, stop long, score string, strand string, frame string, attrs string").where(F.col("feature").isin(*features))
    if contigs:
        rows = rows.where(F.col("contig").isin(*contigs))
    a = F.col("attrs")
    return rows.select(
        "contig",
        "feature",
        (F.col("start") - 1).alias("s"),
        F.col("stop").alias("e"),
        "strand",
        attribute(a, "gene_id").alias("gene_id"),
        attribute(a, "transcript_id").alias("tx_id"),
        attribute(a, "gene_name").alias("gene_name"),
        F.coalesce(attribute(a, "transcript_type"), attribute(a, "transcript_biotype")).alias("tx_type"),
        F.regexp_extract_all(a, F.lit('tag "([^"]*)"'), F.lit(1)).alias("tags"),
        attribute(a, "category").alias("category"),
        attribute(a, "n_molecules").cast("long").alias("n_molecules"),
        attribute(a, "n_reads").cast("long").alias("n_reads"),
    )


def annotation(rows: DataFrame) -> DataFrame:
    """Transcripts of GTF rows: exons, chain, ends, coding start and stop, 3' UTR, rank."""
    struct = F.struct("s", "e")
    of = lambda kind: F.collect_set(F.when(F.col("feature") == kind, struct))
    t = rows.where("tx_id IS NOT NULL").groupBy("tx_id", "gene_id", "contig", "strand").agg(
        F.max("gene_name").alias("gene_name"), F.max("tx_type").alias("tx_type"), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"), F.sort_array(of("exon")).alias("exons"), F.sort_array(of("CDS")).alias("cds"), F.sort_array(of("stop_codon")).alias("stops")
    ).where(F.size("exons") > 0)
    minus = F.col("strand") == "-"
    lo, hi = F.element_at("exons", 1)["s"], F.element_at("exons", -1)["e"]
    cds_lo, cds_hi = F.get("cds", F.lit(0))["s"], F.get("cds", F.size("cds") - 1)["e"]
    stop = F.coalesce(F.when(minus, F.get("stops", F.lit(0))["s"]).otherwise(F.get("stops", F.size("stops") - 1)["e"]), F.when(minus, cds_lo).otherwise(cds_hi))
    t = t.withColumns(
        {
            "chain": exons_to_chain(F.col("exons"), F.col("strand")),
            "tss": F.when(minus, hi).otherwise(lo),
            "tts": F.when(minus, lo).otherwise(hi),
            "tx_len": F.aggregate("exons", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"]),
            "start_pos": F.when(minus, cds_hi).otherwise(cds_lo),
            "stop_pos": stop,
            "rank": canonical_rank(F.col("tags"), F.col("tx_type")),
        }
    )
    beyond = F.aggregate("exons", F.lit(0).cast("long"), lambda acc, x: acc + F.when(minus, F.greatest(F.least(x["e"], F.col("stop_pos")) - x["s"], F.lit(0))).otherwise(F.greatest(x["e"] - F.greatest(x["s"], F.col("stop_pos")), F.lit(0))))
    return t.withColumn("utr3_len", F.when(F.col("stop_pos").isNotNull(), beyond))


def read_star(spark: SparkSession, paths: list[str]) -> DataFrame:
    """STAR junction tables: library, contig, strand, donor, acceptor, motif, annotated, uniq, multi, overhang."""
    rows = tsv(spark, paths, "contig string, first long, last long, strand int, motif int, annotated long, uniq long, multi long, overhang long")
    return rows.select(F.input_file_name().alias("library"), "contig", F.when(F.col("strand") == 1, "+").when(F.col("strand") == 2, "-").otherwise(".").alias("strand"), (F.col("first") - 1).alias("donor"), F.col("last").alias("acceptor"), F.element_at(F.array(*map(F.lit, JUNCTION_MOTIFS)), F.col("motif") + 1).alias("motif"), "annotated", "uniq", "multi", "overhang")


def read_polya_bed(spark: SparkSession, path: str) -> DataFrame:
    """Distinct sites (contig, strand, site): a row's end on plus, its start on minus; no strand is plus."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|\\s*$)"))
    f = F.split("value", "\t")
    strand = F.when(F.get(f, F.lit(5)) == "-", "-").otherwise("+")
    # a start or an end that is no number fails the read
    return lines.select(F.get(f, F.lit(0)).alias("contig"), strand.alias("strand"), F.when(strand == "-", F.get(f, F.lit(1))).otherwise(F.get(f, F.lit(2))).cast("long").alias("site")).distinct()


def read_cage_bed(spark: SparkSession, path: str, min_score: float = 0.0) -> DataFrame:
    """Peaks (contig, strand, start, end, rep): rep is thickStart if within the peak, else the 5' edge."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)"))
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    start, end, thick = at(1).try_cast("long"), at(2).try_cast("long"), F.expr("try_cast(get(split(value, '\t'), 6) AS BIGINT)")
    strand = F.when(at(5) == "-", "-").otherwise("+")
    rep = F.when((thick >= start) & (thick < end), thick).otherwise(F.when(strand == "-", end - 1).otherwise(start))
    rows = lines.select(at(0).alias("contig"), strand.alias("strand"), start.alias("start"), end.alias("end"), rep.alias("rep"), F.expr("coalesce(try_cast(get(split(value, '\t'), 4) AS DOUBLE), 0)").alias("score"), at(3).alias("name"))
    return rows.where((F.col("start").isNotNull()) & (F.col("score") >= min_score))


def read_bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A step function (contig, start, end, value), summed over files where steps are equal."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|\\s*$)"))
    at = lambda i, kind: F.get(F.split("value", "\\s+"), F.lit(i)).cast(kind)
    return lines.select(at(0, "string").alias("contig"), at(1, "long").alias("start"), at(2, "long").alias("end"), at(3, "double").alias("value")).groupBy("contig", "start", "end").agg(F.sum("value").alias("value"))


def read_umis(spark: SparkSession, path: str, cell: str = "cell_barcode", umi: str = "umi", name: str = "read_name") -> DataFrame:
    """(read_name, cell, umi) by header; short rows are skipped."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col(name).alias("read_name"), F.col(cell).alias("cell"), F.col(umi).alias("umi")).where("read_name IS NOT NULL AND cell IS NOT NULL AND umi IS NOT NULL")


CHUNK = 1 << 16


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(contig, chunk, seq): upper-case pieces of `chunk` bases.

    Lines get their offset in the record by a window over each record's lines, so a contig's lines meet
    in one task once, when a genome is imported; queries read the chunks.
    """
    lines = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    contig = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", ""))
    pieces = lines.select(contig.alias("contig"), body.alias("b")).select("contig", "b", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("b"), F.lit(1)) - 1) / chunk))).alias("chunk"))
    return pieces.select("contig", "chunk", F.substring("b", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk)).alias("seq"))


def fetch(windows: DataFrame, genome: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """windows(id, contig, s, e) with seq: the bases of [s, e), clipped to the contig; equi-join on chunks."""
    w = windows.select("id", "contig", F.greatest("s", F.lit(0)).alias("s"), "e").where("e > s").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("s") / chunk), F.floor((F.col("e") - 1) / chunk))))
    lo = F.greatest(F.col("s") - F.col("chunk") * chunk, F.lit(0))
    hi = F.least(F.col("e") - F.col("chunk") * chunk, F.lit(chunk))
    part = F.substring("seq", (lo + 1).cast("int"), (hi - lo).cast("int"))
    parts = w.join(genome, ["contig", "chunk"]).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    return windows.join(parts, "id", "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def write_gtf(models: DataFrame, path: str, source: str = "strandloom") -> None:
    """Transcript and exon rows in order of contig, start and end; exons are numbered in genomic order.

    models(contig, strand, exons, gene_id, model_name, and any of category, n_reads, n_mols). Files follow
    each other in order: no single task writes all.
    """
    names = [c for c in ("category", "n_reads", "n_mols") if c in models.columns]
    attrs = F.concat(F.lit('gene_id "'), F.coalesce("gene_id", F.lit("none")), F.lit('"; transcript_id "'), "model_name", F.lit('";'), *(F.coalesce(F.concat(F.lit(f' {"n_molecules" if n == "n_mols" else n} "'), F.col(n).cast("string"), F.lit('";')), F.lit("")) for n in names))
    m = models.withColumns({"attrs": attrs, "lo": F.element_at("exons", 1)["s"], "hi": F.element_at("exons", -1)["e"]})
    line = lambda kind, s, e, extra: F.concat_ws("\t", F.col("contig").cast("string"), F.lit(source), F.lit(kind), (s + 1).cast("string"), e.cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.col("attrs"), extra))
    tx = m.select("contig", "lo", "hi", "model_name", F.lit(0).alias("n"), line("transcript", F.col("lo"), F.col("hi"), F.lit("")).alias("value"))
    ex = m.select("*", F.posexplode("exons").alias("n", "x")).select("contig", "lo", "hi", "model_name", (F.col("n") + 1).alias("n"), line("exon", F.col("x.s"), F.col("x.e"), F.concat(F.lit(' exon_number "'), (F.col("n") + 1).cast("string"), F.lit('";'))).alias("value"))
    tx.unionAll(ex).orderBy("contig", "lo", "hi", "model_name", "n").select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; numbers to four digits; null is empty."""
    four = [F.when(F.col(c).isNotNull(), F.format_string("%.4g", c)).alias(c) if t in ("double", "float") else F.array_join(c, ",").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes]
    df.select(*four).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", nullValue="", quote="\u0000")


def write_matrix(matrix: DataFrame, path: str) -> None:
    """MatrixMarket coordinates as <path>/matrix, and the ids as <path>/rows and <path>/cols. matrix: of operators.molecules.matrix."""
    size = matrix.agg(F.coalesce(F.max("row"), F.lit(0)), F.coalesce(F.max("col"), F.lit(0)), F.count("*")).first()
    spark = matrix.sparkSession
    head = spark.createDataFrame([(0, 0, 0, "%%MatrixMarket matrix coordinate integer general"), (0, 0, 1, f"{size[0]} {size[1]} {size[2]}")], "row int, col int, k int, value string")
    body = matrix.select("row", "col", F.lit(2).alias("k"), F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.col("n").cast("string")).alias("value"))
    head.unionByName(body).orderBy("row", "col", "k").select("value").write.mode("overwrite").text(f"{path}/matrix")
    for kind, name in (("row", "model_id"), ("col", "cell")):
        matrix.select(kind, F.col(name).cast("string").alias("value")).distinct().orderBy(kind).select("value").write.mode("overwrite").text(f"{path}/{kind}s")


def read_stat(assigned: DataFrame) -> DataFrame:
    """assigned(read_name, start, end, model_name) as id, length, is_fl, stat, pbid; length is the genomic span."""
    return assigned.select(F.col("read_name").alias("id"), (F.col("end") - F.col("start")).alias("length"), F.lit("Y").alias("is_fl"), F.when(F.col("model_name").isNull(), "unassigned").otherwise("unique").alias("stat"), F.coalesce("model_name", F.lit("NA")).alias("pbid"))


def group_members(assigned: DataFrame) -> DataFrame:
    """(model_name, part, names): reads of each model, in bounded parts of a few thousand names."""
    part = F.floor((F.row_number().over(Window.partitionBy("model_name", F.pmod(F.xxhash64("read_name"), F.lit(64))).orderBy("read_name")) - 1) / 4096)
    rows = assigned.where("model_name IS NOT NULL").withColumns({"salt": F.pmod(F.xxhash64("read_name"), F.lit(64)), "part": part})
    return rows.groupBy("model_name", "salt", "part").agg(F.array_join(F.sort_array(F.collect_list("read_name")), ",").alias("names"))


def sample_rows(df: DataFrame, n: int, total: int, seed: int = 7) -> DataFrame:
    """About n of `total` rows, drawn over the whole table and not from its head."""
    return df.sample(fraction=min(1.0, n / max(1, total)), seed=seed)


def read_categories(spark: SparkSession, path: str, names: tuple[str, ...] = ("model_id", "isoform", "transcript_id", "pbid"), kinds: tuple[str, ...] = ("category", "structural_category"), support: tuple[str, ...] = ("n_reads", "n_molecules", "support")) -> DataFrame:
    """(model_id, category, support) of a table with a header, by the first of the names that it has; no other column is read."""
    rows = spark.read.csv(path, sep="\t", header=True)
    pick = lambda options: next((c for c in options if c in rows.columns), None)
    name, kind, count = pick(names), pick(kinds), pick(support)
    if not name or not kind:
        raise ValueError(f"{path} has no column of {names} or of {kinds}")
    return rows.select(F.col(name).alias("model_id"), F.col(kind).alias("category"), (F.col(count).try_cast("long") if count else F.lit(None).cast("long")).alias("support"))


def model_spans(rows: DataFrame) -> DataFrame:
    """GTF rows to (model_id, contig, strand, n_exons, start, end, span) of each transcript."""
    x = rows.where("feature = 'exon' AND tx_id IS NOT NULL").groupBy(F.col("tx_id").alias("model_id")).agg(F.min("contig").alias("contig"), F.min("strand").alias("strand"), F.count("*").alias("n_exons"), F.min("s").alias("start"), F.max("e").alias("end"))
    return x.withColumn("span", F.col("end") - F.col("start"))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(read_name, model_id) of a read_stat table; unassigned reads are left out."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col("id").alias("read_name"), F.col("pbid").alias("model_id")).where("model_id IS NOT NULL AND model_id <> 'NA'")


def assignment_counts(assigned: DataFrame) -> DataFrame:
    """One row: rows, distinct reads, and reads that stand with more than one model."""
    each = assigned.groupBy("read_name").agg(F.count("*").alias("n"), F.count_distinct("model_id").alias("m"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_reads"), F.count_if(F.col("m") > 1).alias("n_with_several"))
