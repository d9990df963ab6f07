"""python -m strandloom: run, config, sj, compare, check, index-umi, diagnose-umi."""

from __future__ import annotations

import argparse
import json
import sys

from . import config


PATHS = ("alignments", "annotation", "genome", "umis", "polya_sites", "out")
MODES = ["none", "strip_segment", "strip_ccs", "zmw"]


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: the gates refused the input; 2: bad settings or another error."""
    parser = argparse.ArgumentParser(prog="strandloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "config"):
        p = sub.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        for option in PATHS:
            p.add_argument(f"--{option.replace('_', '-')}")
    p = sub.add_parser("sj")
    p.add_argument("tables", nargs="+")
    p = sub.add_parser("compare")
    p.add_argument("gtf", nargs="+")
    p.add_argument("--tolerance", type=int, default=100)
    p = sub.add_parser("check")
    for option in ("alignments", "models", "read-stat"):
        p.add_argument(f"--{option}", required=True)
    p.add_argument("--per-class", type=int, default=25)
    for name in ("index-umi", "diagnose-umi"):
        p = sub.add_parser(name)
        p.add_argument("--umis", required=True)
        p.add_argument("--normalise", default="none")
        p.add_argument("--out" if name == "index-umi" else "--alignments", required=True)
    args = parser.parse_args(argv)
    try:
        if args.command in ("run", "config"):
            cfg = config.load(args.config) if args.config else config.Config()
            for option in PATHS:
                if getattr(args, option):
                    cfg = config.override(cfg, option, getattr(args, option))
            for pair in args.set:
                name, _, value = pair.partition("=")
                cfg = config.override(cfg, name, value)
            cfg.check()
            if args.command == "config":
                print(config.dump(cfg))
                return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        if args.command == "run":
            from .plans.catalogue import GateError, run

            try:
                run(spark, cfg)
            except GateError as e:
                print(e, file=sys.stderr)
                return int(cfg.strict)
        elif args.command == "sj":
            from .operators.evidence import concordance
            from .sources.text import read_star

            concordance(read_star(spark, args.tables)).show(truncate=False)
        elif args.command == "check":
            facts = audit(spark, args.alignments, args.models, args.read_stat, args.per_class)
            print(json.dumps(facts, indent=2, default=str))
            return int(facts["n_mono_mismatch"] > 0 or facts["n_with_several"] > 0)
        elif args.command == "index-umi":
            index_umis(spark, args.umis, args.normalise, args.out)
        elif args.command == "diagnose-umi":
            found = diagnose(spark, args.umis, args.alignments)
            print(json.dumps(found, indent=2))
            return int(found["use"] is None)
        else:
            compare(spark, args.gtf, args.tolerance).show(truncate=False)
    except (ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def compare(spark, paths: list[str], tolerance: int):
    """How many of several catalogues hold each structure, by category."""
    from functools import reduce

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from .operators.evidence import concordance_summary, structural_match
    from .sources.text import annotation, read_gtf

    models = []
    for path in paths:
        rows = read_gtf(spark, path, features=("exon",))
        extra = rows.groupBy("tx_id").agg(F.coalesce(F.max("category"), F.lit("unknown")).alias("category"), F.coalesce(F.max("n_molecules"), F.max("n_reads"), F.lit(1)).alias("support"))
        models.append(annotation(rows).join(extra, "tx_id").select(F.lit(path).alias("sample"), F.col("tx_id").alias("model_id"), "contig", "strand", "chain", F.col("tts").alias("three"), "category", "support"))
    return concordance_summary(structural_match(reduce(DataFrame.unionByName, models), tolerance))


def _alignments(spark, path: str):
    from .sources.alignments import read_bam, read_sam

    return (read_bam if path.endswith(".bam") else read_sam)(spark, path)


def audit(spark, alignments: str, models: str, read_stat: str, per_class: int = 25) -> dict:
    """Any catalogue held against the alignments it was made of: exons per read, mass of single-exon models, models that are not like their reads."""
    from pyspark.sql import functions as F

    from .operators import reports as P
    from .sources import alignments as A
    from .sources import text as T

    reads = A.primary(_alignments(spark, alignments))
    spans = A.admitted_columns(reads).select("read_name", (F.col("end") - F.col("start")).alias("span"), (F.size("chain") + 1).alias("n_exons"))
    catalogue = T.model_spans(T.read_gtf(spark, models, features=("exon",)))
    assigned = T.read_assignments(spark, read_stat)
    facts = T.assignment_counts(assigned).first().asDict()
    counts = assigned.groupBy("model_id").agg(F.count("*").alias("n_reads")).join(catalogue, "model_id")
    mass = counts.agg(F.count("*").alias("n_models"), (F.sum(F.when(F.col("n_exons") == 1, F.col("n_reads")).otherwise(0)) / F.sum("n_reads")).alias("mono_mass")).first().asDict()
    kind = F.when(F.col("n_exons") == 1, "mono-exon").otherwise("multi-exon")
    top = P.top_models(counts.withColumn("class", kind), per_class)
    # of the chosen models a bounded number of reads, by a hash of their names
    chosen = P.sample_reads(assigned, top).join(spans, "read_name")
    held = P.step_mismatch(chosen.select("model_id", "span", "n_exons"), catalogue.join(top.select("model_id"), "model_id", "left_semi"))
    seen = held.agg(F.count("*").alias("n_inspected"), F.count_if("is_min").alias("n_is_min"), F.count_if("is_max").alias("n_is_max"), F.count_if("mono_mismatch").alias("n_mono_mismatch")).first().asDict()
    return facts | mass | seen | {"exons_per_read": {r["n_exons"]: r["n"] for r in A.exon_histogram(reads).collect()}}


def index_umis(spark, path: str, normalise: str, out: str) -> None:
    """The UMI table as Parquet by normalised name, one row each, sorted within its files so that name ranges can be skipped."""
    from pyspark.sql import functions as F

    from .functions.sequence import normalise_name
    from .sources.text import read_umis

    rows = read_umis(spark, path).groupBy(normalise_name(F.col("read_name"), normalise).alias("read_name")).agg(F.min(F.struct("cell", "umi")).alias("m"))
    rows.select("read_name", "m.cell", "m.umi").sortWithinPartitions("read_name").write.mode("overwrite").parquet(out)


def diagnose(spark, path: str, alignments: str, rows: int = 200_000) -> dict:
    """Which column of the UMI table, read which way, holds the reads' names: from a sample over the whole table."""
    from .operators.evidence import name_hits, safe_modes
    from .sources.alignments import read_names
    from .sources.text import sample_rows

    table = spark.read.csv(path, sep="\t", header=True)
    hits = safe_modes(name_hits(sample_rows(table, rows, table.count()), table.columns, read_names(_alignments(spark, alignments)), MODES))
    found = [r.asDict() for r in hits.collect()]
    safe = sorted((r for r in found if not r["unsafe"]), key=lambda r: (-r["hits"], MODES.index(r["mode"]), r["column"]))
    return {"use": {k: safe[0][k] for k in ("column", "mode")} if safe else None, "hits": sorted(found, key=lambda r: (r["column"], MODES.index(r["mode"])))}
