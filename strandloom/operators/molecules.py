"""Molecules: distinct UMIs of a cell, with directional merging of neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import normalise_name
from .joins import numbered


def attach(reads: DataFrame, molecules: DataFrame, how: str = "none") -> DataFrame:
    """Left join of molecules(read_name, cell, umi) by the normalised name; both sides are keyed alike.

    Of rows whose names become one, that of the smallest (cell, umi) counts, whatever their order.
    """
    index = molecules.select(normalise_name(F.col("read_name"), how).alias("_name"), "cell", "umi").groupBy("_name").agg(F.min(F.struct("cell", "umi")).alias("_m")).select("_name", "_m.cell", "_m.umi")
    return reads.withColumn("_name", normalise_name(F.col("read_name"), how)).join(index, "_name", "left").drop("_name")


def exact_counts(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell, umi, n): reads of each pair; unknown pairs are left out."""
    return reads.where("cell IS NOT NULL AND umi IS NOT NULL").groupBy(*keys, "cell", "umi").agg(F.count("*").alias("n"))


def merge_cell(counts: dict[str, int]) -> dict[str, str]:
    """UMI to its representative: by falling count, each takes unclaimed neighbours at distance 1 of which it has 2n - 1 or more; those claimed claim none."""
    owner: dict[str, str] = {}
    for u in sorted(counts, key=lambda x: (-counts[x], x)):
        if u in owner:
            continue
        owner[u] = u
        if set(u) - set("ACGT"):
            continue
        for i, had in enumerate(u):
            for base in "ACGT":
                v = u[:i] + base + u[i + 1 :]
                if base != had and v in counts and v not in owner and counts[u] >= 2 * counts[v] - 1:
                    owner[v] = u
    return owner


def collapse_umis(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell, umi, n): reads of each molecule.

    Counts come first, so what goes to Python, in Arrow batches of many cells, is a cell's distinct UMIs
    within a key, never its reads; cells with one UMI, the most of them, don't go there at all.
    """
    cells = exact_counts(reads, keys).groupBy(*keys, "cell").agg(F.collect_list("umi").alias("us"), F.collect_list("n").alias("ns"))
    alone = cells.where(F.size("us") == 1).select(*keys, "cell", F.col("us")[0].alias("umi"), F.col("ns")[0].alias("n"))
    merged = cells.where(F.size("us") > 1).select(*keys, "cell", F.explode(_merge_udf()(F.col("us"), F.col("ns"))).alias("_merged"))
    return alone.unionByName(merged.select(*keys, "cell", "_merged.umi", "_merged.n"))


def _merge_udf():
    @F.pandas_udf("array<struct<umi:string,n:bigint>>")
    def merge(us: pd.Series, ns: pd.Series) -> pd.Series:
        out = []
        for u, n in zip(us, ns, strict=True):
            counts = dict(zip(u.tolist(), n.tolist(), strict=True))
            total: dict[str, int] = {}
            for umi, to in merge_cell(counts).items():
                total[to] = total.get(to, 0) + counts[umi]
            out.append([{"umi": k, "n": v} for k, v in total.items()])
        return pd.Series(out)

    return merge


def support_counts(reads: DataFrame, keys: list[str], *extra: Column, merge: bool = True) -> DataFrame:
    """(keys, n_reads, n_mols, n_cells, extra..): molecules are UMIs of a cell after directional merging; unknown ones count as reads alone.

    The counts of one aggregate feed the next, so reads are shuffled once, after partial sums. extra:
    aggregates by min or max of a column, named by alias, that go along.
    """
    names = [c._jc.toString().rpartition(" AS ")[2].strip("`") for c in extra]
    again = [F.expr(f"{'min' if c._jc.toString().lower().startswith('min') else 'max'}(`{n}`)").alias(n) for c, n in zip(extra, names, strict=True)]
    known = F.col("cell").isNotNull() & F.col("umi").isNotNull()
    each = reads.groupBy(*keys, "cell", "umi").agg(F.count("*").alias("_n"), *extra)
    cells = each.groupBy(*keys, "cell").agg(F.sum("_n").alias("_n"), F.collect_list(F.when(known, F.struct(F.col("umi").alias("u"), F.col("_n").alias("n")))).alias("_m"), *again)
    merged = F.size(_merge_udf()(F.transform("_m", lambda x: x["u"]), F.transform("_m", lambda x: x["n"])))
    cells = cells.select(*keys, "cell", "_n", "_m", *names)
    if not merge:  # distinct UMIs as they are
        return cells.groupBy(*keys).agg(F.sum("_n").alias("n_reads"), F.sum(F.size("_m")).cast("long").alias("n_mols"), F.count("cell").alias("n_cells"), *again)
    alone = cells.where(F.size("_m") < 2).withColumn("_k", F.size("_m"))
    many = cells.where(F.size("_m") > 1).withColumn("_k", merged)
    both = alone.unionByName(many)
    return both.groupBy(*keys).agg(F.sum("_n").alias("n_reads"), F.sum("_k").cast("long").alias("n_mols"), F.count("cell").alias("n_cells"), *again)


def molecule_weights(reads: DataFrame, keys: list[str]) -> DataFrame:
    """reads with weight: 1 over the reads of its molecule within the key; 1 where it is unknown."""
    n = F.count("*").over(Window.partitionBy(*keys, "cell", "umi"))
    return reads.withColumn("weight", F.when(F.col("cell").isNull() | F.col("umi").isNull(), F.lit(1.0)).otherwise(1.0 / n))


def matrix(counts: DataFrame, model: str = "model_id") -> DataFrame:
    """(row, col, n) with indices from 1 in order of the ids, as a MatrixMarket body. counts: (model, cell, n)."""
    rows, cols = numbered(counts, model, "row"), numbered(counts, "cell", "col")
    return counts.join(rows, model).join(cols, "cell").select("row", "col", model, "cell", "n")
