"""Joins that Spark has no operator for, as equi-joins: by bins, by neighbours, by suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bins(start: Column, end: Column, size: int) -> Column:
    """Numbers of the bins that [start, end) touches; an empty interval touches its start's."""
    return F.sequence(F.floor(start / size), F.floor(F.greatest(end - 1, start) / size))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], size: int, slack: int = 0) -> DataFrame:
    """Rows of left(keys, s, e) and right(keys, rs, re) that overlap, by at least a base or within slack.

    Both sides are exploded over bins of `size`, so it is an equi-join. A pair is kept only in the bin
    where its overlap begins: no distinct is needed. Column names must differ but for keys.
    """
    a = left.withColumn("_bin", F.explode(bins(F.col("s") - slack, F.col("e") + slack, size)))
    b = right.withColumn("_bin", F.explode(bins(F.col("rs"), F.col("re"), size)))
    first = F.greatest(F.floor((F.col("s") - slack) / size), F.floor(F.col("rs") / size))
    return a.join(b, [*keys, "_bin"]).where((F.col("s") - slack < F.col("re")) & (F.col("rs") < F.col("e") + slack) & (F.col("_bin") == first)).drop("_bin")


def nearest_within(points: DataFrame, sites: DataFrame, keys: list[str], tol: int) -> DataFrame:
    """points(keys, pos, ..) with site: the nearest of sites(keys, site) within tol, the smaller one on ties, else null.

    Bins wider than tol: a point looks into its bin and both neighbours, so hot positions meet few rows.
    """
    size = max(1, 2 * tol + 1)
    ids = points.select(*keys, "pos").distinct()
    near = ids.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("pos") / size) + i for i in (-1, 0, 1)])))
    marks = sites.select(*keys, "site").distinct().withColumn("_bin", F.floor(F.col("site") / size))
    best = near.join(marks, [*keys, "_bin"]).where(F.abs(F.col("site") - F.col("pos")) <= tol).groupBy(*keys, "pos").agg(F.min_by("site", F.struct(F.abs(F.col("site") - F.col("pos")), "site")).alias("site"))
    return points.join(best, [*keys, "pos"], "left")


def nearest_any(points: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys, pos) with site: the nearest at any distance, the smaller one on ties; null without any.

    Distinct positions and sites are merged and the last site before and the first after are looked up
    in one sorted pass per key and 1 Mb range; edges of a range come from its neighbours' aggregates.
    """
    span = 1 << 20
    p = points.select(*keys, F.col("pos").alias("x")).distinct().withColumn("own", F.lit(None).cast("long"))
    q = sites.select(*keys, F.col("site").alias("x")).distinct().withColumn("own", F.col("x"))
    both = p.unionByName(q).withColumn("_r", F.floor(F.col("x") / span))
    ranges = both.groupBy(*keys, "_r").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
    w = Window.partitionBy(*keys).orderBy("_r")
    ranges = ranges.select(*keys, "_r", F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    inner = Window.partitionBy(*keys, "_r").orderBy("x")
    near = both.withColumns({"l": F.last("own", True).over(inner.rangeBetween(Window.unboundedPreceding, 0)), "n": F.first("own", True).over(inner.rangeBetween(0, Window.unboundedFollowing))}).where("own IS NULL")
    near = near.join(ranges, [*keys, "_r"]).select(*keys, F.col("x").alias("pos"), F.coalesce("l", "before").alias("l"), F.coalesce("n", "after").alias("n"))
    site = F.when(F.col("l").isNull(), F.col("n")).when(F.col("n").isNull(), F.col("l")).when(F.col("pos") - F.col("l") <= F.col("n") - F.col("pos"), F.col("l")).otherwise(F.col("n"))
    return points.join(near.select(*keys, "pos", site.alias("site")), [*keys, "pos"], "left")


def interval_union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, s, e) to the union's islands (keys, s, e); touching intervals are one."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, "s", "e").distinct().withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def runs_by_gap(rows: DataFrame, keys: list[str], pos: str, gap: int, span: int = 1 << 20) -> DataFrame:
    """rows with _run: the first position of the stretch that theirs belongs to; stretches lie over `gap` apart.

    Distinct positions are sorted within ranges of `span`; what a range's first position joins on to is
    told by the last ones of the ranges before it, so no task holds more than a range, and a stretch may
    cross any number of them.
    """
    at = rows.select(*keys, F.col(pos).alias("_x")).distinct().withColumn("_r", F.floor(F.col("_x") / span))
    inner = Window.partitionBy(*keys, "_r").orderBy("_x")
    edges = at.groupBy(*keys, "_r").agg(F.max("_x").alias("_hi"))
    before = Window.partitionBy(*keys).orderBy("_r")
    edges = edges.select(*keys, "_r", F.lag("_hi").over(before).alias("_last"))
    at = at.join(edges, [*keys, "_r"]).withColumn("_prev", F.coalesce(F.lag("_x").over(inner), "_last"))
    at = at.withColumn("_first", F.when(F.col("_prev").isNull() | (F.col("_x") - F.col("_prev") > gap), F.col("_x")))
    carried = at.groupBy(*keys, "_r").agg(F.max("_first").alias("_open"))
    carried = carried.select(*keys, "_r", F.last("_open", True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    own = F.max("_first").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    runs = at.withColumn("_own", own).join(carried, [*keys, "_r"]).select(*keys, F.col("_x").alias(pos), F.coalesce("_own", "_from").alias("_run"))
    return rows.join(runs, [*keys, pos])


def numbered(ids: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a column with a number from 1 in their order: counted by ranges, not in one task."""
    from ..plans.lineage import cut

    # the ranges are kept, so that both readings of them see the same parts
    parts = cut(ids.select(column).distinct().repartitionByRange(F.col(column)).select(column, F.spark_partition_id().alias("_part")))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each part
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return parts.withColumn("_place", place).join(F.broadcast(sizes), "_part").select(column, (F.col("_place") + F.col("_before")).cast("int").alias(name))
