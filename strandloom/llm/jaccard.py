"""N-gram Jaccard self-join with several global token orders, and the classes that its links form.

Documents of equal shingle sets are one node. If two sets are similar enough, their prefixes share a
token under any order of all tokens. The first order is: a hash class first, then how many nodes hold
the token, then its hash; so tokens of one class are counted over all nodes. Nodes that share no
prefix token with another are done. The second order is by how many of the remaining nodes hold a
token, all tokens counted. Tokens of one node match nothing but fill its prefix, so rare wording keeps
documents apart that merely share passages. Positions bound the overlap, which drops most of the rest.
The further orders are seeded hashes; a candidate must share a prefix token under each of them too,
before the sets themselves are compared.

Buckets (tokens) aren't expanded into pairs: first each node is held against one centre of its bucket,
the one with the fewest words of its own; links found so unite most of a group of near copies, and
only nodes of a bucket that are still in different components are paired after that. So no link that
could unite components is lost, and the components are exact.

Documents: words are runs without 0x20 and 0x09-0x0D, A-Z lowered; the set is the distinct runs of k
words, or the whole sequence if it is shorter. Null or empty texts have no shingles and are linked with
nothing. Rows that repeat a doc_id are one document (of its longest text) and each get its result;
rows of null doc_id get a null component. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import drop_stash, hinted, map_batches, mix, shingle_hashes, stash, table, word_hashes
from .components import components

#: Seeds of the orders by hash that follow the first order.
ORDERS = (101, 202)


def class_bits(percent: int) -> int:
    """The first order's leading class holds 1 / 2**bits of all tokens: at least twice a prefix."""
    bits = 0
    while 0.5 ** (bits + 1) >= 2 * (1 - percent / 100) and bits < 6:
        bits += 1
    return bits


def prefix_size(n, percent: int):
    """A set of n tokens with a partner shares at least ceil(percent * n / 100) tokens with it."""
    return n - (-(-n * percent // 100)) + 1


def one_row_each(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null); of rows that repeat a doc_id the longest text, then the greatest."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = again.count()
    if not n:
        return rows
    again = hinted(again, n)
    chosen = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(F.length("text"), F.col("text"))).alias("t")).select("doc_id", F.col("t.text"))
    return rows.join(again, "doc_id", "left_anti").unionAll(chosen)


def shingles(text: bytes, k: int) -> np.ndarray:
    return shingle_hashes(word_hashes(text.lower()), k)


def set_keys(rows: DataFrame, k: int, bits: int) -> DataFrame:
    """rows(doc_id, text) to (doc_id, n_shingles, first, k1, k2); the keys name the set, first counts its tokens of the leading class."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            keys = [np.array([mix(s, seed).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for seed in (1, 2)]
            first = pa.array([int(((s & mask) == 0).sum()) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), first, *map(pa.array, keys)], names=["doc_id", "n_shingles", "first", "k1", "k2"])

    return map_batches(rows.select("doc_id", F.col("text").cast("binary")), run, "doc_id long, n_shingles long, first long, k1 long, k2 long")


def tokens(rows: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """The tokens of each set that its prefix under a counting order can hold: (h, node).

    Those of the leading class, which holds 1 / 2**bits of all tokens, if they fill the prefix, else all.
    """
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 500):
                nodes, found = [], []
                for node, text in zip(ids[at : at + 500], texts[at : at + 500], strict=True):
                    s = shingles(text, k)
                    if len(s):
                        first = s[(s & mask) == 0]
                        found.append(s if len(first) < prefix_size(len(s), percent) else first)
                        nodes.append(node)
                if nodes:
                    own = np.repeat(np.array(nodes, np.int64), [len(x) for x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(own)], names=["h", "node"])

    return map_batches(rows.select("doc_id", F.col("text").cast("binary")), run, "h long, node long")


def prefixes(tokens: DataFrame, sizes: DataFrame, percent: int, bits: int) -> DataFrame:
    """Prefix tokens that more than one node holds: (h, node, n, pos, own); own: the share of a node's tokens that no other node holds.

    sizes(node, n, first): of each set, and of its part in the leading class. They are joined after the
    tokens of one node are gone, so the large shuffles hold (h, node) alone.
    """
    counts = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    held = tokens.join(counts, "h").join(sizes, "node").withColumn("late", (F.col("h").bitwiseAND((1 << bits) - 1) != 0).cast("int"))
    held = held.withColumns({"p": size, "m0": F.col("first"), "m1": F.when(F.col("first") < size, F.col("n") - F.col("first")).otherwise(0)})
    by_node = Window.partitionBy("node")
    ranked = held.withColumns(
        {
            "rank": F.row_number().over(by_node.orderBy("late", "df", "h")),
            "c0": F.sum(1 - F.col("late")).over(by_node),
            "c1": F.sum("late").over(by_node),
        }
    )
    pos = F.when(F.col("late") == 0, F.col("rank") + F.col("m0") - F.col("c0")).otherwise(F.col("rank") - F.col("c0") + F.col("m0") + F.col("m1") - F.col("c1"))
    own = 1 - (F.col("c0") + F.col("c1")) / (F.col("m0") + F.col("m1"))
    return ranked.select("h", "node", F.col("n").cast("int").alias("n"), pos.cast("int").alias("pos"), own.alias("own"), "p").where("pos <= p").drop("p")


def can_link(n1: Column, pos1: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Whether sets whose first shared token has these positions can be similar enough; size bounds are part of it."""
    return (1 + F.least(n1 - pos1, n2 - pos2)) * (100 + percent) >= (n1 + n2) * percent


def verify(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share a prefix token under all further orders and are similar enough."""
    pairs = stash(pairs.select("a", "b"), "jaccard-pairs")
    nodes = stash(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "jaccard-nodes")
    texts = rows.join(hinted(nodes, nodes.count()), "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("text"))
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[int, tuple] = OrderedDict()
        held = 0

        def of(node: int, text: bytes) -> tuple:
            nonlocal held
            found = cache.get(node)
            if found is None:
                s = shingles(text, k)
                p = prefix_size(len(s), percent)
                found = cache[node] = (s, [np.sort(np.partition(mix(s, seed), p - 1)[:p]) for seed in ORDERS])
                held += len(s)
                while held > 4_000_000 and len(cache) > 2:
                    held -= len(cache.popitem(last=False)[1][0])
            return found

        for batch in batches:
            ids_a, ids_b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = np.zeros(len(ids_a), bool)
            for i, (a, b) in enumerate(zip(ids_a, ids_b, strict=True)):
                sa, pa_ = of(a, batch.column(2)[i].as_py())
                sb, pb_ = of(b, batch.column(3)[i].as_py())
                if all(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(pa_, pb_, strict=True)):
                    shared = len(np.intersect1d(sa, sb, assume_unique=True))
                    keep[i] = 100 * shared >= percent * (len(sa) + len(sb) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return map_batches(both, run, "a long, b long")


def similar_classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """docs(doc_id, text) to a row for each row: doc_id, n_shingles, component_id, same_set_id."""
    rows = one_row_each(docs)
    bits = class_bits(percent)
    sets = stash(set_keys(rows, k, bits), "jaccard-sets")
    kinds = sets.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    copied = kinds.where("copies > 1")
    copies = stash(sets.join(copied, ["k1", "k2", "n_shingles"]).where("doc_id <> node").select("doc_id", "node"), "jaccard-copies")
    unique = rows.join(hinted(copies.select("doc_id"), copies.count()), "doc_id", "left_anti")

    # the first order counts a class of tokens over all documents, the second all tokens of those that
    # the first could not set apart
    held = stash(tokens(unique, k, percent, bits), "jaccard-tokens")
    sizes = sets.where("n_shingles > 0").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "first")
    prefix = prefixes(held, sizes, percent, bits)
    met = stash(prefix.select("h", "node"), "jaccard-met")
    drop_stash(held)
    shared = met.groupBy("h").count().where("count > 1").select("h")
    met = stash(met.join(shared, "h", "left_semi").select(F.col("node").alias("doc_id")).distinct(), "jaccard-met")
    held = stash(tokens(unique.join(hinted(met, met.count()), "doc_id", "left_semi"), k, percent, 0), "jaccard-tokens")
    prefix = stash(prefixes(held, sizes.withColumn("first", F.col("n")), percent, 0), "jaccard-prefixes")
    drop_stash(held)

    centre = prefix.groupBy("h").agg(F.min(F.struct("own", "node", "n", "pos")).alias("c"), F.count("*").alias("members")).where("members > 1").select("h", F.col("c.node").alias("cn"), F.col("c.n").alias("cs"), F.col("c.pos").alias("cp"))
    stars = prefix.join(centre, "h").where(F.col("node") != F.col("cn")).where(can_link(F.col("n"), F.col("pos"), F.col("cs"), F.col("cp"), percent))
    stars = stash(stars.select(F.least("node", "cn").alias("a"), F.greatest("node", "cn").alias("b")).distinct(), "jaccard-stars")
    links = stash(verify(stars, unique, k, percent), "jaccard-links")
    first = stash(components(links), "jaccard-first")

    known = prefix.join(first, "node", "left").select("h", "node", "n", "pos", F.coalesce("component", "node").alias("c"))
    split = known.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    known = known.join(split, "h", "left_semi")
    left, right = known.select("h", *(F.col(x).alias(x + "1") for x in ("node", "n", "pos", "c"))), known.select("h", *(F.col(x).alias(x + "2") for x in ("node", "n", "pos", "c")))
    rest = left.join(right, "h").where("node1 < node2 AND c1 <> c2").where(can_link(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"), percent))
    rest = rest.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    found = components(links.unionAll(verify(rest, unique, k, percent)))

    member = copies.join(found.withColumnRenamed("component", "c"), "node", "left").select("doc_id", F.coalesce("c", "node").alias("component_id"), F.col("node").alias("same_set_id"))
    member = member.unionAll(found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"), F.col("node").alias("same_set_id")))
    result = sets.select("doc_id", "n_shingles").join(member, "doc_id", "left")
    result = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.lit(0)).alias("none")).join(result, "doc_id", "left")
    return result.select("doc_id", F.coalesce("n_shingles", "none").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("same_set_id", "doc_id").alias("same_set_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), 3, 90)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s),
rep AS (SELECT min(doc_id) AS r, any_value(n) AS n, sh FROM n WHERE n > 0 GROUP BY sh),
t AS (SELECT r, n, unnest(sh) AS g FROM rep),
p AS (SELECT a.r AS a, b.r AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.r < b.r AND a.n * 100 >= 90 * b.n AND b.n * 100 >= 90 * a.n GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS x, a AS y FROM u UNION SELECT reach.x, u.b FROM reach JOIN u ON reach.y = u.a),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
k AS (SELECT n.doc_id, n.n, CASE WHEN n.n = 0 THEN n.doc_id ELSE rep.r END AS r FROM n LEFT JOIN rep ON n.sh = rep.sh)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(c, r) AS component_id, r AS same_set_id FROM k LEFT JOIN comp ON k.r = comp.x
"""
