"""The corpus pipeline: language ID, quality, near duplicates, decontamination, tokens.

STAGES are functions of (spark, docs, sf_dir); all but the last return the columns of docs. Documents
go if they have no language (no letter, or a score under MIN_LANGUAGE_SCORE), if the quality classifier
rejects them, if a near duplicate of a smaller doc_id stays (five words, similarity 0.8), or if they
hold a benchmark passage. Rows that repeat a doc_id and its text are copies: one stays. Different texts of
one doc_id, and texts of null doc_id, are documents of their own. Extra columns of docs stay as they are;
null and empty texts have no language and go in the first stage. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, cotrain, jaccard, language, tiling
from strandloom.llm.common import hinted, stash, table

MIN_LANGUAGE_SCORE = 0.3
SHINGLE_WORDS, SIMILARITY = 5, 80


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less those that have the values of a row of ids; documents are only shuffled if very many go."""
    ids = stash(ids.distinct(), "dropped")
    return docs.join(hinted(ids, ids.count()), ids.columns, "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.predict(docs, language.train(docs), docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    return cotrain.classify(docs, model, docs.columns).where("kept").select(*docs.columns)


def with_nodes(docs: DataFrame) -> DataFrame:
    """docs with node, a number of its own for each row that stays: doc_id where it is one row's alone.

    Rows of equal doc_id and text (null ids are equal too) are copies, of which the row of greatest other
    columns stays; different texts of one doc_id, and texts without one, get numbers beyond all ids.
    """
    odd = stash(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.coalesce("doc_id", F.lit(0)).alias("_odd"), F.col("doc_id").isNull().alias("_null")), "odd-ids")
    n = odd.count()
    if not n:
        return docs.withColumn("node", F.col("doc_id"))
    keyed = docs.withColumns({"_odd": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull()})
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = keyed.join(hinted(odd, n), ["_odd", "_null"], "left_semi").groupBy("doc_id", "text").agg(F.max(F.struct(F.lit(0).alias("_"), *rest)).alias("r"))
    beyond = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0] + 1
    one = stash(one.select("doc_id", "text", *(f"r.{c}" for c in rest)).select(*docs.columns, (F.monotonically_increasing_id() + beyond).alias("node")), "odd-rows")
    return keyed.join(hinted(odd, n), ["_odd", "_null"], "left_anti").select(*docs.columns, F.col("doc_id").alias("node")).unionByName(one)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    docs = with_nodes(docs)
    found = jaccard.similar_classes(docs.select(F.col("node").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY)
    return without(docs, found.where("component_id <> doc_id").select(F.col("doc_id").alias("node"))).select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are named by two digests of id and text, so rows of null or repeated id go by their own text
    keys = {f"_key{i}": F.xxhash64(F.lit(i), F.col("doc_id").isNull(), "doc_id", "text") for i in (1, 2)}
    keyed = docs.withColumns(keys)
    return without(keyed, tiling.contaminated(keyed, table(spark, sf_dir, "benchmark"), keep=list(keys)).select(*keys)).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode_tokens),
]
#: Trained models and connected components over 5-word shingles: not in SQL. tests/llm hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
