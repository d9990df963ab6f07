"""WARC archives with revisit records.

The payload of a row is its html in UTF-8 (null: empty). Headers alone (page id, digest, size) are
shuffled by digest; of equal payloads of at least MIN_BYTES bytes, the one of the largest page_id is
kept as a response and the others become revisit records that name it. Smaller payloads are all
responses. Archives are written by Spark's own writer, so they land whole in any file system that
Spark can write; a record ends with two line breaks, which the writer puts between rows, and its
length is in its header, so payloads may hold anything. Reading takes the archives apart by those
lengths, and joins revisit records to the responses by digest.

Repeated rows: rows of equal page_id and payload are each a record; if they are a group's original,
each is a response. A null page_id is written as an empty header field and read as null; it is never
an original unless all of its group are null, and then every one is a response. Null url: no target.
Empty tables: no records. Other columns may be present; they are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

MIN_BYTES = 1000
#: Records to an archive at most: readers take one archive at a time into memory.
RECORDS_PER_ARCHIVE = 4000
_EOL = "\r\n"
_END = _EOL + _EOL
_DATE = "2024-01-01T00:00:00Z"


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages(page_id, url, payload binary) with payload_bytes, payload_digest, record_type and refers_to.

    The headers' group sizes don't matter: originals are found by a partial aggregate, and the join back
    is one that Spark can split where a digest is hot. Payloads aren't shuffled by digest.
    """
    sized = pages.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = sized.where(F.col("payload_bytes") >= min_bytes)
    copied = large.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).where("copies > 1 AND original IS NOT NULL").drop("copies")
    headers = large.select("page_id", "payload_digest").join(copied, "payload_digest").where("page_id < original OR page_id IS NULL").select(F.col("page_id").alias("k"), F.col("payload_digest").alias("d"), "original").distinct()
    joined = sized.join(headers, (F.col("page_id").eqNullSafe(F.col("k"))) & (F.col("payload_digest") == F.col("d")), "left").drop("k", "d")
    return joined.withColumn("record_type", F.when(F.col("original").isNull(), "response").otherwise("revisit")).withColumnRenamed("original", "refers_to")


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; those whose value is null are left out."""
    parts = [F.lit("WARC/1.1" + _EOL)]
    for name, value in pairs:
        value = F.lit(value) if isinstance(value, str) else value.cast("string")
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]", " "), F.lit(_EOL)), F.lit("")))
    return F.concat(*parts, F.lit(_EOL))


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha1(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(resolved: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """One record for each row of resolve()'s result, with fresh headers; revisit records carry no payload."""
    revisit = F.col("record_type") == "revisit"
    head = _headers(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("payload_digest")))),
        ("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        ("X-Payload-Length", F.col("payload_bytes")),
        ("Content-Type", "text/html"),
        ("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
    )
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    rows = resolved.select(F.concat(head.cast("binary"), body).cast("string").alias("value"))
    # bytes pass through a string column unchanged: neither the cast nor the writer decodes them
    rows.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, by their lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(_EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        body = data[end + 4 : end + 4 + length]
        if len(body) < length:
            raise ValueError("the archive is cut off")
        yield fields, body
        at = end + 4 + length + 4


RECORD = "page_id long, url string, record_type string, record_id string, refers_to_record string, header_digest string, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record. payload_digest is that of the bytes read (of the header for a revisit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + ([("payload", pa.binary())] if with_payload else []))
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for f, body in parse(gzip.decompress(data)):
                    stated = f["warc-payload-digest"].removeprefix("sha1:")
                    revisit = f["warc-type"] == "revisit"
                    row = {"page_id": int(f["x-page-id"]) if f["x-page-id"] else None, "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "record_id": f["warc-record-id"], "refers_to_record": f.get("warc-refers-to"), "header_digest": stated, "payload_bytes": int(f["x-payload-length"]) if revisit else len(body), "payload_digest": stated if revisit else hashlib.sha1(body).hexdigest()}
                    rows.append(row | ({"payload": None if revisit else body} if with_payload else {}))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD + ", payload binary" * with_payload)


def join_revisits(records: DataFrame) -> DataFrame:
    """Records with refers_to: the page_id of the response that a revisit record names."""
    named = F.col("record_type") == "revisit"
    originals = records.where(~named).select(F.col("record_id").alias("o"), F.col("payload_digest").alias("od"), F.col("page_id").alias("refers_to")).distinct()
    wanted = records.where(named).join(originals, (F.col("refers_to_record") == F.col("o")) & (F.col("payload_digest") == F.col("od")), "left").drop("o", "od")
    return wanted.unionByName(records.where(~named).withColumn("refers_to", F.lit(None).cast("long")))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve(pages), path)
    return join_revisits(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("header_digest").eqNullSafe(F.col("payload_digest")).alias("digest_verified"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < original THEN original END AS refers_to, TRUE AS digest_verified
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND payload_bytes >= 1000
"""
