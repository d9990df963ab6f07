"""What the operators of this subpackage share: tables, the shared folder, words and hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows of at most 16 bytes; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of rows that go to a Python worker at a time, about: either side holds a batch several times over, Spark's by default up to 64 MB of it.
BATCH_BYTES, _BATCH = 2_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a local one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/strandloom-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame | None) -> None:
    """Remove the files of a stash that no later plan reads."""
    if df is None:
        return
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it has few rows (the caller has counted them); else leave the join to shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES, whatever the length of texts; a bound that the session names itself stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, by the planner's statistics; 0 if it is more than a scan of files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if leaves.size() != 1 or leaves.apply(0).nodeName() != "LogicalRelation":
        return 0
    return int(str(leaves.apply(0).stats().sizeInBytes()))


# --- words and 64-bit hashes, over many texts at once -------------------------------------------

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _P), ("i", _P_INV)):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no pattern (splitmix64's last steps)."""
    h = h ^ np.uint64(seed * 0xD6E8FEB86659FD93 & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 7)

#: Word bytes: all but 0x20 and 0x09-0x0D.
WORD = np.ones(256, bool)
WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Word bytes for matches that look past punctuation: ASCII letters and digits and all bytes from 0x80.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each stretch of bytes. Vectorised; any length."""
    power, inverse = _power_table(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind[raw]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(text: bytes, kind: np.ndarray = WORD) -> np.ndarray:
    """The 64-bit hash of each word of a text whose A-Z have been lowered."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(raw, kind)
    return span_hashes(raw, starts, ends) if len(starts) else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; fewer words count as one run, none as none."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        h = h * np.uint64(_P) + words[i : i + n]
    return np.unique(mix(h, min(k, len(words))))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, in order; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(_P) + words[i : i + n]
    return mix(h, k)
