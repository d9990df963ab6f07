"""Byte-level BPE by a global shuffle of distinct words.

A text is split into pre-tokens once. Within a block of texts each distinct pre-token gets a number: its
rank if it is a token itself, which the fixed token table tells on the spot, else the next one by a hash
of the word; a text is kept as these numbers, in the order of their positions. The distinct words that
are no tokens are dealt out by the hash, the words of a block and a bucket of it packed into one row.
Where the rows of a bucket meet, each distinct word of the corpus is encoded once, and its ids are joined
back to the words of every row, which returns to its block. There the ids take the place of the
numbers, position by position. Frequent words are tokens and are never shuffled, and any other word
comes once a block; a bucket that is too large is one that Spark splits, and each part encodes its words.

Decoding joins each id to the fixed table of token bytes (as many rows as the vocabulary, held by every
task) and joins the bytes by position.

The blocks' numbers are written once, bucketed by block in the folder of spark.checkpoint.dir, so that
they aren't shuffled again when the ids come back. Nothing of a word is held over a whole corpus.

Nulls and empty texts: no tokens; both digests are those of the empty string. Repeated rows and equal
doc_ids: each row gets its own result. Other columns may be present; they are not read. Empty tables
give no rows. A word of any length is merged by a heap, in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_bytes, map_batches, shared_dir, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: About this many bytes of text make a block, whose words and numbers one Python worker holds.
BLOCK_BYTES = 8 << 20
#: Input files to a bucket, about, and the most buckets that Spark writes.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 1 << 16
#: Texts of so many characters are split match by match, so that their words aren't held.
LONG = 1 << 20
#: Numbers that are turned into ids at a time.
_PIECE = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pair encoding of one word: join the adjacent pair of lowest rank, leftmost first, until none is in the ranks."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for words of any length in n log n."""
    import heapq

    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after = list(range(1, len(word))) + [-1]
    before = list(range(-1, len(word) - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0:
            rank = ranks.get(parts[i] + parts[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, len(parts[i]), len(parts[j])))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, n, m = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j < 0 or len(parts[i]) != n or len(parts[j]) != m:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


def _splitter(pattern: str):
    """Matches of the pattern, in order; the standard library's engine where it must agree, as it is faster."""
    import re

    import regex

    full = regex.compile(pattern)
    quick = full if pattern != default_pattern() else re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
    # the two engines' classes agree on Latin letters up to U+024F but for these
    odd = re.compile("[^\t-\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ƺƼ-ƿǄ-ɏ‐-‧‰-⁞]").search

    def split(text: str) -> Iterable[str]:
        engine = full if odd(text) else quick
        return engine.findall(text) if len(text) < LONG else (m[0] for m in engine.finditer(text))

    return split


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int], pa.Array, pa.Array]:
    """Ranks, the tokens that are whole UTF-8 by text, and by rank the tokens' bytes and the ranks' digits. Read once by each worker."""
    ranks = load_ranks(path)
    texts, by_rank = {}, [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_rank[rank] = token
        try:
            texts[token.decode()] = rank
        except UnicodeDecodeError:
            continue
    return ranks, texts, pa.array(by_rank, pa.binary()), pa.array(map(str, range(len(by_rank))), pa.string())


class Numbers(dict):
    """Numbers of pre-tokens: ranks of tokens, then the order of first sight."""

    def __init__(self, tokens: dict[str, int], first: int) -> None:
        super().__init__(tokens)
        self.first, self.words = first, []

    def __missing__(self, word: str) -> int:
        n = self[word] = self.first + len(self.words)
        self.words.append(word)
        return n

    def dealt(self, buckets: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """New numbers by old ones, the words in their new order, by bucket, and where each bucket's begin. buckets: a power of two."""
        words = pa.array(self.words, pa.string()).cast(pa.binary())
        bucket = np.fromiter(map(crc32, words.to_pylist()), np.int64, len(words)) & (buckets - 1)
        order = np.argsort(bucket, kind="stable")
        new = np.arange(self.first + len(words), dtype=np.int32)
        new[self.first + order] = np.arange(self.first, self.first + len(words), dtype=np.int32)
        return new, words.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(buckets + 1))


def _pack(array: pa.Array, dtype: str = "<u1") -> bytes:
    """Binary values and their lengths, compressed."""
    flat, starts = _binary(array, dtype)
    raw = np.diff(starts).astype("<u4").tobytes() + flat.tobytes()
    return np.array([len(array), len(raw)], "<u4").tobytes() + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(data: bytes, dtype: str = "<u1") -> tuple[np.ndarray, np.ndarray]:
    """What _pack was given: numbers end to end, and the length of each value."""
    n, size = np.frombuffer(data, "<u4", 2).tolist()
    raw = pa.Codec("zstd").decompress(data[8:], size, asbytes=True)
    return np.frombuffer(raw, dtype, offset=4 * n), np.frombuffer(raw, "<u4", n).astype(np.int64)


def _values(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values from their bytes end to end."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(flat))])


def _binary(column: pa.ChunkedArray | pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that binary values hold, end to end, and where each value's begin."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    width = np.dtype(dtype).itemsize
    if not len(array):
        return np.empty(0, dtype), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return flat.view(dtype) if len(flat) else np.empty(0, dtype), (offsets - offsets[0]) // width


def join_bytes(ids: pa.Array, starts: np.ndarray, table: pa.Array, between: str = "") -> pa.Array:
    """For each run of ids the values of the table that they join to, in order. An id that the table lacks gives null."""
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), table.take(ids))
    return pc.binary_join(lists, pa.scalar(between.encode() if pa.types.is_binary(table.type) else between, table.type))


def _pieces(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most _PIECE numbers, or of one document."""
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _PIECE, "right")) - 1)
        yield at, to
        at = to


def split_blocks(docs: DataFrame, path: str, pattern: str, block_bytes: int, buckets: int) -> DataFrame:
    """docs(doc_id, text) to rows of two kinds: (block, doc_id, data) with the numbers of a text, and (block, bucket, number, data) with a block's words of one bucket that are no tokens, numbered from `number`."""
    kinds = {"block": pa.int64(), "doc_id": pa.int64(), "bucket": pa.int32(), "number": pa.int32(), "data": pa.binary()}

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens, by_rank, _ = _vocabulary(path)
        split, block, size = _splitter(pattern), TaskContext.get().partitionId() << 32, 0
        numbers, ids, held = Numbers(tokens, len(by_rank)), [], []

        def flush() -> Iterator[pa.RecordBatch]:
            new, words, starts = numbers.dealt(buckets)
            for i in range(0, len(held), 2000):
                part = [new[x].tobytes() for x in held[i : i + 2000]]
                yield rows(len(part), block=pa.array(np.full(len(part), block)), doc_id=pa.array(ids[i : i + 2000], pa.int64()), data=pa.array(part, pa.binary()))
            some = np.flatnonzero(np.diff(starts))
            data = [_pack(words.slice(starts[i], starts[i + 1] - starts[i])) for i in some]
            if data:
                yield rows(len(data), block=pa.array(np.full(len(data), block)), bucket=pa.array(some, pa.int32()), number=pa.array(numbers.first + starts[some], pa.int32()), data=pa.array(data, pa.binary()))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(np.fromiter(map(numbers.__getitem__, split(text)), np.int32))
                ids.append(doc_id)
                size += len(text)
                if size >= block_bytes:
                    yield from flush()
                    pa.default_memory_pool().release_unused()
                    numbers, ids, held, block, size = Numbers(tokens, len(by_rank)), [], [], block + 1, 0
        yield from flush()

    schema = "block long, doc_id long, bucket int, number int, data binary"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), run, schema)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """words(block, bucket, number, data) to (block, number, data): the ids of the words of each row. Each distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _vocabulary(path)[0]
        rows = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, meeting in groupby(rows, key=lambda row: row[1]):
            blocks, _, numbers, data = zip(*meeting, strict=True)
            parts = [_unpack(x) for x in data]
            every = _values(np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])).dictionary_encode()
            coded = pa.array([np.array(merge_word(w, ranks), "<i4").tobytes() for w in every.dictionary.to_pylist()], pa.binary())
            ends = np.cumsum([len(n) for _, n in parts])
            for i in range(0, len(parts), 1000):
                some = range(i, min(i + 1000, len(parts)))
                out = [_pack(coded.take(every.indices.slice(ends[k] - len(parts[k][1]), len(parts[k][1]))), "<i4") for k in some]
                yield pa.RecordBatch.from_arrays([pa.array([blocks[k] for k in some], pa.int64()), pa.array([numbers[k] for k in some], pa.int32()), pa.array(out, pa.binary())], names=["block", "number", "data"])

    dealt = words.select("block", "bucket", "number", "data").hint("rebalance", "bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, run, "block long, number int, data binary")


def bucketed(df: DataFrame, key: str, buckets: int, what: str) -> DataFrame:
    """df written to the shared folder in buckets of the key and read back: joins on the key don't shuffle it. The catalogue keeps no entry."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved: the plan holds the files and their buckets
    spark.sql(f"DROP TABLE {name}")  # of an external table: the files stay
    return found


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""
    path, pattern = ranks_path or default_path(), pattern or default_pattern()
    buckets = min(MOST_BUCKETS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), file_bytes(docs) // BUCKET_BYTES))
    buckets = 1 << (buckets - 1).bit_length()
    split = bucketed(split_blocks(docs, path, pattern, block_bytes, buckets), "block", buckets, "bpe_blocks")
    texts = split.where("bucket IS NULL").select("block", "doc_id", "data")
    coded = encode_words(split.where("bucket IS NOT NULL"), path)

    def reassemble(texts: pa.Table, coded: pa.Table) -> pa.Table:
        _, _, by_rank, digits = _vocabulary(path)
        first = len(by_rank)
        parts = [_unpack(x, "<i4") for _, x in sorted(zip(coded.column("number").to_pylist(), coded.column("data").to_pylist(), strict=True))]
        word_ids = np.concatenate([np.empty(0, np.int32), *(x for x, _ in parts)])
        # a number's ids: a token's own rank, or those of the word
        begins = np.concatenate([np.arange(first + 1), first + np.cumsum(np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)]))])
        symbols = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(np.concatenate([np.arange(first, dtype=np.int32), word_ids])))
        sizes = np.diff(begins)
        numbers, starts = _binary(texts.column("data"), "<i4")
        out = {"n": [], "ids": [], "decoded": [], "list": []}
        for a, b in _pieces(starts):
            mine = numbers[starts[a] : starts[b]]
            at = np.concatenate([[0], np.cumsum(sizes[mine])])[starts[a : b + 1] - starts[a]]
            ids = symbols.take(pa.array(mine)).flatten()
            listed, decoded = join_bytes(ids, at, digits, " ").cast(pa.binary()), join_bytes(ids, at, by_rank)
            out["n"].extend(np.diff(at).tolist())
            out["ids"].extend(hashlib.sha256(x).hexdigest() for x in listed.to_pylist())
            out["decoded"].extend(hashlib.sha256(x).hexdigest() for x in decoded.to_pylist())
            if with_ids:
                out["list"].extend(pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids).to_pylist())
        pa.default_memory_pool().release_unused()
        fields = {"doc_id": texts.column("doc_id"), "n_tokens": pa.array(out["n"], pa.int64()), "ids_sha256": pa.array(out["ids"], pa.string()), "decoded_sha256": pa.array(out["decoded"], pa.string())}
        return pa.table(fields | ({"ids": pa.array(out["list"], pa.list_(pa.int32()))} if with_ids else {}))

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(reassemble, out)


def decode(rows: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """rows(doc_id, ids array<int>) to (doc_id, text binary), by a join of the ids to the fixed table of token bytes. Null ids: null; so is a text with an id that is no rank."""
    path = ranks_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = _vocabulary(path)[2]
        for batch in batches:
            lists = batch.column(1)
            known = pc.if_else(pc.and_(pc.greater_equal(lists.flatten(), 0), pc.less(lists.flatten(), len(by_rank))), lists.flatten(), pa.scalar(None, pa.int32()))
            starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            joined = join_bytes(known, starts, by_rank)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.binary()))], names=["doc_id", "text"])

    return map_batches(rows.select("doc_id", F.col("ids").cast("array<int>")), run, "doc_id long, text binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
