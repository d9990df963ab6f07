"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits (all bytes from 0x80 count as letters), A-Z lowered. A running Karp-Rabin
hash of MIN_MATCH words is taken at every position of a whole document and of every benchmark item;
positions that share one are seeds, and seeds on one diagonal a match, whose words are then compared. For each document and item with seeds the longest match of words
not yet marked is marked again and again until none of MIN_MATCH words is left (ties: the match that
begins first in the item, then in the document). What the tiles cover of the item is its coverage, so
passages are found in any order. Rows with coverage of at least THRESHOLD are returned.

An item of fewer than MIN_MATCH words is a match when all of it stands in the document. Items without
words and null texts match nothing; documents and items of null id are read like any other. Repeated documents and items give a row each. Empty
tables give no rows. The benchmark is read in blocks of at most BLOCK_WORDS words, each held by all
tasks in turn, which joins the seeds without shuffling the documents': neither a large benchmark nor a
passage that many documents share meets in one task, and a long text that repeats itself takes the memory
of its runs of seeds, not of their pairs.
Other columns may be present; they are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, grams, map_batches, table, word_hashes

MIN_MATCH, THRESHOLD = 5, 0.5
BLOCK_WORDS = 2_000_000

#: Pairs of equal seeds that are made at a time.
PAIRS = 1_000_000
#: The columns of the result after those of the document.
TILES = "item_id long, n_item_words long, n_covered long, n_tiles long, longest long, coverage double"


def tile(item: np.ndarray, doc: np.ndarray, runs: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start in the item, start in the document, words) of each tile. item, doc: word hashes; runs: rows (start in the item, start in the document, equal k-grams in a row)."""
    heap = [(-(n + k - 1), i, j) for i, j, n in runs.tolist()]
    heapq.heapify(heap)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles = []
    while heap and not in_item.all():
        n, i, j = heapq.heappop(heap)
        n = -n
        # equal k-gram hashes are held against the words; what is left between marks and unequal words is a match of its own
        free = ~(in_item[i : i + n] | in_doc[j : j + n]) & (item[i : i + n] == doc[j : j + n])
        if free.all():
            tiles.append((i, j, n))
            in_item[i : i + n] = in_doc[j : j + n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for at, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - at >= k:
                heapq.heappush(heap, (at - end, i + at, j + at))
    return tiles


def _runs(item: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows (item, i, j, n), sorted, with those that go on from one another in one."""
    order = np.lexsort((i, j - i, item))
    item, i, j, n = item[order], i[order], j[order], n[order]
    fresh = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | ((j - i)[1:] != (j - i)[:-1]) | (i[1:] != i[:-1] + n[:-1])])
    return np.stack([item[fresh], i[fresh], j[fresh], np.add.reduceat(n, fresh)], 1)


class Items:
    """Word hashes of benchmark items, and the positions of their seeds by hash."""

    def __init__(self, rows: list[tuple[int, str]], k: int) -> None:
        self.k = k
        self.ids = [i for i, _ in rows]
        self.words = [word_hashes(t.encode().lower(), ALNUM) for _, t in rows]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(k, len(w)) for w in self.words} - {0}):
            h, own, at = [], [], []
            for x, w in enumerate(self.words):
                if min(k, len(w)) == size:
                    g = grams(w, size)
                    h.append(g)
                    own.append(np.full(len(g), x))
                    at.append(np.arange(len(g)))
            h, own, at = map(np.concatenate, (h, own, at))
            order = np.argsort(h, kind="stable")
            self.by_size[size] = h[order], own[order], at[order]

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, seed size, runs) for each item that shares a seed with a document's words.

        Pairs of equal seeds are made PAIRS at a time and become runs at once, so a text that repeats
        itself takes no more memory than its runs.
        """
        for size, (h, own, at) in self.by_size.items():
            g = grams(words, size)
            if not len(g):
                continue
            first = np.searchsorted(h, g)
            hits = np.flatnonzero(h[np.minimum(first, len(h) - 1)] == g)
            if not len(hits):
                continue
            first = first[hits]
            n = np.searchsorted(h, g[hits], side="right") - first
            ends, begin, parts = np.cumsum(n), 0, []
            while begin < len(hits):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
                m = n[begin:end]
                flat = np.repeat(first[begin:end] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
                parts.append(_runs(own[flat], at[flat], np.repeat(hits[begin:end], m), np.ones(len(flat), np.int64)))
                begin = end
            runs = parts[0] if len(parts) == 1 else _runs(*np.concatenate(parts).T)
            cut = np.flatnonzero(np.r_[True, np.diff(runs[:, 0]) != 0, True])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield int(runs[a, 0]), size, runs[a:b, 1:]


def reach(runs: np.ndarray, size: int, length: int) -> int:
    """Words of an item that its runs touch: tiles can't cover more."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, runs[:, 0], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 2] + size - 1, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """docs(keep.., text), benchmark(item_id, text) to a row for each document and item of enough coverage. keep: the documents' columns to return, doc_id by default."""
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    schema = docs.select(*keep).schema
    for field in T._parse_datatype_string(TILES).fields:
        schema = schema.add(field)
    sized = benchmark.where("text IS NOT NULL").select("item_id", "text", (F.length("text") / 2 + 1).alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]
    blocks = max(1, int(-(-total // block_words)))

    def scan(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                rows = []
                for at, text in enumerate(batch.column(len(keep)).to_pylist()):
                    words = word_hashes(text.lower(), ALNUM)
                    for x, size, runs in items.matches(words):
                        n = len(items.words[x])
                        if reach(runs, size, n) < threshold * n:
                            continue
                        tiles = tile(items.words[x], words, runs, size)
                        covered = sum(t[2] for t in tiles)
                        if covered >= threshold * n:
                            rows.append((at, items.ids[x], n, covered, len(tiles), max(t[2] for t in tiles), covered / n))
                at, *cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64()] * 5 + [pa.float64()]
                taken = batch.select(list(range(len(keep)))).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=schema.names)

        return map_batches(docs.where("text IS NOT NULL").select(*keep, F.col("text").cast("binary").alias("\0text")), run, schema)

    parts = []
    for block in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        parts.append(scan(spark.sparkContext.broadcast(Items(sorted(((r["item_id"], r["text"]) for r in mine), key=lambda r: (r[0] is None, r[0] or 0, r[1])), k))))
    return reduce(DataFrame.unionAll, parts)


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
