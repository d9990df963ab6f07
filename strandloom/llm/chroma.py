"""Chroma fingerprints of audio columns, and their alignment.

A recording is 8-bit unsigned PCM in one channel. Frames of FRAME samples every HOP are turned into 12
pitch classes, smoothed and normalised; filters over rectangles of their integral image, each cut at
three thresholds into two Gray-coded bits, pack every position into a 32-bit code. Recordings align at
an offset where MIN_OVERLAP codes overlap, at most MAX_ERROR of their bits differ and each recording
begins at least MIN_VOTES runs of equal codes (silence and held tones align with nothing). Overlaps under
LONG codes lie at an end of a recording, or are all of it: these stretches are compared all against all,
two middle codes first. Longer ones are looked for where two codes, and those SEED_STEP before them (a run begins
in between), agree in a seed, a choice of their bits, and the codes around are near. So bits may be wrong in every code;
the equal ones that begin runs are the votes. Of the accepted offsets found the one with the most votes is
given (ties: the most bits that agree beyond half, the smallest shift, the earlier).

The tables hold no audio: op1 reads the UTF-8 bytes of each whole text of `documents` as its PCM, so
copies sound the same and near copies align. Recordings of equal codes are one class, named by its
smallest doc_id; queries (doc_id divisible by 50) are searched, by class, against the class of every
row. Queries are held by all tasks a bounded block at a time, so no bucket of a common code is formed.

Recordings under SHORTEST samples are padded with silence to one code; their classes go by their samples.
One of fewer than MIN_OVERLAP codes must overlap whole, with less error in proportion (one code: none).
Null and empty recordings have no codes: each is a class of its own and matches nothing.
Repeated rows and equal doc_ids give their own rows; if one doc_id has different recordings, two classes
may bear its name, and the fingerprint, of matches too, tells them apart. Rows of null doc_id are fingerprinted only. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

RATE, FRAME, HOP = 8000, 256, 64
LOWEST, HIGHEST = 110.0, 3520.0
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
WIDTH = 8
#: Samples of one code; shorter recordings are padded with silence.
SHORTEST = FRAME + (len(SMOOTH) + WIDTH - 2) * HOP
MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 2, 8, 0.2
QUERY_STEP = 50
#: Recordings of a task of the search, about, if that makes more than four tasks a core.
TASK_ROWS = 20_000
#: Query codes that tasks hold at a time.
BLOCK_CODES = 2_000_000
#: Overlaps under LONG codes are compared all against all; longer ones are looked for where SEED_BITS chosen bits of a code
#: and as many of the code SEED_STEP before it agree, for SEEDS choices, and the two differ in at most SEED_WRONG bits.
LONG = 16
SEEDS, SEED_BITS, SEED_STEP, SEED_WRONG = 16, 6, 6, 12
#: Steps from such a code to two between, then pairs of steps to others; and the most wrong bits by the number of codes so far: a little over MAX_ERROR.
BETWEEN, BESIDE = (-2, -4), [(3, -9), (6, -12)]
MOST_WRONG = np.array([0, 7, 14, 21, 28, 35, 41, 47, 52], np.uint8)
#: Wrong bits by which the codes of a short overlap that were compared first, the two middle ones, may exceed their share.
SLACK = 7
#: Items of arrays, of tables of all against all, and alignments to be verified that are worked on at a time.
_FLAT, _DENSE, _HELD = 100_000, 32_768, 4_000_000
#: Samples of recordings that the filters go over together.
_SAMPLES = 500_000
#: Frames that are transformed at a time.
_CHUNK = 8192


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch class, height, width) of 16 filters: kinds, places and sizes by a rule."""
    return [(i % 6, (5 * i) % 7, 3 + (i * 2) % 4, WIDTH - i % 4) for i in range(16)]


FILTERS = _filters()


def _pitch_matrix() -> np.ndarray:
    f = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(f), 12))
    used = (f >= LOWEST) & (f <= HIGHEST)
    out[np.flatnonzero(used), np.rint(12 * np.log2(f[used] / 440)).astype(int) % 12] = 1
    return out / np.maximum(out.sum(0), 1)  # mean energy, so that white noise is even


_PITCH = _pitch_matrix()
_WINDOW = np.hamming(FRAME)


def chroma(pcm: bytes) -> np.ndarray:
    """(frames, 12) of smoothed, normalised pitch-class energy, in 1/4096."""
    x = (np.frombuffer(pcm, np.uint8).astype(np.float64) - 128) / 128
    if len(x) < FRAME:
        return np.zeros((0, 12), np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    parts = []
    for at in range(0, len(frames), _CHUNK):
        s = np.fft.rfft(frames[at : at + _CHUNK] * _WINDOW, axis=1)
        parts.append((s.real**2 + s.imag**2) @ _PITCH)
    c = np.concatenate(parts)
    n = len(c) - len(SMOOTH) + 1
    if n <= 0:
        return np.zeros((0, 12), np.int64)
    c = sum(w * c[i : i + n] for i, w in enumerate(SMOOTH))
    norm = np.sqrt((c**2).sum(1, keepdims=True))
    return np.rint(np.where(norm > 0.01, c / np.maximum(norm, 0.01), 0) * 4096).astype(np.int64)


def codes_of_all(pcm: list[bytes]) -> list[np.ndarray]:
    """The 32-bit codes of each recording, as uint32; none if it is empty. The filters go over all of them at once, in integers."""
    found = [chroma(x.ljust(SHORTEST, b"\x80") if x else x) for x in pcm]
    sizes = np.array([len(c) for c in found], np.int64)
    n = np.maximum(sizes - WIDTH + 1, 0)
    image = np.zeros((sizes.sum() + 1, 13), np.int64)
    image[1:, 1:] = np.concatenate([np.zeros((0, 12), np.int64), *found]).cumsum(0).cumsum(1)
    t = np.repeat(np.cumsum(sizes) - sizes, n) + _runs(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.zeros(len(t), np.uint32)
    for kind, y, h, w in FILTERS:
        # the mean energy of one part of the rectangle (or of all pitch classes) against that of the rest
        whole, size = area(0, w, y, y + h), w * h
        if kind == 0:
            part, few = whole, size
            whole, size = area(0, w, 0, 12), w * 12
        elif kind == 1:
            part, few = area(0, w, y, y + h // 2), w * (h // 2)
        elif kind == 2:
            part, few = area(0, w // 2, y, y + h), (w // 2) * h
        elif kind == 3:
            part, few = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h), (w // 2) * (h // 2) + (w - w // 2) * (h - h // 2)
        elif kind == 4:
            part, few = area(0, w, y + h // 3, y + h - h // 3), w * (h - 2 * (h // 3))
        else:
            part, few = area(w // 3, w - w // 3, y, y + h), (w - 2 * (w // 3)) * h
        a, b = part * (size - few), (whole - part) * few
        # three cuts of a : b, at 4/5, 1 and 5/4, as a Gray code
        level = (5 * a > 4 * b).astype(np.uint32) + (a > b) + (4 * a > 5 * b)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return np.split(out, np.cumsum(n))[: len(pcm)]


def codes_of(pcm: bytes) -> np.ndarray:
    """The 32-bit codes of a recording, as uint32; none if it is empty."""
    return codes_of_all([pcm])[0]


def fingerprint(recordings: DataFrame) -> DataFrame:
    """recordings(doc_id, pcm binary) to (doc_id, n_codes, fingerprint, codes): codes are little-endian 32-bit integers.

    The fingerprint is the digest of the codes; of a recording that was padded, that of its samples, as silence hides much of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pcm = [x or b"" for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in pcm], np.int64)
            codes = [c.astype("<u4").tobytes() for piece in _pieces(sizes, _SAMPLES) for c in codes_of_all(pcm[piece])]
            prints = [hashlib.sha256(x if 0 < len(x) < SHORTEST else c).hexdigest() for x, c in zip(pcm, codes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array(prints), pa.array(codes, pa.binary())],
                names=["doc_id", "n_codes", "fingerprint", "codes"],
            )

    return recordings.mapInArrow(run, "doc_id long, n_codes long, fingerprint string, codes binary")


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)


def _seed_masks() -> np.ndarray:
    """SEEDS choices of SEED_BITS bits of a code and of the code before; the two bits that hardly ever change stay out."""
    rng = np.random.default_rng(0)
    bits = [b for b in range(32) if b not in (8, 20)]
    return np.array([[sum(1 << int(b) for b in rng.choice(bits, SEED_BITS, replace=False)) for _ in range(2)] for _ in range(SEEDS)], np.uint32)


MASKS = _seed_masks()


def _gather(mask: int) -> np.ndarray:
    """(4, 256): the bits of a mask in each byte value, moved to where they go in the key."""
    places = np.cumsum([0] + [mask >> b & 1 for b in range(32)])
    byte = np.arange(256)
    return np.array([sum(((byte >> b) & 1) << places[8 * i + b] for b in range(8) if mask >> (8 * i + b) & 1) + 0 * byte for i in range(4)]).astype(np.uint32)


def _key(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    part = np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 4)
    return tables[0, part[:, 0]] | tables[1, part[:, 1]] | tables[2, part[:, 2]] | tables[3, part[:, 3]]


def _runs(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _pieces(n: np.ndarray, most: int = _FLAT) -> Iterator[slice]:
    """Slices of n whose sums stay at most `most`, but for single items."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class Recordings:
    """Codes of several recordings end to end."""

    def __init__(self, codes: list[np.ndarray]) -> None:
        self.length = np.array([len(c) for c in codes], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.codes = np.concatenate([np.empty(0, np.uint32), *codes]).astype(np.uint32)
        starts = [_starts(c) for c in codes]
        self.of = np.repeat(np.arange(len(codes)), self.length)
        self.left = np.repeat(self.first + self.length, self.length) - np.arange(len(self.codes))
        self.begins = np.zeros(len(self.codes), bool)
        self.begins[np.repeat(self.first, [len(s) for s in starts]) + np.concatenate([np.empty(0, np.int64), *starts])] = True
        self.n_begins = np.r_[0, np.cumsum(self.begins)]
        self.next = self.two(1)

    def two(self, step: int) -> np.ndarray:
        """Each code and, in the upper half, the one step further (anything at the end)."""
        return self.codes | self.codes.take(np.arange(step, step + len(self.codes)), mode="clip").astype(np.uint64) << np.uint64(32)

    def stretches(self, m: int) -> tuple[np.ndarray, ...]:
        """Where stretches of m codes begin that hold enough runs: of recordings of just m codes; of longer ones all of them, the first, the last."""
        longer = self.length > m
        found = self.first[self.length == m], np.flatnonzero((self.left >= m) & longer[self.of]), self.first[longer], (self.first + self.length - m)[longer]
        return tuple(x[self.n_begins[x + m] - self.n_begins[x] >= min(MIN_VOTES, m)] for x in found)

    def places(self) -> np.ndarray:
        """The codes of recordings of at least LONG codes where a run begins since the code SEED_STEP before."""
        at = np.flatnonzero((self.length >= LONG)[self.of] & (np.arange(len(self.codes)) - self.first[self.of] >= SEED_STEP))
        return at[self.n_begins[at + 1] > self.n_begins[at + 1 - SEED_STEP]]

    def beside(self, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pair of steps of BESIDE, the codes so far from each place in one integer, and the bits of those that there are."""
        at, left, out = places - self.first[self.of[places]], self.left[places], []
        for steps in BESIDE:
            codes, there = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            for step, shift in zip(steps, (np.uint64(0), np.uint64(32)), strict=True):
                has = (at + step >= 0) & (step < left)
                codes |= np.where(has, self.codes.take(places + step, mode="clip"), 0).astype(np.uint64) << shift
                there |= np.where(has, np.uint64(2**32 - 1), np.uint64(0)) << shift
            out.append((codes, there))
        return out


class Places:
    """Places of some recordings where long overlaps are looked for: the code and the one SEED_STEP before, and those beside."""

    def __init__(self, r: Recordings, places: np.ndarray) -> None:
        self.value = r.two(SEED_STEP)[places - SEED_STEP]
        self.between = r.two(BETWEEN[0] - BETWEEN[1])[places + BETWEEN[1]]
        self.near = r.beside(places)
        self.of, self.left = r.of[places], r.left[places]
        self.at = places - r.first[self.of]

    def by_key(self, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key of a seed begins in the order by keys, and that order."""
        low, high = (_key((self.value >> np.uint64(s)).astype(np.uint32), t) for s, t in zip((0, 32), tables, strict=True))
        key = (low << np.uint32(SEED_BITS) | high).astype(np.uint16)
        return np.r_[0, np.cumsum(np.bincount(key, minlength=1 << 2 * SEED_BITS))], np.argsort(key, kind="stable").astype(np.int32)


class Room:
    """Buffers for tables of all against all."""

    def __init__(self) -> None:
        self.bits, self.wrong, self.near = np.empty(_DENSE, np.uint64), np.empty(_DENSE, np.uint8), np.empty(_DENSE, bool)

    def close(self, a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in a and b, of pairs that differ in at most `most` bits, and the bits in which they do."""
        if len(a) > len(b):
            yield from ((i, j, wrong) for j, i, wrong in self.close(b, a, most))
            return
        width = max(1, min(len(b), _DENSE))
        rows = _DENSE // width
        for j in range(0, len(b), width):
            beyond = b[j : j + width]
            for i in range(0, len(a), rows):
                some = a[i : i + rows]
                n = len(some) * len(beyond)
                np.bitwise_xor(some[:, None], beyond, out=self.bits[:n].reshape(len(some), -1))
                np.less_equal(np.bitwise_count(self.bits[:n], out=self.wrong[:n]), most, out=self.near[:n])
                near = np.flatnonzero(self.near[:n])
                if len(near):
                    row = near // len(beyond)
                    yield row + i, near - row * len(beyond) + j, self.wrong[near]


def _together(pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same pairs, about _FLAT at a time."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= _FLAT:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _equal(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and b of equal values, and zeros."""
    order = np.argsort(a, kind="stable")
    lo = np.searchsorted(a[order], b, "left")
    n = np.searchsorted(a[order], b, "right") - lo
    for piece in _pieces(n):
        yield order[np.repeat(lo[piece], n[piece]) + _runs(n[piece])], np.repeat(np.arange(len(b))[piece], n[piece]), np.zeros(n[piece].sum(), np.uint8)


class Queries:
    """Codes of a block of queries, and for each seed their places by key."""

    def __init__(self, ids: list, codes: list[np.ndarray]) -> None:
        self.ids, self.data = ids, codes
        self.index: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "data": self.data, "index": None}  # the index is built where it is used

    def _build(self) -> None:
        self.all, self.room = Recordings(self.data), Room()
        self.places = Places(self.all, self.all.places())
        self.index = []
        for masks in MASKS:
            tables = np.array([_gather(int(mask)) for mask in masks])
            self.index.append((tables, *self.places.by_key(tables)))

    def _long(self, r: Recordings) -> Iterator[np.ndarray]:
        """(query, recording, offset) of overlaps of at least LONG codes where a seed holds at one of the places and the codes beside it are near.

        Up to about _HELD at a time, each once among them.
        """
        q, p = self.places, Places(r, r.places())
        width = int(max(self.all.length.max(initial=1), r.length.max(initial=1)) + 1).bit_length() + 1

        def once(found: list[np.ndarray]) -> np.ndarray:
            key = np.sort(np.concatenate(found))
            return key[np.r_[True, key[1:] != key[:-1]]]

        def apart(key: np.ndarray) -> np.ndarray:
            pair = key >> width
            return np.stack([pair // len(r.length), pair % len(r.length), (key & (1 << width) - 1) - (1 << width - 1)])

        found, n = [], 0
        for tables, first, order in self.index:
            first_p, order_p = p.by_key(tables)
            value, between, value_p, between_p = q.value[order], q.between[order], p.value[order_p], p.between[order_p]
            keys = np.flatnonzero((np.diff(first) > 0) & (np.diff(first_p) > 0))
            edges = zip(*(x[keys + more].tolist() for x in (first, first_p) for more in (0, 1)), strict=True)
            close = ((i + a, j + c, wrong) for a, b, c, d in edges for i, j, wrong in self.room.close(value[a:b], value_p[c:d], SEED_WRONG))
            for i, j, wrong in _together(close):
                wrong += np.bitwise_count(between[i] ^ between_p[j])
                near = np.flatnonzero(wrong <= MOST_WRONG[4])
                of, at, wrong = order[i[near]], order_p[j[near]], wrong[near]
                bits = np.full(len(of), 128, np.uint16)
                for (x, x_there), (y, y_there) in zip(q.near, p.near, strict=True):
                    there = y_there[at] & x_there[of]
                    wrong += np.bitwise_count((y[at] ^ x[of]) & there)
                    bits += np.bitwise_count(there)
                    near = np.flatnonzero(wrong <= MOST_WRONG[bits >> 5])
                    at, of, wrong, bits = at[near], of[near], wrong[near], bits[near]
                some = np.flatnonzero(np.minimum(q.at[of], p.at[at]) + np.minimum(q.left[of], p.left[at]) >= LONG)
                of, at = of[some], at[some]
                if len(of):
                    found.append((q.of[of] * len(r.length) + p.of[at] << width) + (p.at[at] - q.at[of] + (1 << width - 1)))
                    n += len(of)
                if n >= _HELD:
                    found = [once(found)]
                    n = len(found[0])
                    if n >= _HELD // 2:
                        yield apart(found[0])
                        found, n = [], 0
        if found:
            yield apart(once(found))

    def _short(self, r: Recordings) -> Iterator[np.ndarray]:
        """(query, recording, offset) of overlaps under LONG codes: such an overlap is all of one of them, or the end of one and the beginning of the other."""
        q = self.all
        for m in range(1, LONG):
            most, half = int(MAX_ERROR * min(m / MIN_OVERLAP, 1) * 32 * m + 1e-9), (m + 1) // 2
            (whole, inside, head, tail), (r_whole, r_inside, r_head, r_tail) = q.stretches(m), r.stretches(m)
            sides = [(whole, np.concatenate([r_whole, r_inside])), (inside, r_whole)]
            if m >= MIN_OVERLAP:
                sides += [(tail, r_head), (head, r_tail)]
            x, y = q.two(half), r.two(half)
            first, *rest = sorted(range(half), key=lambda step: step != max(0, (m - half - 1) // 2))
            for a, b in sides:
                near = self.room.close(x[a + first], y[b + first], min(most, -(-2 * most // m) + SLACK)) if most else _equal(q.codes[a], r.codes[b])
                for i, j, wrong in _together(near):
                    i, j = a[i], b[j]
                    for n, step in enumerate(rest, 1):
                        apart = x[i + step] ^ y[j + step]
                        wrong += np.bitwise_count(apart if step + half < m else apart & np.uint64(2**32 - 1))
                        some = np.flatnonzero(wrong <= min(most, -(-2 * most * (n + 1) // m) + SLACK + 2 * n))
                        i, j, wrong = i[some], j[some], wrong[some]
                    own, to = q.of[i], r.of[j]
                    yield np.stack([own, to, j - r.first[to] - (i - q.first[own])])

    def _verify(self, r: Recordings, found: np.ndarray) -> tuple[np.ndarray, ...]:
        """query, recording, offset, overlap, votes and bit error rate of the alignments that are accepted."""
        q, (own, to, offset) = self.all, found
        m = np.minimum(q.length[own] + np.minimum(offset, 0), r.length[to] - np.maximum(offset, 0))
        a, b = q.first[own] - np.minimum(offset, 0), r.first[to] + np.maximum(offset, 0)
        # a held tone or silence has one run, which tells nothing
        changes = np.minimum(q.n_begins[a + m] - q.n_begins[a], r.n_begins[b + m] - r.n_begins[b])
        # a recording under MIN_OVERLAP codes must overlap whole, with fewer wrong bits in proportion
        shorter = np.minimum(q.length[own], r.length[to])
        some = np.flatnonzero((m >= np.minimum(MIN_OVERLAP, shorter)) & (changes >= np.minimum(MIN_VOTES, shorter)))
        own, to, offset, m, a, b = (x[some] for x in (own, to, offset, m, a, b))
        wrong, half = np.zeros(len(m), np.int64), (m + 1) // 2
        for piece in _pieces(half):
            n, step = half[piece], 2 * _runs(half[piece])
            apart = q.next[np.repeat(a[piece], n) + step] ^ r.next[np.repeat(b[piece], n) + step]
            ends = np.cumsum(n)
            apart[ends[m[piece] % 2 == 1] - 1] &= np.uint64(2**32 - 1)
            wrong[piece] = np.add.reduceat(np.bitwise_count(apart), ends - n, dtype=np.int64)
        error = wrong / (32 * m)
        some = np.flatnonzero(error <= MAX_ERROR * np.minimum(m / MIN_OVERLAP, 1))
        own, to, offset, m, a, b, error = (x[some] for x in (own, to, offset, m, a, b, error))
        votes = np.zeros(len(m), np.int64)
        for piece in _pieces(m):
            n, step = m[piece], _runs(m[piece])
            i, j = np.repeat(a[piece], n) + step, np.repeat(b[piece], n) + step
            votes[piece] = np.add.reduceat((q.codes[i] == r.codes[j]) & q.begins[i] & r.begins[j], np.cumsum(n) - n, dtype=np.int64)
        return own, to, offset, m, votes, error

    def align(self, recordings: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(query, recording, offset, votes, overlap, bit error rate) of each query that aligns with one of the recordings, by their places in the lists."""
        if self.index is None:
            self._build()
        q, r = self.all, Recordings(recordings)
        if not len(q.codes) or not len(r.codes):
            return
        parts = [self._verify(r, found) for stage in (self._short, self._long) for found in stage(r)]
        if not parts:
            return
        own, to, offset, m, votes, error = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((offset, np.abs(offset), m * (2 * error - 1), -votes, to, own))
        own, to, offset, m, votes, error = (x[order] for x in (own, to, offset, m, votes, error))
        # an alignment may come from two parts; a pair stays once
        best = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (to[1:] != to[:-1])]) if len(own) else []
        for i in best:
            yield int(own[i]), int(to[i]), int(offset[i]), int(votes[i]), int(m[i]), float(error[i])


def search(queries: DataFrame, recordings: DataFrame, block_codes: int = BLOCK_CODES) -> DataFrame:
    """queries(doc_id, n_codes, fingerprint, codes), recordings(doc_id, fingerprint, codes) to (query_id, doc_id, fingerprint, offset, votes, overlap, bit_error_rate).

    The fingerprint is the recording's; a query isn't matched with the recording of its own doc_id and fingerprint.
    """
    spark = recordings.sparkSession
    total = queries.agg(F.coalesce(F.sum("n_codes"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_codes))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-recordings.count() // TASK_ROWS))

    def scan(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, asked = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), shared.value
                codes = [np.frombuffer(x, "<u4") for x in batch.column(2).to_pylist()]
                rows = [(asked.ids[q][0], *ids[d], *x) for q, d, *x in asked.align(codes) if asked.ids[q] != ids[d]]
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 3 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "doc_id", "fingerprint", "offset", "votes", "overlap", "bit_error_rate"])

        return recordings.select("doc_id", "fingerprint", "codes").repartition(tasks).mapInArrow(run, "query_id long, doc_id long, fingerprint string, offset long, votes long, overlap long, bit_error_rate double")

    found = []
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block).select("doc_id", "fingerprint", "codes").collect()
        rows.sort(key=lambda r: (r["doc_id"], r["fingerprint"]))
        found.append(scan(spark.sparkContext.broadcast(Queries([(r["doc_id"], r["fingerprint"]) for r in rows], [np.frombuffer(r["codes"], "<u4") for r in rows]))))
    return reduce(DataFrame.unionAll, found)


def align_classes(recordings: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    """A row of kind `member` for each recording with its class, and one of kind `match` for each class that a query's class aligns with."""
    printed = stash(fingerprint(recordings), "chroma")
    named = printed.where("n_codes > 0 AND doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.max((F.col("doc_id") % step == 0).cast("int")).alias("asked"))
    named = stash(named, "chroma-classes")
    classes = printed.where("n_codes > 0").join(named, "fingerprint").where("doc_id = class_id").select("doc_id", "n_codes", "fingerprint", "codes", "asked").dropDuplicates(["fingerprint"])
    classes = stash(classes, "chroma-kinds")
    matches = search(classes.where("asked = 1"), classes)
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    members = printed.join(named.select("fingerprint", "class_id"), "fingerprint", "left").select(
        F.lit("member").alias("kind"),
        "doc_id",
        F.when(F.col("n_codes") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        "n_codes",
        "fingerprint",
        *none(("query_id", "long"), ("offset", "long"), ("votes", "long"), ("overlap", "long"), ("bit_error_rate", "double")),
    )
    pairs = matches.select(F.lit("match").alias("kind"), "doc_id", F.col("doc_id").alias("class_id"), *none(("n_codes", "long")), "fingerprint", "query_id", "offset", "votes", "overlap", "bit_error_rate")
    return members.unionAll(pairs)


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align_classes(docs.select("doc_id", F.col("text").cast("binary").alias("pcm")))
