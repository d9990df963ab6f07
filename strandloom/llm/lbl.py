"""A log-bilinear language model, trained in numpy by noise-contrastive estimation.

Words are counted over all training texts. The core has a fixed size: the most frequent words, the end
of a text, and classes that share out all other words by a hash of their last two bytes. The count of
each pair of neighbours in it is gathered from the whole corpus, and the model

    s(w | c) = (C r_c) . q_w + b_w

is fitted to those counts by noise-contrastive estimation with NOISE draws from the unigram
distribution to each word, whose expectation is taken exactly. Then every other word that occurs LEAST
times gets a context vector C r of its own, fitted in the same way to the counts of all that follows it,
with the core fixed: those counts are a shuffled table that grows with the corpus, as do the vectors.
One matrix product gives every score, and a log-sum-exp over each row makes them normalised
log-probabilities. A word outside the core gets its class's probability times (c + 1) / (sum of c + 1
over the class + 1), the last 1 being for unseen words; so the probabilities of all known words and one
unseen word per class sum to 1.

Counts and vectors of the HEAD most frequent words are broadcast (a fixed size bound); rarer words of
each text are shuffled by the word and joined to theirs, so no key is hot. A word of more than
LONG_WORD bytes goes by its digest and last two bytes, in counts, vocabulary and joins alike.

Null and empty texts hold the end alone. Repeated rows and equal doc_ids get a result each. If nothing
is held in for training, N and V are 0, the base gives every token 1 / (0 + 0 + 1), and the model, whose
symbols are then the end and the classes, gives each of them the same probability. Empty tables give no rows. Other columns may be present; they are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import span_hashes, stash, table, word_spans

WORDS, CLASSES, DIM, NOISE, STEPS = 1024, 127, 48, 10, 120
#: Words outside the core that occur LEAST times in training have a context vector of their own, of OWN_STEPS steps, its class's weighing as PRIOR counts.
LEAST, OWN_STEPS, PRIOR = 16, 5, 16.0
#: A pair's name holds a word's class and hash, and the symbol that follows: 63 bits. Words of one name share a vector.
CLASS_BITS, HASH_BITS, NEXT_BITS = 7, 45, 11
#: Texts are cut into words in blocks of so many bytes.
BLOCK = 1 << 18
#: So many frequent words are broadcast with their counts; words of more than LONG_WORD bytes go by a digest.
HEAD, LONG_WORD = 131_072, 48


def words_of(text: bytes) -> list[bytes]:
    """A-Z lowered; runs without 0x20 and 0x09-0x0D, long ones by a digest that keeps their last two bytes."""
    found = text.lower().split()
    if len(text) > LONG_WORD:
        for i in [i for i, w in enumerate(found) if len(w) > LONG_WORD]:
            found[i] = name_of(found[i])
    return found


def name_of(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\0" + hashlib.sha256(word).digest() + word[-2:]


def name_hashes(names: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in names], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(names), np.uint8), ends - [len(w) for w in names], ends) if names else np.empty(0, np.uint64)


def class_of(word: bytes, classes: int = CLASSES) -> int:
    return zlib.crc32(word[-2:]) % classes


def _class_column(word: Column, classes: int) -> Column:
    return F.pmod(F.crc32(F.when(F.length(word) < 2, word).otherwise(F.substring(word, -2, 2))), F.lit(classes)).cast("int")


def count_words(texts: DataFrame) -> DataFrame:
    """texts(text binary) to (word binary, n long); counts are added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.binary()), "n": pa.array(found.values(), pa.int64())})
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words_of(text))
            if len(found) > 400_000:
                yield out()
                found.clear()
        if found:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids of the model: frequent words, the end, then the classes; and counts of the head, by hashes of words."""

    def __init__(self, head: list[tuple[bytes, int]], words: int, classes: int) -> None:
        core = head[:words]
        self.classes = classes
        self.end = len(core)
        self.first = self.end + 1
        self.size = self.first + classes
        if self.size > 1 << NEXT_BITS or classes > 1 << CLASS_BITS:
            raise ValueError(f"{self.size} symbols with {classes} classes don't fit in names of pairs")
        hashes = name_hashes([w for w, _ in head])
        counts = np.array([c for _, c in head], np.int64)
        by_hash = np.argsort(hashes[: self.end])
        self.core_hashes, self.core_ids = hashes[by_hash], by_hash
        by_hash = np.argsort(hashes)
        self.head_hashes, self.head_counts = hashes[by_hash], counts[by_hash]
        # the class of each pair of last bytes, then of each word of one byte
        self.class_table = np.array([class_of(bytes((i >> 8, i & 255)), classes) for i in range(1 << 16)] + [class_of(bytes((i,)), classes) for i in range(256)], np.int64)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Block:
    """Some texts as one sequence of symbols, the end after each: symbols, and of each word its place, hash and class."""

    def __init__(self, v: Vocabulary, texts: list[bytes]) -> None:
        self.bytes = b"\n".join(texts).lower()
        raw = np.frombuffer(self.bytes, np.uint8)
        self.starts, self.ends = word_spans(raw)
        self.hashes = span_hashes(raw, self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD):
            self.hashes[i] = name_hashes([self.name(i)])[0]
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.text = np.searchsorted(np.cumsum(lengths), self.starts, side="right")
        self.places = np.arange(len(self.starts)) + self.text
        last = raw[self.ends - 1].astype(np.int64)
        before = raw[np.maximum(self.ends - 2, 0)].astype(np.int64)
        self.kinds = v.class_table[np.where(self.ends - self.starts > 1, before << 8 | last, (1 << 16) + last)]
        at, core = find(v.core_hashes, self.hashes)
        ids = v.first + self.kinds
        ids[core] = v.core_ids[at[core]]
        self.symbols = np.full(len(self.starts) + len(texts), v.end, np.int64)
        self.symbols[self.places] = ids
        # each text ends with the end, so the next one begins after it
        self.before = np.concatenate([[v.end], self.symbols[:-1]])
        self.outside = np.flatnonzero(~core)

    def name(self, i: int) -> bytes:
        return name_of(self.bytes[self.starts[i] : self.ends[i]])

    def pairs(self) -> np.ndarray:
        """For each word outside the core its name of 52 bits, then the symbol after it."""
        o = self.outside
        key = self.kinds[o] << HASH_BITS | (self.hashes[o] >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        return key << NEXT_BITS | self.symbols[self.places[o] + 1]


def blocks(batch: pa.RecordBatch, column: int, v: Vocabulary) -> Iterator[tuple[int, int, Block]]:
    """The texts of a batch in blocks of about BLOCK bytes, each with its range of rows; long texts stay whole."""
    texts = batch.column(column)
    start, held, size = 0, [], 0
    for i in range(batch.num_rows):
        held.append(texts[i].as_py())
        size += len(held[-1])
        if size >= BLOCK or i + 1 == batch.num_rows:
            yield start, i + 1, Block(v, held)
            start, held, size = i + 1, [], 0


def count_pairs(texts: DataFrame, vocabulary) -> DataFrame:
    """(pair long, n long): neighbours in the core, c * size + w, the end coming before each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        found = np.zeros(v.size * v.size, np.int64)
        held: list[np.ndarray] = []
        add = lambda: np.add(found, np.bincount(np.concatenate(held), minlength=v.size * v.size), out=found)
        for batch in batches:
            for _, _, block in blocks(batch, 0, v):
                held.append(block.before * v.size + block.symbols)
                if sum(map(len, held)) > 1_000_000:
                    add()
                    held.clear()
        if held:
            add()
        keys = np.flatnonzero(found)
        if len(keys):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(keys, pa.int64()), "n": pa.array(found[keys], pa.int64())})

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def count_followers(texts: DataFrame, vocabulary) -> DataFrame:
    """(pair long, n int): what follows each word outside the core, added up in parts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pydict({"pair": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int32())})

        for batch in batches:
            for _, _, block in blocks(batch, 0, v):
                held.append(block.pairs())
                if sum(map(len, held)) > 2_000_000:
                    yield out()
        if sum(map(len, held)):
            yield out()

    return texts.mapInArrow(run, "pair long, n int")


def fold_in(counts: np.ndarray, start: np.ndarray, q: np.ndarray, b: np.ndarray, unigram: np.ndarray, noise: int = NOISE, steps: int = OWN_STEPS, prior: float = PRIOR) -> np.ndarray:
    """A context vector (C r) for each row of counts of followers, by noise-contrastive estimation with all else fixed.

    A row begins at its start, which weighs as much as `prior` of its counts. Steps go along the gradient
    by the inverse curvature at the unigram distribution, no score moving by more than 2; one that
    raises a row's loss is taken back and halved.
    """
    n = counts.sum(1, keepdims=True)
    p, pull = counts / n, (prior / n).astype(np.float32)
    ku = (noise * unigram).astype(np.float32)
    shift = (b - np.log(ku)).astype(np.float32)
    curve = (q.T * (unigram * noise / (1 + noise))) @ q + 1e-4 * np.eye(q.shape[1])
    inverse = np.linalg.inv(curve).astype(np.float32)
    curve = curve.astype(np.float32)
    best, loss, rate = start.copy(), np.full(len(counts), np.inf, np.float32), np.ones((len(counts), 1), np.float32)
    move = np.zeros_like(best)
    for step in range(steps + 1):
        a = best + rate * move
        d = np.clip(a @ q.T + shift, -30, 30)
        e = np.exp(d)
        soft = np.log1p(e)
        off = a - start
        now = ((p + ku) * soft - p * d).sum(1) + 0.5 * pull[:, 0] * ((off @ curve) * off).sum(1)
        better = now < loss
        rate[~better] *= 0.5
        if not better.any():
            continue
        best[better], loss[better] = a[better], now[better]
        if step == steps:
            break
        chance = e / (1 + e)
        g = (ku * chance - p * (1 - chance)) @ q
        new = -(g @ inverse + pull * off) / (1 + pull)
        reach = np.abs(new @ q.T).max(1, keepdims=True)
        new *= np.minimum(1, 2 / np.maximum(reach, 1e-6))
        move[better] = new[better]
    return best


def own_vectors(followers: DataFrame, model, vocabulary, least: int = LEAST) -> DataFrame:
    """(key long, n long, vector binary, log_z float): the context vector of each word outside the core that occurs `least` times.

    Followers are dealt out by word and sorted, so each task adds up one word after the other; the
    words of the core, which could be hot, are not among them. log_z makes the scores after a word
    log-probabilities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = vocabulary.value, model.value
        a, q, b, unigram = m["a"], m["q"], m["b"], m["unigram"]
        low = (1 << NEXT_BITS) - 1

        def fitted(keys: np.ndarray, total: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 512):
                some = keys[at : at + 512]
                lo, hi = np.searchsorted(pairs, (some[0] << NEXT_BITS, some[-1] + 1 << NEXT_BITS))
                counts = np.zeros((len(some), v.size), np.float32)
                row, hit = find(some, pairs[lo:hi] >> NEXT_BITS)
                np.add.at(counts, (row[hit], (pairs[lo:hi] & low)[hit]), n[lo:hi][hit])
                vectors = fold_in(counts, a[v.first + (some >> HASH_BITS)], q, b, unigram).astype(np.float16)
                s = vectors.astype(np.float32) @ q.T + b
                top = s.max(1)
                log_z = top + np.log(np.exp(s - top[:, None]).sum(1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(some),
                        "n": pa.array(total[at : at + 512]),
                        "vector": pa.array([x.tobytes() for x in vectors], pa.binary()),
                        "log_z": pa.array(log_z, pa.float32()),
                    }
                )

        pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pairs, n
            # the last word's rows may go on in the next batch; a word has few distinct followers
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            pairs, n = pairs[first], np.add.reduceat(n, first)
            end = len(pairs) if last else np.searchsorted(pairs, pairs[-1] >> NEXT_BITS << NEXT_BITS)
            if end:
                own = pairs[:end] >> NEXT_BITS
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                total = np.add.reduceat(n[:end], starts)
                often = total >= least
                yield from fitted(own[starts][often], total[often], pairs[:end], n[:end])
            pairs, n = pairs[end:], n[end:]

        for batch in batches:
            pairs = np.concatenate([pairs, batch.column(0).to_numpy()])
            n = np.concatenate([n, batch.column(1).to_numpy().astype(np.int64)])
            if len(pairs) > 200_000:
                yield from ready(False)
        if len(pairs):
            yield from ready(True)

    dealt = followers.repartition(F.shiftright("pair", NEXT_BITS)).sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "key long, n long, vector binary, log_z float")


def least_head_count(counts: DataFrame, head_size: int) -> int:
    """The smallest count that at most head_size words reach, told from histograms of counts.

    First by powers of two, then within the power where the number is passed: few rows reach the driver,
    as large counts are few and small counts have few values.
    """
    rough = {r["k"]: r["m"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("m")).collect()}
    have = 0
    for k in sorted(rough, reverse=True):
        if have + rough[k] > head_size:
            fine = counts.where((F.floor(F.log2("n")) == k)).groupBy("n").agg(F.count("*").alias("m")).collect()
            least = 2 ** (k + 1)
            for row in sorted(fine, key=lambda r: -r["n"]):
                have += row["m"]
                if have > head_size:
                    break
                least = row["n"]
            return least
        have += rough[k]
    return 1


def unigram_of(counts: np.ndarray) -> np.ndarray:
    smoothed = counts.sum(0) + 0.5
    return smoothed / smoothed.sum()


def fit(counts: np.ndarray, dim: int = DIM, noise: int = NOISE, steps: int = STEPS, rate: float = 0.05, seed: int = 3) -> np.ndarray:
    """Log-probabilities (natural), one row for each context, from counts of (context, word)."""
    return normalised(*fit_vectors(counts, dim, noise, steps, rate, seed))


def normalised(a: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = (a @ q.T + b).astype(np.float64)
    top = s.max(1, keepdims=True)
    return s - top - np.log(np.exp(s - top).sum(1, keepdims=True))


def fit_vectors(counts: np.ndarray, dim: int = DIM, noise: int = NOISE, steps: int = STEPS, rate: float = 0.05, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts' vectors C r, the words' vectors q and their biases b."""
    size = len(counts)
    rng = np.random.default_rng(seed)
    unigram = unigram_of(counts)
    context = counts.sum(1)
    total = max(1.0, context.sum())
    p = {"r": rng.normal(0, 0.1, (size, dim)), "m": np.eye(dim) + rng.normal(0, 0.01, (dim, dim)), "q": rng.normal(0, 0.1, (size, dim)), "b": np.log(unigram)}
    p = {k: x.astype(np.float32) for k, x in p.items()}
    data = (counts / total).astype(np.float32)
    weight = (context[:, None] / total * noise * unigram[None]).astype(np.float32)
    log_noise = np.log(noise * unigram).astype(np.float32)
    # each parameter's gradient is divided by how often its word occurs, so rare ones learn as fast
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        r = p["r"] @ p["m"]
        d = r @ p["q"].T + p["b"] - log_noise
        # the model's chance that a word is data and not noise
        chance = 1 / (1 + np.exp(-np.clip(d, -30, 30)))
        g = weight * chance - data * (1 - chance)
        gr = g @ p["q"]
        grads = {"b": g.sum(0), "q": g.T @ r, "r": gr @ p["m"].T, "m": p["r"].T @ gr}
        scale = rate * (1 - (step - 1) / steps) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for k in p:
            m[k] += 0.1 * (grads[k] - m[k])
            v[k] += 0.01 * (grads[k] ** 2 - v[k])
            p[k] -= (scale * m[k] / (np.sqrt(v[k]) + 1e-12)).astype(np.float32)
    return p["r"] @ p["m"], p["q"], p["b"]


def score(docs: DataFrame, training: Column, words: int = WORDS, classes: int = CLASSES, head_size: int = HEAD, own_least: int = LEAST) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), (~training).alias("held_out"))
    known = rows.where(~F.col("held_out")).select("text")
    counts = stash(count_words(known), "lbl-words")
    ends = known.count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] + ends, totals["v"] + (ends > 0)
    least = least_head_count(counts, head_size)
    head = counts.where(F.col("n") >= least).toPandas()
    head = sorted(((bytes(w), int(c)) for w, c in zip(head["word"], head["n"], strict=True)), key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary(head, words, classes)
    shared = spark.sparkContext.broadcast(vocabulary)

    pairs = count_pairs(known, shared).toPandas()  # at most size * size rows
    matrix = np.zeros(vocabulary.size**2)
    matrix[pairs["pair"].to_numpy(np.int64)] = pairs["n"]
    matrix = matrix.reshape(vocabulary.size, vocabulary.size)

    in_classes = counts.groupBy(_class_column(F.col("word"), classes).alias("k")).agg(F.sum(F.col("n") + 1).alias("t")).collect()
    share = np.ones(classes)
    for row in in_classes:
        share[row["k"]] += row["t"]
    for w, c in head[: vocabulary.end]:
        share[class_of(w, classes)] -= c + 1
    if ends:
        a, q, b = fit_vectors(matrix)
        log_p = (normalised(a, q, b) / np.log(10)).astype(np.float32)
    else:
        a = q = np.zeros((vocabulary.size, DIM), np.float32)
        b = np.zeros(vocabulary.size, np.float32)
        log_p = np.full(matrix.shape, -np.log10(vocabulary.size), np.float32)
    core_counts = np.zeros(vocabulary.first, np.int64)
    core_counts[: vocabulary.end] = [c for _, c in head[: vocabulary.end]]
    core_counts[vocabulary.end] = ends
    fitted = spark.sparkContext.broadcast({"a": a, "q": q, "b": b, "unigram": unigram_of(matrix)})
    vectors = stash(own_vectors(count_followers(known, shared), fitted, shared, own_least), "lbl-vectors")
    # vectors of words of the head are broadcast with it, the others are joined to the texts' words
    near = vectors.where(F.col("n") >= least).toPandas().sort_values("key")
    near = (near["key"].to_numpy(np.int64), np.frombuffer(b"".join(near["vector"]), np.float16).reshape(-1, DIM), near["log_z"].to_numpy(np.float32))
    model = spark.sparkContext.broadcast((q, b, log_p, np.log10(share), np.log10(core_counts + 1.0), near))

    def after(vector: np.ndarray, log_z: np.ndarray, following: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,ij->i", vector.astype(np.float32), q[following]) + b[following] - log_z) / np.log(10)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (q, b, log_p, log_share, log_core, (near_keys, near_vectors, near_z)) = shared.value, model.value
        for batch in batches:
            for start, stop, block in blocks(batch, 1, v):
                rows, o = stop - start, block.outside
                model_part = log_p[block.before, block.symbols].astype(np.float64)
                base_part = np.zeros(len(block.symbols))
                inside = block.symbols < v.first
                base_part[inside] = log_core[block.symbols[inside]]
                at, in_head = find(v.head_hashes, block.hashes[o])
                logs = np.zeros(len(o))
                logs[in_head] = np.log10(v.head_counts[at[in_head]] + 1.0)
                places = block.places[o]
                base_part[places] = logs
                pairs = block.pairs()
                at, own = find(near_keys, pairs >> NEXT_BITS)
                at, own = at[own], places[own] + 1
                model_part[own] = after(near_vectors[at], near_z[at], block.symbols[own], q, b)
                model_part[places] += logs - log_share[block.kinds[o]]
                of = np.zeros(len(block.symbols), np.int64)
                last = np.cumsum(np.bincount(block.text, minlength=rows) + 1) - 1
                of[last[:-1] + 1] = 1
                of = np.cumsum(of)
                tail = o[~in_head]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(block.text[tail], minlength=rows))])
                tokens = np.bincount(of, minlength=rows)
                unknown = np.bincount(block.text[tail], minlength=rows) + (0 if n else 1)
                offsets = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, rows),
                        batch.column(2).slice(start, rows),
                        pa.array(tokens, pa.int64()),
                        pa.array(tokens - unknown, pa.int64()),
                        pa.array(np.bincount(of, base_part, rows)),
                        pa.array(np.bincount(of, model_part, rows)),
                        pa.ListArray.from_arrays(offsets, pa.array([block.name(i) for i in tail], pa.binary())),
                        pa.ListArray.from_arrays(offsets, pa.array(pairs[~in_head], pa.int64())),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "tail", "tail_pairs"],
                )

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (q, b, log_p, *_) = shared.value, model.value
        for batch in batches:
            if batch.num_rows:
                pairs = batch.column(1).to_numpy()
                vector = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float16).reshape(-1, DIM)
                following = pairs & (1 << NEXT_BITS) - 1
                gain = after(vector, batch.column(3).to_numpy(), following, q, b) - log_p[v.first + (pairs >> NEXT_BITS + HASH_BITS), following]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain.astype(np.float64))], names=["row", "gain"])

    scored = rows.mapInArrow(local, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, tail array<binary>, tail_pairs array<long>")
    scored = stash(scored.withColumn("row", F.monotonically_increasing_id()), "lbl-rows")
    # words outside the broadcast head: add log10(c + 1) where the count is known, else 0
    rare = scored.select("row", F.explode("tail").alias("word"))
    below = counts.where(F.col("n") < least).select("word", "n")
    added = rare.join(below, "word").select("row", F.log10(F.col("n") + 1.0).alias("extra"), F.lit(1).alias("known"), F.lit(0.0).alias("gain"))
    far = vectors.where(F.col("n") < least).select("key", "vector", "log_z")
    steps = scored.select("row", F.explode("tail_pairs").alias("pair")).withColumn("key", F.shiftright("pair", NEXT_BITS))
    steps = steps.join(far, "key").select("row", "pair", "vector", "log_z").mapInArrow(later, "row long, gain double")
    added = added.unionAll(steps.select("row", F.lit(0.0), F.lit(0), "gain")).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("extra", "known", "gain")))
    extra = F.coalesce("extra", F.lit(0.0))
    return scored.drop("tail", "tail_pairs").join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("model") + extra + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return score(docs, ~held_out)
