"""Language identification by a byte convolutional network, trained and applied in numpy.

Each text is cut into windows of WINDOW bytes, the last one padded; filters of widths 2, 3 and 4 over
embedded bytes, max pooling over the window, one linear layer and softmax give each window's
probabilities, and the whole text's are the mean of the windows' logarithms, weighted by their letters.

Prediction reads the text alone. A null text or one without a letter is `und` with score 0. Training
reads texts with a language; rows without one, or with a text that is null or has no letter, are left out. Empty
tables give no rows; without any usable training row every prediction is `und`. Repeated rows and
equal doc_ids get a result each. Other columns may be present; they are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

WINDOW = 256
WIDTHS, FILTERS, DIM = (2, 3, 4), 8, 8
#: Labelled texts to a language that the network is fitted on, about, and windows of each: the documented bound.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT = 1200, 2
#: Bytes become this many symbols: letters without case, digit, space, punctuation, control, and the bytes of UTF-8 sequences.
SYMBOLS = 26 + 4 + 64 + 32


def _symbol_table() -> np.ndarray:
    out = np.full(256, 29, np.int32)
    out[33:127] = 28
    out[[9, 10, 11, 12, 13, 32]] = 27
    out[48:58] = 26
    for i in range(26):
        out[65 + i] = out[97 + i] = i
    out[128:192] = 30 + np.arange(64)
    out[192:256] = 94 + np.arange(64) // 2
    return out


_SYMBOL = _symbol_table()
_LETTERISH = (_SYMBOL < 26) | (_SYMBOL >= 94)
_ascii_letter = re.compile("[A-Za-z]").search


def has_letter(text: str) -> bool:
    """Whether a character is a letter by its Unicode category; number signs and marks are none."""
    return bool(_ascii_letter(text)) or any(map(str.isalpha, text))


def windows_of(text: bytes) -> np.ndarray:
    """All of a text as rows of WINDOW + 4 symbols; the padding is white space."""
    n = max(1, -(-len(text) // WINDOW))
    flat = np.full(n * WINDOW + 4, 27, np.int32)
    flat[: len(text)] = _SYMBOL[np.frombuffer(text, np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW + 4)[::WINDOW]


class ByteConvNet:
    """Embedding, convolutions of several widths, max pooling, a linear layer."""

    def __init__(self, languages: list[str], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.params = {"e": rng.normal(0, 0.5, (SYMBOLS, DIM))}
        for w in WIDTHS:
            self.params[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS))
            self.params[f"b{w}"] = np.zeros(FILTERS)
        self.params["v"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(languages))))
        self.params["c"] = np.zeros(max(1, len(languages)))
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross entropy; gradients flow through each filter's largest position."""
        rng, p = np.random.default_rng(seed), self.params
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                s, y = windows[pick], labels[pick]
                n, emb, pooled, best = len(y), p["e"][s], [], {}
                for w in WIDTHS:
                    cols = np.concatenate([emb[:, j : WINDOW + j] for j in range(w)], axis=2)
                    h = cols @ p[f"w{w}"] + p[f"b{w}"]
                    at_max = h.argmax(1)
                    best[w] = (cols, at_max)
                    pooled.append(np.take_along_axis(h, at_max[:, None], 1)[:, 0])
                x = np.concatenate(pooled, 1)
                x = np.maximum(x, 0)
                z = x @ p["v"] + p["c"]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(n), y] -= 1
                z /= n
                g = {"v": x.T @ z, "c": z.sum(0), "e": np.zeros_like(p["e"])}
                dx = (z @ p["v"].T) * (x > 0)
                rows = np.arange(n)[:, None]
                for i, w in enumerate(WIDTHS):
                    d = dx[:, i * FILTERS : (i + 1) * FILTERS]
                    cols, at_max = best[w]
                    picked = cols[rows, at_max]  # n, filters, w * dim
                    g[f"w{w}"] = np.einsum("nf,nfk->kf", d, picked)
                    g[f"b{w}"] = d.sum(0)
                    back = (d[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, DIM)
                    for j in range(w):
                        np.add.at(g["e"], s[rows, at_max + j], back[:, :, j])
                step += 1
                scale = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k in p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    p[k] -= (scale * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)

    def tables(self) -> dict:
        """The filters' responses to each symbol and pair of symbols, as 16-bit integers of a common scale.

        A convolution then reads tables: pair + nothing, pair + symbol, pair + pair for widths 2, 3, 4.
        One entry, 8 filters of 2 bytes, is read as one 16-byte number.
        """
        p, e = self.params, self.params["e"]
        one = {(w, j): e @ p[f"w{w}"][j * DIM : (j + 1) * DIM] for w in WIDTHS for j in range(w)}
        pair = lambda w, j: (one[w, j][:, None] + one[w, j + 1][None]).reshape(-1, FILTERS)
        raw = {"2": pair(2, 0), "3": pair(3, 0), "3+": one[3, 2], "4": pair(4, 0), "4+": pair(4, 2)}
        scale = 16_000 / max(1e-9, *(float(np.abs(x).max()) for x in raw.values()))
        return {k: np.ascontiguousarray(np.rint(x * scale).astype(np.int16)).view(np.complex128).ravel() for k, x in raw.items()} | {"scale": scale}

    def log_probabilities(self, windows: np.ndarray, t: dict) -> np.ndarray:
        """Of each language for each window."""
        p, n = self.params, len(windows)
        s = np.ascontiguousarray(windows.T)
        pairs = s[:-1] * SYMBOLS + s[1:]
        read = lambda k, at: t[k].take(at).view(np.int16).reshape(WINDOW, n, FILTERS)
        h = {2: read("2", pairs[:WINDOW]), 3: read("3", pairs[:WINDOW]), 4: read("4", pairs[:WINDOW])}
        h[3] += read("3+", s[2 : WINDOW + 2])
        h[4] += read("4+", pairs[2 : WINDOW + 2])
        x = np.concatenate([h[w].max(0) / t["scale"] + p[f"b{w}"] for w in WIDTHS], 1)
        z = np.maximum(x, 0) @ p["v"].astype(np.float64) + p["c"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(docs: DataFrame, text: str = "text", label: str = "lang", texts: int = TEXTS_PER_LANGUAGE) -> ByteConvNet:
    """Fit on a bounded sample: about `texts` rows of each language, picked by a hash of the text."""
    known = docs.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("y"), F.col(text).alias("x"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return ByteConvNet([])
    share = F.lit(0.0)
    for y in languages:
        share = F.when(F.col("y") == y, F.lit(min(1.0, texts / counts[y]))).otherwise(share)
    bytes_wanted = WINDOW * WINDOWS_PER_TEXT
    offset = F.pmod(F.xxhash64("x"), F.greatest(F.length("x") - F.lit(bytes_wanted), F.lit(1))) + 1
    picked = (
        known.where(F.pmod(F.xxhash64("x", F.lit("language")), F.lit(1_000_003)) < share * 1_000_003)
        .select("y", F.xxhash64("x").alias("k"), F.substring("x", offset.cast("int"), F.lit(bytes_wanted)).alias("x"))
        .orderBy("k", "y", "x")
        .limit(2 * texts * len(languages))
        .toPandas()
    )
    rows = [(w, y) for y, x in zip(picked["y"], picked["x"], strict=True) if has_letter(x) for w in windows_of(x.encode()[:bytes_wanted])]
    languages = sorted({y for _, y in rows})  # those that something was learned of
    net = ByteConvNet(languages)
    if rows:
        net.fit(np.stack([w for w, _ in rows]), np.array([languages.index(y) for _, y in rows]))
    return net


def predict(docs: DataFrame, net: ByteConvNet, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred and score."""
    keep = keep if keep is not None else ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        t = net.tables()
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            # windows of many texts go through together, a bounded number at a time
            sums = np.zeros((len(texts), len(net.params["c"])))
            weights = np.zeros(len(texts))
            held: list[np.ndarray] = []
            owners: list[np.ndarray] = []

            def flush(held=held, owners=owners, sums=sums, weights=weights) -> None:
                if held:
                    w, own = np.concatenate(held), np.concatenate(owners)
                    weight = 1e-6 + ((w[:, :WINDOW] < 26) | (w[:, :WINDOW] >= 94)).sum(1)
                    np.add.at(sums, own, net.log_probabilities(w, t) * weight[:, None])
                    np.add.at(weights, own, weight)
                    held.clear()
                    owners.clear()

            usable = [bool(x) and bool(net.languages) and bool(has_letter(x)) for x in texts]
            n = 0
            for i, x in enumerate(texts):
                if usable[i]:
                    w = windows_of(x.encode())
                    for at in range(0, len(w), 64):
                        part = w[at : at + 64]
                        held.append(part)
                        owners.append(np.full(len(part), i))
                        n += len(part)
                        if n >= 64:
                            flush()
                            n = 0
            flush()
            langs, scores = [], []
            for i, ok in enumerate(usable):
                if not ok:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                z = sums[i] / weights[i]
                z = np.exp(z - z.max())
                z /= z.sum()
                langs.append(net.languages[int(z.argmax())])
                scores.append(float(z.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return map_batches(docs.select(*keep, F.col(text).alias("\0text")), run, schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    net = train(docs.where(~F.col("held_out")))
    return predict(docs, net, ["doc_id", "held_out"])
