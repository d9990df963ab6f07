"""A quality classifier by co-training.

Two views of a document: what its text holds (its words by hash, shares of kinds of bytes, repetition of
words and lines, sizes of words), and its page metadata (language, source, stated length), each with a ridge logistic
model. Over rounds either view labels the pool's documents that it is most sure of, and the other view
learns from them. Both are then calibrated on labelled documents that neither has seen, and their
log-odds are added (less the prior's, which both hold).

The models are fitted on a bounded sample: about LABELLED labelled documents and a pool of about POOL
others, picked by a hash of doc_id. All documents are scored, over their whole texts.

Null and word-less texts get score 0 and aren't kept. Null metadata is a value of its own. Labels of
null quality, of unknown documents or that contradict each other evenly are left out; without labels
of both kinds every text with words gets the share of good labels (1 without any) and is kept if that is at least
THRESHOLD. Rows that repeat a doc_id get a result each. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, map_batches, table, word_hashes

LABELLED, POOL, ROUNDS, THRESHOLD = 8192, 8192, 5, 0.5
#: Confident documents that a view hands over in a round, at most, and how sure it must be.
EXCHANGED, SURE = 256, 0.97
SOURCES = 64

_GROUPS = np.zeros(256, np.int64)  # 0: other controls
_GROUPS[97:123], _GROUPS[65:91], _GROUPS[48:58], _GROUPS[32], _GROUPS[10], _GROUPS[128:] = 1, 2, 3, 4, 5, 6
_PUNCT = [i for i in range(33, 127) if not chr(i).isalnum()]
_GROUPS[_PUNCT] = 7 + np.arange(len(_PUNCT))
N_GROUPS = 7 + len(_PUNCT)
#: Words are counted by a hash into so many columns.
WORD_COLUMNS = 128


def text_features(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    words = word_hashes(text.lower(), WORD)
    n = max(1, len(words))
    _, times = np.unique(words, return_counts=True)
    shares = np.bincount(_GROUPS[raw], minlength=N_GROUPS) / max(1, len(raw))
    near = [float((words[d:] == words[:-d]).mean()) if len(words) > d else 0.0 for d in (1, 2, 3, 4)]
    lines = text.split(b"\n")
    few = len(times) / n
    extra = [np.log1p(len(words)) / 10, few, few * np.log1p(n) / 10, times.max() / n if len(times) else 0.0, *near, len(set(lines)) / len(lines), len(raw) / n / 10, float((times > 1).sum()) / n]
    held = np.bincount((words % np.uint64(WORD_COLUMNS)).astype(np.int64), minlength=WORD_COLUMNS) / n
    return np.concatenate([np.sqrt(shares), np.sqrt(held), extra, [shares[7:].sum(), shares[2] / (shares[1] + shares[2] + 1e-9)]])


N_TEXT = len(text_features(b""))


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    import zlib

    out = np.zeros(16 + SOURCES + 12)
    out[zlib.crc32((lang or "\0").encode()) % 16] = 1
    out[16 + zlib.crc32((source or "\0").encode()) % SOURCES] = 1
    at = 16 + SOURCES
    if n_chars is None or n_chars < 0:
        out[at] = 1
    else:
        size = np.log2(n_chars + 1)
        out[at + 1 + min(9, int(size / 2))] = 1
        out[at + 11] = size / 10
    return out


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.c_[np.ones(len(x)), self.columns(x)]
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) + penalty * w
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + self.columns(x) @ self.w[1:], -30, 30)


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


class CoTrained:
    """Both views' models and calibrations."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> None:
        self.share = float(y.mean()) if len(y) else 1.0
        train, held = ~fold, fold
        self.usable = len(y) > 0 and all(0 < y[m].mean() < 1 for m in (train, held) if m.any()) and train.any() and held.any()
        if not self.usable:
            return
        views = {"text": (text, pool_text), "meta": (meta, pool_meta)}
        left = np.ones(len(pool_text), bool)
        lent = {"text": ([], []), "meta": ([], [])}  # pool rows and labels that a view has been handed
        for _ in range(rounds + 1):
            models = {}
            for k, (x, pool) in views.items():
                rows, labels = lent[k]
                models[k] = Logistic().fit(np.r_[x[train], pool[rows]] if rows else x[train], np.r_[y[train], labels] if rows else y[train])
            if not left.any():
                break
            taken: set[int] = set()
            for k, other in (("text", "meta"), ("meta", "text")):
                p = _sigmoid(models[k].logit(views[k][1])) if len(pool_text) else np.empty(0)
                for label, sure in ((1, p), (0, 1 - p)):
                    quota = max(1, round(EXCHANGED * (self.share if label else 1 - self.share)))
                    rows = [int(i) for i in np.argsort(-sure, kind="stable") if left[i] and sure[i] >= SURE and int(i) not in taken][:quota]
                    lent[other][0].extend(rows)
                    lent[other][1].extend([label] * len(rows))
                    taken.update(rows)
            left[list(taken)] = False
        self.models = models
        self.calibration = {k: Logistic().fit(models[k].logit(x[held])[:, None], y[held], 0.1) for k, (x, _) in views.items()}
        p = min(max(y[held].mean(), 1e-3), 1 - 1e-3)
        self.prior = float(np.log(p / (1 - p)))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by both views, by text, by metadata."""
        if not self.usable:
            same = np.full(len(text), self.share)
            return same, same, same
        zt = self.calibration["text"].logit(self.models["text"].logit(text)[:, None])
        zm = self.calibration["meta"].logit(self.models["meta"].logit(meta)[:, None])
        return _sigmoid(zt + zm - self.prior), _sigmoid(zt), _sigmoid(zm)


def _features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with both views' features as 32-bit numbers end to end, for the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for batch in batches:
            t, lang, source, n = (batch.column(k + i).to_pylist() for i in range(4))
            text = [text_features(x).astype("<f4").tobytes() for x in t]
            meta = [meta_features(*x).astype("<f4").tobytes() for x in zip(lang, source, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=[*keep, "tf", "mf"])

    schema = docs.select(*keep).schema.add("tf", "binary").add("mf", "binary")
    return map_batches(docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("t"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")), run, schema)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    def part(df: DataFrame, most: int, seed: str) -> DataFrame:
        n = df.count()
        picked = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) < min(1.0, most / max(1, n)) * 1_000_003
        return df.where(picked).orderBy(F.xxhash64("doc_id", F.lit(seed)), *df.columns[:1]).limit(2 * most)

    agreed = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y")).where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
    some = part(agreed, labelled, "labels")  # at most 2 * labelled rows of 12 bytes: broadcast whatever the input
    known = _features(docs.join(F.broadcast(some), "doc_id"), ["doc_id", "y"]).orderBy("doc_id", "tf", "mf").limit(4 * labelled).toPandas().sort_values("doc_id", kind="stable")
    ids = set(known["doc_id"])
    rest = _features(part(docs.where("doc_id IS NOT NULL"), pool, "pool"), ["doc_id"]).toPandas().sort_values("doc_id", kind="stable")
    rest = rest[~rest["doc_id"].isin(ids)]
    stack = lambda s, n: np.frombuffer(b"".join(s), "<f4").reshape(-1, n).astype(float)
    n_meta = len(meta_features(None, None, None))
    fold = np.array([(int(i) * 2654435761 >> 7) % 4 == 0 for i in known["doc_id"]], bool)
    return CoTrained(stack(known["tf"], N_TEXT), stack(known["mf"], n_meta), known["y"].to_numpy(float), fold, stack(rest["tf"], N_TEXT), stack(rest["mf"], n_meta))


def classify(docs: DataFrame, model: CoTrained, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` of docs(doc_id, text, lang, source, n_chars) with quality_score, text_score, meta_score, kept."""
    keep = keep if keep is not None else ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema
    for name, kind in (("quality_score", "double"), ("text_score", "double"), ("meta_score", "double"), ("kept", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for batch in batches:
            t, lang, source, n = (batch.column(k + i).to_pylist() for i in range(4))
            text = np.array([text_features(x) for x in t]).reshape(-1, N_TEXT)
            meta = np.array([meta_features(*x) for x in zip(lang, source, n, strict=True)]).reshape(len(t), -1)
            both, by_text, by_meta = shared.value.score(text, meta)
            some = np.array([bool(x.strip(b" \t\n\r\x0b\x0c")) for x in t], bool)
            both = np.where(some, both, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(both), pa.array(by_text), pa.array(by_meta), pa.array(some & (both >= threshold))], names=[*keep, "quality_score", "text_score", "meta_score", "kept"])

    return map_batches(docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("\0t"), F.col("lang").cast("string").alias("\0l"), F.col("source").cast("string").alias("\0s"), F.col("n_chars").cast("long").alias("\0n")), run, schema)


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
