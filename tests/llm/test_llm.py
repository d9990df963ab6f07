"""The ten operators and the pipeline on small tables, against brute force, round trips or held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import bpe, chat, chroma, components, cotrain, jaccard, language, lbl, license, registry, tiling, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    """Rows of documents with columns that clash with names the operators use."""
    data = [(i, t, lang, "s", None if t is None else len(t), 7, "x") for i, t in texts]
    return spark.createDataFrame(data, DOCS + ", block long, node string")


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "A b C\x1fd é 日本 ½ 🙂 's 'll  x"), (6, "same text here"), (6, "same text here"), (7, "z" * 5000), (None, "no id at all")]


# --- byte-level BPE ------------------------------------------------------------------------------


def reference_bpe():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})


def test_bpe_agrees_with_the_library_and_round_trips(spark):
    rng = random.Random(3)
    pool = "ab'stZ é ßñ0123²½Ⅷ一二٣ \t\n\r\x0b\x0c\x1c\x85 　_-!.?🙂'LL'll're\x00ǅªº"
    texts = EDGES + [(100 + i, "".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(3000)]
    own, sha = reference_bpe(), lambda b: hashlib.sha256(b).hexdigest()
    out = bpe.encode(docs(spark, texts), with_ids=True)
    want = Counter()
    for i, t in texts:
        ids = own.encode_ordinary(t or "")
        want[(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    back = Counter((r.doc_id, bytes(r.text).decode()) for r in bpe.decode(out).collect())
    assert back == Counter((i, t or "") for i, t in texts)


def test_bpe_blocks_and_repeated_words(spark):
    rng = random.Random(9)
    pool = ["the", "zqxjv", "Ünïcode", "日本語", "12345678", "\n\n  ", "a" * 200]
    texts = [(i % 40, " ".join(rng.choice(pool) + str(rng.randrange(30)) for _ in range(rng.randrange(80)))) for i in range(200)] + [(None, None)]
    own = reference_bpe()
    want = Counter((i, tuple(own.encode_ordinary(t or ""))) for i, t in texts)
    for block_bytes in (1, 500, 1 << 24):
        got = bpe.encode(docs(spark, texts).repartition(3), with_ids=True, block_bytes=block_bytes)
        assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    assert bpe.encode(docs(spark, [])).count() == 0


def test_bpe_encodes_a_word_once_and_does_not_shuffle_texts(spark):
    plan = bpe.encode(docs(spark, EDGES))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "Bucketed: true" in plan
    parts = [bpe._vocabulary(bpe.default_path())[0]]
    assert bpe.merge_word(b"zqxjv", parts[0]) == reference_bpe().encode_ordinary("zqxjv")


def test_bpe_decodes_by_the_token_table(spark):
    ranks = bpe.load_ranks(bpe.default_path())
    by_rank = {i: b for b, i in ranks.items()}
    rows = [(1, [5, 300, 7000]), (2, []), (3, None), (4, [max(by_rank) + 1]), (5, [-1, 5]), (None, [65])]
    got = {r.doc_id: None if r.text is None else bytes(r.text) for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {1: by_rank[5] + by_rank[300] + by_rank[7000], 2: b"", 3: None, 4: None, 5: None, None: by_rank[65]}


def test_bpe_merges_long_words_alike():
    ranks = bpe.load_ranks(bpe.default_path())
    rng = random.Random(5)
    for n in (65, 90, 300):
        w = bytes(rng.choice(b"abcthe in") for _ in range(n))
        parts = [w[i : i + 1] for i in range(n)]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe.merge_word(w, ranks) == [ranks[p] for p in parts]


# --- n-gram Jaccard join -------------------------------------------------------------------------


def brute_classes(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                comp[q] = p
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_classes_against_all_pairs(spark, k, percent):
    rng = random.Random(percent)
    passage = words(60, 1)
    texts = list(EDGES[:8])
    for i in range(20, 60):
        texts.append((i, " ".join(words(rng.randrange(1, 40), i) + (passage if i % 3 == 0 else []))))
    base = words(rng.randrange(60, 200), 99)
    for i in range(60, 130):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"edit{i}x{rng.randrange(99)}"
        texts.append((i, " ".join(w)))
    for i in range(130, 150):
        w = words(14, 500)
        w[rng.randrange(14)] = rng.choice(["p", "q", "r"])
        texts.append((i, " ".join(w)))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_classes(docs(spark, texts), k, percent).collect()}
    assert got == brute_classes(texts, k, percent)


def test_jaccard_edges_and_empty_tables(spark):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_classes(docs(spark, EDGES), 3, 90).collect())
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 0, 3)] == got[(4, 1, 4)] == 1
    assert got[(6, 1, 6)] == 2 and sum(got.values()) == len(EDGES)
    assert [k for k in got if k[0] is None] == [(None, 0, None)]
    assert jaccard.similar_classes(docs(spark, []), 3, 90).count() == 0


def test_long_texts_come_to_python_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.repeat(F.lit("word "), 4000), "id").alias("text"))
    sets = jaccard.set_keys(rows, 5, 1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 12_000_000 and max(found) < 4_000_000
    assert {(r.doc_id, r.n_shingles) for r in sets.collect()} == {(i, 2) for i in range(600)}
    encoded = bpe.encode(rows)  # a block of texts is more than a batch
    want = {i: hashlib.sha256(("word " * 4000 + f" {i}").encode()).hexdigest() for i in range(600)}
    assert {r.doc_id: r.decoded_sha256 for r in encoded.collect()} == want


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)] + [(202, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 140)} | {200: 200, 201: 200, 202: 200}


# --- log-bilinear model --------------------------------------------------------------------------


def test_lbl_counts_base_and_normalisation(spark):
    rng = random.Random(2)
    vocab = words(60, 3)
    texts = [*EDGES[:8], *((20 + i, " ".join(rng.choice(vocab[:20] if i % 2 else vocab[20:]) for _ in range(30))) for i in range(120)), (500, " ".join(f"rare{i}" for i in range(40)))]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    training = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    got = lbl.score(docs(spark, texts), training, words=16, classes=5, head_size=30).collect()
    assert len(got) == len(texts)
    for r in got:
        t = next(t for i, t in texts if i == r.doc_id)
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    seen = [r for r in got if 20 <= r.doc_id < 140 and r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)  # it knows which words go together
    assert lbl.score(docs(spark, []), training).count() == 0


def brute_lbl(texts, held, words, classes, least):
    """Scores by the definition, from counts, the fitted table and the vectors of words outside it."""
    name = lambda w: w if len(w) <= 48 else b"\0" + hashlib.sha256(w).digest() + w[-2:]
    tokens = lambda t: [name(w) for w in (t or "").encode().lower().split()]
    c = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    ends = sum(not held(i) for i, _ in texts)
    vocabulary = {w: n for n, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:words])}
    cls = lambda w: zlib.crc32(w[-2:]) % classes
    symbol = lambda w: vocabulary.get(w, len(vocabulary) + 1 + cls(w))
    size = len(vocabulary) + 1 + classes
    pairs = np.zeros((size, size))
    for i, t in texts:
        if not held(i):
            s = [len(vocabulary), *map(symbol, tokens(t)), len(vocabulary)]
            for a, b in zip(s, s[1:], strict=False):
                pairs[a, b] += 1
    share = [1 + sum(n + 1 for w, n in c.items() if w not in vocabulary and cls(w) == k) for k in range(classes)]
    a, q, b = lbl.fit_vectors(pairs)
    p = lbl.normalised(a, q, b) / math.log(10) if ends else np.full(pairs.shape, -math.log10(size))
    followers = {}
    for i, t in texts:
        s = tokens(t)
        for x, y in zip([] if held(i) else s, [*s, None][1:], strict=False):
            if x not in vocabulary:
                followers.setdefault(x, np.zeros(size, np.float32))[len(vocabulary) if y is None else symbol(y)] += 1
    own = {}
    for w, row in followers.items():
        if row.sum() >= least:
            vector = lbl.fold_in(row[None], a[[symbol(w)]], q, b, lbl.unigram_of(pairs)).astype(np.float16)
            own[w] = lbl.normalised(vector.astype(np.float32), q, b)[0] / math.log(10)
    out = {}
    for i, t in texts:
        before, total = p[len(vocabulary)], 0.0
        for w in [*tokens(t), None]:
            s = len(vocabulary) if w is None else symbol(w)
            total += before[s]
            if w is not None and w not in vocabulary:
                total += math.log10((c[w] + 1) / share[cls(w)])
            before = own.get(w, p[s])
        out[i] = total
    return out, own


def test_lbl_scores_against_brute_force_with_long_words(spark):
    rng = random.Random(8)
    vocab = [*words(40, 4), *["x" * 60] * 5, "y" * 300 + "é"]
    texts = [(1, None), (2, ""), *((20 + i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(30)))) for i in range(60)), (500, "x" * 61 + " " + "x" * 60), (501, "rare1 rare2 rare1")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    training = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    want, own = brute_lbl(texts, held, 12, 5, 5)
    assert len(own) > 20  # more than a head of 30 holds beyond the core
    for head in (20, 30, 1000):
        got = {r.doc_id: r.score for r in lbl.score(docs(spark, texts), training, words=12, classes=5, head_size=head, own_least=5).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-3) for i in want)
    alone = [(i, t) for i, t in texts if held(i)]
    got = lbl.score(docs(spark, alone), training, words=12, classes=5).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in got)


def test_lbl_words_outside_the_core_learn_their_own_followers():
    rng = np.random.default_rng(1)
    core = rng.dirichlet(np.full(20, 0.5), 20)
    a, q, b = lbl.fit_vectors(np.round(core * 3000), dim=12, steps=300)
    u = lbl.unigram_of(np.round(core * 3000))
    truth = core[rng.integers(0, 20, 300)]  # each word goes on like one of the core
    loss = lambda vectors: -(truth * lbl.normalised(vectors, q, b)).sum(1).mean()
    start = np.repeat(a.mean(0, keepdims=True), 300, 0)
    gains = []
    for n in (16, 100, 1000):
        counts = np.array([rng.multinomial(n, x) for x in truth], np.float32)
        gains.append(loss(start) - loss(lbl.fold_in(counts, start, q, b, u)))
    assert 0.03 < gains[0] < gains[1] < gains[2]


def test_lbl_hot_and_repeated_words(spark):
    """One word holds a third of all tokens; one text is very long; rows repeat and ids are null."""
    rng = random.Random(4)
    vocab = words(60, 9)
    text = lambda n: " ".join("the" if rng.random() < 0.33 else rng.choice(vocab) for _ in range(n))
    texts = [(None, "the the"), (0, text(60_000)), *((i, text(40)) for i in range(1, 40)), (3, "again"), (3, "again")]
    training = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2
    want, _ = brute_lbl([(n, t) for n, (_, t) in enumerate(texts)], lambda n: zlib.crc32(b"" if texts[n][0] is None else str(texts[n][0]).encode()) % 7 == 2, 10, 5, 16)
    got = lbl.score(docs(spark, texts), training, words=10, classes=5, head_size=30).collect()
    assert sorted(r.score for r in got) == pytest.approx(sorted(want.values()), rel=1e-4, abs=2e-3)


def test_lbl_fit_is_normalised_and_close_to_the_counts():
    rng = np.random.default_rng(0)
    truth = rng.dirichlet(np.full(12, 0.5), 12)
    counts = np.round(truth * 5000)
    p = np.exp(lbl.fit(counts, dim=12, steps=400))
    assert np.allclose(p.sum(1), 1)
    gap = (counts * (np.log(np.maximum(truth, 1e-9)) - np.log(p))).sum() / counts.sum()
    uniform = (counts * (np.log(np.maximum(truth, 1e-9)) - np.log(counts.sum(0) / counts.sum()))).sum() / counts.sum()
    assert gap < 0.2 * uniform


# --- greedy string tiling ------------------------------------------------------------------------


def brute_tiling(item, doc, k):
    marked_i, marked_j, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in marked_i and j + n not in marked_j:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return out
        marked_i |= set(range(i, i + n))
        marked_j |= set(range(j, j + n))
        out += n


def test_tiling_against_brute_force(spark):
    rng = random.Random(6)
    small = words(6, 2)
    items = [(i, " ".join(rng.choice(small) for _ in range(rng.randrange(1, 26)))) for i in range(12)] + [(90, None), (91, ""), (92, "..."), (12, "one two")]
    texts = [*EDGES[:8], *((20 + i, " ".join(rng.choice(small) for _ in range(60))) for i in range(12)), (70, "x, One; TWO y")]
    whole = items[0][1].split()
    texts.append((80, " ".join(words(30, 5) + whole[len(whole) // 2 :] + words(9, 6) + whole[: len(whole) // 2])))
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in texts:
        for i, x in items:
            w = split(x)
            if w:
                covered = brute_tiling(w, split(t), min(5, len(w)))
                if covered >= 0.5 * len(w):
                    want[(d, i)] = covered
    for block in (tiling.BLOCK_WORDS, 40):
        got = tiling.contaminated(docs(spark, texts), b, block_words=block).collect()
        assert {(r.doc_id, r.item_id): r.n_covered for r in got} == want
    assert (70, 12) in want
    assert tiling.contaminated(docs(spark, []), b).count() == 0
    assert tiling.contaminated(docs(spark, texts), b.limit(0)).count() == 0


def test_tiling_of_texts_that_repeat_themselves(spark):
    item, text = " ".join(["same"] * 1000), " ".join(["same"] * 20000)
    b = spark.createDataFrame([(1, item), (None, "one two three four five six")], "item_id long, text string")
    got = tiling.contaminated(docs(spark, [(7, text), (None, "x one two three four five six y")]), b).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.n_covered, r.n_tiles) for r in got) == [(-1, None, 6, 1), (7, 1, 1000, 1)]


def test_reordered_passages_are_covered(spark):
    item = words(40, 8)
    text = " ".join(words(50, 9) + item[20:] + words(20, 10) + item[:20])
    got = tiling.contaminated(docs(spark, [(1, text), (2, " ".join(words(90, 11)))]), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_covered, r.n_tiles) for r in got] == [(1, 5, 40, 2)]


# --- WARC ----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500 + "\r\n\r\nWARC/1.1\r\n\r\né"
    rows = [(1, "u1", big), (2, None, big), (9, "u\r\nX-Bad: 1", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "y" * 999), (8, "u", "y" * 999), (None, "u", big), (9, "u9", big)]
    pages = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, original int").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    warc.write_archives(warc.resolve(pages), str(tmp_path / "w"), records_per_archive=3)
    records = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.join_revisits(records.drop("payload")).collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == big and i != 9
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)] += 1
    assert got == want
    assert {bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()} == {(h or "") for _, _, h in rows}
    warc.write_archives(warc.resolve(pages.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


# --- language ------------------------------------------------------------------------------------


def test_language_held_out_accuracy_and_edges(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    net = language.train(d.where(~language.held_out()))
    got = language.predict(d.where(language.held_out()), net, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    edge = {(r.doc_id, r.lang_pred) for r in language.predict(docs(spark, EDGES), net).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= edge and (4, "und") not in edge
    signs = ["12 %%", "½ ² 12", "Ⅷ", "①②", "_ 7"]
    assert {r.lang_pred for r in language.predict(docs(spark, list(enumerate(signs))), net).collect()} == {"und"}
    assert {r.lang_pred for r in language.predict(docs(spark, [(1, "日"), (2, "½é")]), net).collect()} & {"und"} == set()
    none = language.train(docs(spark, []))
    blind = language.train(docs(spark, [(i, "123 !") for i in range(9)]))  # a language, but nothing to learn from
    assert language.predict(docs(spark, [(1, "abc")]), blind).first().lang_pred == "und"
    assert language.predict(docs(spark, [(1, "abc")]), none).first().lang_pred == "und"


def test_prediction_is_that_of_the_whole_text(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.train(d.where(~language.held_out()))
    t = net.tables()
    rows = [(r.doc_id, r.text) for r in d.collect()] + [(10**6, "é" * 5000 + " the and" * 3000)]
    got = {r.doc_id: r for r in language.predict(docs(spark, rows), net).collect()}
    for i, x in rows:
        if x and any(map(str.isalpha, x)):
            w = language.windows_of(x.encode())
            weight = 1e-6 + ((w[:, : language.WINDOW] < 26) | (w[:, : language.WINDOW] >= 94)).sum(1)
            z = (net.log_probabilities(w, t) * weight[:, None]).sum(0) / weight.sum()
            p = np.exp(z) / np.exp(z).sum()
            assert got[i].lang_pred == net.languages[int(p.argmax())] and got[i].score == pytest.approx(p.max(), abs=1e-6)


def test_table_convolution_is_the_convolution():
    net = language.ByteConvNet(["a", "b"], seed=1)
    w = language.windows_of(bytes(range(256)) * 3)
    p, emb = net.params, net.params["e"][w]
    pooled = []
    for k in language.WIDTHS:
        cols = np.concatenate([emb[:, j : language.WINDOW + j] for j in range(k)], axis=2)
        pooled.append(np.maximum((cols @ p[f"w{k}"] + p[f"b{k}"]).max(1), 0))
    z = np.concatenate(pooled, 1) @ p["v"] + p["c"]
    z = z - z.max(1, keepdims=True)
    assert np.allclose(z - np.log(np.exp(z).sum(1, keepdims=True)), net.log_probabilities(w, net.tables()), atol=2e-3)


# --- quality -------------------------------------------------------------------------------------


def test_quality_on_labels_and_edges(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = cotrain.train(d, labels)
    got = cotrain.classify(d, model).join(labels, "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.97
    edge = [(r.doc_id, r.quality_score, r.kept) for r in cotrain.classify(docs(spark, EDGES), model).collect() if r.doc_id in (1, 2, 3)]
    assert sorted(edge) == [(1, 0.0, False), (2, 0.0, False), (3, 0.0, False)]
    blank = cotrain.train(d, labels.limit(0))
    assert {r.kept for r in cotrain.classify(docs(spark, [(1, "some words"), (2, None)]), blank).collect()} == {True, False}


def test_rounds_teach_a_view_what_its_labels_do_not_show():
    """Few labels, whose metadata happen to say nothing: the text view's confident pool labels teach the metadata view."""
    gains = []
    for seed in range(5):
        rng = np.random.default_rng(seed)
        y = rng.integers(0, 2, 1200).astype(float)
        text, meta = y[:, None] * 5 + rng.normal(size=(1200, 3)), y[:, None] * 3 + rng.normal(size=(1200, 4))
        known = np.arange(1200) < 24
        meta[known] = rng.normal(size=(24, 4))
        fold = np.arange(24) % 4 == 0
        right = []
        for rounds in (0, cotrain.ROUNDS):
            m = cotrain.CoTrained(text[known], meta[known], y[known], fold, text[~known][:800], meta[~known][:800], rounds)
            logit = m.models["meta"].logit(meta[~known][800:])
            right.append(((logit > np.median(logit)) == y[~known][800:].astype(bool)).mean())
        gains.append(right)
    before, after = np.mean(gains, 0)
    assert after > 0.9 and after > before + 0.1


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600).astype(float)
    text, meta = y[:, None] * 4 + rng.normal(size=(600, 3)), y[:, None] * 4 + rng.normal(size=(600, 2))
    known = np.arange(600) < 60
    fold = np.arange(60) % 4 == 0
    m = cotrain.CoTrained(text[known], meta[known], y[known], fold, text[~known], meta[~known])
    both, _, _ = m.score(text[~known], meta[~known])
    assert ((both > 0.5) == y[~known].astype(bool)).mean() > 0.97


# --- chroma --------------------------------------------------------------------------------------


def tone(freqs, n):
    t = np.arange(n) / chroma.RATE
    x = sum(np.sin(2 * np.pi * f * (t + 0.3 * np.sin(2 * np.pi * t * (i + 1) * 0.7))) for i, f in enumerate(freqs))
    return np.clip(128 + 40 * x, 0, 255).astype(np.uint8).tobytes()


def brute_align(a, b):
    starts = lambda c: [i for i in range(len(c)) if i == 0 or c[i] != c[i - 1]]
    votes = Counter(i - j for i in starts(b) for j in starts(a) if a[j] == b[i])
    votes = {o: n for o, n in votes.items() if n >= chroma.MIN_VOTES}
    if not votes:
        return None
    o = min(votes, key=lambda o: (-votes[o], abs(o), o))
    pairs = [(int(b[i]), int(a[i - o])) for i in range(len(b)) if 0 <= i - o < len(a)]
    error = sum((x ^ y).bit_count() for x, y in pairs) / (32 * len(pairs))
    return (o, votes[o], len(pairs), error) if len(pairs) >= chroma.MIN_OVERLAP and error <= chroma.MAX_ERROR else None


def test_chroma_alignment_against_brute_force(spark):
    song = tone([220, 330, 550], 9000)
    rng = random.Random(4)
    noise = lambda n, s: bytes(random.Random(s).randrange(256) for _ in range(n))
    pcm = {0: song, 1: song, 50: song[1280:] + noise(640, 1), 3: noise(1920, 2) + song, 100: noise(6000, 3), 4: noise(6000, 5), 5: b"", 6: None, 7: b"\x80" * 4000, 150: b"\x80" * 4000, 8: bytes(rng.randrange(100, 156) for _ in range(100))}
    got = chroma.align_classes(spark.createDataFrame([(i, None if x is None else bytearray(x), 1) for i, x in pcm.items()], "doc_id long, pcm binary, codes int")).collect()
    codes = {i: chroma.codes_of(x or b"") for i, x in pcm.items()}
    cls = {i: min(j for j in pcm if len(codes[i]) and codes[j].tobytes() == codes[i].tobytes()) if len(codes[i]) else i for i in pcm}
    assert {(r.doc_id, r.class_id, r.n_codes) for r in got if r.kind == "member"} == {(i, cls[i], len(codes[i])) for i in pcm}
    asked = {cls[i] for i in pcm if i % 50 == 0 and len(codes[i])}
    want = {}
    for q in asked:
        for d in set(cls.values()):
            if d != q and len(codes[d]) and (m := brute_align(codes[q], codes[d])):
                want[(q, d)] = m
    assert {(r.query_id, r.doc_id): (r.offset, r.votes, r.overlap, r.bit_error_rate) for r in got if r.kind == "match"} == want
    assert (0, 3) in want and want[(0, 3)][0] == 30
    blocks = chroma.fingerprint(spark.createDataFrame([(i, bytearray(x or b"")) for i, x in pcm.items()], "doc_id long, pcm binary")).where("n_codes > 0")
    one, many = (sorted(tuple(r) for r in chroma.search(blocks, blocks, block_codes=n).collect()) for n in (10**6, 50))
    assert one == many and one


def test_chroma_finds_alignments_with_wrong_bits_in_every_code(spark):
    rng = np.random.default_rng(8)
    codes = {i: rng.integers(0, 2**32, 30, dtype=np.uint32) for i in range(40)}
    for i in range(40):  # the beginning of recording i again, each code with 3 to 6 wrong bits
        part = codes[i][: int(rng.integers(8, 20))].copy()
        part ^= np.array([sum(1 << int(b) for b in rng.permutation(32)[: rng.integers(3, 7)]) for _ in part], np.uint32)
        codes[100 + i] = np.concatenate([rng.integers(0, 2**32, int(rng.integers(0, 9)), dtype=np.uint32), part])
    df = spark.createDataFrame([(i, len(c), hashlib.sha256(c.tobytes()).hexdigest(), bytearray(c.tobytes())) for i, c in codes.items()], "doc_id long, n_codes long, fingerprint string, codes binary")
    got = {(r.query_id, r.doc_id): r for r in chroma.search(df.where("doc_id < 100"), df).collect()}
    want = {}
    for q, a in codes.items():
        for d, b in codes.items():
            for o in range(1 - len(a), len(b)) if q < 100 and d != q else ():
                x, y = b[max(0, o) :], a[max(0, -o) :]
                m = min(len(x), len(y))
                error = int(np.bitwise_count(x[:m] ^ y[:m]).sum()) / (32 * m)
                if m >= chroma.MIN_OVERLAP and error <= chroma.MAX_ERROR:
                    want.setdefault((q, d), {})[o] = (m, error)
    assert len(want) >= 40 and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all((r.overlap, r.bit_error_rate) == want[p][r.offset] for p, r in got.items())


def test_chroma_finds_every_short_overlap(spark):
    rng = np.random.default_rng(12)
    spoilt = lambda part, n: part ^ np.array([sum(1 << int(b) for b in rng.permutation(32)[:n]) for _ in part], np.uint32)
    codes, wrong = {}, {2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 5}
    for m in range(1, chroma.LONG + 5):  # m codes at an end of a query, or all of a short recording, with wrong bits in each
        n = 6 if m >= chroma.MIN_OVERLAP else wrong.get(m, 0)
        for k in range(6):
            q, d = 1000 * m + 2 * k, 1000 * m + 2 * k + 1
            codes[q] = rng.integers(0, 2**32, 40, dtype=np.uint32)
            at = (0, 40 - m, 11)[k % 3]
            codes[d] = spoilt(codes[q][at : at + m], n)
            if m >= chroma.MIN_OVERLAP and k % 3 < 2:
                more = rng.integers(0, 2**32, 25, dtype=np.uint32)
                codes[d] = np.concatenate([more, codes[d]] if at == 0 else [codes[d], more])
    df = spark.createDataFrame([(i, len(c), hashlib.sha256(c.tobytes()).hexdigest(), bytearray(c.tobytes())) for i, c in codes.items()], "doc_id long, n_codes long, fingerprint string, codes binary")
    got = {(r.query_id, r.doc_id): (r.offset, r.overlap) for r in chroma.search(df, df).collect()}
    for q in (i for i in codes if i % 2 == 0):
        m, k = q // 1000, q % 1000 // 2
        offset = (25 if m >= chroma.MIN_OVERLAP else 0, m - 40, -11)[k % 3]
        assert got[(q, q + 1)] == (offset, m) and got[(q + 1, q)] == (-offset, m), (q, m)


def test_chroma_looks_for_long_overlaps_around_each_run_start():
    held = np.repeat(np.array([5, 9], np.uint32), 10)  # the other recording may change a little sooner or later
    r = chroma.Recordings([held, held[: chroma.LONG - 1], np.full(30, 7, np.uint32), held])
    assert r.places().tolist() == [*range(10, 10 + chroma.SEED_STEP), *range(75, 75 + chroma.SEED_STEP)]


def test_chroma_compares_all_against_all():
    rng = np.random.default_rng(13)
    room = chroma.Room()
    for n, k in ((0, 0), (0, 5), (1, 1), (3, 40_000), (40_000, 2), (700, 90), (90, 700)):
        a, b = (rng.integers(0, 2**64, x, dtype=np.uint64) & np.uint64(2**16 - 1) for x in (n, k))
        got = sorted((int(i), int(j), int(n)) for found in room.close(a, b, 3) for i, j, n in zip(*found, strict=True))
        wrong = np.bitwise_count(a[:, None] ^ b)
        assert got == [(int(i), int(j), int(wrong[i, j])) for i, j in zip(*np.nonzero(wrong <= 3), strict=True)]


def test_chroma_codes_together_and_search_in_many_tasks(spark):
    rng = random.Random(9)
    pcm = [b"", b"a", tone([220, 330], 3000), *(bytes(rng.randrange(256) for _ in range(n)) for n in (959, 960, 1024, 5000)), b"", b"\x80" * 2000, b""]
    together = chroma.codes_of_all(pcm)
    assert [c.tolist() for c in together] == [chroma.codes_of(x).tolist() for x in pcm] and chroma.codes_of_all([]) == []
    assert [len(c) for c in together] == [max(0, (max(len(x), chroma.SHORTEST) - chroma.SHORTEST) // chroma.HOP + 1) if x else 0 for x in pcm]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(pcm)], "doc_id long, pcm binary").coalesce(1)
    printed = chroma.fingerprint(df)
    assert {r.doc_id: bytes(r.codes) for r in printed.collect()} == {i: c.astype("<u4").tobytes() for i, c in enumerate(together)}
    # a search takes long for few bytes, so files or partitions by size would leave cores idle
    assert chroma.search(printed, printed).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_chroma_of_short_recordings(spark):
    rng = random.Random(6)
    pcm = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 40, 300, 959, 1100, 1300)]
    rows = [(i, x) for i, x in enumerate(pcm)] + [(20 + i, x) for i, x in enumerate(pcm)] + [(50, pcm[5] + bytes(rng.randrange(256) for _ in range(3000))), (100, b""), (101, b"")]
    got = chroma.align_classes(spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "doc_id long, pcm binary")).collect()
    members = {r.doc_id: (r.class_id, r.n_codes) for r in got if r.kind == "member"}
    assert all(members[i] == members[20 + i] and members[i][0] == i and members[i][1] > 0 for i in range(6))
    assert members[100] == (100, 0) and members[101] == (101, 0)
    assert {(r.query_id, r.doc_id, r.offset, r.overlap) for r in got if r.kind == "match" and r.overlap > 1} == {(50, 5, 0, len(chroma.codes_of(pcm[5])))} and len(chroma.codes_of(pcm[5])) < chroma.MIN_OVERLAP


def test_chroma_keeps_every_recording_of_a_doc_id(spark):
    a, b = tone([220, 330, 550], 6000), tone([440, 700, 1250], 6000)
    rows = [(1, a), (1, b), (2, b), (50, a[640:]), (100, b[1280:])]
    got = chroma.align_classes(spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "doc_id long, pcm binary")).collect()
    prints = {x: hashlib.sha256(chroma.codes_of(x).astype("<u4").tobytes()).hexdigest() for x in (a, b)}
    found = {(r.query_id, r.doc_id, r.fingerprint, r.offset) for r in got if r.kind == "match"}
    assert {(50, 1, prints[a], 10), (100, 1, prints[b], 20)} <= found
    assert sorted((r.doc_id, r.fingerprint) for r in got if r.kind == "member" and r.class_id == 1) == sorted([(1, prints[a]), (1, prints[b]), (2, prints[b])])


# --- licences and chat ---------------------------------------------------------------------------


def test_licence_forms(spark):
    mit = next(t for i, t in license.NOTICES if i == "MIT" and len(t) > 500)
    texts = [*EDGES[:8], (20, mit.upper().replace("2020", "1999").replace("\n", "\n\n")), (21, "intro line\nreleased UNDER the mit licence!!\nend"), (22, mit + "\nextra"), (23, "Copyright (c) 2001 X"), (24, "Released under the MIT License." * 2)]
    got = {}
    for r in license.scan(docs(spark, texts)).collect():
        got.setdefault((r.doc_id, r.scope), set()).add(r.license_id)
    assert got[(20, "text")] == {"MIT"} and got[(22, "text")] == {None} == got[(24, "text")]
    assert got[(21, "line")] == {"MIT"} and (23, "line") not in got and (1, "text") in got
    assert license.scan(docs(spark, [])).count() == 0
    own = license.digests_of(spark.createDataFrame([("OWN", "Do  what, you LIKE."), ("NONE", "(c) 2001 somebody"), ("NONE", None)], "license_id string, text string"))
    got = {(r.doc_id, r.scope): r.license_id for r in license.scan(docs(spark, [(1, "do what you like"), (2, ""), (3, "Copyright 2001 X")]), own).collect()}
    assert got == {(1, "text"): "OWN", (1, "line"): "OWN", (2, "text"): None, (3, "text"): None}


def test_whole_licences_are_known(spark):
    import os

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(i, open(f"{folder}/{f}", encoding="utf-8").read(), x) for i, (f, x) in enumerate(names.items()) if os.path.exists(f"{folder}/{f}")]
    got = {r.doc_id: r.license_id for r in license.scan(docs(spark, [(i, t.upper().replace("\n", "\r\n")) for i, t, _ in texts])).where("scope = 'text'").collect()}
    assert got == {i: x for i, _, x in texts}
    known = {i for i, _ in license.NOTICES} | {i for i, _ in license.KNOWN_DIGESTS}
    assert {"BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "Unlicense", "Zlib", "BSL-1.0", "0BSD", "ISC", "MPL-2.0"} <= known


def test_preferences_and_edges(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "b"), (1, 0, "user", "hi"), (1, 1, "assistant", "c"), (2, 0, "user", "alone"), (3, 0, None, None), (4, 0, "assistant", "s"), (5, 0, "assistant", "s"), (None, 0, "user", "x"), (6, None, "user", "late"), (6, 0, "assistant", "first"), (7, 1, "assistant", "")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, chosen int")
    got = {r.conv_id: r for r in chat.format_preferences(chat.swapped_replies(df)).collect()}
    assert len(got) == 9
    a = got[0]
    assert (a.n_prompt_turns, a.chosen, a.rejected) == (3, "<|assistant|>\nb<|end|>\n", "<|assistant|>\nc<|end|>\n")
    assert a.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nmore<|end|>\n"
    assert a.chosen_mask == "0x14 1x9" and len(a.chosen) == 23
    assert got[2].rejected is None and got[3].chosen == "<||>\n<|end|>\n" and got[None].rejected is None
    assert (got[4].n_prompt_turns, got[4].chosen, got[4].rejected, got[4].chosen_mask) == (1, "", "", "")
    assert got[6].n_prompt_turns == 0 and got[6].rejected.endswith("late<|end|>\n")
    assert chat.format_preferences(chat.swapped_replies(df.limit(0))).count() == 0


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = d.columns, d
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept.write.parquet(str(tmp_path / name))
        out = stage(spark, spark.read.parquet(str(tmp_path / name)), SF)
        after = {r.doc_id for r in out.collect()}
        if name == "n-gram Jaccard join":
            assert after == {c for _, _, c in brute_classes(list(before.items()), P.SHINGLE_WORDS, P.SIMILARITY)}
        elif name == "benchmark decontamination":
            split = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
            items = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert after == {i for i, t in before.items() if not any(f" {x} " in f" {split(t)} " for x in items)}
        elif name == "language ID":
            assert after == {i for i, t in before.items() if any(map(str.isalpha, t))}
        elif name == "byte-level BPE":
            own = reference_bpe()
            assert {(r.doc_id, r.n_tokens) for r in out.collect()} == {(i, len(own.encode_ordinary(t))) for i, t in before.items()}
            assert {r.doc_id for r in P.run(spark, SF).collect()} == after
        if name != P.STAGES[-1][0]:
            assert out.columns == names
        kept = out
        assert after <= set(before)


def test_pipeline_stages_on_edge_rows(spark):
    import corpus_pipeline as P

    d = spark.createDataFrame([(i, t, None, None, None) for i, t in EDGES], DOCS)
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    assert ids(P.drop_near_duplicates(spark, d, SF))[6] == 1
    assert sum(ids(P.decontaminate(spark, d, SF)).values()) == len(EDGES)
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    clean, other = " ".join(words(40, 70)), " ".join(words(40, 71))
    rows = [(None, f"a {passage} b"), (None, clean), (None, clean), (None, other), (8, clean + " x"), (9, f"{passage}"), (9, other + " " + clean), (9, clean + " y z")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t), 1, 2, 3) for i, t in rows], DOCS + ", node int, _odd int, block int")
    left = P.decontaminate(spark, odd, SF)
    assert left.columns == odd.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter(x for x in rows if passage not in x[1])
    left = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, odd.drop("node", "_odd"), SF).collect()]
    assert (8, clean + " x") in left and (None, other) in left and (9, other + " " + clean) in left
    assert (None, clean) not in left and (9, clean + " y z") not in left
    for _, stage in P.STAGES:
        assert stage(spark, d.limit(0), SF).count() == 0


def test_every_operator_is_registered():
    names = {re.match(r"op\d+", n)[0] for n in registry.queries()}
    assert names == {f"op{n}" for n in range(1, 11)}
    assert set(registry.oracle_sql()) <= set(registry.queries())
