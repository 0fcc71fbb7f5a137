"""Each operator against a brute-force version on small tables with nulls, empties, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veristrata.llm import cotrain, encoding, exthash, histogram, hmm, itq, linedup, minhash, mixing, packing, warc
from veristrata.llm.common import row_keys, words

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
TEXTS = [
    (0, BASE + "\nshared line with five words", "b"), (1, BASE + " more", "b"), (2, "  " + BASE.replace(" ", "\n") + "\nshared  LINE with five words", "a"),
    (3, None, None), (4, "", "a"), (5, "a b", "a"), (6, "A  B", "c"), (7, "shared line with six words", "c"), (8, BASE.replace("ten", "10"), "c"),
    (9, "word " * 6000, "b"), (10, "shared line with five words extra\n\n", "b"), (10, "shared line with five words extra\n\n", "b"), (None, "a b", "a"),
]
SCHEMA = "doc_id long, text string, source string, key string, id int, label string, h int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "clash", 1, "clash", 2) for t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, empty):
    groups = {}
    for d, t, _ in TEXTS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    want = Counter()
    for norm, g in groups.items():
        keep = min(g)[3]
        for x in g:
            want[(x[3], keep, len(g), x[3] == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter(map(tuple, exthash.exact_dedup(docs).collect())) == want
    assert exthash.exact_dedup(empty).count() == 0


def test_exact_in_batches(docs):
    """An index that grows batch by batch, with splits, holds what one batch gives; lookups go through its files."""
    want = Counter(map(tuple, exthash.exact_dedup(docs, capacity=1).collect()))
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 OR doc_id IS NULL")
    one = exthash.build_index(first, capacity=1)
    two = exthash.build_index(second, index=one, capacity=1)
    assert Counter(map(tuple, exthash.exact_dedup(docs, index=two).collect())) == want
    stored = two.filter(f"kind = {exthash.DIRECTORY}")
    assert stored.agg(F.max("depth")).first()[0] > 0 or two.filter(f"kind = {exthash.ENTRY}").groupBy("owner").count().agg(F.max("count")).first()[0] == 1
    assert exthash.exact_dedup(docs.filter("doc_id = 7"), index=one).count() == 0  # not in there
    assert exthash.build_index(docs.limit(0)).count() == 0 and exthash.exact_dedup(first, index=exthash.build_index(docs.limit(0))).count() == 0


def test_index_outgrows_its_owners(docs, monkeypatch):
    want = Counter(map(tuple, exthash.exact_dedup(docs).collect()))
    one = exthash.build_index(docs.filter("doc_id < 3"))
    monkeypatch.setattr(exthash, "OWNER_BYTES", 50)
    two = exthash.build_index(docs.filter("doc_id >= 3 OR doc_id IS NULL"), index=one)
    assert two.agg(F.max("bits")).first()[0] > one.agg(F.max("bits")).first()[0]
    assert Counter(map(tuple, exthash.exact_dedup(docs, index=two).collect())) == want


def test_directory_splits_and_chains():
    d = exthash.Directory(2, 2)
    keys = [(k << 54, b"%d" % k) for k in range(40)] + [(5 << 54, b"other %d" % i) for i in range(5)]
    for k, t in keys:
        assert d.find(k, t) is None
        d.add(k, [t])
    assert all(d.find(k, t) == [t] for k, t in keys) and d.find(5 << 54, b"7") is None and d.depth > 3
    found = [(n, b) for n, b in d.buckets()]
    assert sorted((k, e[0]) for _, b in found for k, c in b.chains.items() for e in c) == sorted(keys)
    assert all(d._bits(k, b.depth) == n for n, b in found for k in b.chains)
    assert all(b.size <= 2 or 5 << 54 in b.chains for _, b in found)
    again = exthash.Directory.restore(2, 2, [(n, b.depth) for n, b in found])
    assert [(n, b.depth) for n, b in again.buckets()] == [(n, b.depth) for n, b in found]
    with pytest.raises(ValueError):
        exthash.Directory.restore(2, 2, [(n, b.depth) for n, b in found][1:])


def brute_near(rows):
    sets = {}
    for d, t, _ in rows:
        w = words(t or "")
        if d is not None:
            sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in sets}


def test_near(spark, docs, empty):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = list(TEXTS)
    for i in range(60):  # near copies at every distance around the threshold, and chains of them
        w = list(base)
        for j in rng.choice(200, int(rng.integers(1, 14)), replace=False):
            w[j] = f"x{i}_{j}"
        rows.append((100 + i, " ".join(w), "z"))
    df = spark.createDataFrame([r for r in rows], "doc_id long, text string, source string")
    want = brute_near(rows)
    got = {r[0]: (r[1], r[2]) for r in minhash.near_dedup(df).collect() if r[0] is not None}
    assert got == want
    assert minhash.near_dedup(empty).count() == 0


def at_cosine(a, cosine, rng):
    u = rng.standard_normal(a.shape)
    u -= (u * a).sum(axis=1)[:, None] * a
    return cosine * a + np.sqrt(1 - cosine * cosine) * u / np.linalg.norm(u, axis=1)[:, None]


@pytest.mark.parametrize("width", [2, 8, 16, 24, 32, 64, 256])
def test_tables_recall(width):
    """Pairs at the threshold meet in a table and pass the Hamming bound, however wide the vectors and the words."""
    rng = np.random.default_rng(6)
    x, a = itq.unit(rng.standard_normal((3000, width))), itq.unit(rng.standard_normal((3000, width)))
    for n in (1000, 10**6):
        m = itq.learn(x, n)
        for cosine in (0.951, 0.97):
            one, two = m.bits(a), m.bits(at_cosine(a, cosine, rng))
            met = (m.words(one) == m.words(two)).any(axis=1) & ((one != two).sum(axis=1) <= m.most)
            assert met.mean() >= 0.95, (width, n, cosine)
        assert (m.unpack(m.pack(one)) == one).all()


def test_near_vectors(spark, monkeypatch):
    """Links at the threshold, of two lengths, repeated and missing ids, huge and unusable vectors."""
    monkeypatch.setattr(itq, "BLOCK", 40)
    rng = np.random.default_rng(2)
    x = itq.unit(rng.standard_normal((150, 24)))
    every = np.concatenate([x, at_cosine(x[:60], 0.96, rng), at_cosine(np.tile(x[:1], (60, 1)), 0.98, rng)])
    rows = [(i, v.tolist()) for i, v in enumerate(every)] + [(904, every[3].tolist()), (3, every[3].tolist()), (5, every[9].tolist()), (None, every[3].tolist()), (None, x[149].tolist())]
    rows += [(950 + i, v.tolist()) for i, v in enumerate(itq.unit(rng.standard_normal((9, 7))))]
    rows += [(970, rows[-1][1]), (971, [c * 1e300 for c in rows[-1][1]]), (972, [1.0]), (973, [2.0]), (974, [-1.0])]
    bad = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (905, []), (None, None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows + bad], "vec_id long, embedding array<double>, id string, cid int")
    out = itq.near_vectors(df).collect()
    v = np.zeros((len(rows), 32))
    for i, (_, c) in enumerate(rows):
        v[i, : len(c)] = itq.unit(np.array([c]))[0]
    size = np.array([len(c) for _, c in rows])
    link = (v @ v.T >= 0.95) & (size[:, None] == size)
    np.fill_diagonal(link, False)
    found, true = sum(r["n_links"] for r in out), int(link.sum())
    assert 0.97 * true <= found <= true
    ids = np.array([2**62 if i is None else i for i, _ in rows])
    label = ids.copy()
    for _ in range(20):
        label = np.minimum(label, np.where(link, label[None, :], 2**62).min(axis=1))
    none = lambda i: None if i >= 2**62 else int(i)
    want = Counter((none(i), int(n), none(c), i == c) for i, n, c in zip(ids, link.sum(axis=1), label)) + Counter((i, 0, i, True) for i, _ in bad)
    got = Counter(map(tuple, out))
    assert sum(got.values()) == sum(want.values()) and sum((got & want).values()) >= 0.9 * len(rows)
    assert sum(r["vec_id"] in (970, 971) and r["n_links"] >= 2 for r in out) == 2 and (972, 1, 972, True) in got and (974, 0, 974, True) in got
    assert all((i, 0, i, True) in got for i, _ in bad) and itq.near_vectors(df.limit(0)).count() == 0


def test_encoding():
    e = encoding.encoder(encoding.default_tokenizer())
    texts = [t or "" for _, t, _ in TEXTS] + [" a", "a  b", "x\n y", " a b　 c", "It's <|endoftext|> né 12 345", "x" * 100 + " " + "y" * 100]
    texts += ["x<|endoftext|>y", "<|endoftext|>", " a <|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext|", "word " * 300 + "<|endoftext|>\n"]
    own = Tokenizer.from_file(encoding.default_tokenizer())  # as it comes, special strings included
    want = [np.asarray(x.ids, "<u4").tobytes() for x in own.encode_batch(texts, add_special_tokens=False)]
    assert e.ids(texts) == want == e.ids(texts)
    assert np.frombuffer(e.ids(["x<|endoftext|>y"])[0], "<u4").tolist() == [87, 50256, 88]


def test_special_strings(spark):
    """Lengths and checksums of pieces, and the histogram, count a special string as its one id."""
    own = Tokenizer.from_file(encoding.default_tokenizer())
    texts = ["x<|endoftext|>y", "plain words", None, "<|endoftext|>" * 30, "a " * 2100 + "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    rows = packing.pack_documents(df).collect()
    for d, i in enumerate(ids):
        raw = np.asarray([*i, 0], "<u4").tobytes()
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == d)
        assert sum(n for _, n, _ in pieces) == len(raw) // 4 and all(zlib.crc32(raw[4 * a : 4 * (a + n)]) == c for a, n, c in pieces)
    lengths = Counter(map(len, ids))
    got = {r[0]: r[1] for r in histogram.length_histogram(df).collect()}
    assert got == lengths


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, pieces_per_shard=5).collect()
    enc = encoding.encoder(encoding.default_tokenizer())
    total = 0
    for d, t, _ in TEXTS[:10]:
        raw = enc.ids([t or ""])[0] + bytes(4)
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(raw) // 4
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + r["length"])])
            at += r["length"]
            assert r["length"] == 2048 or r["piece"] == 0
        total += at
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit(rule):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 81, 500)
    where, _ = packing.best_fit(n, (100, 4, 7000), rule=rule)
    for s in np.unique(where):
        own = n[where == s]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 7000
    where, _ = packing.best_fit(n, (100, 100, 10_000), rule=rule)
    assert len(np.unique(where)) <= 1.05 * n.sum() / 100 + 1


def test_best_fit_refuses():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([11]), (10, 5, 1000))


def test_warc(spark):
    long = "é" * 50_000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a\r\nX: y", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", long), (7, "v", "x" * 70_000), (7, "v", "x" * 70_000), (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    want = Counter()
    for p, _, h in rows:
        raw, b = (h or "").encode(), best[h or ""]
        first = b == -1 or p == b
        want[(p, len(raw), warc.payload_digest(raw), "response" if first else "revisit", None if first else b, True)] += 1
    assert Counter(map(tuple, warc.round_trip(df).collect())) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_segments():
    assert warc.assemble([(2, 5, b"de"), (1, None, b"abc")]) == b"abcde"
    assert warc.assemble([(1, None, b"abc"), (3, 5, b"de")]) is None  # one is missing
    assert warc.assemble([(1, None, b"abc"), (2, 6, b"de")]) is None  # another length was stated
    assert warc.dechunked(warc.chunked("naïve é".encode() * 9, 4)) == "naïve é".encode() * 9
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


def test_forward_is_exact():
    rng = np.random.default_rng(4)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    c = hmm.Chain(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))))
    docs = [rng.integers(0, 5, n) for n in (4, 1, 6)]
    for d, got in zip(docs, c.log10(*hmm.flat(docs))):
        p = 0.0
        for path in np.ndindex(*[3] * len(d)):
            q = c.start[path[0]] * c.emit[path[0], d[0]]
            for t in range(1, len(d)):
                q *= c.move[path[t - 1], path[t]] * c.emit[path[t], d[t]]
            p += q
        assert got == pytest.approx(log10(p))
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    c.expect(*hmm.flat(docs), start, move, emit)
    assert start.sum() == pytest.approx(3) and move.sum() == pytest.approx(8) and emit.sum() == pytest.approx(11)


def test_hmm(spark, docs, empty, monkeypatch):
    for known in (hmm.KNOWN, 3):  # with a tail of words that are joined
        monkeypatch.setattr(hmm, "KNOWN", known)
        monkeypatch.setattr(hmm, "EMITTED", min(known, 10))
        got = hmm.score_documents(docs).collect()
        train, c = [], Counter()
        for d, t, _ in TEXTS:
            if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
                train.append(d)
                c.update([*words(t or ""), None])
        n, v = sum(c.values()), len(c)
        want = Counter()
        for d, t, _ in TEXTS:
            ts = [*words(t or ""), None]
            want[(d, len(ts), sum(c[x] > 0 for x in ts), n, round(sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts), 6))] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 for r in got)
    m = hmm.train(docs, rounds=3)
    assert m.history == sorted(m.history)
    assert hmm.score_documents(empty).count() == 0


def one_word_edit(a, b):
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(a[head:][::-1], b[head:][::-1])) if x != y), min(len(a), len(b)) - head)
    return max(len(a), len(b)) - head - tail <= 1


@pytest.mark.parametrize("least", [5, 2])
def test_lines(spark, empty, least):
    long = [f"w{i}" for i in range(3000)]
    texts = [*TEXTS, (20, " ".join(long), "a"), (21, " ".join(long[:1500] + long[1501:]), "a"), (22, " ".join(["x", *long]), "b"), (23, " ".join(["x", "y", *long]), "b")]
    texts += [(None, "found once\nshared line with five words", "a"), (None, "found once too\nown line", "b"), (5, "b c d\na b", "a"), (5, "z\nlast of all words here", "b")]
    docs = spark.createDataFrame([(*t, "clash", 1, "clash", 2) for t in texts], SCHEMA)
    rows = row_keys(docs.select("doc_id", "text")).orderBy("_key").collect()
    keys = [(r["doc_id"] is None, r["doc_id"] or 0) for r in rows]
    assert keys == sorted(keys) and len({r["_key"] for r in rows}) == len(texts)
    seen, want = [], Counter()
    alike = lambda a, b: a == b or min(len(a), len(b)) >= least and one_word_edit(a, b)
    for r in rows:
        gone = []
        for i, line in enumerate((r["text"] or "").split("\n")):
            w = tuple(words(line))
            if w and any(alike(w, v) for v in seen):
                gone.append(i)
            seen += [w] if w else []
        want[(r["doc_id"], (r["text"] or "").count("\n") + 1, len(gone), tuple(gone))] += 1
    got = Counter((r[0], r[1], r[2], tuple(r[3])) for r in linedup.line_dedup(docs, min_words=least).collect())
    assert got == want and sum(r[2] for r in want) > 3
    if least == 5:
        assert linedup.line_dedup(empty).count() == 0
        cut = linedup.without_lines(docs).filter("doc_id = 10").collect()
        assert all(r["text"] == "\n" and r["key"] == "clash" for r in cut) and len(cut) == 2
    with pytest.raises(ValueError):
        linedup.line_dedup(docs, min_words=1)


def test_mix(spark, docs, empty):
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, t, s in TEXTS:
        size[s] += len(words(t or ""))
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    first = Counter(map(tuple, got))
    assert first == Counter(map(tuple, mixing.mix(docs).collect()))
    assert sum({r["source_size"]: 0 for r in got} | {1: 0}) > 0 and mixing.mix(empty).count() == 0
    s = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 500)], "source string, source_size long")
    t = {r[0]: r[2] for r in mixing.targets(s).collect()}
    want, free, left = {}, {"a": (5, 100), "b": (2, 1000), "c": (1, 500), None: (5, 10)}, 1.5 * 1610
    while True:  # share by weight, cap, share the rest again
        w = sum(x for x, _ in free.values())
        over = [k for k, (x, n) in free.items() if left * x / w > 2 * n]
        if not over:
            want |= {k: left * x / w for k, (x, _) in free.items()}
            break
        for k in over:
            want[k] = 2.0 * free[k][1]
        left -= sum(want[k] for k in over)
        free = {k: v for k, v in free.items() if k not in over}
    assert t == pytest.approx(want)


def test_mix_comes_near(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 90).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 90 for r in got) and len(got) == 2


def test_mix_draws_rows_without_ids(spark):
    """Half of a source is due in the fractional part: of rows without an id, and of rows that share one, about half come in, whatever the seed."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"), F.format_string("word a%d", "id").alias("text"), F.lit("a").alias("source"))
    for seed in ("mix-1:", "x", "y", "z"):
        got = mixing.mix(df, share=0.5, seed=seed, weight=F.lit(1.0)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("taken")).collect()
        assert all(0.43 < r["taken"] / r["n"] < 0.57 for r in got if r["doc_id"] in (None, 7)) and abs(sum(r["taken"] for r in got) - 1500) <= 1


def test_mix_weights(spark):
    """Against brute force: the same keys, sorted, prefix sums to the target; heavy rows come in more often."""
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 3 == 0], 0.2 + i % 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = {r["doc_id"]: r for r in mixing.mix(df, share=0.7, weight=F.col("q")).collect()}
    u = {r[0]: r[1] for r in df.select("doc_id", mixing.uniform(F.col("doc_id"), "mix-1:")).collect()}
    for source in "ab":
        mine = sorted((r for r in rows if r[2] == source), key=lambda r: -np.log(u[r[0]]) / r[3])
        n = sum(1 + r[0] % 5 for r in mine)
        target, done = got[mine[0][0]]["target"], 0
        epochs = int(target // n)
        for r in mine:
            size = 1 + r[0] % 5
            assert got[r[0]]["copies"] == epochs + (done + size / 2 <= target - epochs * n and target > epochs * n)
            done += size
    taken = Counter()
    for r in rows:
        taken[r[3]] += got[r[0]]["copies"]
    assert taken[3.2] > taken[0.2]


def test_histogram(docs, empty):
    enc = encoding.encoder(encoding.default_tokenizer())
    n = [len(x) // 4 for x in enc.ids([t or "" for _, t, _ in TEXTS])]
    table = histogram.context_table(histogram.length_histogram(docs)).cache()
    for r in table.collect():
        c = r["length"]
        assert r["n_docs"] == n.count(c) and r["tokens_truncated"] == sum(min(x, c) for x in n) and r["docs_over"] == sum(x > c for x in n) and r["tokens_over"] == sum(x for x in n if x > c)
    got = {r[0]: r[1] for r in histogram.at_limits(table, [0, 1, 7, 10**6]).collect()}
    assert got == {c: sum(min(x, c) for x in n) for c in (0, 1, 7, 10**6)}
    assert histogram.quantile(table, 0.5).first()[0] == sorted(n)[-(-len(n) // 2) - 1]
    assert histogram.context_table(histogram.length_histogram(empty)).count() == 0


def test_cotraining(spark, empty):
    path = Path("/root/testdata/sf0.1")
    if path.exists():
        d, lab = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
        some = lab.filter("doc_id % 2 = 0")
        out = cotrain.classify(d, some).join(lab.filter("doc_id % 2 = 1"), "doc_id").select("quality", "kept").collect()  # held out
        assert np.mean([(r["quality"] == 1) == r["kept"] for r in out]) > 0.99
        assert all(r["kept"] for r in out if r["quality"] == 1)
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, None, None, "k", 7), (None, "x", "a", "k", 7), (2, "", "b", "k", 7), (2, "", "b", "k", 7), (3, long, "b", "k", 7)], "doc_id long, text string, source string, keep string, quality int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r["score"] for r in cotrain.classify(docs, none).collect()] == [1.0] * 5
    assert cotrain.classify(empty, none).count() == 0


def _taught(spark, n: int, labelled: int, words_of, source_of):
    """Documents whose words and source both tell their quality, which the first `labelled` rows have labels of."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        bad = bool(rng.random() < 0.4)
        rows.append((i, " ".join(rng.choice(words_of(bad, i), 30)), "en", source_of(bad, i), 200))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(i, int(r[3][0] == "g")) for i, r in enumerate(rows[:labelled])], "doc_id long, quality int")
    return rows, docs, labels


def test_content_teaches_metadata(spark):
    """Labels name a few sources only; pseudo-labels of the content view teach the other view the rest, summed over all partitions."""
    rows, docs, labels = _taught(
        spark, 3000, 800, lambda bad, i: ["zorkle", "blatum", "vexorn", "quobit"] if bad else ["rivers", "stones", "letter", "musics"], lambda bad, i: ("b" if bad else "g") + str(i % 4 if i >= 800 else i % 2)
    )
    alone, taught = cotrain.fit(docs, labels, rounds=0), cotrain.fit(docs, labels)
    layout = np.stack([cotrain.text_features("rivers stones letter musics " * 7)[cotrain.LAYOUT_AT]] * 2)
    x = cotrain.meta_features(["en"] * 2, ["b3", "g3"], [200, 200], layout)
    before, after = alone.views[1].probability(x), taught.views[1].probability(x)
    assert after[0] < before[0] and after[0] < 0.2 < 0.8 < after[1]
    assert all(n > 0 for n in taught.taught[0]) and alone.taught == []
    out = cotrain.classify(docs, labels).collect()
    assert all(r["kept"] == (rows[r["doc_id"]][3][0] == "g") for r in out)


def test_metadata_teaches_content(spark):
    """Labels name a few words only; pseudo-labels of the metadata view teach the content view words that no label knows."""
    new = (["grumfo", "hastil", "jovren", "klimpt"], ["garden", "winter", "yellow", "candle"])
    old = (["zorkle", "blatum", "vexorn", "quobit"], ["rivers", "stones", "letter", "musics"])
    rows, docs, labels = _taught(spark, 3000, 800, lambda bad, i: (new if i >= 800 else old)[not bad], lambda bad, i: ("b" if bad else "g") + str(i % 2))
    alone, taught = cotrain.fit(docs, labels, rounds=0), cotrain.fit(docs, labels)
    x = np.stack([cotrain.text_features(" ".join(w * 7)) for w in new])[:, cotrain.CONTENT_AT]
    before, after = alone.views[0].probability(x), taught.views[0].probability(x)
    assert after[1] - after[0] > before[1] - before[0] and after[0] < 0.5 < after[1]
    assert taught.taught[0][0] > 1000


def test_a_view_that_tells_nothing_teaches_nothing(spark):
    rows, docs, labels = _taught(spark, 1000, 120, lambda bad, i: ["zorkle", "blatum", "vexorn", "quobit"] if bad else ["rivers", "stones", "letter", "musics"], lambda bad, i: "b" if bad else "g")
    blind = docs.withColumn("source", F.lit("one"))
    assert all(content == 0 and meta > 0 for content, meta in cotrain.fit(blind, labels).taught)


def test_views_exchange_on_the_tables(spark):
    path = Path("/root/testdata/sf0.1")
    if not path.exists():
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    assert all(n > 1000 for pair in cotrain.fit(docs, labels).taught for n in pair)


def test_pipeline(spark):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    sizes = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.toArrow())
            sizes.append(docs.count())
            rows = [(r["doc_id"], r["text"], 0) for r in docs.collect()]
            if k == 1:
                assert len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows}) == len(rows)
            if k == 2:
                assert all(label == d for d, (_, label) in brute_near(rows).items())
        else:
            assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert sizes[0] > sizes[1] > sizes[2]


def test_pipeline_odd_rows(spark, tmp_path):
    """Null and repeated ids, extra columns: each row on its own, run() against brute force."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    text = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(40))
    own, loose = [text() for _ in range(8)], [text() for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(own)] + [(None, t) for t in loose] + [(None, loose[0]), (None, loose[0]), (None, own[0])]
    rows += [(None, loose[1] + " more"), (None, own[1] + " more"), (None, None), (None, " "), (2, own[2]), (3, text()), (3, own[7] + " more")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _part string, key int"
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or ""), "x", 1) for d, t in rows], schema)
    ids = lambda df: sorted((-1 if r[0] is None else r[0], r[1] or "") for r in df.select("doc_id", "text").collect())
    keyed = sorted(((r["_key"], -1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in row_keys(docs).collect()))
    assert len({k for k, _, _ in keyed}) == len(rows)
    # exact: of equal texts the longest original, then the first row stays
    groups = {}
    for k, d, t in keyed:
        groups.setdefault("".join(t.split()), []).append((-len(t), k, d, t))
    want = sorted((d, t) for _, _, d, t in map(min, groups.values()))
    got = spark.createDataFrame(corpus_pipeline.exact(spark, docs, "").toArrow())
    assert got.columns == docs.columns and ids(got) == want and len(want) == 17
    # near: the first row of each group stays
    keyed = [(r["_key"], -1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in row_keys(got).collect()]
    label = brute_near([(k, t, 0) for k, _, t in keyed])
    want = sorted((d, t or "") for k, d, t in keyed if label[k][1] == k)
    got = spark.createDataFrame(corpus_pipeline.near(spark, got, "").toArrow())
    assert got.columns == docs.columns and ids(got) == want and len(want) == 14
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    mixed = corpus_pipeline.mixture(spark, got, f"{tmp_path}/none")
    assert mixed.columns == docs.columns
    copies = Counter(ids(mixed))
    assert set(copies.values()) <= {1, 2} and set(copies) == set(want) and sum(n for (_, t), n in copies.items() if t.strip()) in (19, 20)
    assert ids(corpus_pipeline.quality(spark, docs, f"{tmp_path}/none")) == ids(docs)
    docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/none").collect()
    assert Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in out) == Counter(d for (d, _), n in copies.items() for _ in range(n))
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_pipeline_rejects(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    text = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(40))
    loose = [text() for _ in range(4)]
    rows = [(100 + i, "!!! $$ 1 2 3" if i % 2 else text()) for i in range(80)] + [(None, t) for t in loose] + [(None, "!!! $$ 1 2 3")]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(100 + i, 1 - i % 2) for i in range(80)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert (None, "!!! $$ 1 2 3") not in left and {(None, t) for t in loose} <= left
