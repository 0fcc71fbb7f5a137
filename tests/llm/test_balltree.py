"""Hard negatives against brute force; what the bounds prune."""

import numpy as np
import pytest

from veristrata.llm import balltree

TOP = 2**63 - 1


def brute(rows, positives=5, negatives=10, window=(30, 90)):
    """rows (key, id, label, vector of ints, asks), keys in rank order -> the operator's rows."""
    dot = lambda a, b: max(-TOP - 1, min(TOP, sum(x * y for x, y in zip(a, b))))
    out = []
    for key, i, label, vec, asks in rows:
        if not asks:
            continue
        rest = sorted((-dot(vec, v), k, j, own == label) for k, j, own, v, _ in rows if k != key and len(v) == len(vec))
        for p, _, j, _ in [r for r in rest if r[3]][:positives]:
            hits = [r for r in rest if not r[3] and window[0] * -p <= 100 * -r[0] <= window[1] * -p][:negatives]
            out += [(i, j, n, r[2], -p, -r[0]) for n, r in enumerate(hits, 1)]
    return sorted(out, key=str)


def made(n, d, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((6, d))
    label = rng.integers(0, 6, n)
    label[: n // 3] = 0  # a hot label
    x = 0.6 * centers[0] + 0.5 * centers[label] + spread * rng.standard_normal((n, d))
    return label.tolist(), x.tolist()


def prepared(rows):
    """What embeddings_negatives() makes of (vec_id, label, embedding), ordered as keys are: by id, null last."""
    good = [r for r in rows if r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[2])]
    out = []
    for i, label, v in sorted(good, key=lambda r: (r[0] is None, r[0] or 0)):
        own = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        out.append((len(out), i, own, [max(-TOP - 1, min(TOP, int(np.floor(256 * x)))) for x in v], i is not None and i % 100 == 0))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_negatives(spark, monkeypatch, small):
    """All rows against brute force: hot labels, ties, copies, unusable rows, other lengths, extra columns; with tiles of a few rows and several blocks."""
    if small:
        monkeypatch.setattr(balltree, "BLOCK", 40)
    label, x = made(700, 8, 3)
    rows = [(i * 25, c, v) for i, (c, v) in enumerate(zip(label, x))]
    rows += [(20_000 + i * 50, i % 3, x[5]) for i in range(40)]  # copies of one vector under several labels
    rows += [(30_000, 1, None), (30_100, None, x[0]), (30_200, 1, [float("nan")] * 8), (30_300, 1, [None] * 8), (30_400, 1, [float("inf")] + [0.0] * 7), (None, 2, x[7]), (None, 0, x[8])]
    rows += [(40_000 + 10 * i, i % 2, [1.0, i / 8]) for i in range(30)] + [(50_000, 1, []), (50_001, 1, []), (50_002, 2, [])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, embedding array<double>, key string, rank int")
    got = balltree.embeddings_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(prepared(rows))
    assert balltree.embeddings_negatives(df.limit(0)).count() == 0
    assert balltree.embeddings_negatives(df.filter("vec_id = 25")).count() == 0


def test_repeats(spark):
    """Rows that repeat an id are rows of their own; huge components don't overflow."""
    label, x = made(120, 4, 5)
    rows = [(i // 2 * 50, c, v) for i, (c, v) in enumerate(zip(label, x))] + [(9_000, 0, [1e300, 1.0, 0.0, 0.0]), (9_100, 0, [3e15, 2e15, 1.0, -7e14]), (9_101, 1, [2e15, 1e15, 5.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = balltree.embeddings_negatives(df).collect()
    want = brute(prepared(rows))
    ids = lambda t: sorted((r[0], r[2], r[4], r[5]) for r in t)  # noqa: E731  rows alike in id stand in the order of their content
    assert len(got) == len(want) and ids(got) == ids(want)


def _search(rows, k, same, low, high, seed=1):
    key, label, vec = np.arange(len(rows[0])), np.array(rows[0], np.int64), np.floor(256 * np.array(rows[1])).astype(np.int64)
    a = np.arange(0, len(key), 40)
    s = balltree.Search(vec[a], key[a], label[a], np.repeat(np.arange(len(a)), len(low)), np.tile(low, len(a)), np.tile(high, len(a)), k, same)
    order = np.lexsort((-(vec.astype(float) ** 2).sum(axis=1), label))  # as hard_negatives() sorts
    for tile in np.array_split(order, 5):
        tile = tile[balltree.grow(vec[tile].astype(float))]
        s.visit(vec[tile], key[tile], label[tile])
    return s, key, label, vec, a


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("d", [1, 2, 16])
def test_search(same, d):
    """Windows of both kinds, ties at the k-th place, rows all alike; a node at the k-th score isn't pruned."""
    for rows in (made(900, d, 7), ([0, 1] * 300, [[1.0] * d] * 600)):
        low, high = np.array([-(2**63), 20_000 // d]), np.array([2**63 - 1, 70_000])
        s, key, label, vec, a = _search(rows, 6, same, low, high)
        for q in range(len(s.owner)):
            own = a[s.owner[q]]
            score = vec @ vec[own]
            ok = ((label == label[own]) == same) & (key != own) & (score >= s.low[q]) & (score <= s.high[q])
            best = sorted((-int(score[i]), int(i)) for i in np.flatnonzero(ok))[:6]
            assert [(-int(x), int(r)) for x, r in zip(s.score[q], s.row[q]) if r != balltree._NONE] == best


def test_pruning():
    """Clustered rows: far fewer rows are compared than there are, for positives and within a narrow window."""
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((40, 16))
    label = rng.integers(0, 40, 8000)
    x = centers[label] + 0.05 * rng.standard_normal((8000, 16))
    for same, low, high in ((True, [-(2**63)], [2**63 - 1]), (False, [600_000], [650_000])):
        s, *_ = _search((label, x), 5, same, np.array(low), np.array(high))
        assert s.compared < 0.2 * len(s.key) * 8000


def test_share(spark):
    values = [0, 1, 9, 10, 11, 99, 100, 101, -1, -10, -99, 2**63 - 1, -(2**63), 12345678901234567]
    df = spark.createDataFrame([(v,) for v in values], "p long")
    got = df.select(balltree._share("p", 30, True).alias("a"), balltree._share("p", 90, False).alias("b")).collect()
    assert [tuple(r) for r in got] == [(-(-30 * v // 100), 90 * v // 100) for v in values]
