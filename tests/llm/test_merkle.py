"""The manifest against a tree built whole, with groups of more than one block."""

import hashlib
import zlib

import pytest

from veristrata.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def above(nodes):
    return [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(above(levels[-1]))
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        lo = at - at % 3
        out.append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 3])))
        at //= 3
    return out


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> the manifest's rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, H(*map(field, r))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
        trees[s] = tree([h for _, h in by[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (r, leaf) in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = H(*map(field, (*r[:4], text)))
            for a, b in steps:
                h = H(a, h, b)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], H(*[x + y for x, y in steps]), h, h == top[-1][0]))
    return out


@pytest.mark.parametrize("n", [*range(0, 30), 80, 81, 82, 242, 243, 244, 500, 729, 730, 1000])
def test_traverse(n):
    """Every path of a block, also of one that is cut short, equals that of the whole tree; no more than two subtrees a height are held."""
    leaves = [H(str(i)) for i in range(n)]
    levels = merkle.LEVELS if n > 700 else merkle.depth(n)
    own = tree(leaves) if n else [[]]
    while len(own) <= levels:
        own.append(above(own[-1]))
    assert list(merkle.traverse(leaves, levels)) == [path(own[: levels + 1], i) for i in range(n)]


def test_held(monkeypatch):
    """The nodes that a traversal holds don't grow with the block."""
    made, most = [], 0
    real = merkle.Subtree
    monkeypatch.setattr(merkle, "Subtree", lambda *a: made.append(s := real(*a)) or s)
    leaves = [H(str(i)) for i in range(729)]
    for _ in merkle.traverse(leaves, 6):
        most = max(most, sum(sum(map(len, s.nodes)) + sum(map(len, s.open)) for s in made[-6:]))
    assert most <= 6 * (9 + 3) + 6 * 2 * 3


ROWS = [(1, "b", "en", 3, "a\nb"), (2, "b", "en", None, None), (None, "b", None, 0, ""), (None, "b", None, 0, "x\ny"), (3, None, "de", 9, "é" * 50_000 + "\n"), (3, None, "de", 9, "é\n"), (3, None, "de", 9, "é\n"), (4, "é", "", -1, "\n\n"), (5, "", "", 1, "alone")]


@pytest.mark.parametrize("more", [0, 2300])
def test_manifest(spark, more):
    """Nulls, repeated rows, one-row sources, a source of several blocks; with many sources the upper tree has several blocks, too."""
    rows = ROWS + [(10 + i, f"s{i % 31:02}" if not more else ("hot" if i % 3 else "cold"), "en", i, f"line {i}\nnext") for i in range(more or 200)]
    if not more:
        rows += [(1000 + i, "hot", "en", i, f"l {i}\n") for i in range(120)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos long")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(map(tuple, merkle.document_manifest(df, merkle.LEVELS if more else 2).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert got == want and {r[6] for r in got} == {True, False}
    assert all(r[6] for r in got if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2)


def test_small(spark):
    df = spark.createDataFrame([ROWS[0]], "doc_id long, source string, lang string, n_chars long, text string")
    assert [tuple(r) for r in merkle.document_manifest(df).collect()] == brute([ROWS[0]])
    assert merkle.document_manifest(df.limit(0)).count() == 0
