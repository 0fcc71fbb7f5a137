"""Quality classifier by co-training: a text view and a metadata view teach each other.

Each view is a logistic regression, one on the content (its words and word pairs, hashed, and how
varied they are), one on the page's metadata (language, source, length, and facts of its layout:
lines, bytes by kind, marks). No feature is in both. In each round both label all documents without
a label, and what one is confident about becomes training data of the other. In every round each
view is calibrated (Platt) on the labelled rows, each of them by a fit that left its fold out: a
view is confident by its calibrated probability, so one that tells nothing stays near the labels'
mean and teaches nothing at any number of labels, and by rank: it teaches about the surer half of
either label. In the end the labelled rows weigh the two calibrated views; that combination scores
all documents.

Labelled rows are a bounded sample (LABELLED, drawn by a hash of the id over the whole table)
and stay on the driver. Pseudo-labels come from the whole corpus: its features are written
once, and each Newton step sums gradients and Hessians over them in Spark.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from copy import copy
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import stage, text_batches

#: Bound of the labelled sample.
LABELLED = 12_000
#: Rounds, and Newton steps over the corpus in each.
ROUNDS, STEPS = 3, 2
#: The most that a step moves the logit of a labelled row.
FARTHEST = 3.0
#: A view teaches what it gives at least this calibrated probability, for either label, and what is
#: further from the other label than this share of the labelled rows of its own.
CONFIDENT, SURER_THAN = 0.98, 0.5
#: Pseudo-labels weigh this much each, all of them at most as much as this share of the labelled rows.
PSEUDO, PSEUDO_SHARE = 0.5, 0.5
#: Documents below this probability of good quality are rejected.
REJECT_BELOW = 0.35
SOURCES = 32
#: Folds of the labelled rows; with fewer rows of a label than that nothing is fitted.
FOLDS = 4
#: Hash classes of words, and of word pairs; their L2 penalty (others: 1).
CONTENT, CONTENT_PENALTY = 64, 30.0
#: Words whose classes a worker remembers at most.
REMEMBERED = 200_000
#: Words count as so many characters at most in a text's word lengths.
LONG_WORD = 20
#: L2 penalty of the calibration, which has few weights and may have few rows.
CALIBRATION_PENALTY = 0.1

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"!", b"|", b".", b",", b"?", b"#*_=~-+<>[]{}()/\\&%$@^", b":;'\"`"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 13
_SYMBOLS = frozenset(bytes([c]) for c in b"|#*_=~-+<>[]{}()/\\&%$@^!?.,:;")
#: A word that ends in a repeated symbol.
_NOISY = re.compile(rb"([#*_=~+<>/\\&%$@^|])\1(?=\s|\Z)")
SHAPE = 14 + 15
TEXT_FEATURES = SHAPE + 2 * CONTENT
#: Features of a text that are facts of the page's layout: bytes by kind, number of words, longest word, lines, repeated lines, longest line, marks.
LAYOUT_AT = np.r_[0:14, 14, 17, 21, 22, 23, 27, 28]
CONTENT_AT = np.setdiff1d(np.arange(TEXT_FEATURES), LAYOUT_AT)
META_FEATURES = 4 + 8 + SOURCES + len(LAYOUT_AT)
TEXT_PENALTY = np.r_[np.ones(SHAPE), np.full(2 * CONTENT, CONTENT_PENALTY)][CONTENT_AT]
META_PENALTY = np.ones(META_FEATURES)


class _WordClass(dict):
    def __missing__(self, word: bytes) -> int:
        c = zlib.crc32(word) % CONTENT
        if len(self) < REMEMBERED:
            self[word] = c
        return c


_class_of = _WordClass()


def text_features(text: str) -> np.ndarray:
    """Of a whole text: shares of character classes, word and line statistics, repeated words and symbol noise, hashed words and word pairs."""
    raw = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=14) / max(1, len(raw))
    ws = raw.lower().split()
    n = len(ws)
    lines = [x for x in text.split("\n") if x.strip()]
    size = np.fromiter(map(len, ws), np.int64, n) if n else np.zeros(1, np.int64)
    longest, size = size.max(), np.minimum(size, LONG_WORD)  # one key or link doesn't move the mean
    counts = Counter(ws)
    pairs = len(set(zip(ws, ws[1:]))) if n > 1 else 1
    extra = [
        np.log1p(n), size.mean(), size.std(), np.log1p(longest) / 5, len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n),
        pairs / max(1, n - 1), len(lines) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, lines), default=0)),
        (size == 1).mean() if n else 0.0, n / max(1, len(raw)) * 5,
        np.sqrt(sum(map(eq, ws, ws[1:])) / max(1, n - 1)), np.sqrt(len(_NOISY.findall(raw)) / max(1, n)), np.sqrt(sum(map(_SYMBOLS.__contains__, ws)) / max(1, n)),
    ]
    c = np.fromiter(map(_class_of.__getitem__, ws), np.int64, n)
    both = np.r_[np.bincount(c, minlength=CONTENT), np.bincount((c[:-1] * 31 + c[1:]) % CONTENT, minlength=CONTENT)]
    return np.concatenate([np.sqrt(shares), extra, np.sqrt(both / max(1, n))])


def meta_features(lang: list, source: list, n_chars: list, layout: np.ndarray) -> np.ndarray:
    """Length bands, language, hashed source and layout (columns LAYOUT_AT of text_features) of each row; null is a value of its own."""
    n = np.log1p(np.array([max(0, c or 0) for c in n_chars], float))
    out, at = np.zeros((len(n), META_FEATURES)), np.arange(len(n))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = n, n * n / 10, [c is None for c in n_chars], n < 5
    code = lambda values, size: np.array([c % size for c in map({v: zlib.crc32((v or "").encode()) for v in set(values)}.__getitem__, values)], int)
    out[at, 4 + code(lang, 8)] = 1
    out[at, 12 + code(source, SOURCES)] = 1
    out[:, 12 + SOURCES :] = layout
    return out


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Logistic:
    """Standardised logistic regression with an L2 penalty, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.w, self.penalty = np.zeros(x.shape[1] + 1), np.append(penalty, 1e-6)
        for _ in range(25):
            if self.step(*self.sums(x, y), x) < 1e-8:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the rows."""
        z = self._z(x)
        p = _sigmoid(z @ self.w)
        return z.T @ (p - y), (z * (p * (1 - p) + 1e-9)[:, None]).T @ z

    def step(self, grad: np.ndarray, hess: np.ndarray, x: np.ndarray) -> float:
        """A Newton step, shortened so that no row of x moves by more than FARTHEST: where rows are far from the border, their curvature is next to none."""
        move = np.linalg.solve(hess + np.diag(self.penalty), grad + self.penalty * self.w)
        move = move * min(1.0, FARTHEST / max(1e-9, float(np.abs(self._z(x) @ move).max())))
        self.w = self.w - move
        return float(np.abs(move).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._z(x) @ self.w

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


class CoTrained:
    """Two views, their calibration and their combination; taught: for each round the rows taught to (content, metadata)."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.constant = float(y.mean()) if len(y) else 1.0
        self.views, self.taught = None, []
        self.fold = np.arange(len(y)) % FOLDS  # the sample comes in an order that doesn't depend on labels
        if min((y == c).sum() for c in (0, 1)) >= FOLDS:
            self.own, self.y, self.pseudo = (text, meta), y.astype(float), [None, None]
            self.views = [Logistic(x, self.y, p) for x, p in zip(self.own, (TEXT_PENALTY, META_PENALTY))]
            self.left_out = self._left_out()

    def learn(self, views: list[Logistic], pseudo: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Take on the views of a round, and what pseudo-labels add near them: gradient and Hessian at weights."""
        self.views, self.pseudo = views, pseudo
        self.left_out = self._left_out()

    def _left_out(self) -> list[np.ndarray]:
        """Each view's logits of the labelled rows, each row by a fit without its fold; pseudo-labels enter by their quadratic form."""
        out = []
        for view, x, pseudo in zip(self.views, self.own, self.pseudo):
            z = np.zeros(len(self.y))
            for f in range(FOLDS):
                v, rest = copy(view), self.fold != f
                for _ in range(25):
                    g, h = v.sums(x[rest], self.y[rest])
                    if pseudo is not None:
                        g, h = g + pseudo[0] + pseudo[1] @ (v.w - pseudo[2]), h + pseudo[1]
                    if v.step(g, h, x) < 1e-4:
                        break
                z[~rest] = v.logit(x[~rest])
            out.append(z)
        return out

    def platt_scaled(self) -> list[Logistic]:
        """Each view's calibration by what it says of rows it didn't learn from."""
        return [Logistic(z[:, None], self.y, np.full(1, CALIBRATION_PENALTY)) for z in self.left_out]

    def sure(self) -> list[tuple[float, float]]:
        """For each view the logits from which on it is sure of good, and down from which of bad; infinite where it never is."""
        out, odds = [], np.log(CONFIDENT / (1 - CONFIDENT))
        for c, z in zip(self.platt_scaled(), self.left_out):
            slope = c.w[0] / c.scale[0]
            start = c.w[1] - slope * c.mean[0]  # calibrated logit = slope * logit + start
            if slope <= 0:
                out.append((np.inf, -np.inf))
                continue
            good, bad = np.quantile(z[self.y == 1], SURER_THAN), np.quantile(z[self.y == 0], 1 - SURER_THAN)
            out.append((max(good, (odds - start) / slope), min(bad, (-odds - start) / slope)))
        return out

    def calibrate(self) -> CoTrained:
        self.platt = self.platt_scaled()
        self.joint = Logistic(self._calibrated(self.left_out), self.y, np.full(2, CALIBRATION_PENALTY))
        del self.own, self.y, self.fold, self.pseudo, self.left_out
        return self

    def _calibrated(self, logits: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([p.logit(z[:, None]) for p, z in zip(self.platt, logits)])

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text, metadata and combined probabilities of good quality."""
        if self.views is None:
            one = np.full(len(text), self.constant)
            return one, one, one
        logits = self._calibrated([v.logit(x) for v, x in zip(self.views, (text, meta))])
        single = _sigmoid(logits)
        return single[:, 0], single[:, 1], self.joint.probability(logits)


def teach(views: list[Logistic], sure: list[tuple[float, float]], xs: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view the rows that the other view is sure of, unless this one is as sure of the opposite, and their labels."""
    logits = [v.logit(x) for v, x in zip(views, xs)]
    out = []
    for k in (0, 1):
        other, mine = (logits[1 - k], sure[1 - k]), (logits[k], sure[k])
        good, bad = (other[0] >= other[1][0]) & (mine[0] > mine[1][1]), (other[0] <= other[1][1]) & (mine[0] < mine[1][0])
        at = np.flatnonzero(good | bad)
        out.append((at, good[at].astype(float)))
    return out


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features of both views from columns text (features), lang, source, n_chars."""
    column = lambda c: part.column(part.schema.get_field_index(c))
    text = np.asarray(column("text").flatten(), dtype=float).reshape(part.num_rows, TEXT_FEATURES)
    return text[:, CONTENT_AT], meta_features(*(column(c).to_pylist() for c in ("lang", "source", "n_chars")), text[:, LAYOUT_AT])


FEATURES = "doc_id long, text array<float>, lang string, source string, n_chars long"


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """What both views see of every row of docs, written once."""

    def run(batches):
        for part, texts in text_batches(batches, "text"):
            made = np.stack([text_features(t) for t in texts]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(range(0, made.size + 1, TEXT_FEATURES), pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, *part.columns[2:]], part.schema.names)

    return stage(_own(docs, text_col, id_col).mapInArrow(run, FEATURES), "features")


def _own(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, text, lang, source, n_chars; metadata columns that docs lacks are null."""
    has = set(docs.columns)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        *((F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))),
    )


def _pseudo(pool: DataFrame, model: CoTrained, current: list[Logistic]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each view: how many rows of pool the other one (as of model) teaches it, their gradient and Hessian at current."""
    shared = pool.sparkSession.sparkContext.broadcast((model.views, model.sure(), current))
    upper = [np.triu_indices(len(v.w)) for v in current]

    def run(batches):
        views, sure, current = shared.value
        total = [np.zeros(1 + len(v.w) + len(u[0])) for v, u in zip(current, upper)]  # count, gradient, half of the Hessian
        for part in batches:
            x = _views(part)
            for k, (at, label) in enumerate(teach(views, sure, x)):
                if len(at):
                    g, h = current[k].sums(x[k][at], label)
                    total[k] += np.concatenate([[len(at)], g, h[upper[k]]])
        flat = np.concatenate(total)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], ["at", "value"])

    sums = pool.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(sum(1 + len(v.w) + len(u[0]) for v, u in zip(current, upper)))
    flat[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    out, start = [], 0
    for v, u in zip(current, upper):
        n = len(v.w)
        h = np.zeros((n, n))
        h[u] = flat[start + 1 + n : start + 1 + n + len(u[0])]
        out.append((int(flat[start]), flat[start + 1 : start + 1 + n], h + np.triu(h, 1).T))
        start += 1 + n + len(u[0])
    return out


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", labelled: int = LABELLED, rounds: int = ROUNDS, made: DataFrame | None = None) -> CoTrained:
    """Fit on at most `labelled` rows of labels (doc_id, quality) and on all other documents (made: their features(), if they are there).

    Null labels and labels without a document don't count. Of several labels of a document the lowest does.
    """
    made = features(docs, text_col, id_col) if made is None else made
    clean = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = made.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    taken = stage(clean.join(known, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(17), F.col("doc_id")), "doc_id").limit(labelled), "labelled")
    # at most `labelled` ids: a proven bound
    t = made.join(F.broadcast(taken), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64(F.lit(5), F.col("doc_id")), "doc_id").toArrow()
    x = [_views(b) for b in t.to_batches() if b.num_rows]
    text, meta = (np.concatenate([p[k] for p in x]) if x else np.zeros((0, n)) for k, n in enumerate((len(CONTENT_AT), META_FEATURES)))
    model = CoTrained(text, meta, (t.column("quality").to_numpy() > 0).astype(int))
    if model.views is None:
        return model
    pool = made.join(F.broadcast(taken.select("doc_id")), "doc_id", "left_anti")
    for _ in range(rounds):
        current, at = list(map(copy, model.views)), [None, None]
        for _ in range(STEPS):
            sums = _pseudo(pool, model, current)
            for k, (n, grad, hess) in enumerate(sums):
                g, h = current[k].sums(model.own[k], model.y)
                weight = min(PSEUDO, PSEUDO_SHARE * len(model.y) / n) if n else 0.0
                at[k] = weight * grad, weight * hess, current[k].w
                current[k].step(g + weight * grad, h + weight * hess, model.own[k])
        model.learn(current, at)
        model.taught.append(tuple(n for n, _, _ in sums))
    return model.calibrate()


def score(docs: DataFrame, model: CoTrained, text_col: str = "text", id_col: str = "doc_id", reject_below: float = REJECT_BELOW) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept of every row of docs.

    Null text is scored as the empty text, null metadata as a value of its own; a null doc_id
    and repeated rows are scored like any other; other columns of docs don't matter. Without
    labels of both kinds every document gets the labels' mean (1.0 without labels). An empty
    table gives an empty result.
    """
    return score_features(features(docs, text_col, id_col), model, reject_below)


def score_features(made: DataFrame, model: CoTrained, reject_below: float = REJECT_BELOW) -> DataFrame:
    shared = made.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in batches:
            a, b, c = shared.value.score(*_views(part))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= reject_below)], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return made.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """fit() and score() with the features of docs made once."""
    made = features(docs, text_col, id_col)
    return score_features(made, fit(docs, labels, text_col, id_col, made=made, **options))
