"""Hidden Markov language model: Baum-Welch over all training documents, exact likelihood by forward recursion.

Latent states emit symbols: the most frequent words one each (at most EMITTED), all other
words through one of BUCKETS classes by their last two bytes, and the end of a text. Within a
class a word's probability comes from its training count, smoothed, with mass for unseen
words, which all count as one: the model is a distribution over texts in these words.

The words are counted over all training documents. Those above a count that at most KNOWN
words reach are broadcast (a fixed bound); counts of the rest stay distributed and
are joined by word. Texts are split into words and encoded as symbols once; that table is
written, and every later pass reads it alone. Each Baum-Welch round goes over all training
documents: partitions add their expected counts, which Spark sums by symbol, and the driver
gets one row per symbol.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import slices, stage, text_batches, words

STATES, ROUNDS = 4, 3
#: Words that have a symbol, and words whose counts are broadcast, at most.
EMITTED, KNOWN = 1 << 15, 1 << 18
BUCKETS = 256
#: Symbols of a lane at least, where there are enough; steps between two scalings.
LANE, SCALED = 2048, 4
#: Pseudo-counts that a state's emissions get, spread like the words of the whole corpus.
PRIOR = 50.0


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all symbols, number of symbols of each document) of documents given one by one."""
    return np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(d) for d in docs], np.int64)


class Lanes:
    """Documents laid one after another on lanes, so that a step moves many documents at once.

    x (steps, lanes) holds symbols; lanes come in falling length, on[t] of them reach step t.
    first and last are the flat places in x of each document's first and last symbol.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        longest, total = int(lengths.max()), int(lengths.sum())
        n = min(len(lengths), max(1, -(-total // max(longest, LANE))))
        order = np.argsort(-lengths, kind="stable")
        open_lanes, lane, at = [(0, i) for i in range(n)], np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for d in order:  # each to the shortest lane
            used, i = open_lanes[0]
            lane[d], at[d] = i, used
            heapq.heapreplace(open_lanes, (used + int(lengths[d]), i))
        filled = np.bincount(lane, weights=lengths, minlength=n).astype(np.int64)
        place = np.empty(n, np.int64)
        place[np.argsort(-filled, kind="stable")] = np.arange(n)
        filled = np.sort(filled)[::-1]
        self.first = at * n + place[lane]
        self.last = self.first + (lengths - 1) * n
        self.on = np.searchsorted(-filled, -np.arange(int(filled[0])), side="left")
        self.x = np.zeros((int(filled[0]), n), np.int64)
        inner = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.cells = np.repeat(self.first, lengths) + inner * n  # of each symbol in turn
        self.x.ravel()[self.cells] = symbols

    def by_step(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, lanes, offsets): cells order[offsets[t]:offsets[t + 1]] lie in step t."""
        order = np.argsort(cells, kind="stable")
        step, lane = np.divmod(cells[order], self.x.shape[1])
        return order, lane, np.searchsorted(step, np.arange(len(self.x) + 1))


def _parts(symbols: np.ndarray, lengths: np.ndarray, most: int = 1 << 19):
    """(documents from, to, their symbols, their lengths), about `most` symbols at a time."""
    ends = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        begin = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + most, side="right")))
        yield a, b, symbols[begin : int(ends[b - 1])], lengths[a:b]
        a = b


class Chain:
    """Start, transition (K, K) and emission (K, symbols) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, np.ascontiguousarray(move), emit
        self.by_symbol = np.ascontiguousarray(emit.T)  # a token's emissions lie together

    def forward(self, own: Lanes):
        """Forward recursion, scaled every SCALED steps: emissions, alphas (T, lanes, K), scales (T, lanes).

        At the start of a document the recursion starts anew, so a document's likelihood is the
        product of its scales and the sum of its last alphas.
        """
        e = np.take(self.by_symbol, own.x, axis=0)
        alpha, scale, ones = np.zeros(e.shape), np.ones(own.x.shape), np.ones(len(self.start))
        _, lane, at = own.by_step(own.first)
        for t, m in enumerate(own.on):
            a = alpha[t, :m]
            if t:
                np.matmul(alpha[t - 1, :m], self.move, out=a)
            if at[t] < at[t + 1]:
                a[lane[at[t] : at[t + 1]]] = self.start
            a *= e[t, :m]
            if t % SCALED == SCALED - 1:
                s = scale[t, :m]
                np.matmul(a, ones, out=s)
                a /= s[:, None]
        return e, alpha, scale

    def _log10(self, own: Lanes, lengths: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 likelihood, sum of the last alphas) of each document."""
        end = alpha.reshape(-1, alpha.shape[2])[own.last].sum(axis=1)
        logs = np.log10(scale).ravel()[own.cells]
        return np.add.reduceat(logs, np.cumsum(lengths) - lengths) + np.log10(end), end

    def log10(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 likelihood of each document (none of them empty), in the given order."""
        out = np.zeros(len(lengths))
        for a, b, part, n in _parts(symbols, lengths):
            own = Lanes(part, n)
            _, alpha, scale = self.forward(own)
            out[a:b] = self._log10(own, n, alpha, scale)[0]
        return out

    def expect(self, symbols: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
        """Add the documents' expected counts to start (K), move (K, K), emit (symbols, K); returns their log10 likelihood."""
        total, k = 0.0, len(self.start)
        for _, _, part, n in _parts(symbols, lengths):
            own = Lanes(part, n)
            e, alpha, scale = self.forward(own)
            logs, end = self._log10(own, n, alpha, scale)
            total += float(logs.sum())
            moved, beta, back = np.zeros((k, k)), np.empty(alpha.shape[1:]), np.ascontiguousarray(self.move.T)
            _, begins, at = own.by_step(own.first)
            order, ends, until = own.by_step(own.last)
            for t in range(len(own.x) - 1, -1, -1):
                m = own.on[t]
                if until[t] < until[t + 1]:
                    here = slice(until[t], until[t + 1])
                    beta[ends[here]] = 1 / end[order[here], None]
                b = e[t, :m]
                b *= beta[:m]
                if t % SCALED == SCALED - 1:
                    b /= scale[t, :m, None]
                alpha[t, :m] *= beta[:m]  # state posteriors; alphas of earlier steps are still whole
                if t:
                    if at[t] < at[t + 1]:
                        b[begins[at[t] : at[t + 1]]] = 0.0  # no transition into a document's first symbol
                    moved += alpha[t - 1, :m].T @ b
                    np.matmul(b, back, out=beta[:m])
            move += moved * self.move
            start += alpha.reshape(-1, k)[own.first].sum(axis=0)
            for i in range(k):  # alphas of places that no document takes are 0
                emit[:, i] += np.bincount(own.x.ravel(), weights=alpha[:, :, i].ravel(), minlength=len(emit))
        return total


class Lexicon:
    """Known words by falling count: index, count and class; the first `emitted` have symbols."""

    def __init__(self, known: list[bytes], counts: np.ndarray, emitted: int):
        self.index = {w: i for i, w in enumerate(known)}
        self.log_count = np.log10(np.append(counts, 0) + 0.5)  # the last is a stand-in for other words
        symbols = [i if i < emitted else emitted + bucket(w) for i, w in enumerate(known)]
        self.symbol = np.array([*symbols, 0], np.int64)
        self.emitted, self.end, self.size = emitted, emitted + BUCKETS, emitted + BUCKETS + 1

    def read(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(indices with -1 for words that aren't known, symbols) of words."""
        at = np.fromiter(map(self.index.get, ws, repeat(-1)), np.int64, len(ws))
        symbols = self.symbol[at]
        for i in np.flatnonzero(at < 0):
            symbols[i] = self.emitted + bucket(ws[i])
        return at, symbols


def _threshold(vocabulary: DataFrame, most: int) -> int:
    """The smallest count that at most `most` words reach."""
    by = vocabulary.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    over = by.select("c", F.sum("n").over(Window.orderBy(F.desc("c"))).alias("n"))
    low = over.filter(F.col("n") <= most).agg(F.min("c")).first()[0]
    return low if low is not None else 2**62


def held_out(id_col: str):
    """crc32 of the id as text, mod 5, is 1; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 1


class Model:
    """Word counts of the training texts, and the chain once it is trained."""


def learn_words(docs: DataFrame, text_col: str = "text", emitted: int = EMITTED) -> Model:
    """Count the words of all rows of docs (null text: an empty one, its end alone)."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for _, part in text_batches(batches, "text", 16 << 20):
            found = Counter()
            for t in part:
                found.update(words(t))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array([bucket(w) for w in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["word", "bucket", "c"])

    m = Model()
    counted = texts.mapInArrow(count, "word string, bucket int, c long")
    m.vocabulary = stage(counted.groupBy("word", "bucket").agg(F.sum("c").cast("long").alias("c")), "vocabulary")
    m.n_docs = texts.count()
    sums = m.vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    m.n_tokens, m.n_words = int(sums[0]) + m.n_docs, int(sums[1]) + (m.n_docs > 0)
    m.known_from, emitted_from = _threshold(m.vocabulary, KNOWN), _threshold(m.vocabulary, min(emitted, KNOWN))
    rows = m.vocabulary.filter(F.col("c") >= m.known_from).select("word", "c").toArrow()
    order = sorted(zip((-c for c in rows.column("c").to_pylist()), (w.encode() for w in rows.column("word").to_pylist())))
    counts = np.array([-c for c, _ in order], float)
    lex = m.lexicon = Lexicon([w for _, w in order], counts, int((counts >= emitted_from).sum()))
    rare = m.vocabulary.filter(F.col("c") < emitted_from).groupBy("bucket").agg(F.sum("c"), F.count(F.lit(1))).collect()
    mass, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, c, n in rare:
        mass[b], kinds[b] = c, n
    m.log_class = np.log10(mass + 0.5 * (kinds + 1))
    base = np.concatenate([counts[: lex.emitted], mass, [float(m.n_docs)]]) + 0.5
    m.base = base / base.sum()
    return m


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, head double, in_class double, tail array<struct<word:string,n:long>>, symbols array<int>"


def encode(docs: DataFrame, m: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row of docs as symbols with its end, and what its words give besides; written once, read by every pass.

    head sums the log counts of known words. in_class sums, over words without a symbol of
    their own, the logs of their shares of their class. Words whose counts aren't broadcast
    are listed in tail.
    """
    shared = docs.sparkSession.sparkContext.broadcast((m.lexicon, m.log_class))
    names = [c.split()[0] for c in ENCODED.split(", ")]
    pair = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def run(batches):
        lex, log_class = shared.value
        row = TaskContext.get().partitionId() << 33
        for part, texts in text_batches(batches, "text", 2 << 20):
            split = [words(t) for t in texts]
            n = np.array([len(ws) for ws in split], np.int64)
            ends = np.cumsum(n)
            every = list(chain.from_iterable(split))
            at, symbols = lex.read(every)
            owner = np.repeat(np.arange(len(n)), n)
            known = at >= 0
            sums = lambda on, value: np.bincount(owner[on], weights=value, minlength=len(n)).astype(float)
            rare = symbols >= lex.emitted
            in_class = sums(rare & known, lex.log_count[at[rare & known]]) - sums(rare, log_class[symbols[rare] - lex.emitted])
            tail: list[Counter] = [Counter() for _ in n]
            for i in np.flatnonzero(~known):
                tail[owner[i]][every[i]] += 1
            closed = np.insert(symbols, ends, lex.end).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n + 1)], pa.int32()), pa.array(closed, pa.int32()))
            own = [[{"word": w.decode(), "n": c} for w, c in t.items()] for t in tail]
            cols = [pa.array(range(row, row + len(n)), pa.int64()), part.column(0), part.column(1), pa.array(n + 1), pa.array(sums(known, None).astype(np.int64)), pa.array(sums(known, lex.log_count[at[known]])), pa.array(in_class), pa.array(own, pair), lists]
            yield pa.RecordBatch.from_arrays(cols, names)
            row += len(n)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return stage(own.mapInArrow(run, ENCODED), "encoded")


def _symbols(batches):
    """(part, all symbols, lengths) of bounded parts of batches with a column symbols."""
    for batch in batches:
        for part in slices(batch, "symbols"):
            lists = part.column(part.schema.get_field_index("symbols"))
            yield part, np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64)
    pa.default_memory_pool().release_unused()


def baum_welch(encoded: DataFrame, m: Model, states: int = STATES, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Train m.chain on the encoded documents, all of them in every round."""
    sc, size = encoded.sparkSession.sparkContext, m.lexicon.size
    rng = np.random.default_rng(seed)
    emit = m.base * np.exp(rng.standard_normal((states, size)))
    move = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
    m.chain = Chain(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    m.history = []
    names = [f"k{i}" for i in range(states)]
    for _ in range(rounds if m.n_docs else 0):
        shared = sc.broadcast(m.chain)

        def expect(batches, shared=shared):
            start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
            for _, symbols, lengths in _symbols(batches):
                total += shared.value.expect(symbols, lengths, start, move, emit)
            seen = np.flatnonzero(emit.any(axis=1))
            # symbols from 0; -1: start, -2 - i: transitions from state i, -2 - states: likelihood
            at = np.concatenate([seen, [-1], -2 - np.arange(states), [-2 - states]])
            rows = np.concatenate([emit[seen], start[None], move, np.full((1, states), total)])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(c) for c in rows.T)], ["symbol", *names])

        sums = encoded.select("symbols").mapInArrow(expect, "symbol long, " + ", ".join(f"{c} double" for c in names)).groupBy("symbol").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        at, got = sums.column("symbol").to_numpy(), np.column_stack([sums.column(c).to_numpy() for c in names])
        emit = PRIOR * np.tile(m.base, (states, 1))
        emit[:, at[at >= 0]] += got[at >= 0].T
        start, move = got[at == -1][0] + 1.0, np.stack([got[at == -2 - i][0] for i in range(states)]) + 1.0
        m.history.append(float(got[at == -2 - states][0][0]))
        m.chain = Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return m


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", emitted: int = EMITTED, **options) -> Model:
    """Learn from all rows of docs."""
    m = learn_words(docs, text_col, emitted)
    return baum_welch(encode(docs, m, text_col, id_col), m, **options)


def score(docs: DataFrame, m: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Null text is the empty text: one token, its end. A null id isn't held out. Rows that repeat
    an id, or all of a row, are scored each; other columns don't matter; no rows give none.
    A text's probability is that of its words with all words unseen in training taken as one.
    """
    return _score(encode(docs, m, text_col, id_col), m)


def _score(encoded: DataFrame, m: Model) -> DataFrame:
    """Words whose counts aren't broadcast leave as (row, word, times) and meet their counts by a join on the word."""
    shared = encoded.sparkSession.sparkContext.broadcast(m.chain)

    def run(batches):
        for part, symbols, lengths in _symbols(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shared.value.log10(symbols, lengths))], [*part.schema.names[:-1], "latent"])

    plain = ["row", "doc_id", "held_out", "n_tokens", "known", "head", "in_class"]
    schema = ", ".join(c for c in ENCODED.split(", ") if c.split()[0] in plain) + ", latent double"
    rows = encoded.select(*plain, "symbols").mapInArrow(run, schema)
    tail = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    counts = m.vocabulary.filter(F.col("c") < m.known_from).select("word", "c")
    met = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("seen")
    )
    whole = float(np.log10(m.n_tokens + 0.5 * (m.n_words + 1)))
    end = float(np.log10(m.n_docs + 0.5))
    logs, seen = F.coalesce("logs", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return rows.join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + seen + F.lit(int(m.n_docs > 0))).cast("long").alias("n_known"),
        F.lit(m.n_tokens).cast("long").alias("train_tokens"),
        (F.col("head") + logs + F.lit(end) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("latent") + F.col("in_class") + logs).alias("score"),
    )


def score_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", emitted: int = EMITTED, **options) -> DataFrame:
    """Train on the rows that aren't held out, score all rows; see score() for nulls, repeats and empty tables."""
    m = learn_words(docs.filter(~held_out(id_col)), text_col, emitted)
    encoded = encode(docs, m, text_col, id_col)
    baum_welch(encoded.filter("NOT held_out"), m, **options)
    return _score(encoded, m)
