"""Scoring texts by a hidden Markov language model.

A text is its words, A-Z lowered, and one end. Latent states emit word classes: each of the ``own`` most frequent training tokens is a class of its own, the others
fall into ``shared`` classes by the hash of their first and last letters. Within a class a word has its smoothed share of the class's
training tokens, whatever the state. So

    P(text) = sum over state paths of prod a(s', s) b(s, class of w) * prod P(w | class of w),

a distribution over texts in which every word, known or not, has a positive probability. The first factor is the forward recursion, scaled at every token, over a model of
fixed size; the second needs each word's count, which the frequent words' table gives at once and a join with the whole vocabulary gives for the rest.

Baum-Welch trains on all training texts. Each task runs scaled forward and backward passes over its sequences and adds up expected
transitions, emissions and starts; the tasks' sums are merged level by level and the driver re-estimates. Texts are encoded to class numbers once. In a task, sequences of like length run
side by side, a block of steps at a time: the forward values at block ends are kept and a block's own are computed again on the way back,
so memory is bounded by the block, however long a text is.

The vocabulary's counts cover all training texts and are a table, joined by word; what is broadcast are the ``own`` words and the model, (own + shared) x states numbers.

Null and empty texts are one end. A null id counts as the empty text in the fold. Rows are scored each, equal or not. Without
training texts all words are unknown and classes equally likely. Columns other than the named ones are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, merged, mix64, pack, space_words, texts, unpack

FOLDS, HELD = 5, 1
STATES, OWN, SHARED, ITERATIONS = 8, 1 << 15, 1 << 12, 6
#: The end of a text; words hold no blank, so none is like it.
END = b" "
#: Weight of the classes' overall shares in a state's emissions and of equal shares in its transitions and starts.
PRIOR = 50.0
CHUNK, STEPS, HELD_WORDS = 400_000, 1 << 15, 400_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD


def sized(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most about ``most`` bytes of text in its first column (a longer text stays whole)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy().astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
            yield b.slice(i, j - i)
            i = j


# --- vocabulary --------------------------------------------------------------------------------------------------------------


def vocabulary(train: DataFrame, text: str = "text") -> DataFrame:
    """(w binary, c long): every token of the texts and how often it stands; summed in the tasks before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "c"])
            seen.clear()
            return got

        for b in sized(batches):
            for t in texts(b.column(0)):
                seen.update(space_words(t))
                seen[END] += 1
            if len(seen) > HELD_WORDS:
                yield out()
        yield out()

    return train.select(F.col(text).alias("text")).mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Classes:
    """Classes of tokens: the frequent ones by rank, the end behind them, then the shared classes."""

    def __init__(self, frequent: list[tuple[bytes, int]], shared: int) -> None:
        known = dict(frequent)
        words = [w for w, _ in frequent if w != END] + [END]
        self.index = {w: i for i, w in enumerate(words)}
        self.own, self.shared = len(words), shared
        self.counts = np.array([known.get(w, 0) for w in words], np.int64)
        self.kind = np.uint16 if self.own + shared <= 1 << 16 else np.int32

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' classes, and where those of shared classes stand."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(at < 0)
        at[rare] = self.own + self.shared_class([words[i] for i in rare.tolist()])
        return at, rare

    def shared_class(self, words: list[bytes]) -> np.ndarray:
        """A hash of each word's first two and last two bytes; none is empty."""
        text = np.frombuffer(b"".join(words), np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(n)
        start = end - n
        second, before = np.minimum(start + 1, end - 1), np.maximum(end - 2, start)
        key = sum(text[i].astype(np.uint64) << np.uint64(8 * k) for k, i in enumerate((start, second, before, end - 1)))
        return (mix64(key) % np.uint64(self.shared)).astype(np.int32)


def shares(counts: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each shared class."""
    sent = counts.sparkSession.sparkContext.broadcast(classes)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = sent.value
        n, v = np.zeros(k.shared, np.int64), np.zeros(k.shared, np.int64)
        for b in batches:
            at, rare = k.of(b.column(0).to_pylist())
            np.add.at(n, at[rare] - k.own, b.column(1).to_numpy()[rare])
            v += np.bincount(at[rare] - k.own, minlength=k.shared)
        yield pa.RecordBatch.from_arrays([pa.array([pack(n, v)], pa.binary())], names=["blob"])

    def add(blobs: Iterator[bytes]) -> bytes:
        n, v = (x.copy() for x in unpack(next(blobs), np.int64, np.int64))
        for b in blobs:
            more = unpack(b, np.int64, np.int64)
            n, v = n + more[0], v + more[1]
        return pack(n, v)

    blob = merged(counts.mapInArrow(tally, "blob binary"), add)
    return tuple(unpack(blob, np.int64, np.int64)) if blob else (np.zeros(classes.shared, np.int64), np.zeros(classes.shared, np.int64))


def encoded(docs: DataFrame, classes: Classes) -> DataFrame:
    """(row, doc_id, held_out, classes, rare): a number of each row, its tokens' classes as bytes of whole numbers, the words of shared classes."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, row = sent.value, TaskContext.get().partitionId() << 40
        for b in sized(batches):
            words, ends = [], []
            for t in texts(b.column(0)):
                words += space_words(t)
                words.append(END)
                ends.append(len(words))
            at, rare = k.of(words)
            blobs = [x.tobytes() for x in np.split(at.astype(k.kind), ends[:-1])]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, [0, *ends]), pa.int32()), pa.array([words[i] for i in rare.tolist()], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(blobs)), pa.int64()), b.column(1), b.column(2), pa.array(blobs, pa.binary()), lists], names=["row", "doc_id", "held_out", "classes", "rare"])
            row += len(blobs)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("text", "doc_id", held_out().alias("held_out")).mapInArrow(encode, f"row long, doc_id {id_type}, held_out boolean, classes binary, rare array<binary>")


# --- the model ---------------------------------------------------------------------------------------------------------------


class Sequences:
    """Sequences side by side, longest first: tokens in order of step, then sequence."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        lens = np.array([len(p) for p in parts])
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        self.longest = int(lens[0]) if len(lens) else 0
        #: how many sequences have a token at each step, and where each step begins
        self.active = len(lens) - np.searchsorted(lens[::-1], np.arange(self.longest), side="right")
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        self.tokens = np.empty(int(self.begin[-1]), np.int32)
        for s, p in enumerate(self.order.tolist()):
            self.tokens[self.begin[: lens[s]] + s] = parts[p]


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit  # (K), (K, K), (classes, K)

    def single(self) -> Model:
        """The same in single precision, enough for expected counts."""
        return Model(*[x.astype(np.float32) for x in (self.start, self.move, self.emit)])

    def forward(self, seqs: Sequences, t0: int, t1: int, a: np.ndarray | None, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Steps t0 to t1 from the scaled values before them (None: the start): the last values, all values if kept, and the scales."""
        low = seqs.begin[t0]
        e = self.emit[seqs.tokens[low : seqs.begin[t1]]]
        values = np.empty_like(e) if keep else None
        scales = np.empty(len(e), e.dtype)
        at, active, move = (seqs.begin[t0 : t1 + 1] - low).tolist(), seqs.active[t0:t1].tolist(), self.move
        for t in range(t1 - t0):
            i, j = at[t], at[t + 1]
            a = (self.start if a is None else a[: active[t]] @ move) * e[i:j]
            s = scales[i:j] = a.sum(1)
            a /= s[:, None]
            if keep:
                values[i:j] = a
        return a, values, scales

    def log_likelihoods(self, seqs: Sequences) -> np.ndarray:
        """Natural logarithms of the sequences' probabilities, in the order they were given."""
        out, a = np.zeros(len(seqs.order)), None
        for t0 in range(0, seqs.longest, STEPS):
            t1 = min(t0 + STEPS, seqs.longest)
            a, _, scales = self.forward(seqs, t0, t1, a, False)
            low = seqs.begin[t0]
            who = np.arange(len(scales)) - np.repeat(seqs.begin[t0:t1] - low, seqs.active[t0:t1])
            out += np.bincount(who, np.log(scales), minlength=len(out))
        back = np.empty_like(out)
        back[seqs.order] = out
        return back


class Expected:
    """Expected starts, transitions and emissions, and the log-likelihood."""

    def __init__(self, states: int, classes: int) -> None:
        self.start, self.move, self.emit, self.fit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), 0.0

    def add(self, m: Model, seqs: Sequences) -> None:
        ends, a = [None], None
        for t0 in range(0, seqs.longest - STEPS, STEPS):  # values at the blocks' ends
            a, _, _ = m.forward(seqs, t0, t0 + STEPS, a, False)
            ends.append(a)
        pair = np.zeros(self.move.shape)
        carry = None  # of the step behind the block: emission * backward value / scale, for the sequences that have it
        for k in range(len(ends) - 1, -1, -1):
            t0, t1 = k * STEPS, min((k + 1) * STEPS, seqs.longest)
            _, values, scales = m.forward(seqs, t0, t1, ends[k], True)
            low = seqs.begin[t0]
            tokens = seqs.tokens[low : seqs.begin[t1]]
            weighted = m.emit[tokens] / scales[:, None]
            at, back = (seqs.begin[t0 : t1 + 1] - low).tolist(), m.move.T.copy()
            for t in range(t1 - t0 - 1, -1, -1):
                i, j = at[t], at[t + 1]
                v = values[i:j]
                carry_now = weighted[i:j]
                if carry is not None:  # sequences that end here keep a backward value of one
                    n = len(carry)
                    pair += v[:n].T @ carry
                    b = carry @ back
                    v[:n] *= b
                    carry_now[:n] *= b
                carry = carry_now
            for s in range(self.emit.shape[1]):
                self.emit[:, s] += np.bincount(tokens, values[:, s], minlength=len(self.emit))
            self.fit += float(np.log(scales.astype(float)).sum())
            if not k and len(values):
                self.start += values[: seqs.active[0]].sum(0)
        self.move += pair * m.move

    def pack(self) -> bytes:
        return pack(self.start, self.move.ravel(), self.emit.ravel(), np.array([self.fit]))

    @classmethod
    def unpack(cls, blob: bytes) -> Expected:
        start, move, emit, fit = unpack(blob, *[np.float64] * 4)
        out = cls(0, 0)
        k = len(start)
        out.start, out.move, out.emit, out.fit = start.copy(), move.reshape(k, k).copy(), emit.reshape(-1, k).copy(), float(fit[0])
        return out

    def merge(self, other: Expected) -> None:
        self.start += other.start
        self.move += other.move
        self.emit += other.emit
        self.fit += other.fit

    def model(self, overall: np.ndarray) -> Model:
        """Re-estimated parameters; ``overall`` are the classes' shares of all tokens."""
        k = len(self.start)
        emit = self.emit + PRIOR * overall[:, None]
        start, move = self.start + 1.0 / k, self.move + 1.0 / k
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def first_model(overall: np.ndarray, states: int, seed: int = 1) -> Model:
    """Equal starts, states that tend to stay, and the overall shares with a random factor, the same in each run, that tells states apart."""
    emit = overall[:, None] * np.random.default_rng(seed).gamma(1.0, size=(len(overall), states))
    emit = 0.9 * emit / emit.sum(0) + 0.1 * overall[:, None]
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1.0 / states), move, emit)


def _grouped(batches: Iterator[pa.RecordBatch], column: int, kind: type) -> Iterator[tuple[pa.RecordBatch, list[int], Sequences]]:
    """Rows of each batch by falling length, in groups of at most about CHUNK tokens."""
    for b in batches:
        parts = [np.frombuffer(x, kind) for x in b.column(column).to_pylist()]
        order = np.argsort([-len(p) for p in parts], kind="stable").tolist()
        while order:
            n = held = 0
            while n < len(order) and (not n or held + len(parts[order[n]]) <= CHUNK):
                held += len(parts[order[n]])
                n += 1
            yield b, order[:n], Sequences([parts[i] for i in order[:n]])
            order = order[n:]


def train(rows: DataFrame, overall: np.ndarray, kind: type, states: int, iterations: int) -> tuple[Model, list[float]]:
    """Baum-Welch over a column of class numbers of the type ``kind``: the model, and the training log-likelihood before each round."""
    sc = rows.sparkSession.sparkContext
    model, fits = first_model(overall, states), []

    def add(blobs: Iterator[bytes]) -> bytes:
        total = Expected.unpack(next(blobs))
        for b in blobs:
            total.merge(Expected.unpack(b))
        return total.pack()

    for _ in range(iterations):
        sent = sc.broadcast(model.single())

        def expect(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            m, got, any_ = sent.value, Expected(states, len(overall)), False
            for _, _, seqs in _grouped(batches, 0, kind):
                got.add(m, seqs)
                any_ = True
            if any_:
                yield pa.RecordBatch.from_arrays([pa.array([got.pack()], pa.binary())], names=["blob"])

        blob = merged(rows.select("classes").mapInArrow(expect, "blob binary"), add)
        sent.destroy()
        if blob is None:
            break
        total = Expected.unpack(blob)
        fits.append(total.fit)
        model = total.model(overall)
    return model, fits


# --- scores ------------------------------------------------------------------------------------------------------------------


def fitted(docs: DataFrame, *, states: int = STATES, own: int = OWN, shared: int = SHARED, iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame, Classes, Model, dict]:
    """The vocabulary, the encoded rows, the classes, the model learned from the rows that are not held out, and its statistics."""
    counts = cut(vocabulary(docs.where(~held_out())), "vocabulary")
    size = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    frequent = [(bytes(r["w"]), r["c"]) for r in counts.orderBy(F.col("c").desc(), "w").limit(own).collect()]  # at most ``own`` words
    end = counts.where(F.col("w") == F.lit(END)).first()
    if end and END not in dict(frequent):
        frequent.append((END, end["c"]))
    classes = Classes(frequent, shared)
    tokens, distinct = shares(counts, classes)
    overall = np.concatenate([classes.counts, tokens]) + 0.5
    overall = overall / overall.sum()
    rows = cut(encoded(docs, classes), "encoded")
    model, fits = train(rows.where(~F.col("held_out")), overall, classes.kind, states, iterations)
    return counts, rows, classes, model, {"n": int(size["n"]), "v": int(size["v"]), "tokens": tokens, "distinct": distinct, "fits": fits}


def digest(docs: DataFrame, **more: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    counts, rows, classes, model, stats = fitted(docs, **more)
    spark = docs.sparkSession
    n, v, own = stats["n"], stats["v"], classes.own
    # log10 (c + 0.5) of own classes; for shared ones minus the logarithm of the class's total, which turns it into a share
    logs = np.concatenate([np.log10(classes.counts + 0.5), np.zeros(classes.shared)])
    within = np.concatenate([np.zeros(own), -np.log10(stats["tokens"] + 0.5 * (stats["distinct"] + 1))])
    known = np.concatenate([classes.counts > 0, np.zeros(classes.shared, bool)])
    kind, sent = classes.kind, spark.sparkContext.broadcast((model, logs, within, known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lg, wi, kn = sent.value
        for b, at, seqs in _grouped(batches, 3, kind):
            paths = m.log_likelihoods(seqs) / np.log(10)
            own_parts = [np.frombuffer(b.column(3)[i].as_py(), kind) for i in at]
            got = b.take(pa.array(at, pa.int64()))
            numbers = [[len(p) for p in own_parts], [int(kn[p].sum()) for p in own_parts]]
            sums = [[float(lg[p].sum()) for p in own_parts], [float(x + wi[p].sum()) for x, p in zip(paths.tolist(), own_parts, strict=True)]]
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), got.column(2), *[pa.array(x, pa.int64()) for x in numbers], *[pa.array(x, pa.float64()) for x in sums]], names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "path"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    own_side = rows.select("row", "doc_id", "held_out", "classes").select("row", "doc_id", "held_out", "classes").mapInArrow(score, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, known long, logs double, path double")
    rare = rows.select("row", F.explode("rare").alias("w")).join(counts, "w", "left")
    rest = rare.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"))
    logs_all = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return own_side.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs_all - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"), (F.col("path") + F.coalesce("rare_logs", F.lit(0.0))).alias("score"),
    )
