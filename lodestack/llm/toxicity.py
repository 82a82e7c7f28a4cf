"""Toxicity by weak supervision.

Voters: words of a fixed lexicon, counts of lexicon words, and word stems (a word, or its first bytes) that are mined from labelled rows, some for toxic and
some for clean text. A voter votes on a text when its pattern stands in it. A generative label model estimates how often
each voter fires on toxic and on clean texts (its accuracy) and which voters fire together beyond what the class explains (their
correlations); votes of correlated voters are shared out among them. Its posterior labels, which the given labels enter as one more
noisy voter, train a linear classifier on the voters' patterns; that scores every text.

The classifier is fitted on a sample of at most about ``most`` labelled rows, chosen by a hash of their id; the bound is a parameter, as what is
fitted must not grow with the corpus. All texts are scored, whole. Rows of the held-out fold (crc32 of the id as text, mod 5 = 0) are never learned
from. Labels, language, source and id are not inputs of a score.

Null and empty texts get the score of a text without any pattern. Null labels and labels with a null id are left out; of labels that repeat an id
the highest counts. A null id counts as the text ''. Without toxic or without clean labels there is nothing to mine: the lexicon's votes score alone. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, pack, slices, texts, unpack

MOST, BITS, MINED, FOLDS = 20_000, 21, 600, 5
STEMS = (4, 5, 6, 7, 8, 9, 10, 12)

# English words that insult.
LEXICON = "idiot idiots stupid moron morons dumb fool loser losers clown scum trash pathetic worthless disgusting filthy garbage vermin imbecile bastard bitch shit fuck fucking asshole crap damn cunt whore slut jerk coward freak retard".split()


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod FOLDS; fold 0 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def stems(word: bytes) -> list[bytes]:
    """The word, marked as whole, and its first bytes."""
    n = len(word)
    return [b"=" + word, *[word[:k] for k in STEMS if k <= n]]


class StemHash(dict):
    """word -> slots of its stems, remembered up to a bound."""

    BOUND = 300_000

    def __init__(self, bits: int) -> None:
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.BOUND:
            self.clear()
        v = self[word] = tuple(xxhash.xxh3_64_intdigest(s) & self.mask for s in stems(word))
        return v


class Patterns:
    """The voters' patterns: which stand in a text."""

    def __init__(self, slots: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.lexicon = {w.encode(): i for i, w in enumerate(LEXICON)}
        self.first = len(LEXICON) + 2  # behind the lexicon: one lexicon word at least, three at least
        self.slot = {int(s): self.first + i for i, s in enumerate(slots)}
        self.size = self.first + len(slots)
        self.words: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, w: bytes) -> tuple[int, ...]:
        mask = (1 << self.bits) - 1
        found = tuple({v for s in stems(w) if (v := self.slot.get(xxhash.xxh3_64_intdigest(s) & mask)) is not None})
        if len(self.words) >= 400_000:
            self.words.clear()
        self.words[w] = found
        return found

    def of(self, text: bytes | None) -> list[int]:
        hit: set[int] = set()
        get, insults = self.words.get, 0
        for w in set(alnum_words(text)):
            f = get(w)
            if f is None:
                f = self.of_word(w)
            if f:
                hit.update(f)
            if w in self.lexicon:
                hit.add(self.lexicon[w])
                insults += 1
        if insults:
            hit.add(len(LEXICON))
            if insults > 2:
                hit.add(len(LEXICON) + 1)
        return sorted(hit)


def mine(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, most: int) -> np.ndarray:
    """Slots whose stems tell the classes apart: by the lower bound of their log-odds, most of them for toxic text."""
    if not n_pos or not n_neg:
        return np.zeros(0, np.int64)
    p, q = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
    odds, spread = np.log(p / q), 1.64 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    toxic = np.where(pos >= 3, odds - spread, -np.inf)
    clean = np.where(neg >= 10, -odds - spread, -np.inf)
    a = np.argsort(-toxic * np.sqrt(pos + 1), kind="stable")[: most * 3 // 4]
    b = np.argsort(-clean * np.sqrt(neg + 1), kind="stable")[: most // 4]
    return np.unique(np.concatenate([a[toxic[a] > 0.2], b[clean[b] > 0.2]]))


class Votes:
    """Sparse votes: of each row the voters that fire."""

    def __init__(self, rows: list[list[int]], size: int) -> None:
        self.n, self.size = len(rows), size
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)
        self.col = np.array([v for r in rows for v in r], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=x[self.row], minlength=self.size)


def label_model(votes: Votes, given: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior P(toxic) of each row by expectation maximisation, and the estimated accuracies and shares."""
    post = np.where(given == 1, 0.95, 0.05)
    share = np.ones(votes.size)
    gold = np.array([0.95, 0.05])  # P(given = 1 | toxic), P(given = 1 | clean)
    alpha = beta = np.zeros(votes.size)
    for k in range(rounds):
        a, b = post.sum(), (1 - post).sum()
        alpha, beta = (votes.sums(post) + 0.5) / (a + 1), (votes.sums(1 - post) + 0.5) / (b + 1)
        gold = np.clip([(post * given).sum() / max(a, 1e-9), ((1 - post) * given).sum() / max(b, 1e-9)], 0.01, 0.99)
        gold = np.array([max(gold[0], 0.6), min(gold[1], 0.2)])
        if k == 3:
            share = shares(votes, post, alpha, beta)
        fire = share * (np.log(alpha / beta) - np.log((1 - alpha) / (1 - beta)))
        prior = np.log((a + 1) / (b + 1)) + (share * np.log((1 - alpha) / (1 - beta))).sum()
        said = np.where(given == 1, np.log(gold[0] / gold[1]), np.log((1 - gold[0]) / (1 - gold[1])))
        now = 1 / (1 + np.exp(-np.clip(prior + votes.times(fire) + said, -40, 40)))
        if np.abs(now - post).max() < 1e-4:
            post = now
            break
        post = now
    return post, {"toxic_rate": alpha, "clean_rate": beta, "share": share, "given": gold}


def shares(votes: Votes, post: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """1 / (1 + the sum of a voter's positive correlations with the others, given the class)."""
    v = votes.size
    rows = np.split(votes.col, np.searchsorted(votes.row, np.arange(1, votes.n))) if votes.n else []
    both = np.zeros((2, v, v))
    for r, p in zip(rows, post, strict=True):
        if 1 < len(r):
            both[0][np.ix_(r, r)] += p
            both[1][np.ix_(r, r)] += 1 - p
    out = np.zeros((v, v))
    for c, rate, n in ((0, alpha, post.sum()), (1, beta, (1 - post).sum())):
        cov = both[c] / max(n, 1) - np.outer(rate, rate)
        var = np.sqrt(np.outer(rate * (1 - rate), rate * (1 - rate)))
        out = np.maximum(out, np.where(var > 1e-9, cov / np.maximum(var, 1e-9), 0))
    out = np.where(out > 0.1, np.minimum(out, 1), 0)
    np.fill_diagonal(out, 0)
    return 1 / (1 + out.sum(1))


def linear(votes: Votes, target: np.ndarray, penalty: float = 0.1, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights of a logistic classifier on soft labels, by adaptive gradient descent with an L2 penalty."""
    w, bias = np.zeros(votes.size), np.log((target.sum() + 1) / ((1 - target).sum() + 1)) if votes.n else 0.0
    squares = np.zeros(votes.size + 1)
    for _ in range(rounds):
        err = 1 / (1 + np.exp(-np.clip(votes.times(w) + bias, -40, 40))) - target
        slope = np.append(votes.sums(err) + penalty * w, err.sum())
        squares += slope**2
        step = 0.5 * slope / (np.sqrt(squares) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


class Scorer:
    def __init__(self, patterns: Patterns, weights: np.ndarray, bias: float) -> None:
        self.patterns, self.weights, self.bias = patterns, weights.tolist(), bias

    def score(self, text: bytes | None) -> float:
        x = self.bias + sum(map(self.weights.__getitem__, self.patterns.of(text)))
        return 1 / (1 + np.exp(-x)) if x > -700 else 0.0


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most about ``most`` labelled documents outside of the held-out fold; of rows that share an id the one with the least text."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)
    taken = docs.where(fold() != 0).select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about ``most`` ids at most
    return taken.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _stem_counts(sample: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """How many toxic and clean rows of the sample hold a stem of each slot: fixed-size vectors, summed in the executors."""
    pieces = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, slots = np.zeros((2, 1 << bits), np.int32), [0, 0], StemHash(bits)
        for b in slices(batches, "text"):
            for t, y in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                hit = {s for w in set(alnum_words(t)) for s in slots[w]}
                total[y][np.fromiter(hit, np.int64, len(hit))] += 1
                n[y] += 1
        blobs = [pack(total[0].reshape(pieces, -1)[i], total[1].reshape(pieces, -1)[i], np.array(n)) for i in range(pieces)]
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int64()), pa.array(blobs, pa.binary())], names=["piece", "blob"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        got = [unpack(b, np.int32, np.int32, np.int64) for b in part.column("blob").to_pylist()]
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([pack(*[sum(x[i] for x in got) for i in range(3)])], pa.binary())})

    kind = "piece long, blob binary"
    got = {r["piece"]: unpack(r["blob"], np.int32, np.int32, np.int64) for r in sample.mapInArrow(count, kind).groupBy("piece").applyInArrow(add, kind).collect()}
    if not got:
        return np.zeros(1 << bits), np.zeros(1 << bits), 0, 0
    clean, toxic = (np.concatenate([got[i][k] for i in range(pieces)]) for k in (0, 1))
    return toxic, clean, int(got[0][2][1]), int(got[0][2][0])


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST, mined: int = MINED, bits: int = BITS) -> Scorer:
    """The scorer learned from the labelled rows of ``docs``."""
    sample = _sample(docs, labels, most)
    toxic, clean, n_toxic, n_clean = _stem_counts(sample, bits)
    patterns = Patterns(mine(toxic, clean, n_toxic, n_clean, mined), bits)
    sent = docs.sparkSession.sparkContext.broadcast(patterns)  # at most ``mined`` slots

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([p.of(t) for t in texts(b.column(0))], pa.list_(pa.int32())), b.column(1)], names=["votes", "toxic"])

    rows = sorted((r["votes"], r["toxic"]) for r in sample.mapInArrow(vote, "votes array<int>, toxic int").toLocalIterator())  # at most about ``most`` rows
    return learn([r[0] for r in rows], np.array([r[1] for r in rows], float), patterns)


def learn(rows: list[list[int]], given: np.ndarray, patterns: Patterns) -> Scorer:
    if not len(given) or given.min() == given.max():
        w = np.zeros(patterns.size)
        w[: len(LEXICON)] = 1.0
        return Scorer(patterns, w, -2.0)
    votes = Votes(rows, patterns.size)
    post, _ = label_model(votes, given)
    w, bias = linear(votes, post)
    return Scorer(patterns, w, bias)


def scores(scorer: Scorer, spark: object, text: str = "text") -> Column:
    sent = spark.sparkContext.broadcast(scorer)  # a weight per voter

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        s = sent.value
        return pa.array((s.score(t) for t in texts(column)), pa.float64())

    return score(text)


def digest(docs: DataFrame, labels: DataFrame, **more: int) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scorer = fit(docs, labels, **more)
    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), scores(scorer, docs.sparkSession).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, **more: int) -> DataFrame:
    """The documents that are not predicted toxic, columns unchanged."""
    scorer = fit(docs.select("doc_id", "text"), labels, **more)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return row.where(scores(scorer, docs.sparkSession) < 0.5).select("row.*")
