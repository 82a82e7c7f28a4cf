"""The language model against enumeration of all state paths, counts against a Counter, and held-out texts."""

import re
import zlib
from collections import Counter
from itertools import product
from math import log10

import numpy as np
import pytest

from lodestack.llm import hmm
from lodestack.llm.hmm import END, Classes, Expected, Model, Sequences

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def random_model(rng, k=3, c=5):
    return Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T.copy())


def path_sums(m, seq):
    """Probability of a sequence, and expected starts, transitions and emissions, over every path."""
    k = len(m.start)
    total, start, move, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for p in product(range(k), repeat=len(seq)):
        w = m.start[p[0]] * m.emit[seq[0], p[0]]
        for t in range(1, len(seq)):
            w *= m.move[p[t - 1], p[t]] * m.emit[seq[t], p[t]]
        total += w
        start[p[0]] += w
        for t, s in enumerate(p):
            emit[seq[t], s] += w
            if t:
                move[p[t - 1], s] += w
    return total, start / total, move / total, emit / total


@pytest.mark.parametrize("steps", [2, 3, 1 << 15])
def test_recursions_equal_enumeration(monkeypatch, steps):
    """Blocks of two, three and many steps: the same likelihoods and the same expected counts."""
    monkeypatch.setattr(hmm, "STEPS", steps)
    rng = np.random.default_rng(11)
    m = random_model(rng)
    parts = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 7, 3, 2, 5, 7, 1)]
    sums = [path_sums(m, p.tolist()) for p in parts]
    seqs = Sequences(parts)
    np.testing.assert_allclose(m.log_likelihoods(seqs), [np.log(s[0]) for s in sums], rtol=1e-12)
    got = Expected(3, 5)
    got.add(m, seqs)
    for i, have in enumerate((got.start, got.move, got.emit), 1):
        np.testing.assert_allclose(have, sum(s[i] for s in sums), rtol=1e-10, atol=1e-13)
    assert got.fit == pytest.approx(sum(np.log(s[0]) for s in sums))
    again = Expected.unpack(got.pack())
    again.merge(got)
    np.testing.assert_allclose(again.emit, 2 * got.emit)


def test_long_sequences_do_not_underflow():
    m = random_model(np.random.default_rng(2))
    seq = np.tile(np.array([0, 1, 2, 3, 4], np.int32), 40_000)
    out = m.log_likelihoods(Sequences([seq, seq[:3]]))
    assert np.isfinite(out).all() and out[0] < -100_000


def texts_of_two_kinds(rng, n):
    kinds = [["ka", "ki", "ku", "ke", "ko"], ["lamo", "lemo", "limo", "lomo"]]
    return [" ".join(rng.choice(kinds[i % 2], 30)) for i in range(n)]


def digest(spark, rows, **more):
    df = spark.createDataFrame([(9, t, i, "x") for i, t in rows], "row int, text string, doc_id long, classes string")
    return {(r["doc_id"], k): r for k, r in enumerate(hmm.digest(df, **more).collect())}


def check_base(rows, got, own):
    train = Counter()
    for i, t in rows:
        if not held(i):
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t in rows:
        w = [*words(t), None]
        base = sum(log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[(i, held(i), len(w), sum(train[x] > 0 for x in w), n, round(base, 6))] += 1
    have = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.values())
    assert have == want


@pytest.mark.parametrize("own", [3, 1000])
def test_counts_and_base(spark, odd, own):
    rng = np.random.default_rng(4)
    rows = [*odd, *[(100 + i, t) for i, t in enumerate(texts_of_two_kinds(rng, 40))], *[(300 + i, f"new{i} KA ka é\x0bÉ") for i in range(30)]]
    got = digest(spark, rows, own=own, shared=4, states=2, iterations=2)
    check_base(rows, got, own)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())


def test_score_is_the_forward_sum(spark):
    """score of each text by all state paths of the fitted model, and a word's share within its class."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "ee", "f"], rng.integers(0, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts, _, classes, model, stats = hmm.fitted(df, own=3, shared=2, states=2, iterations=3)
    c = {bytes(r["w"]): r["c"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in hmm.digest(df, own=3, shared=2, states=2, iterations=3).collect()}
    for i, t in rows:
        w = [*(x.encode() for x in words(t)), END]
        k = classes.of(w)[0].tolist()
        want = log10(path_sums(model, k)[0])
        for x, j in zip(w, k, strict=True):
            if j >= classes.own:
                s = j - classes.own
                want += log10((c.get(x, 0) + 0.5) / (stats["tokens"][s] + 0.5 * (stats["distinct"][s] + 1)))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_model_is_a_distribution():
    """The probabilities of all sequences of one length sum to one."""
    m = random_model(np.random.default_rng(8), 2, 3)
    assert sum(np.exp(m.log_likelihoods(Sequences([np.array(s, np.int32) for s in product(range(3), repeat=4)])))) == pytest.approx(1.0)


def test_training_raises_the_likelihood_and_beats_the_base(spark):
    rng = np.random.default_rng(9)
    rows = list(enumerate(texts_of_two_kinds(rng, 300)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    *_, stats = hmm.fitted(df, states=2, iterations=8, own=100, shared=4)
    assert all(b >= a - 50 for a, b in zip(stats["fits"], stats["fits"][1:], strict=False))  # the priors' weight aside, it never falls
    got = [r for r in hmm.digest(df, states=2, iterations=8, own=100, shared=4).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.15  # one of two kinds of about equal words: at most log10(2) a token


def test_empty_and_all_held_out(spark):
    assert digest(spark, []) == {}
    only = [i for i in range(50) if held(i)][:3]
    rows = [(i, "some words") for i in only]
    got = digest(spark, rows, own=5, shared=3, states=2, iterations=2)
    check_base(rows, got, 5)
    assert all(r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in got.values())


def test_classes():
    k = Classes([(b"the", 5), (END, 3), (b"of", 2)], 7)
    words = [b"of", b"zebra", END, b"the", b"x", b"zbra"]
    at, rare = k.of(words)
    assert at[[0, 2, 3]].tolist() == [1, 2, 0] and k.counts.tolist() == [5, 2, 3] and rare.tolist() == [1, 4, 5]
    assert 3 <= at[rare].min() and at[rare].max() < 10 and k.of([b"zebra", b"ze--ra"])[0].tolist() == [at[1]] * 2


def test_single_precision_counts():
    rng = np.random.default_rng(3)
    m = random_model(rng, 4, 50)
    seqs = Sequences([rng.integers(0, 50, n).astype(np.int32) for n in (2000, 30, 400)])
    exact, single = Expected(4, 50), Expected(4, 50)
    exact.add(m, seqs)
    single.add(m.single(), seqs)
    np.testing.assert_allclose(single.emit, exact.emit, rtol=1e-3, atol=1e-3)
    assert single.fit == pytest.approx(exact.fit, rel=1e-5)
