import hashlib
import random

import numpy as np
import pytest

from lodestack.llm import suffix_dedup as sd


def brute(docs, length):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(length):
    r = random.Random(length)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 5)))
    shared = [" ".join(word() for _ in range(r.randrange(5, 60))) for _ in range(12)]
    docs = []
    for i in range(50):
        parts = [r.choice([*shared, " ".join(word() for _ in range(20)), "z" * r.randrange(10, 120), "ab" * r.randrange(5, 60)]) for _ in range(r.randrange(1, 6))]
        docs.append((r.randrange(40), r.choice(["", " ", "\n"]).join(parts)))
    docs += [(60, docs[0][1]), (61, docs[0][1]), (61, docs[0][1]), (62, docs[1][1][1:])]
    return docs


@pytest.mark.parametrize("length", [50, 20])
def test_equals_brute_force(docs_of, odd, length):
    docs = [*odd, *corpus(length)]
    got = sorted((tuple(r) for r in sd.digest(docs_of(docs), length=length).collect()), key=str)
    assert got == brute(docs, length)


def test_empty(docs_of):
    assert sd.digest(docs_of([])).count() == 0


def test_common_starts_are_the_equal_prefixes():
    r = np.random.default_rng(2)
    for n, sigma, length in ((400, 2, 5), (900, 3, 9), (50, 1, 6)):
        t = r.integers(1, sigma + 1, n)
        t[r.integers(0, n, 4)] = 0
        t[-1] = 0
        t = t.astype(np.int16)
        order, edge = sd.common_starts(t, length)
        text = bytes(t.astype(np.uint8))
        prefix = [text[i : i + length] for i in order]
        group = np.cumsum(edge)
        valid = [len(p) == length and 0 not in p for p in prefix]
        for a in range(n):
            for b in range(max(0, a - 30), a):
                if valid[a] and valid[b]:
                    assert (group[a] == group[b]) == (prefix[a] == prefix[b])


def test_home_is_sparks(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, -5, 2**62, 123456789]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.xxhash64("i"), F.lit(97))).collect()]
    assert sd.home_of(np.array(ids, np.int64), 97).tolist() == want
