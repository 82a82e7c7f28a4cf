import random

import numpy as np

from lodestack.llm import suffix_dedup as sd


def test_only_strings_that_recur_enter_the_transform(monkeypatch):
    r = random.Random(7)
    text = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    shared = text(60)
    segs = [text(400) + shared + text(300), text(200), shared + text(500), text(49), text(50)]
    owner = np.array([5, 1, 3, 2, 4])
    seen = []
    inner = sd.common_starts
    monkeypatch.setattr(sd, "common_starts", lambda t, length: seen.append(len(t)) or inner(t, length))
    got = sd.least_owner(segs, owner, 50)
    assert [len(x) for x in got] == [max(0, len(s) - 49) for s in segs]
    want = [np.where((np.arange(len(x)) >= 400) & (np.arange(len(x)) <= 410) & (k == 0), 3, owner[k]) for k, x in enumerate(got)]
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    assert seen == [2 * 61]  # the shared bytes and a separator, twice; all 1,500 bytes before


def test_least_owner_equals_plain_search():
    r = random.Random(11)
    for length in (1, 4, 9):
        for _ in range(60):
            base = "".join(r.choice("abc") for _ in range(200))
            segs = sorted({base[i : i + length + r.randrange(20)].encode() for i in (r.randrange(150) for _ in range(r.randrange(1, 25)))})
            owner = np.array([r.randrange(-50, 50) for _ in segs])
            got = sd.least_owner(segs, owner, length)
            for s, x in zip(segs, got, strict=True):
                assert x.tolist() == [min(o for o, q in zip(owner.tolist(), segs, strict=True) if s[p : p + length] in q) for p in range(len(s) - length + 1)]
