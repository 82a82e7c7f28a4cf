import random

from lodestack.llm import license_scan as ls


def stretched(r, words):
    return [v for w in words for v in [w] * (r.random() >= 0.12) + ["foreign"] * (r.random() < 0.5)]


def test_no_start_is_lost(docs_of):
    r = random.Random(4)
    notice = [w.decode() for w in ls.alnum_words(ls.TEMPLATES["bsd"].encode())]
    t = ls.Template("bsd", ls.TEMPLATES["bsd"], {}, 80)
    off_grid = []
    for _ in range(5000):
        text = ["pad"] * r.randrange(9) + stretched(r, notice)
        words = [w.encode() for w in text]
        most = max(len(set(words[s : s + t.width]) & set(t.tokens)) for s in range(len(words)))
        got = t.windows(words, set(words))
        assert max((n for *_, n in got), default=0) == (most / len(t.tokens) if most >= t.need else 0)
        if got and not t.blocks(words, set(words)):
            off_grid.append(" ".join(text))
    assert off_grid  # the grid alone misses these
    assert [d.labels for d in ls.digest(docs_of([(1, off_grid[0])])).collect()] == ["bsd"]
