import random

import pytest

from lodestack.llm import line_dedup as ld

SHORT = ["Les.", "les.\r", "All rights reserved.", "all  rights\treserved.", "今日はとても良い天気です", "a b c d", "A b c  d", "d c b a", "", " ", "a b c d e"]


def words(x):
    return [w for w in x.lower().replace("\t", " ").replace("\r", " ").split(" ") if w]


def brute(docs):
    """Line numbers that go: a line of fewer than five words has its whole word sequence as its one token."""
    places = []
    for i, t in docs:
        for p, x in enumerate(t.split("\n") if t is not None else []):
            w = words(x)
            places.append(((i is None, i or 0, p), x, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    out = []
    for i, t in docs:
        gone = []
        for p, x in enumerate(t.split("\n") if t is not None else []):
            here = (i is None, i or 0, p)
            s = next(z for q, _, z in places if q == here)
            first = min(q for q, y, _ in places if y == x)
            if s and (here > first or any(q < first and 180 * len(s & z) >= 80 * (len(s) + len(z)) for q, _, z in places)):
                gone.append(p)
        out.append((i, len(t.split("\n")) if t is not None else 0, len(gone), ",".join(map(str, gone))))
    return sorted(out, key=str)


def test_short_lines_equal_brute_force(docs_of):
    r = random.Random(5)
    long = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(5, 20))) for _ in range(15)]
    docs = [(i, "\n".join(r.choice(SHORT + long) for _ in range(r.randrange(1, 6)))) for i in range(40)]
    docs += [(None, "Les.\nonly here"), (50, None), (51, "")]
    got = sorted((tuple(x) for x in ld.digest(docs_of(docs), short=True).collect()), key=str)
    assert got == brute(docs)


def test_pipeline_takes_short_repeats(spark, docs_of):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = [(1, "Les.\nkeep one"), (2, "keep two\nLES. "), (3, "les."), (4, "今日はとても良い天気です\n"), (5, "x\n今日はとても良い天気です")]
    got = {x.doc_id: x.text for x in pipeline.lines(spark, docs_of(docs), "").collect()}
    assert got == {1: docs[0][1], 2: "keep two", 4: docs[3][1], 5: "x"}
