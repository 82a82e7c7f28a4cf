import random

from lodestack.llm import line_dedup as ld


def brute(docs):
    words = lambda x: [w for w in x.lower().replace("\t", " ").replace("\r", " ").split(" ") if w]
    places = []
    for i, t in docs:
        for p, x in enumerate((t or "").split("\n") if t is not None else []):
            w = words(x)
            if w:  # fewer than five words: the whole sequence as one token
                places.append(((i is None, i or 0, p), x, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
    out = []
    for i, t in docs:
        gone = []
        for p, x in enumerate(t.split("\n") if t is not None else []):
            w = words(x)
            if not w:
                continue
            s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            first = min(q for q, y, _ in places if y == x)
            here = (i is None, i or 0, p)
            if here > first or any(q < first and 180 * len(s & z) >= 80 * (len(s) + len(z)) for q, _, z in places):
                gone.append(p)
        out.append((i, len(t.split("\n")) if t is not None else 0, len(gone), ",".join(map(str, gone))))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(5, 40))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 7)):
            w = r.choice(base).split(" ")
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            lines.append(r.choice([" ".join(w), " ".join(w), "  ".join(w) + "\r", "few words only", "the the the the the the the"]))
        docs.append((i + 100, "\n".join(lines)))
    return docs


def test_equals_brute_force(docs_of, odd):
    docs = [*[x for x in odd if x[0] != 4], (4, "alpha beta gamma delta epsilon zeta"), *corpus()]
    assert sorted((tuple(r) for r in ld.digest(docs_of(docs)).collect()), key=str) == brute(docs)


def test_texts(docs_of):
    docs = [(1, "one two three four five\nshort\n\nnine eight seven six five"), (2, "one two three four five"), (3, "keep\nOne two three  four five\nshort"), (4, ""), (5, None), (None, "one two three four five\nx")]
    out = ld.dedup(docs_of(docs))
    assert out.columns == docs_of([]).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: docs[0][1], 3: "keep", 4: "", 5: None, None: "x"}
    assert {r.doc_id: r.text for r in ld.dedup(docs_of(docs), drop_emptied=False).collect()}[2] == ""


def test_empty_and_repeated_rows(docs_of):
    assert ld.digest(docs_of([])).count() == 0
    same = [(1, "a b c d e f"), (1, "a b c d e f")]
    assert [r.n_removed for r in ld.digest(docs_of(same)).collect()] == [0, 0]


def test_no_python_in_the_plan(docs_of):
    plan = ld.digest(docs_of([(1, "a b c d e f\na b c d e f")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def phrased():
    """Lines of a few common phrases with words of their own, in families of near copies: most tokens of a line are frequent."""
    r = random.Random(9)
    phrases = [" ".join(f"p{k}x{j}" for j in range(r.choice([6, 9, 14]))) for k in range(3)]
    lines = [" ".join(r.sample([*phrases, f"own{i} a{i} b{i}", f"c{i % 7} d{i % 5}"], r.choice([2, 3, 4]))) for i in range(90)]
    return [(i, "\n".join(r.choice(lines) for _ in range(3))) for i in range(70)]


def test_frequent_tokens_lose_no_line(docs_of):
    assert sorted((tuple(x) for x in ld.digest(docs_of(phrased()), arrow=True).collect()), key=str) == brute(phrased())


def test_arrow_batches_equal_brute_force(docs_of, odd, monkeypatch):
    monkeypatch.setattr(ld.Tokens, "MOST", 3000)  # several slices
    docs = [*[x for x in odd if x[0] != 4], (4, "alpha beta gamma delta epsilon zeta"), *corpus()]
    docs += [(900, "\n" * 70000 + "Les\u00a0amis\t d\u00e9j\u00e0 vu\r"), (901, "les\u00a0amis D\u00c9J\u00c0   VU\n\n"), (902, "one two three four five\n\none two three four five six"), (903, " \n")]
    got = ld.digest(docs_of(docs), arrow=True).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(docs)


def test_shuffled_joins_give_the_same(docs_of, monkeypatch):
    for name, value in (("BROADCAST", 0), ("BROADCAST_ROWS", 0), ("HOT", 20)):
        monkeypatch.setattr(ld, name, value)
    assert sorted((tuple(x) for x in ld.digest(docs_of(corpus()), arrow=True).collect()), key=str) == brute(corpus())


def test_arrow_empty_table_and_extra_columns(docs_of):
    assert ld.digest(docs_of([]), arrow=True).count() == 0
    out = ld.dedup(docs_of([(1, "a b\na  B"), (2, None)]).withColumnRenamed("key", "pos"), arrow=True)
    assert "pos" in out.columns and {r.doc_id: r.text for r in out.collect()} == {1: "a b", 2: None}


def test_filters_lose_no_pair_at_the_threshold(spark):
    """Many lines just above and below it, of 5 to 150 words: removed as brute force does, in both forms."""
    r = random.Random(8)
    docs = []
    for i in range(40):
        base = [f"w{r.randrange(60)}" for _ in range(r.randrange(5, 150))]
        lines = []
        for _ in range(4):
            w = list(base)
            for _ in range(max(1, len(w) // r.choice([40, 60, 90]))):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randrange(2)] = [f"x{r.randrange(10**6)}"] * r.randrange(2)
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    want = brute(docs)
    assert 30 < sum(x[2] for x in want) < 110  # of 160
    for arrow in (False, True):
        got = ld.digest(spark.createDataFrame(docs, "doc_id long, text string"), arrow=arrow)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_rare_tokens_are_joined_once(docs_of, monkeypatch):
    """Tokens of few lines don't go through the first round, and where the bound lies changes no result."""
    asked, pairs = [], ld._pairs
    monkeypatch.setattr(ld, "_pairs", lambda left, right, percent: asked.append(left.count()) or pairs(left, right, percent))
    two = [(1, "one two three four five six seven eight nine ten eleven"), (2, "one two three four five six seven eight nine ten eleven twelve")]
    assert [r.n_removed for r in ld.digest(docs_of(two)).orderBy("doc_id").collect()] == [0, 1]
    assert asked[0] == 0 < asked[1]
    for few in (1, 100):
        monkeypatch.setattr(ld, "FEW", few)
        assert sorted((tuple(x) for x in ld.digest(docs_of(phrased())).collect()), key=str) == brute(phrased())
