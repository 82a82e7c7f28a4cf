import random

import pytest

from lodestack.llm import ngram_join as nj


def brute(rows):
    def words(t):
        return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def family(n, seed, length=60, edits=3):
    r = random.Random(seed)
    base = [f"w{seed}x{r.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(length)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    r = random.Random(5)
    rows = [(None, "one two three four five six"), (1, None), (2, ""), (3, " \n\t "), (4, "Same Few"), (5, "same few"), (6, "one two three four five six"), (7, "ONE two three\nfour five six"), (7, "one two three four five six"), (8, "a")]
    k = 10
    shared = " ".join(f"common{i}" for i in range(30))
    for s in range(8):
        for t in family(r.randrange(2, 9), s):
            rows.append((k, t))
            k += 1
    for t in family(40, 99, 50, 8):  # copies around the threshold
        rows.append((k, t))
        k += 1
    for s in range(12):  # a passage that many documents share
        rows.append((k, " ".join(f"own{s}n{i}" for i in range(12)) + " " + shared))
        k += 1
    rows.append((k, "long " * 30000))
    rows.append((k + 1, "long " * 29000))
    return rows


@pytest.mark.parametrize("cap", [2000, 7])
def test_components_equal_brute_force(docs_of, cap):
    rows = corpus()
    got = sorted((tuple(r) for r in nj.near_copies(docs_of(rows), cap=cap).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_columns(docs_of):
    empty = docs_of([])
    assert nj.near_copies(empty).collect() == []
    kept = nj.representatives(docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "key"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_group_bound_never_loses_a_link():
    import numpy as np

    r = np.random.default_rng(1)
    base = [np.unique(r.integers(0, 2**60, 50).astype(np.uint64)) for _ in range(5)]
    sets = []
    for b in base:
        for _ in range(20):
            keep = b[r.random(len(b)) > 0.08]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**60, 2).astype(np.uint64)])))
    tg = nj.TokenGroups(sets, [b""] * len(sets), 80)
    label = np.arange(len(sets))
    tg.links(list(range(len(sets))), label)
    for i in range(len(sets)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if 180 * same >= 80 * (len(sets[i]) + len(sets[j])):
                assert label[i] == label[j]


def test_rows_that_share_an_id_are_judged_each(spark, docs_of):
    """An unrelated row of an id stays although another row of that id goes."""
    from lodestack.llm.ngram_join import representatives

    a = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"z{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, other), (2, other), (2, None), (3, a + " w40"), (4, other), (None, a), (5, "")]
    got = representatives(docs_of(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, a), (2, other), (2, other), (2, ""), (0, a), (5, "")])
    assert got[0].asDict().keys() == docs_of(rows).first().asDict().keys()
    plain = representatives(docs_of([(1, a), (2, a), (3, other)])).collect()
    assert {r["doc_id"] for r in plain} == {1, 3}


def test_range_blobs_are_small():
    """A slice's tokens of one hash range and their rows: about 21 and 11 bits each, and little more when written down."""
    import numpy as np

    from lodestack.llm.common import press, unpress

    r = np.random.default_rng(1)
    t, rows, ids = np.sort(r.integers(0, 1 << 40, 500_000)).astype(np.uint64), r.integers(0, 2000, 500_000).astype(np.uint32), np.arange(0, 4000, 2)
    blob = press(np.diff(t, prepend=np.uint64(0)), rows, np.diff(ids, prepend=np.int64(0)))
    assert len(blob) < 4.7 * len(t)
    back = unpress(blob, np.uint64, np.uint32, np.int64)
    assert (np.cumsum(back[0], dtype=np.uint64) == t).all() and (back[1] == rows).all() and (np.cumsum(back[2]) == ids).all()
    assert [len(x) for x in unpress(press(t[:0], rows[:0]), np.uint64, np.uint32)] == [0, 0]


def test_texts_stay_where_they_are(spark, docs_of):
    from lodestack.llm.common import cut

    docs = docs_of([(i, f"text {i}") for i in range(40)])
    reps = cut(spark.createDataFrame([(3, b"x"), (9, b"y")], "doc_id long, sid binary"), "reps")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent, met = nj._texts_of(docs, reps), nj._texts_of(docs, reps, sent=1)
        assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
        assert sorted(sent.collect()) == sorted(met.collect()) and sent.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
