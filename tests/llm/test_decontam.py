import re

from lodestack.llm import decontam as d
from lodestack.llm.common import alnum_words


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    win = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        if i is not None:
            for k in range(len(w) - n + 1 if n else 0):
                win.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in win:
                    hit |= set(range(k, k + n))
                    ids |= win[g]
        out.append((i, len(w), len(hit), len(ids), d.sha(sorted(ids)), bool(hit)))
    return sorted(out, key=str)


P = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, P), (1, P), (20, "short item"), (3, None), (4, ""), (None, "lost words of no item at all here in ten"), (5, "the " * 15), (9, "Éclair d'été")]


def test_equals_brute_force(spark, docs_of, odd):
    docs = [*odd, (10, f"x {P.upper()}, y"), (11, "ten nine eight"), (12, P.replace("six", "6")), (13, "SHORT-item short  item"), (14, "the " * 40), (15, f"{P} {P}"), (16, "short\nitem"), (17, "l'éclair d'été"), (18, " ".join(P.split()[:10]))]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in d.digest(docs_of(docs), bench).collect()), key=str) == brute(docs, ITEMS)
    assert sorted((tuple(r) for r in d.digest(docs_of(docs), bench, block_words=20).collect()), key=str) == brute(docs, ITEMS)  # many blocks
    kept = d.clean(docs_of(docs), bench)
    assert kept.columns == docs_of([]).columns and kept.count() == sum(not r[5] for r in brute(docs, ITEMS))


def test_empty_sides(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.digest(docs_of([]), none).count() == 0
    r = d.digest(docs_of([(1, P)]), none).first()
    assert (r.n_words, r.n_hit, r.contaminated) == (12, 0, False) and r.items_sha256 == d.sha([])


def test_bytes_words():
    assert alnum_words("Ab-c1_É".encode()) == [b"ab", b"c1", "É".encode()]


def test_proximity(spark, docs_of):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = docs_of([(1, "red x green y blue"), (2, "red x y z green blue"), (3, "blue green red"), (4, "red green")])
    near = d.find(docs, bench, slop=2)(docs).where("size(matches.spans) > 0")
    assert [r.doc_id for r in near.collect()] == [1]
