"""Every count of the audit against each order applied to the documents one by one."""

import re
from collections import defaultdict
from itertools import permutations

from lodestack.llm import filter_audit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(docs, labels):
    """(part, order, step) -> counts; docs: (doc_id, text, lang), labels: (doc_id, quality, toxic)."""
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            every = alive
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if r[1][f]]
                alive = [r for r in alive if not r[1][f]]
                fail = sum(r[1][f] for r in every)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in every)
                out[part, "".join(order), step] = [len(alive), len(gone), fail - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(t, i, lang, 1, 2) for i, t, lang in docs], "text string, doc_id long, lang string, failed int, part int")
    got = filter_audit.digest(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in got}) == len(got)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*COLUMNS, "shapley")) for r in got}


def test_all_orders(spark):
    long = " ".join(f"word{i}" for i in range(120))
    few = " ".join(f"w{i % 20}" for i in range(120))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long + " $", "en"), (4, few, "en"), (5, few + " #", "de"), (6, None, "en"), (7, "", "de"), (8, " \n\t\x0b ", None),
        (9, "SHOUT " * 30, "en"), (10, long.upper(), ""), (None, long, "en"), (None, None, None), (11, "a|b " * 200_000, "fr"), (12, "é " * 99 + "é", "fr"), (13, "x" * 9 + "X", "fr"), (14, few, "en"), (15, "日本 " + long, "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (9, None, 1), (14, 0, 0), (99, 1, 1), (None, 1, 1), (14, 1, 0)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    only = audited(spark, [(1, "short", None)], [])
    assert len(only) == 600 and only == brute([(1, "short", None)], [])


def test_states_are_shared(spark):
    """32 sets of filters, of which the full one has no edge: 80 edges a part, whatever the number of orders."""
    rows = spark.createDataFrame([("en", k, k % 3 == 0, k % 5 == 0) for k in range(32)], "part string, failed int, good boolean, toxic boolean")
    e = filter_audit.edges(rows, 5).collect()
    assert len(e) == len({(r["state"], r["filter"]) for r in e}) <= 80
    for r in e:
        here = [k for k in range(32) if not k & r["state"]]
        assert (r["here"], r["removed"]) == (len(here), sum(k >> r["filter"] & 1 for k in here))
