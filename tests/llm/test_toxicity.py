import random
import zlib

import numpy as np

from lodestack.llm import toxicity as tox


def corpus(n=900):
    r = random.Random(4)
    syl = ["an", "the", "or", "in", "es", "er", "wh", "sh", "ti", "re"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randrange(20, 80))]
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(["idiot", "scum", "blorgwhan", "blorgthe", "blorger"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad) if i % 7 else None))
    return docs, labels


def test_held_out_accuracy_and_folds(spark, docs_of):
    docs, labels = corpus()
    lab = spark.createDataFrame([*labels, (None, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    rows = tox.digest(docs_of([*docs, (None, None), (None, "idiot"), (5000, "")]), lab).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    wrong = sum(r.predicted != truth[r.doc_id] for r in held)
    assert len(held) > 100 and wrong <= 0.03 * len(held)
    kept = tox.clean(docs_of(docs), lab)
    assert kept.columns == docs_of([]).columns and 0 < kept.count() < len(docs)


def test_no_labels_and_no_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tox.digest(docs_of([]), none).count() == 0
    r = {x.doc_id: x.predicted for x in tox.digest(docs_of([(1, "you stupid pathetic moron"), (2, "hello"), (3, None)]), none).collect()}
    assert r == {1: 1, 2: 0, 3: 0}


def test_correlated_voters_share_their_votes():
    r = np.random.default_rng(0)
    y = r.random(2000) < 0.3
    a = np.where(y, r.random(2000) < 0.6, r.random(2000) < 0.05)
    b = np.where(y, r.random(2000) < 0.6, r.random(2000) < 0.05)
    rows = [[v for v, on in ((0, a[i]), (1, a[i]), (2, b[i])) if on] for i in range(2000)]  # voter 1 copies voter 0
    post, info = tox.label_model(tox.Votes(rows, 3), y.astype(float))
    assert abs(info["share"][0] - 0.5) < 0.1 and info["share"][2] > 0.8
    assert ((post > 0.5) == y).mean() > 0.9


def test_a_repeated_id_does_not_flood_the_sample(spark, docs_of):
    from lodestack.llm import toxicity

    rows = [(3, f"text {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(4, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 60)], "doc_id long, toxic int")
    got = toxicity._sample(docs_of(rows), labels, 20_000).collect()
    assert len(got) <= 57 and len([r for r in got if r["text"].startswith("text")]) <= 1
