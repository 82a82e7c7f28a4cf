"""The inverted-list index against the exact search, sparse scores against BM25, vectors that can't be compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import fts_tokens
from lodestack.operators import ann, retrieval, sparse


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [float("nan")] * 16), (9003, [0.0] * 16), (9004, [None] + [1.0] * 15)]
    return spark.createDataFrame(rows + odd, "id long, vector array<double>")


def exact(rows, queries, k):
    r = [(x["id"], np.array(x["vector"])) for x in rows.where("id < 9000").collect()]
    ids, m = np.array([i for i, _ in r]), np.array([v / np.linalg.norm(v) for _, v in r])
    out = {}
    for q in queries.collect():
        v = np.array(q["vector"])
        s = np.round(m @ (v / np.linalg.norm(v)), 6)
        out[q["query_id"]] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:k]]
    return out


def hits(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def test_lists(spark, clustered, tmp_path):
    q = clustered.where("id % 50 = 0 and id < 9000").select(F.col("id").alias("query_id"), "vector")
    true = exact(clustered, q, 10)
    assert hits(retrieval.dense_batch(clustered, q, 10)) == true
    index = ann.Lists.ensure(clustered, str(tmp_path / "ivf"), lists=40)
    assert index.note["probe"] < 40 and index.note["held"] >= 0.95 and index.rows().count() == 1500
    got = hits(index.search(q, 10))
    assert np.mean([len(set(got[i]) & set(true[i])) / 10 for i in true]) >= 0.9
    assert hits(index.search(q, 10, probe=40)) == true  # all lists: the exact answer
    r = ann.recall(index.search(q, 10), retrieval.dense_batch(clustered, q, 10)).first()
    assert r["queries"] == 30 and r["recall"] >= 0.9
    again = ann.Lists.ensure(clustered, str(tmp_path / "ivf"))
    assert again.note == index.note
    with pytest.raises(ValueError, match="16 dimensions"):
        ann.Lists.ensure(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), str(tmp_path / "ivf"))
    plan = index.rows([1, 2])._jdf.queryExecution().toString()
    assert "list" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_empty_and_one(spark, tmp_path):
    none = spark.createDataFrame([], "id string, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("null", None)], "query_id string, vector array<float>")
    assert ann.Lists.build(none, str(tmp_path / "a")).search(q.where("false"), 3).collect() == []
    one = ann.Lists.build(spark.createDataFrame([("x", [1.0, 1.0])], "id string, vector array<float>"), str(tmp_path / "b"))
    assert [(r["query_id"], r["id"], r["rank"]) for r in one.search(q, 3).collect()] == [("q", "x", 1)]


def test_vectors_that_cannot_be_compared(spark, clustered):
    q = clustered.where("id in (1, 9001, 9002)").select(F.col("id").alias("query_id"), "vector")
    assert {r["query_id"] for r in retrieval.dense_batch(clustered, q, 3).collect()} == {1}
    found = retrieval.dense_search(clustered, [1.0] * 16, None, digits=6).collect()
    assert {r["id"] for r in found} == {*range(1500), 9003} and not np.isnan([r["score"] for r in found]).any()


def test_sparse_is_bm25(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c"), (3, "A a a d é"), (4, ""), (5, None), (6, "c c c c b")], "id long, content string")
    tokens = fts_tokens("content")
    vectors = sparse.documents(docs, tokens)
    asked = sparse.queries(spark.createDataFrame([(1, "B a"), (2, "zzz"), (3, "c c"), (4, None)], "query_id long, content string"), tokens, sparse.inverse(vectors, docs.count()))
    got = hits(sparse.search(vectors, asked, 10, digits=6))
    filled = docs.withColumn("content", F.coalesce("content", F.lit("")))
    for i, text in ((1, "b a"), (3, "c")):
        assert got[i] == [(r["id"], r["score"]) for r in retrieval.bm25(filled, text, 10, tokens, every=False, digits=6).collect()]
    assert set(got) == {1, 3}
    dims = sparse.dimensions(spark.createDataFrame([("b a zzz c",)], "content string"), tokens)
    assert {r["dim"]: round(r["idf"], 9) for r in sparse.inverse_of(docs, tokens, dims).collect()}.items() <= {r["dim"]: round(r["idf"], 9) for r in sparse.inverse(vectors, docs.count()).collect()}.items()
    assert hits(sparse.scan(docs, tokens, asked, 10)) == got and hits(sparse.scan(docs, tokens, asked.where("false"), 10)) == {}
    assert hits(sparse.scan(docs, tokens, asked, 2)) == hits(sparse.search(vectors, asked, 2, digits=6))
    assert all(len(v) <= 2 for v in hits(sparse.search(vectors, asked, 2)).values())


def test_pair_has_a_threshold_on_the_dense_side_only(spark):
    d = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.1), (2, 10, 0.5)], "query_id long, id long, score double")
    s = spark.createDataFrame([(1, 11, 5.0), (1, 12, 15.0)], "query_id long, id long, score double")
    got = hits(sparse.pair(d, s, 5, threshold=0.3, digits=6))
    assert got == {1: [(10, 0.63), (12, 0.225), (11, 0.15)], 2: [(10, 0.35)]}


def test_scores_are_held_by_tiles():
    """Many queries times a whole batch of rows: what is held at once does not grow with either, the rows are those of all scores."""
    import tracemalloc

    rng = np.random.default_rng(3)
    q, x, ids = rng.normal(size=(3000, 8)), rng.normal(size=(10_000, 8)), rng.permutation(10_000)
    best = retrieval.Best(len(q), 3)
    tracemalloc.start()
    best.products(range(len(q)), q, ids, x, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all scores are 240 MB
    for i in (0, 1023, 1024, 2999):
        s = np.round(q[i] @ x.T, 2)
        assert best.held[i] == [(float(s[j]), int(ids[j])) for j in np.lexsort((ids, -s))[:3]]
    assert ann.nearest(x, q[:50]).tolist() == np.argmax(x @ q[:50].T, 1).tolist() and len(ann.nearest(x[:0], q)) == 0
