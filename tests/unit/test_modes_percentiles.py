"""Hybrid mode on a hand-made graph, and exact percentiles against sorted lists."""

import random

import pytest

from lodestack.operators import evaluation, modes


@pytest.fixture(scope="module")
def graph(spark):
    e = spark.createDataFrame([("Alpha", "x", ["c1"]), ("alpha beta", None, ["c2", "c3"]), ("Gamma", "z", ["c4"]), (None, "n", ["c9"])], "name string, description string, source_chunks array<string>")
    r = spark.createDataFrame([("alpha", "gamma", "links", "d", ["c7"]), (None, "gamma", "x", "", ["c8"])], "source string, target string, relation_type string, description string, source_chunks array<string>")
    return e, r


def rows(df):
    return {(r["query_id"], r["id"]): (round(r["score"], 6), r["legs"]) for r in df.collect()}


def test_hybrid(spark, graph):
    e, r = graph
    chunks = spark.createDataFrame([("c1", [1.0, 0.0]), ("c5", [0.6, 0.8]), ("c6", [-1.0, 0.0]), ("c0", None)], "id string, vector array<double>")
    q = spark.createDataFrame([(1, "Alpha", [1.0, 0.0]), (2, "beta ALPHA", None), (3, "zzz", [0.0, 1.0]), (4, "", None)], "query_id long, text string, vector array<double>")
    got = rows(modes.hybrid(q, chunks, e, r, 10))
    assert got == {
        (1, "c1"): (1.3, "both"), (1, "c5"): (0.6, "dense"), (1, "c2"): (0.9, "graph"), (1, "c3"): (0.9, "graph"), (1, "c4"): (0.8, "graph"),
        (2, "c2"): (1.0, "graph"), (2, "c3"): (1.0, "graph"), (2, "c1"): (0.9, "graph"), (2, "c4"): (0.72, "graph"),  # no vector: the graph alone
        (3, "c5"): (0.8, "dense"), (3, "c1"): (0.0, "dense"), (3, "c6"): (0.0, "dense"),
    }
    assert len(rows(modes.hybrid(q, chunks, e, r, 2))) == 6


def test_semantic_points(spark, graph):
    e, r = graph
    ep, rp = modes.entity_points(e, 8), modes.relation_points(r, 8)
    assert {x["id"] for x in ep.collect()} == {"alpha", "alpha beta", "gamma"} and [x["id"] for x in rp.collect()] == ["alpha|gamma|links"]
    own = {x["id"]: x["vector"] for x in ep.collect()}
    q = spark.createDataFrame([(1, "nothing", own["gamma"]), (2, "nothing", rp.first()["vector"])], "query_id long, text string, vector array<double>")
    got = {(x["query_id"], x["id"]): round(x["score"], 6) for x in modes.semantic_leg(q, ep).collect()}
    assert got[1, "c4"] == 1.0
    none = spark.createDataFrame([], "id string, vector array<double>")
    full = rows(modes.hybrid(q, none, e, r, 5, entity_points=ep, relation_points=rp))
    assert full[1, "c4"] == (1.0, "graph") and full[2, "c7"] == (0.9, "graph")


def test_percentiles_are_exact(spark):
    rnd = random.Random(4)
    data = [("a", rnd.expovariate(1) ** 5) for _ in range(3000)] + [("b", 7.0)] * 500 + [("b", 9.0)] + [("c", -1.5)] + [(None, float(i)) for i in range(11)] + [("d", None), ("a", float("nan")), ("e", 1e308), ("e", -1e308), ("e", 0.0)]
    df = spark.createDataFrame(data, "g string, v double")
    ps = (0.0, 0.5, 0.95, 1.0)
    want = {}
    for g in {g for g, _ in data}:
        s = sorted(v for k, v in data if k == g and v is not None and v == v)
        for p in ps:
            if s:
                want[g, p] = s[int((len(s) - 1) * p + 0.5)]
    got = {(r["g"], r["p"]): r["value"] for r in evaluation.percentiles(df, "g", "v", ps, ranked=20).collect()}
    assert got == want
    assert evaluation.percentiles(df.where("false"), "g", "v", ps).collect() == []
