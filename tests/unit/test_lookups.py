from datetime import datetime

from pyspark.sql import functions as F

from lodestack.operators import catalog, graph, routing, state


def test_graph_view_leaves_out_halves(spark):
    e = spark.createDataFrame([("a", "x"), ("b", None), (None, "x")], "name string, entity_type string")
    r = spark.createDataFrame([("a", "b", None), ("a", None, "t"), (None, "b", "t")], "source string, target string, relation_type string")
    v = graph.view(e, r)
    assert sorted(map(tuple, v.collect()), key=str) == [("edge", "a", "b", "relation"), ("node", "a", None, "x"), ("node", "b", None, "entity")]
    assert tuple(graph.view_counts(v).first()) == (2, 1)
    assert tuple(graph.view_counts(graph.view(e.limit(0), r.limit(0))).first()) == (0, 0)


def test_lookups(spark):
    profiles = spark.createDataFrame([("p", "{}"), ("q", "{1}")], "project_id string, profile_json string")
    assert [r[0] for r in state.latest_profile(profiles, "q").collect()] == ["{1}"]
    assert state.latest_profile(profiles, "z").count() == 0
    versions = spark.createDataFrame([(3,), (None,), (7,)], "version int")
    assert state.schema_version(versions).first()[0] == 7 and state.schema_version(versions.limit(0)).first()[0] == 0
    families = spark.createDataFrame([("a", "docs"), ("a", "unsafe-tools"), ("b", "docs"), ("c", None)], "project_id string, family string")
    assert dict(map(tuple, state.effective_risk(families).collect())) == {"a": "high", "b": "medium", "c": "medium"}


def test_enabled_under_both_roots_and_semantic_hits(spark):
    enabled = spark.createDataFrame([("t2", "/real"), ("t1", "/link"), ("t2", "/link"), ("t3", "/other")], "tool_id string, project_root string")
    assert [r[0] for r in catalog.enabled_ids(enabled, "/real", "/link").collect()] == ["t1", "t2"]
    tools = spark.createDataFrame([("t1", "one"), ("t2", "two")], "id string, name string")
    vectors = spark.createDataFrame([("t1", [1.0, 0.0]), ("t2", [0.0, 1.0]), ("gone", [1.0, 0.1])], "id string, vector array<double>")
    assert [(r["id"], r["state"]) for r in catalog.semantic(tools, enabled, vectors, [1.0, 0.0], 5).collect()] == [("t1", "enabled")]


def test_availability_after_a_cooldown(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    calls = spark.createDataFrame([("a", 1, at(0), True), ("a", 2, at(1), False), ("b", 1, at(0), True), ("c", 1, at(0), True), ("c", 2, at(1), True)], "p string, i int, ts timestamp, bad boolean")
    runs = routing.failure_runs(calls, "p", F.col("bad"), F.col("ts"), F.col("i"))
    now = lambda s: {r["p"]: r["available"] for r in routing.availability(runs, "p", "ts", F.lit(at(s)), "ts", "i").collect()}
    assert now(4) == {"a": True, "b": False, "c": False}
    assert now(5) == {"a": True, "b": True, "c": False}
    assert now(16) == {"a": True, "b": True, "c": True}
