import pytest

from lodestack.operators import graph, routing, state


def test_negative_limits_are_refused():
    with pytest.raises(ValueError, match="negative"):
        state.page_size("audit", -1)


def test_equal_versions_give_one_result(spark):
    base = spark.createDataFrame([(1, "a", 0)], "k int, v string, updated_at int")
    same = spark.createDataFrame([(1, "b", 5), (1, "c", 5)], "k int, v string, updated_at int")
    assert [r.v for r in state.upsert(base, same, ["k"]).collect()] == ["c"] == [r.v for r in state.upsert(base, same.orderBy("v"), ["k"]).collect()]


def test_turns_of_each_policy(spark):
    p = spark.createDataFrame([("a", 0, 9), ("b", 1, 3), ("c", 2, 3)], "name string, idx int, p50 int")
    turns = lambda policy, n=0: [r["name"] for r in routing.provider_order(p, policy, n).orderBy("turn").collect()]
    assert turns("priority") == ["a", "b", "c"] and turns("latency") == ["b", "c", "a"] and turns("round_robin", 4) == ["b", "c", "a"]


def test_deep_walks_keep_short_plans(spark):
    rows = [(f"n{i}", "room", f"l{i}", f"n{i - 1}" if i else None) for i in range(12)]
    nodes = spark.createDataFrame(rows, "node_id string, kind string, label string, parent_node_id string")
    out, _ = graph.traverse(nodes, "n0", 10)
    assert [(r.node_id, r.depth) for r in out.collect()] == [(f"n{i}", i) for i in range(11)]
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() < 20
