"""Conversations taken in with all their rows, against hand-made cases."""

import hashlib
import json

from lodestack.operators import ingest

SOURCES = "source_path string, format string, wing string, hall string, room string"
MESSAGES = "source_id string, role string, content string, turn_index int, wing int"  # a clashing column
LONG = "always run the tests before a commit"


def taken(spark, sources, messages, at=1):
    return ingest.records(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(sources, SOURCES), "p1", at)


def digest(*parts):
    return hashlib.sha256(":".join(parts).encode()).hexdigest()[:32]


def test_nodes(spark):
    rows = [("a", "claude", "W 1", "H", "R"), ("b", "claude", None, None, "R"), ("c", "claude", "W 1", "H", None), ("d", "claude", None, None, None), ("e", "claude", "W 1", None, "R")]
    got = {r.node_id: r for r in taken(spark, rows, [])["nodes"].collect()}
    drawer, closet, own = "drawer:w_1-" + digest("v2", "p1", "drawer", "W 1"), "closet:h-" + digest("v2", "p1", "closet", "W 1", "H"), "drawer:p1-" + digest("v2", "p1", "drawer", "p1")
    rooms = {"room:r-" + digest("v2", "p1", "room", "W 1", "H", "R"): closet, "room:r-" + digest("v2", "p1", "room", "p1", "R"): own, "room:r-" + digest("v2", "p1", "room", "W 1", "R"): drawer}
    assert {k: r.parent_node_id for k, r in got.items()} == {drawer: None, own: None, closet: drawer, **rooms}
    assert (got[closet].label, got[closet].hall, got[closet].room) == ("H", "H", None)


def test_lessons_by_source(spark):
    rows = [("a", "x", None, None, None), ("b", "x", None, None, None)]
    said = [("a", "user", LONG, i, 0) for i in range(3)] + [("b", "user", LONG, i, 0) for i in range(2)] + [("a", "user", "once", 5, 0), ("b", "user", "once", 6, 0), ("stray", "user", "no", 0, 0), ("stray", "user", "no", 1, 0)]
    got = taken(spark, rows, said)
    (lesson,) = got["lessons"].collect()  # 'once' stands once in each source; of the shared lesson the last source counts
    assert (lesson.canonical_text, lesson.source_transcript_path, lesson.occurrence_count) == (LONG, "b", 2)
    assert {r.source_path: r.message_count for r in got["sources"].collect()} == {"a": 4, "b": 3}
    many = [("a", "user", f"{LONG} {k}", 10 * k + i, 0) for k in range(12) for i in range(2 + (k == 11))]
    assert [r.canonical_text[-2:].strip() for r in taken(spark, rows, many)["lessons"].orderBy("occurrence_count", "canonical_text").collect()][-1] == "11"
    assert taken(spark, rows, many)["lessons"].count() == 8


def test_chunks_and_audit(spark):
    rows = [("a", "x", None, "H", None), ("a", "x", None, None, None), ("empty", "x", None, None, None)]
    got = taken(spark, rows, [("a", "user", "one", 0, 0), ("a", "tool", None, 1, 0)])
    chunks = got["chunks"].orderBy("chunk_index").collect()
    assert [(c.id, c.content, c.heading_hierarchy, c.signature, c.symbol) for c in chunks] == [("a:0", "[turn:0][role:user]\none", ["conversation", "p1", "H"], "H", None), ("a:1", "[turn:1][role:tool]\n", ["conversation", "p1", "H"], "H", None)]
    assert {json.loads(r.params)["path"]: json.loads(r.params)["ingested_chunks"] for r in got["audit"].collect()} == {"a": 2, "empty": 0}


def test_nothing(spark):
    assert all(x.count() == 0 for x in taken(spark, [], []).values())


def test_commit_again(spark, tmp_path):
    first = taken(spark, [("a", "x", "W", None, None), ("b", "x", "W", None, None)], [("a", "user", LONG, i, 0) for i in range(4)] + [("b", "user", "hi", 0, 0)])
    ingest.commit(first, str(tmp_path), 4)
    again = taken(spark, [("a", "x", "V", None, None)], [("a", "user", "new", 0, 0)], at=2)
    for _ in range(2):  # the second time as after a failure
        tables = ingest.commit(again, str(tmp_path), 4)
    assert sorted((r.id, r.content[-3:]) for r in tables["chunks"].read().collect()) == [("a:0", "new"), ("b:0", "\nhi")]
    assert {r.source_path: (r.wing, r.message_count, r.updated_at) for r in tables["sources"].read().collect()} == {"a": ("V", 1, 2), "b": ("W", 1, 1)}
    assert sorted(r.label for r in tables["nodes"].read().collect()) == ["V", "W"]
    assert tables["lessons"].read().count() == 1
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 4
