import pytest

from lodestack.functions import text as t
from lodestack.operators import catalog, evaluation, graph, retrieval, routing, state, transcripts


def test_entity_names():
    for raw, want in [("  rust   language ", "Rust Language"), ("API", "API"), ('"the cat" of it.', 'The Cat" of it'), ("", ""), ("...", ""), ("go", "go")]:
        assert t.normal_entity(raw) == want


def test_merge_and_search(spark):
    e = spark.createDataFrame([("Qdrant", "db", "Vector database", ["a.md:0"], 0), ("qdrant", "store", "Supports cosine similarity", ["b.md:0"], 1), ("Tokio", "library", "", ["c"], 2), ("QDRANT", "db", "database", ["a.md:0"], 3)], graph.ENTITY + ", position int")
    m = {r.name.lower(): r for r in graph.merge_entities(e).collect()}
    assert m["qdrant"].description == "Vector database; Supports cosine similarity" and m["qdrant"].source_chunks == ["a.md:0", "b.md:0"] and m["qdrant"].entity_type == "db" and m["qdrant"].name == "QDRANT"
    r = spark.createDataFrame([("Tokio", "Rust", "implemented_in", "", 1.0, ["d:0"], 0), ("tokio", "RUST", "Implemented_In", "", 1.0, ["e:0"], 1)], graph.RELATION + ", position int")
    assert graph.merge_relations(r).count() == 1
    names = spark.createDataFrame([("rust",)], "name string")
    assert graph.neighbours(r, names).collect()[0].other == "tokio"
    kept, rels = graph.remove_chunk(e.drop("position"), r.drop("position"), "c")
    assert kept.count() == 3 and rels.count() == 2
    found = graph.term_search(e.select("name").distinct(), "tok qdrant", 3).orderBy("rank").collect()
    assert found[0].name == "Tokio" and len(found) == 3
    ents, rel = graph.parse_extraction('```json\n{"entities":[{"name":"A","type":"x"},{"type":"y"}],"relations":[{"source":"A","target":"B"}]}\n```', "c:0")
    assert len(ents) == 1 and rel[0]["weight"] == 1.0 and graph.parse_extraction("nonsense", "c") == ([], [])


def test_graph_scores_union_and_legacy(spark):
    e = spark.createDataFrame([("A", "t", "", ["c1"]), ("B", "t", "", ["c2"])], graph.ENTITY)
    r = spark.createDataFrame([("A", "B", "r", "", 1.0, ["c3"])], graph.RELATION)
    ranked = spark.createDataFrame([("A", 0)], "name string, rank int")
    semantic = spark.createDataFrame([("c9", 0.5), ("c1", 0.2)], "id string, score double")
    got = {x.id: round(x.score, 3) for x in retrieval.graph_scores(e, r, ranked, semantic).collect()}
    assert got == {"c1": 1.0, "c2": 0.8, "c3": 0.8, "c9": 0.5}
    assert "c9" not in {x.id for x in retrieval.graph_scores(e, r, ranked, semantic, legacy=True).collect()}


def test_transcripts(spark):
    x = '[{"role":"User","content":[{"type":"text","text":"Hello"},{"type":"text","text":"world"}]},{"role":"bot","content":{"type":"output_text","text":"Structured reply"}}]'
    assert [(m["role"], m["content"]) for m in transcripts.parse(x, "openai")] == [("user", "Hello world"), ("unknown", "Structured reply")]
    lines = '{"role":"user","content":"a"}\n\n{"role":"assistant","content":null}'
    assert [(m["turn_index"], m["content"]) for m in transcripts.parse(lines, "jsonl")] == [(0, "a"), (2, "")]
    with pytest.raises(ValueError):
        transcripts.parse("{broken", "openai")
    ex = spark.createDataFrame([("s", "openai", x)], "source_id string, format string, payload string")
    assert transcripts.parsed(ex).count() == 2


def test_motifs_round_trip(spark):
    long = "We should rotate the issuer config in staging."
    m = spark.createDataFrame([("assistant", long, 0), ("user", "hi", 1), ("assistant", long, 2), ("user", "ok", 3), ("user", "ok", 4)], transcripts.MESSAGES)
    found = transcripts.motifs(m).collect()
    assert [(r.canonical_text, r.occurrence_count, r.turn_indexes) for r in found] == [("We should rotate the issuer config in staging.", 2, [0, 2]), ("ok", 2, [3, 4])]
    turns, kept = transcripts.compress(m, 2, 70)
    assert kept.count() == 1 and turns.where("kind = 'motif'").count() == 2
    assert [tuple(r) for r in transcripts.expand(turns, kept).collect()] == [(r[0], r[1], r[2]) for r in m.orderBy("turn_index").collect()]
    with pytest.raises(Exception, match="unknown motif"):
        transcripts.expand(turns, kept.where("false")).collect()
    assert transcripts.lessons(transcripts.motifs(m), "p").count() == 1


def test_upsert_pages_and_cursor(spark):
    table = spark.createDataFrame([(1, "a", 10, 10), (2, "b", 10, 10)], "k int, v string, created_at int, updated_at int")
    new = spark.createDataFrame([(2, "x", 20, 20), (2, "y", 30, 30), (3, "z", 30, 30)], table.schema)
    got = {r.k: (r.v, r.created_at) for r in state.upsert(table, new, ["k"], keep_first=["created_at"]).collect()}
    assert got == {1: ("a", 10), 2: ("y", 10), 3: ("z", 30)}
    audit = spark.range(120).select("id")
    p = state.page(audit, "audit", 50)
    assert p.total == 120 and p.next_cursor and [r.id for r in p.rows.limit(2).collect()] == [119, 118]
    q = state.page(audit, "audit", 50, state.page(audit, "audit", 50, p.next_cursor).next_cursor)
    assert q.rows.count() == 20 and q.next_cursor is None
    with pytest.raises(ValueError):
        state.page(audit, "audit", 501)
    with pytest.raises(ValueError):
        state.decode_cursor("!!")
    assert state.decode_cursor(state.encode_cursor(7)) == 7 and state.page_size("diary") == 20


def test_diary(spark):
    d = spark.createDataFrame([("p", "2026-04-08", " focused ", ["Release ", "auth", "release"], "Cut the release"), ("p", "2026-04-09", "", [], "nothing"), ("p", "2026-04-31", None, ["x"], "calendar-like")], "project_id string, entry_date string, mood string, tags array<string>, content string")
    e = state.diary_entry(d).withColumn("updated_at", __import__("pyspark").sql.functions.lit(1))
    rows = {r.entry_date: r for r in e.collect()}
    assert rows["2026-04-08"].tags == ["release", "auth"] and rows["2026-04-08"].mood == "focused" and rows["2026-04-09"].mood is None
    assert [r.entry_date for r in state.diary_search(e, "release").collect()] == ["2026-04-08"]
    assert [r.entry_date for r in state.diary_search(e, "ALEND", like=True).collect()] == ["2026-04-31"]
    with pytest.raises(ValueError):
        state.date_range(e, "2026-05-01", "2026-04-01")
    with pytest.raises(Exception, match="bad date"):
        state.diary_entry(d.limit(1).withColumn("entry_date", __import__("pyspark").sql.functions.lit("2026-13-01"))).collect()


def test_navigation(spark):
    n = spark.createDataFrame([("d", "drawer", "D", None), ("c", "closet", "C", "d"), ("r", "room", "R", "c"), ("x", "drawer", "X", None), ("y", "closet", "Y", "r")], "node_id string, kind string, label string, parent_node_id string")
    seen, tunnels = graph.traverse(n, "r", 2, tunnels=spark.createDataFrame([("t1", "c", "r"), ("t2", "r", "x")], "tunnel_id string, from_node_id string, to_node_id string"))
    assert [(r.node_id, r.depth) for r in seen.collect()] == [("r", 0), ("c", 1), ("y", 1), ("d", 2)]
    assert [r.tunnel_id for r in tunnels.collect()] == ["t1"]
    assert [r.node_id for r in graph.parent_violations(n).collect()] == ["y"]


def test_catalog(spark):
    cols = "id string, name string, type string, languages array<string>, tags array<string>, description string, when_to_use string, what_it_finds string, risk_level string, source string"
    tools = spark.createDataFrame([("a", "cargo audit", "cli", ["rust"], ["security"], "audit crates", "", "", "low", "catalog"), ("b", "ruff", "cli", ["python"], [], "lint audit", "", "", "low", "user"), ("c", "any", "mcp", [], [], "x", "", "", "high", "catalog")], cols)
    enabled = spark.createDataFrame([("a", "cl", "/p")], "tool_id string, cli string, project_root string")
    s = catalog.suggest(tools, enabled, 10, ["rust"], cli="cl", root="/p").collect()
    assert [(r.id, r.grouping) for r in s] == [("a", "enabled")]
    assert catalog.suggest(tools, enabled, 10, tool_type="mcp").count() == 1
    assert catalog.search(tools, "audit", 5).first().id in ("a", "b")
    assert {r.id for r in catalog.remove_user_tools(tools, ["a", "b"]).collect()} == {"a", "c"}
    inv = spark.createDataFrame([("a", "/bin/a", "1")], "binary_name string, path string, version string")
    assert {r.id: r.state for r in catalog.full_info(tools, inv).collect()} == {"a": "installed", "b": "available", "c": "available"}


def test_routing_and_health(spark):
    q = spark.createDataFrame([("Search this",), ("please RUN it",), ("hello",)], "request string")
    assert [r.route for r in routing.routed(q).collect()] == ["retrieval", "execution", "default"]
    a = spark.createDataFrame([("p", "k", "high"), ("p", "z", "high"), ("p", "z", "low")], "project_id string, action_key string, risk_level string")
    known = spark.createDataFrame([("p", "k", "forever", True)], "project_id string, action_key string, scope string, approved boolean")
    assert sorted(r.decision for r in routing.approved(a, known).collect()) == ["allow", "deny", "forever"]
    p = spark.createDataFrame([(0, 30.0), (1, 10.0), (2, 20.0)], "idx int, p50 double")
    assert [r.idx for r in routing.provider_order(p, "round_robin", 4).collect()] == [1, 2, 0]
    assert [r.idx for r in routing.provider_order(p, "latency").collect()] == [1, 2, 0]


def test_keyword_dense_and_fusion(spark):
    ch = spark.createDataFrame([("a", "Routing memory search"), ("b", "nothing"), ("c", "routing only")], "id string, content string")
    got = retrieval.keyword_search(ch, "routing memory", 5).collect()
    assert [(r.id, r.score) for r in got] == [("a", 1.0), ("c", 0.5)]
    assert retrieval.keyword_search(ch, "  ", 5).count() == 0
    v = retrieval.embedded(spark.createDataFrame([("x", "alpha beta"), ("y", "pgvector search"), ("z", "cooking")], "id string, content string"), "content", dims=32)
    assert retrieval.dense_search(v, retrieval.embed("pgvector search", 32), 1).first().id == "y"
    d = spark.createDataFrame([("a", 1.0)], "id string, score double")
    s = spark.createDataFrame([("b", 5.0)], "id string, score double")
    assert [(r.id, round(r.score, 2)) for r in retrieval.fuse(d, s, 5).collect()] == [("a", 0.7), ("b", 0.15)]
    assert [(r.id, round(r.score, 2)) for r in retrieval.boost(d, d, 5).collect()] == [("a", 1.3)]


def test_quality(spark):
    f = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id int, rank int")
    q = evaluation.quality(f).first()
    assert (round(q.recall_1, 3), round(q.recall_5, 3), round(q.mrr, 4)) == (0.333, 0.667, 0.4167)


def test_exports_that_are_null_or_malformed(spark):
    import pytest

    from lodestack.operators import transcripts

    kind = "source_id string, format string, payload string"
    fine = spark.createDataFrame([("a", "jsonl", None), ("b", "openai", '[{"role": "user", "content": 5}]')], kind)
    assert [(r["source_id"], r["content"]) for r in transcripts.parsed(fine).collect()] == [("b", "5")]
    for form, payload in (("jsonl", "7"), ("openai", '{"role": "user"}'), ("claude", "[1]"), ("jsonl", "{")):
        with pytest.raises(Exception, match="malformed export s1"):
            transcripts.parsed(spark.createDataFrame([("s1", form, payload)], kind)).collect()
