"""Extraction with gleaning, reranking of pairs, sections over lines and pages by key against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.operators import chunking, extraction, retrieval, state, transcripts


def flaky(text, found=None):
    """Answers by rule: 'down' never, 'odd' in a later pass not; else the words of the text, one a pass."""
    if text.startswith("down"):
        raise OSError("no answer")
    have = [] if found is None else [e["name"] for e in found["entities"]]
    if text.startswith("odd") and have:
        return "not json"
    rest = [w for w in text.split() if w not in have]
    return "```json\n" + json.dumps({"entities": [{"name": w, "type": f"t{len(have)}", "description": w.upper()} for w in rest[:1]], "relations": []}) + "\n```"


def test_passes_stop():
    assert [e["name"] for e in extraction.passes("a b c", "1", flaky, rounds=1)[0]] == ["a", "b"]
    assert [e["name"] for e in extraction.passes("a b c", "1", flaky, rounds=9)[0]] == ["a", "b", "c"]
    assert [e["name"] for e in extraction.passes("odd b", "1", flaky, rounds=9)[0]] == ["odd"]
    calls = []

    def once(text, found=None):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("busy")
        return "{}"

    assert extraction.passes("x", "1", once, rounds=3) == ([], []) and len(calls) == 3
    with pytest.raises(ValueError):
        extraction.passes("x", "1", lambda t, f: "[1]")


def test_extraction(spark, tmp_path):
    rows = [(1, "Ann Bob", 0), (2, "ann Carl", 0), (3, "down", 0), (4, None, 0), (5, "", 0), (6, "odd", 0), (2, "ann Carl", 0)]
    found = extraction.mentions(spark.createDataFrame(rows, "id long, content string, chunk int").repartition(3), flaky, rounds=5, store=str(tmp_path / "mentions"))
    assert [(r.chunk, r.description) for r in found.where("kind = 'failed'").collect()] == [("3", "no answer")]
    got = {r.name: (r.entity_type, r.description, r.chunks) for r in extraction.entities(found).collect()}
    assert got == {"ann": ("t0", "ANN", 2), "Bob": ("t1", "BOB", 1), "Carl": ("t1", "CARL", 1), "odd": ("t0", "ODD", 1)}
    short = extraction.entities(found, lambda n, d: f" {n}:{len(d)} ", longest=3)
    assert {r.name: r.description for r in short.collect()} == {"ann": "ANN", "Bob": "BOB", "Carl": "Carl:4", "odd": "ODD"}
    none = extraction.mentions(spark.createDataFrame([], "id long, content string"), flaky)
    assert none.count() == 0 and extraction.entities(none).count() == 0 and extraction.relations(none).count() == 0


def test_descriptions_and_relations(spark):
    rows = [("1", "entity", 0, "A", None, "x", "red"), ("1", "entity", 1, "a", None, "y", "red cat"), ("2", "entity", 0, "A", None, "z", "red"), ("2", "entity", 1, "A", None, "z", "blue"), ("3", "entity", 0, "a", None, "z", "")]
    rows += [("2", "relation", 0, "A", "b", "to", "late"), ("1", "relation", 3, "a", "B", "TO", "first"), ("1", "relation", 4, "a", "b", "of", "")]
    found = spark.createDataFrame(rows, extraction.MENTION)
    assert [tuple(r) for r in extraction.entities(found).collect()] == [("a", "x", "red; red cat; blue", 3)]
    assert sorted(tuple(r) for r in extraction.relations(found).collect()) == [("a", "B", "TO", "first", 2), ("a", "b", "of", "", 1)]


def test_late_interaction():
    assert retrieval.late_interaction("abc", "abd x") == pytest.approx(2 / 3)
    assert retrieval.late_interaction("abc zz", "abc") == 0.5
    assert retrieval.late_interaction("", "a") is None and retrieval.late_interaction("a", "--") is None
    r = random.Random(4)
    for _ in range(200):
        q, t = ([" ".join("".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(r.randint(1, 8)))][0] for _ in range(2))

        def like(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n / max(len(a), len(b))

        want = [max(like(a, b) for b in t.split()) for a in set(q.split())]
        assert retrieval.late_interaction(q, t) == pytest.approx(sum(want) / len(want))


def test_rerank_batch(spark):
    hits = spark.createDataFrame([(1, "a", 9.0), (1, "b", 0.4), (1, "c", 0.1), (1, "gone", 0.2), (2, "a", 0.3), (3, "a", 0.7)], "query_id long, id string, score double")
    asked = spark.createDataFrame([(1, "red cat"), (2, None), (3, "!"), (4, "none")], "query_id long, text string")
    chunks = spark.createDataFrame([("a", "blue", 1), ("b", "red cat", 2), ("c", None, 3)], "id string, content string, score int")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in retrieval.rerank_batch(hits, asked, chunks, 3).collect()}
    assert got == {(1, 1): ("b", 1.0), (1, 2): ("gone", 0.2), (1, 3): ("c", 0.1), (2, 1): ("a", 0.3), (3, 1): ("a", 0.7)}

    def fails(q, t):
        raise ValueError

    assert {(r.id, r.score) for r in retrieval.rerank_batch(hits.where("query_id = 1"), asked, chunks, 2, fails).collect()} == {("a", 9.0), ("b", 0.4)}
    assert retrieval.candidates(2) == 10 and retrieval.candidates(10) == 30


def plain_section(text, title):
    out, level = [], None
    for line in re.sub(r"\r?\n\Z", "", text).replace("\r\n", "\n").split("\n"):
        m = re.fullmatch(r"\s*(#+)(?: (.*))?", line)
        name = (m.group(2) or "").strip() if m else ""
        if name == title and name:
            level = len(m.group(1))
        elif name and level is not None and len(m.group(1)) <= level:
            break
        if level is not None:
            out.append(line)
    return "\n".join(out) or None


def test_sections(spark):
    r = random.Random(7)
    lines = ["# A", "## A", "### A", "# B", "## B", "### C", " ## A ", "#A", "#", "text", "", "```", "## ", "  text"]
    docs = [(f"d{i}", "\n".join(r.choices(lines, k=r.randint(0, 14)))) for i in range(150)] + [("nul", None), ("crlf", "x\r\n# A\r\ny\r\n# B\r\n"), ("long", "# A\n" + "ä\n" * 5000)]
    d = spark.createDataFrame([(p, c, "t") for p, c in docs], "path string, content string, title string").repartition(3)
    wanted = spark.createDataFrame([(p, t) for p, _ in docs for t in "AB"] + [("d1", "A"), ("nowhere", "A"), (None, "A"), ("d2", None)], "path string, title string")
    want = {(p, t): s for p, c in docs if c is not None for t in "AB" if (s := plain_section(c, t)) is not None}
    got = {(x.path, x.title): x.section for x in chunking.sections(d, wanted).collect()}
    assert [k for k in want.keys() | got.keys() if want.get(k) != got.get(k)] == []
    cut = {(x.path, x.title): x.section for x in chunking.sections(d, wanted, 6).collect()}
    assert cut == {k: s.encode()[:6].decode(errors="ignore") for k, s in want.items()}
    assert chunking.sections(d.where("false"), wanted).count() == 0


def test_seek(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2]), r.choice([None, 0.5, float("nan"), 2.0]), f"k{i:03}", i) for i in range(90)]
    df = spark.createDataFrame(rows, "confidence_percent int, occurrence_count double, pattern_key string, other int").repartition(4)
    want = [x.pattern_key for x in df.orderBy(*state.order_columns("lessons")).collect()]
    got, cursor, pages = [], None, 0
    while True:
        page, cursor = state.seek(df, "lessons", 20, cursor)
        got += [x.pattern_key for x in page.collect()]
        pages += 1
        if cursor is None:
            break
    assert got == want and pages == 5
    _, second = state.seek(df, "lessons", 20)
    late = df.unionByName(spark.createDataFrame([(9, 9.0, "new", 0)], df.schema))  # before the cursor: the second page stays
    assert [x.pattern_key for x in state.seek(late, "lessons", 20, second)[0].collect()] == want[20:40]
    assert state.seek(df.where("false"), "lessons", 20)[1] is None
    for bad in ("%%", state.encode_cursor(20), "eyJrIjpbMV19"):
        with pytest.raises(ValueError):
            state.seek(df, "lessons", 20, bad)


def test_seek_filters_at_the_scan(spark, tmp_path):
    at = str(tmp_path / "audit")
    spark.range(1000).select(F.col("id"), F.lit("x").alias("kind")).write.parquet(at)
    df = spark.read.parquet(at)
    _, cursor = state.seek(df, "audit", 10)
    plan = state.seek(df, "audit", 10, cursor)[0]._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(id,990\)", plan), plan


def test_diary_digest(spark):
    rows = [("p", "e1", "2024-01-01", 1, "old\nold\n# head"), ("p", "e2", "2024-01-03", 1, " new  line \nSource: x\n\nmore"), ("p", "e3", "2024-01-03", 2, "late\nmore"), ("q", "e1", "2024-02-01", 1, None), (None, "e9", "2024-03-01", 1, "x"), ("q", "e2", "2024-02-02", 1, "")]
    d = spark.createDataFrame(rows, "project_id string, entry_id string, entry_date string, updated_at long, content string").repartition(3)
    got = {r.project_id: r for r in transcripts.diary_digest(d, 4).collect()}
    assert got["p"].highlights == ["late", "more", "new line", "more"] and got["p"].entry_count == 3
    assert (got["p"].date_from, got["p"].date_to, got["p"].summary) == ("2024-01-01", "2024-01-03", "Summarized 3 diary entries across the requested range.")
    assert got["q"].highlights == [] and got[None].highlights == ["x"] and got[None].summary.startswith("Summarized 1 diary entry ")
    assert {r.project_id: r.highlights for r in transcripts.diary_digest(d, 9).collect()}["p"][-1] == "old"
    assert transcripts.diary_digest(d.where("false"), 4).count() == 0
