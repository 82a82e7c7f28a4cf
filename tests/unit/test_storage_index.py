"""Bucketed tables and the stored text index against plain versions of the same."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import fts_tokens
from lodestack.operators import retrieval
from lodestack.operators.fts_index import Index
from lodestack.operators.storage import Stored


def files(folder):
    return {os.path.relpath(p, folder): os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/data/**/*.parquet", recursive=True)}


@pytest.fixture
def stored(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}", 1, 10) for i in range(200)], "id long, value string, created int, updated_at int")
    return Stored.create(rows, str(tmp_path / "t"), ["id"], buckets=16)


def content(t, version=None):
    return {r["id"]: (r["value"], r["created"], r["updated_at"]) for r in t.read(version).collect()}


def test_upsert_leaves_other_buckets_alone(spark, stored):
    before = files(stored.folder)
    old = content(stored)
    changes = spark.createDataFrame([(3, "new", 9, 20), (3, "newer", 9, 30), (900, "added", 9, 20)], "id long, value string, created int, updated_at int")
    assert stored.upsert(changes, keep_first=["created"]) == 2
    assert content(stored) == old | {3: ("newer", 1, 30), 900: ("added", 9, 20)}
    assert content(stored, 1) == old  # readers of the last version still see it
    after = files(stored.folder)
    assert before.items() <= after.items() and 1 <= len({p.split("/")[2] for p in after.keys() - before.keys()}) <= 2
    assert {r["id"] for r in stored.lookup(changes).collect()} == {3, 900}


def test_delete_replace_vacuum(spark, stored):
    stored.delete(spark.createDataFrame([(i,) for i in range(50)], "id long"))
    assert set(content(stored)) == set(range(50, 200))
    stored.delete(spark.createDataFrame([(60,), (61,)], "id long"), F.col("value") == "v60")
    assert 60 not in content(stored) and 61 in content(stored)
    keys = spark.createDataFrame([(70,), (71,), (5,)], "id long")
    stored.replace(keys, spark.createDataFrame([(70, "a", 0, 0), (70, "b", 0, 0)], "id long, value string, created int, updated_at int"))
    rows = stored.read().where("id in (70, 71, 5)").collect()
    assert sorted(r["value"] for r in rows) == ["a", "b"]
    want = content(stored)
    assert stored.vacuum() > 0 and content(stored) == want and stored.vacuum() == 0
    stored.delete(stored.read().select("id"))
    assert content(stored) == {}


def test_a_failed_change_leaves_the_last_version(spark, stored):
    old = content(stored)
    bad = spark.createDataFrame([(3, "x", 1, 20)], "id long, value string, created int, updated_at int")
    with pytest.raises(Exception, match="broken"):
        stored.change(bad, lambda rows: rows.withColumn("value", F.when(F.col("id") >= 0, F.raise_error(F.lit("broken"))).otherwise("x")))
    assert content(stored) == old and stored.manifests.numbers() == [1]
    stored.upsert(bad)
    assert content(stored)[3] == ("x", 1, 20)


def bm25(docs, query, k, every=True):
    return [(r["id"], r["score"]) for r in retrieval.bm25(docs, query, k, fts_tokens("content"), every=every, digits=6).collect()]


def found(index, query, k, every=True):
    return [(r["id"], r["score"]) for r in index.search(query, k, every, digits=6).collect()]


def test_index_equals_a_scan_through_changes(spark, tmp_path):
    import random

    rnd = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(30)], k=rnd.randint(0, 40)))
    have = {i: text() for i in range(300)} | {1000: None, 1001: "", 1002: "W0, w0! w0_w1 é"}
    table = lambda: spark.createDataFrame(list(have.items()), "id long, content string").withColumn("content", F.coalesce("content", F.lit("")))
    index = Index.create(spark.createDataFrame(list(have.items()), "id long, content string"), str(tmp_path / "i"), buckets=8)

    def agree():
        for q, k, every in (("w1 w3", 7, True), ("w0 w7 w2", 500, True), ("w29 W5", 3, False)):
            assert found(index, q, k, every) == bm25(table(), q, k, every)

    agree()
    up = {5: text(), 6: "", 7: "w0 w0 w0 w29", 2000: text() + " w29", 2001: "w1 w3 w1 w3"}
    index.change(spark.createDataFrame(list(up.items()), "id long, content string"), spark.createDataFrame([(8,), (9,), (7777,)], "id long"))
    have |= up
    have = {i: t for i, t in have.items() if i not in (8, 9)}
    agree()
    index.change(spark.createDataFrame([(8, "w5 w29 back"), (5, "w2")], "id long, content string"))
    have |= {8: "w5 w29 back", 5: "w2"}
    assert index.compact() == 4 and index.manifests.read()[1]["generations"] == [4]
    agree()
    index.change(spark.createDataFrame([(3000, "w0")], "id long, content string"), spark.createDataFrame([(5,)], "id long"))
    have[3000] = "w0"
    have.pop(5)
    agree()


def test_index_edges(spark, tmp_path):
    index = Index.create(spark.createDataFrame([], "id string, content string"), str(tmp_path / "e"))
    assert found(index, "a", 5) == [] and found(index, "", 5) == []
    index.change(spark.createDataFrame([("x", "a b a b c"), ("y", "b a"), ("z", "a a a")], "id string, content string"))
    assert found(index, "nothing", 5) == [] and [i for i, _ in found(index, "b", 5)] == ["x", "y"]
    assert {(r["id"], r["places"]) for r in index.phrase("A b").collect()} == {("x", 2)}
    assert {(r["id"], r["places"]) for r in index.phrase("a a").collect()} == {("z", 2)} and index.phrase("?").collect() == []


def test_search_reads_the_terms_buckets_and_skips_blocks(spark, tmp_path):
    rows = [(i, "rare " * (i % 3 + 1) + "filler " * (10 if i < 8 else 400 + 13 * (i % 50))) for i in range(600)]
    index = Index.create(spark.createDataFrame(rows, "id long, content string"), str(tmp_path / "b"), buckets=8)
    total, read = index.blocks_read("rare", 5)
    assert read < total
    table = spark.createDataFrame(rows, "id long, content string")
    assert found(index, "rare", 5) == bm25(table, "rare", 5)
    plan = index.postings(["rare"])._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan or "bucket" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(term,rare)" in scan or "In(term, [rare])" in scan


def test_dealt_rows_and_whole_replacement(spark, tmp_path):
    """Rows that lie by their key are written without a shuffle; a replacement of all keys does not take the old rows along."""
    rows = spark.createDataFrame([(f"s{i % 7}", i) for i in range(70)], "path string, n long").repartition(3, "path").cache()
    seen = []
    write, Stored._write = Stored._write, lambda self, df, version, note, touched, dealt=False: (seen.append((dealt, df._jdf.queryExecution().optimizedPlan().toString())), write(self, df, version, note, touched, dealt))[1]
    try:
        table = Stored.create(rows, str(tmp_path / "d"), ["path"], 4, dealt=True)
        assert sorted(table.read().collect()) == sorted(rows.collect())
        table.replace(rows.select("path"), rows.selectExpr("path", "n + 1 as n"), dealt=True)
        assert sorted(table.read().collect()) == sorted((p, n + 1) for p, n in rows.collect())
        assert "Union" not in seen[-1][1] and seen[-1][0]
        table.replace(spark.createDataFrame([("s1",)], "path string"), rows.where("path = 's1'"))
        assert sorted(table.read().collect()) == sorted((p, n + (p != "s1")) for p, n in rows.collect())
    finally:
        Stored._write = write


def test_places_are_gathered_before_the_shuffle(spark, tmp_path):
    """A build shuffles a row for each text and term, not for each token; slices of a few tokens give the rows of one."""
    import lodestack.operators.fts_index as fts

    texts = [(1, "a b a a c a"), (2, ""), (3, None), (4, "Ünï ünï b " * 40), (5, "c " * 900), (6, "--"), (7, "d")]
    docs = spark.createDataFrame(texts, "id long, content string")
    plans, old = [], fts.Index._postings

    def seen(self, rows, gen):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        old(self, rows, gen)

    fts.Index._postings = seen
    try:
        index = Index.create(docs, str(tmp_path / "a"), buckets=4)
    finally:
        fts.Index._postings = old
    assert "Generate" not in plans[0] and "Aggregate" not in plans[0]
    want = {}
    for r in docs.select("id", fts_tokens(F.coalesce("content", F.lit(""))).alias("tk")).collect():
        for p, t in enumerate(r["tk"]):
            want.setdefault((t, r["id"], len(r["tk"])), []).append(p)
    got = {(r["term"], r["id"], r["len"]): r["pos"] for r in index.postings(["a", "b", "c", "d", "ünï"]).where("tf = size(pos)").collect()}
    assert got == want
    tk = docs.select("id", F.coalesce(fts_tokens("content"), F.array().cast("array<string>")).alias("tk")).withColumn("len", F.size("tk")).withColumn("block", F.lit(3).cast("long")).select("id", "len", "block", "tk")
    kind = "id long, len int, block long, bucket int, term string, pos array<int>"
    tokens = fts.TOKENS
    try:
        whole = sorted(map(str, tk.mapInArrow(fts._gathered(4), kind).collect()))
        fts.TOKENS = 3
        assert sorted(map(str, tk.mapInArrow(fts._gathered(4), kind).collect())) == whole
    finally:
        fts.TOKENS = tokens
