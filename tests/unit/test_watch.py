"""Debounced changes over several batches, a restart and late events; the chunk table that follows files."""

import json
import os

from lodestack.operators import chunking, storage
from lodestack.streaming import flows, watch


def put(folder, name, rows):
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(json.dumps({"path": p, "op": o, "version": v, "at": f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}.000Z"}) + "\n" for p, o, v, at in rows)
    os.utime(f"{folder}/.{name}", (1_700_000_000 + int(name),) * 2)  # files are taken in this order
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def run(spark, src, cp, seen, **more):
    """All that is there now, one file a batch; a new query on the same checkpoint each time."""
    stream = spark.readStream.schema(watch.CHANGE).option("maxFilesPerTrigger", 1).json(src)
    q = watch.settled(stream, delay="1 second", **more).writeStream.foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_changes_settle_across_batches_and_restarts(spark, tmp_path):
    src, cp, seen = str(tmp_path / "in"), str(tmp_path / "cp"), []
    os.mkdir(src)
    put(src, "1", [("a.md", "upsert", 1, 0), ("b.md", "upsert", 1, 0)])
    put(src, "2", [("a.md", "upsert", 2, 1), ("b.md", "remove", 3, 1), ("b.md", "upsert", 2, 1)])  # within two seconds of the first ones
    run(spark, src, cp, seen)
    assert seen == []  # nothing has settled yet
    put(src, "3", [("a.md", "upsert", 3, 2), ("c.md", "upsert", 1, 10)])  # a restart in between
    put(src, "4", [("d.md", "upsert", 1, 20)])
    run(spark, src, cp, seen)
    assert sorted(x for x in seen if x[0] in ("a.md", "b.md")) == [("a.md", "upsert", 3), ("b.md", "remove", 3)]
    seen.clear()
    put(src, "5", [("b.md", "upsert", 2, 40), ("a.md", "upsert", 4, 41)])  # b's is older than what was passed on
    put(src, "6", [("e.md", "upsert", 1, 60), ("a.md", "upsert", 9, 3)])  # a's is far behind the watermark
    put(src, "7", [("f.md", "upsert", 1, 90)])
    run(spark, src, cp, seen)
    assert [x for x in seen if x[0] == "b.md"] == []
    assert [x for x in seen if x[0] == "a.md"] == [("a.md", "upsert", 4)]
    assert ("c.md", "upsert", 1) in seen or ("d.md", "upsert", 1) in seen


def test_chunks_follow_files(spark, tmp_path):
    src, cp, docs = tmp_path / "in", str(tmp_path / "cp"), tmp_path / "docs"
    src.mkdir()
    docs.mkdir()
    none = chunking.chunk(spark.createDataFrame([], "path string, content string"))
    chunks = storage.Stored.create(none, str(tmp_path / "chunks"), ["source_path"], 4)
    have = {"a.md": "# One\n\nfirst", "b.md": "# Two\n\nsecond", "c.bin": "no"}

    def read(paths):
        return spark.createDataFrame([(r["path"], have[r["path"]]) for r in paths.collect() if r["path"] in have], "path string, content string")

    def go():
        stream = spark.readStream.schema(watch.CHANGE).option("maxFilesPerTrigger", 1).json(str(src))
        q = watch.follow_files(stream, chunks, read, cp, delay="1 second").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return {(r["source_path"], r["content"]) for r in chunks.read().collect()}

    put(src, "1", [(p, "upsert", 1, 0) for p in have])
    put(src, "2", [("z.md", "upsert", 1, 30)])
    put(src, "3", [("z.md", "upsert", 2, 31)])  # timers run in the batch behind the one that moves the watermark
    got = go()
    assert {p for p, _ in got} == {"a.md", "b.md"} and any("first" in c for _, c in got)
    have["a.md"] = "# One\n\nchanged"
    del have["b.md"]
    put(src, "4", [("a.md", "upsert", 2, 40), ("b.md", "upsert", 2, 40)])  # b is gone when it is read
    put(src, "5", [("y.md", "upsert", 1, 80)])
    put(src, "6", [("y.md", "upsert", 2, 81)])
    got = go()
    assert {p for p, _ in got} == {"a.md"} and any("changed" in c for _, c in got) and not any("first" in c for _, c in got)


def test_tombstones_outlast_late_upserts(spark):
    kind = "path string, content string, version int, deleted boolean"
    t = spark.createDataFrame([("a", "1", 1, False)], kind)
    batch = lambda *rows: spark.createDataFrame(list(rows), "op string, path string, content string, version int")
    t = flows.apply_changes(t, batch(("remove", "a", None, 3), ("upsert", "b", "x", 1)))
    t = flows.apply_changes(t, batch(("upsert", "a", "2", 2)))
    assert {(r["path"], r["deleted"]) for r in t.collect()} == {("a", True), ("b", False)}
    assert [r["path"] for r in flows.present(t).collect()] == ["b"]
    t = flows.apply_changes(t, batch(("upsert", "a", "4", 4)))
    assert {(r["path"], r["content"]) for r in flows.present(t).collect()} == {("a", "4"), ("b", "x")}
