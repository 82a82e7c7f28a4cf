import json

from lodestack.sources import files
from lodestack.streaming import flows


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "sub/b.md").write_text("# B")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "Cargo.toml").write_text("[package]")
    (tmp_path / "i.png").write_bytes(b"\x89PNG")
    assert files.markdown_tree(spark, str(tmp_path)).count() == 2
    assert files.images(spark, str(tmp_path)).count() == 1
    assert files.profile(spark, str(tmp_path)).first().language == "rust"
    one = files.fingerprint(spark, str(tmp_path)).first()[0]
    (tmp_path / "Cargo.toml").write_text("[package]\nname='x'")
    assert files.fingerprint(spark, str(tmp_path)).first()[0] != one
    e, r = files.graph(spark, str(tmp_path / "missing.json"))
    assert e.count() == 0 and r.count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"entities": [{"name": "A", "entity_type": "t", "description": "", "source_chunks": ["c"]}], "relations": []}))
    assert files.graph(spark, str(tmp_path / "g.json"))[0].first().name == "A"
    m = files.models(spark, '[[models]]\nname="a"\ndims=3\ndefault=true\n[[models]]\nname="b"\n', '[[models]]\nname="b"\ndims=7\n')
    assert {x.name: x.dims for x in m.collect()} == {"a": 3, "b": 7}


def test_follow_upserts_and_deletes(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    table = {"df": spark.createDataFrame([("old.md", "o", 1)], "path string, content string, version long")}

    def save(df):
        df.write.mode("overwrite").parquet(str(out) + f"/{len(saved)}")
        saved.append(1)
        table["df"] = spark.read.parquet(str(out) + f"/{len(saved) - 1}")

    saved = []
    rows = [("upsert", "a.md", "1", 1), ("upsert", "a.md", "2", 2), ("remove", "old.md", None, 5), ("upsert", "x.exe", "no", 1)]
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(("op", "path", "content", "version"), r, strict=True))) for r in rows))
    q = flows.follow(flows.change_log(spark, str(src)), lambda: table["df"], save, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in table["df"].select("path", "content").collect()] == [("a.md", "2")]


def test_logs_groups_series(spark):
    e = spark.createDataFrame([("s", f"{i:03d}") for i in range(5)], "stream string, id string")
    assert [r.id for r in flows.tail(e, "002").collect()] == ["003", "004"]
    assert flows.trimmed(e, 2).count() == 2
    d = spark.createDataFrame([("g", "s", "000", "c1", 0, False), ("g", "s", "001", "c1", 900, False)], "group string, stream string, id string, consumer string, delivered_ms long, acked boolean")
    assert [r.id for r in flows.group_read(e, d, "g", 2).collect()] == ["002", "003"]
    assert flows.pending(flows.acked(d, "g", ["000"]), "g").count() == 1
    assert {r.id: r.consumer for r in flows.claimed(d, "g", "c2", 1000, 500).collect()} == {"000": "c2", "001": "c1"}
    m = spark.createDataFrame([("a.b",), ("a.c",), ("z",)], "channel string")
    assert flows.subscribed(m, pattern="a.*").count() == 2 and flows.subscribed(m, "z").count() == 1
    x = spark.createDataFrame([("k", 1000, 1.0, 1), ("k", 1000, 2.0, 2), ("k", 2000, 3.0, 3)], "key string, ts_ms long, value double, arrival int")
    assert [r.value for r in flows.series_range(flows.series(x), 1000, 1500).collect()] == [2.0]
    old = spark.createDataFrame([("k", 0, 1.0), ("k", 8 * 86_400_000, 2.0)], "key string, ts_ms long, value double")
    assert flows.retained(old).count() == 1
