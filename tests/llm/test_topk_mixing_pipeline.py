import math

import numpy as np
import pytest

from lodestack.llm import mixing, topk


def brute(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seen, out = {}, []
    for i, v in fine:
        if i % 50 == 0:
            seen[i] = min(seen.get(i, v), v)
    for q, v in seen.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_topk_equals_brute_force(spark, block):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.float32(r.normal(size=8) / 3)]) for i in range(0, 700)]
    rows += [(i, rows[3][1]) for i in range(701, 740)]  # ties
    rows += [(50, None), (750, [float("nan")] * 8), (800, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (850, [1.0, None] + [0.0] * 6), (900, []), (7, [0.5] * 8), (950, [0.25] * 3), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    assert sorted(tuple(x) for x in topk.search(df, block=block).collect()) == brute(rows)


def test_topk_small_and_empty(spark):
    df = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df).collect()] == [(50, 1, 51, 256 * 512)]
    assert topk.search(df.where("false")).count() == 0


def test_mix(docs_of):
    r = np.random.default_rng(2)
    docs = [(int(i), " ".join(["w"] * int(r.integers(1, 60)))) for i in range(600)] + [(900, None), (901, ""), (None, "a b c"), (902, "x " * 5000), (5, "dup")]
    src = lambda i: None if i is not None and i % 11 == 0 else f"s{(i or 0) % 5}"
    d = docs_of(docs, source=src)
    rows = mixing.digest(d).collect()
    size = {}
    for (i, t) in docs:
        size[src(i)] = size.get(src(i), 0) + len((t or "").split())
    order = [s for s in sorted(x for x in size if x is not None)] + [None]
    weight = dict(zip(order, [5, 2, 1] * 3, strict=False))
    total, stopped = sum(size.values()), {}
    while True:
        left = total - sum(stopped.values())
        w = sum(weight[s] for s in order if s not in stopped)
        over = [s for s in order if s not in stopped and left * weight[s] / w > 3 * size[s]]
        if not over:
            break
        stopped |= {s: 3.0 * size[s] for s in over}
    want = {s: stopped.get(s, left * weight[s] / w) for s in order}
    by = {}
    for x in rows:
        assert x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
    assert sum(x.size for x in rows) == total and len(rows) == len(docs)
    got = {}
    for x in mixing.mix(d).collect():
        got[x.source] = got.get(x.source, 0) + x.copies * x.size
        by[x.source] = x.target
        assert abs(x.source_size - size[x.source]) == 0
    for s in order:
        assert abs(by[s] - want[s]) < 1e-6 * total
        assert abs(got[s] - want[s]) <= 1 + 0.001 * want[s], s
    assert sorted(map(str, mixing.digest(d).collect())) == sorted(map(str, rows))
    copies = mixing.resample(d)
    assert copies.columns == [*d.columns, "copy"] and copies.count() == sum(x.taken // x.size for x in rows if x.size)


def test_mix_fills_the_gap_of_a_long_document(docs_of):
    """Sources of one long document and short ones: whichever the hash order meets first, the taken words come near the target."""
    r = np.random.default_rng(8)
    docs = [(i, " ".join(["w"] * n)) for i, n in enumerate([3000, *r.integers(1, 40, 60).tolist(), 2000, *r.integers(1, 40, 60).tolist(), 900, 900, 900, *r.integers(1, 9, 40).tolist()])]
    got, want = {}, {}
    for x in mixing.mix(docs_of(docs, source=lambda i: "a" if i < 61 else "b" if i < 122 else "c")).collect():
        got[x.source] = got.get(x.source, 0) + x.copies * x.size
        want[x.source] = x.target
        assert 0 <= x.copies <= 3
    for s in "abc":
        assert abs(got[s] - want[s]) <= 0.01 * want[s], (s, got, want)


def test_mix_empty(docs_of):
    assert mixing.digest(docs_of([])).count() == 0
    assert [x.taken for x in mixing.digest(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


def test_pipeline_stages_take_effect(spark, docs_of, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    passage = "benchmark words that stand in a row and make a passage of more than ten"
    near = " ".join(f"n{i}" for i in range(100))
    docs = [(i, f"clean document number {i} with words of its own a{i} b{i} c{i} d{i} e{i}\nsecond line of {i} f{i} g{i} h{i} i{i}") for i in range(60)]
    docs += [(100, "you stupid pathetic worthless moron " + "x y z " * 5), (101, f"intro q1 q2 q3 q4 {passage} outro"), (102, near), (103, near.replace("n50", "other")), (104, docs[0][1]), (105, None), (106, "")]
    docs_of(docs, source=lambda i: f"s{i % 3}").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs_of([]).columns, name
        at = spark.createDataFrame(at.collect(), at.schema)
        seen.append({r.doc_id for r in at.collect()})
    assert 100 not in seen[0] and len(seen[0]) == len(docs) - 1
    assert seen[1] == seen[0] - {103, 104}  # nothing of them is left behind earlier lines
    assert seen[2] == seen[1] and 101 not in seen[3]
    assert set(range(60)) <= seen[3]
    last = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} <= seen[3] and {r["copy"] for r in last} <= {1, 2, 3}
