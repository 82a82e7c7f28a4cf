import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import decontam as d
from lodestack.llm import line_dedup as ld
from lodestack.llm import ngram_join as nj


def peak(call):
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_stages_pass_bounded_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 1600).alias("text"))
    items = spark.createDataFrame([(1, "no such passage")], "item_id long, text string")
    try:
        corpus_pipeline.table, old = (lambda *_: items), corpus_pipeline.table
        kept = corpus_pipeline.benchmark(spark, docs, "")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").agg(F.max("n"), F.sum("n")).first()
        assert sizes[0] < 12e6 < 25e6 < sizes[1]
        assert kept.count() == 4000
    finally:
        corpus_pipeline.table = old
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_pairs_of_windows_and_places_are_bounded():
    items = d.TestItems([(i, f"common w{i}".encode()) for i in range(300)], 2)
    items.ranked(np.array([0 if w == b"common" else 9 for w in items.vocab], np.int64))
    text = b"common w7 " * 20000
    out, mb = peak(lambda: d.scan([text, b"w1", b"common w3"], items))
    assert out == [(40000, [(0, 40000)], [7]), (1, [], []), (2, [(0, 2)], [3])]
    assert mb < 30


def test_met_tokens_against_plain_loop():
    rng = np.random.default_rng(5)
    for size in (1, 2, 50):
        t = np.sort(rng.integers(0, 20, size).astype(np.uint64))
        r = rng.integers(0, 3, size)
        many, new = nj._met(t, r)
        rows = {x: {int(b) for a, b in zip(t, r) if a == x} for x in set(t.tolist())}
        assert many.tolist() == [len(rows[x]) > 1 for x in t.tolist()]
        assert new.tolist() == [i == 0 or t[i] != t[i - 1] for i in range(size)]


def test_plans_the_driver_keeps_are_short(spark):
    """The rarity sketch stands in the plan of the lines as small numbers, and a stage's plans are kept as bounded texts."""
    docs = spark.createDataFrame([(1, "a b c d e f\na b c d e f")], "doc_id long, text string")
    assert len(ld.lines_of(docs)._jdf.queryExecution().optimizedPlan().toString()) < 1 << 20
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    try:
        plan = corpus_pipeline.lines(spark, docs, "")
        assert int(spark.conf.get("spark.sql.maxPlanStringLength")) <= 100_000
        assert plan.count() == 1
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", before)


def test_dealing_texts_holds_few_arrays_and_gives_memory_back(monkeypatch):
    """A worker of the n-gram join takes 4 MB of text at a time, remembers 200,000 words and frees what a slice has held."""
    from lodestack.llm import common

    rng, freed = np.random.default_rng(3), []
    monkeypatch.setattr(common, "_trim", freed.append)
    words = [f"w{x}" for x in range(50_000)]
    texts = [" ".join(words[x] for x in rng.integers(0, len(words), 9000)) for _ in range(190)]  # some 10 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out, mb = peak(lambda: sum(x.num_rows for x in nj._deal(5, 4, 4, 45)(iter([batch]))))
    assert out > 0 and len(freed) >= 3
    assert mb < 65
    hashes = common.WordHash()
    hashes.of([b"%d" % x for x in range(300_000)])
    assert len(hashes) <= 200_000
