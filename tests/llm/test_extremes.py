"""Inputs at the edge of what the corpus operators define."""

import random

import numpy as np

from lodestack.llm import mixing, ngram_join, token_count, topk


def test_vectors_beyond_64_bits(spark):
    rows = [(50, [1e30, 1.0]), (51, [1e30, 0.0]), (52, [2e10, 2e10]), (53, [-1e300, 0.0]), (54, [1.7e308, 1.0]), (55, [0.5, 0.5])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 51), (2, 52), (3, 54), (4, 55), (5, 53)]  # the first three are beyond 38 digits
    assert got[0].score == got[1].score == 2**63 - 1 and got[4].score == -(2**63)


def test_mix_keeps_a_column_named_copy(docs_of):
    docs = docs_of([(i, "a b c " * (i + 1)) for i in range(20)]).withColumnRenamed("key", "Copy")
    out = mixing.resample(docs)
    assert out.columns == [*docs.columns, "copy_1"] and {r.Copy for r in out.collect()} == {7}


def test_whole_equality_links(docs_of):
    words = " ".join(f"w{i}" for i in range(30))
    got = {r.doc_id: r.component_id for r in ngram_join.near_copies(docs_of([(1, words), (2, words.upper()), (3, words + " more")]), percent=100).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_vocabularies_that_begin_alike_are_told_apart():
    common = [(chr(97 + i % 26) * (i // 26 + 1), -1.0 - i) for i in range(120)]
    a, b = [*common, ("xyz", -0.5)], [*common, ("zyx", -0.5)]
    assert token_count._tokenizer(a).count("xyz") != token_count._tokenizer(b).count("xyz")


def test_many_rows_without_an_id(docs_of):
    from lodestack.llm import suffix_dedup

    r = random.Random(1)
    same = "".join(r.choice("abcdef ") for _ in range(200))
    rows = [(None, f"{same}{i}") for i in range(60)] + [(1, same), (2, "x" + same)]
    got = {r.doc_id: r for r in suffix_dedup.digest(docs_of(rows)).where("doc_id is not null").collect()}
    none = suffix_dedup.digest(docs_of(rows)).where("doc_id is null").collect()
    assert got[1].n_removed == 0 and got[2].n_removed == 200
    assert len(none) == 60 and all(x.n_removed == 0 for x in none)


def test_tilts_reach_the_targets(spark):
    rows = [(f"s{i}", float(10 + i), float(np.exp(i / 7) * 3)) for i in range(12)]
    for r in mixing.tilts(spark.createDataFrame(rows, "source string, size double, target double").where("target <= 3 * size")).collect():
        assert abs(r["size"] * r.rate - r.target) < 1e-9 * r.target
