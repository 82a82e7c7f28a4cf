import random

import numpy as np

from lodestack.llm import ngram_join as nj
from lodestack.llm.common import mix64


def table(spark, sets, blocks=10):
    rows = [(i.to_bytes(16, "big"), bytearray(s.tobytes()), i % blocks, True) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "sid binary, tokens binary, home long, left_over boolean").repartition(3)


def test_left_over_sets_visit_blocks_that_can_hold_a_partner(spark):
    """A chain: each set shares a few tokens with the next one only, so that ties make one cluster of all."""
    fresh = lambda i: mix64(np.arange(i * 100, i * 100 + 100, dtype=np.uint64))
    sets = [np.unique(np.concatenate([fresh(i)[:90], fresh(i + 1)[:10]])) for i in range(60)]
    sent = spark.sparkContext.broadcast(np.zeros(1 << 20, np.uint8))
    got = {(int.from_bytes(r.sid, "big"), r.home) for r in nj._visits(table(spark, sets), sent, 80).collect()}
    own = [set(nj._keys(s, sent.value, 80).tolist()) for s in sets]
    assert got == {(i, j % 10) for i in range(60) for j in range(60) if own[i] & own[j] and i % 10 != j % 10}
    assert 0 < len(got) <= 2 * 60  # all blocks before: 600


def test_each_partner_in_another_block_is_visited(spark):
    r = random.Random(3)
    base = [[r.randrange(1 << 60) for _ in range(40)] for _ in range(6)]
    sets = [np.array(sorted({*b[r.randrange(4) :], *(r.randrange(1 << 60) for _ in range(r.randrange(5)))}), np.uint64) for b in base for _ in range(12)]
    sent = spark.sparkContext.broadcast(nj._sketch(table(spark, sets), 20))
    got = {(int.from_bytes(x.sid, "big"), x.home) for x in nj._visits(table(spark, sets), sent, 80).collect()}
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i % 10 != j % 10 and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))]
    assert near and all((i, j % 10) in got for i, j in near)


def test_sketch_counts_and_grows(spark):
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 22, 3000).astype(np.uint64)) for _ in range(20)]
    count = np.bincount(np.concatenate(sets).astype(np.int64) & ((1 << 20) - 1), minlength=1 << 20)
    assert (nj._sketch(table(spark, sets), 20, most=5000) == nj._rank(count)).all()
    assert (np.diff(nj._rank(np.arange(1 << 18)).astype(int)) >= 0).all()
    assert nj._sketch(table(spark, sets).where("home < 0"), 20).sum() == 0
    assert [nj.sketch_bits(n) for n in (0, 1 << 20, 1 << 25, 1 << 40)] == [20, 20, 25, 26]
