"""Whitening against numpy over the whole list, exact sums, merges, and vectors at the edges."""

import numpy as np
import pytest

from lodestack.llm import whitening
from lodestack.llm.whitening import Welford, Whitening, symmetric_qr, tridiagonal


def brute(rows, top=4):
    """(vec_id, component) -> (n, deviation, |whitened|, explained) by eigh over the distinct vectors."""
    fine = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in fine), default=0)
    fine = [(i, v + [0] * (dims - len(v))) for i, v in fine]
    fit = sorted({tuple(v) for _, v in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float)
    centred = x - x.mean(0)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, v in fine:
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for k in range(min(top, dims)):
            out.append((i, k + 1, n, dev, abs(float((np.array(v) - x.mean(0)) @ u[:, k] / np.sqrt(e[k]))), float(e[k] / np.trace(cov))))
    return sorted(out)


def run(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(v, i, 3) for i, v in rows], f"embedding {kind}, vec_id long, x int")
    return whitening.digest(df).collect()


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(0.1, 1.5, 12)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(200)]  # copies count once in the fit
    rows += [(2000, None), (2001, [float("nan")] + [0.0] * 11), (2002, [float("inf")] + [0.0] * 11), (2003, [None] + [0.1] * 11), (2004, [0.5, -0.0]), (2004, [0.5, -0.0]), (2005, [])]
    got, want = run(spark, rows), brute(rows)
    assert len(got) == len(want)
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    have = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], abs=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)
    assert got[0]["n"] == len({tuple(np.floor(256 * np.array(v))) for i, v in rows[:300]}) + 2


def test_one_sign_for_all_rows(spark):
    rows = [(i, [float(i), float(i % 3)]) for i in range(40)]
    got = {r["vec_id"]: r["whitened"] for r in run(spark, rows) if r["component"] == 1}
    steps = [got[i] < got[i + 3] for i in range(0, 36, 3)]
    assert all(steps) or not any(steps)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [float("nan")])]) == []
    assert run(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == []  # no variance
    line = run(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0])])
    assert sorted((r["vec_id"] or 0, r["component"]) for r in line) == [(0, 1), (1, 1), (2, 1)] and line[0]["explained"] == pytest.approx(1.0)
    big = run(spark, [(1, [1e17, 0.0]), (2, [-1e17, 1.0])], "array<double>")
    assert {r["deviation"] for r in big} == {2**63 - 1}


def test_welford_by_blocks_and_merges():
    rng = np.random.default_rng(5)
    x = rng.integers(-3000, 3000, size=(5001, 6)) + 10**9
    whole = Welford(6)
    whole.add(x)
    parts = Welford(6)
    for k in range(0, 5001, 700):
        s = Welford(6)
        s.add(x[k : k + 700])
        parts.merge(Welford.unpack(s.pack()))
    near = x - 10**9  # so that the centred products to compare with lose nothing
    c = near - near.mean(0)
    want = c.T @ c
    for state in (whole, parts):
        assert state.n == 5001 and list(state.sums) == [int(s) for s in x.sum(0)]
        np.testing.assert_allclose(state.m, want, atol=1e-12 * np.abs(want).max())


def test_symmetric_qr():
    rng = np.random.default_rng(7)
    for d in (1, 2, 3, 10, 64):
        a = rng.normal(size=(d, d))
        a = a + a.T
        diag, off, q = tridiagonal(a)
        np.testing.assert_allclose(q @ (np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)) @ q.T, a, atol=1e-12 * d)
        e, u = symmetric_qr(a)
        np.testing.assert_allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * d)
        np.testing.assert_allclose(u.T @ u, np.eye(d), atol=1e-12 * d)
        np.testing.assert_allclose(a @ u, u * e, atol=1e-11 * d)
    e, u = symmetric_qr(np.diag([2.0, 2.0, 0.0, 5.0]))
    assert e.tolist() == [5.0, 2.0, 2.0, 0.0]


def test_deviations_beyond_64_bits():
    s = Welford(2)
    s.add(np.array([[2**40, 5], [-(2**40), 7]]))
    w = Whitening(s)
    assert w.deviations(np.array([[2**40, 5]])) == [2**63 - 1] and w.deviations(np.array([[3, 6]])) == [36]
