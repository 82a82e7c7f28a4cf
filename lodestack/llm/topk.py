"""Exact top-k inner-product search in three phases with a uniform threshold.

The vectors are rounded to whole numbers floor(256 * x). Queries are taken in blocks of at most ``block`` vectors
(a checked bound for what is broadcast); each block is run against all rows:

1. every slice of rows sends its local list of k best scores for each query; the k-th best of a query's lists
   together is a safe cutoff: no entry of the answer scores less;
2. the cutoffs go to all slices, which send the entries that reach them (of those that tie, the k smallest ids);
3. what was sent is resolved with exact whole-number products and ranked, ties to the smaller id.

Scores of phases 1 and 2 are in floating point while all products stay below 2**53, where they are exact; beyond, the
cutoff is lowered by the rounding error, and phase 3 alone decides, in Python's whole numbers.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. Shorter
vectors count as filled with zeros. Rows that repeat an id are candidates each by itself (not of their own id), and
the repeated query is answered once, by its smallest vector. Columns other than the named ones are ignored; an empty table gives none.
Scores beyond 64 bits are ranked as whole numbers of up to 38 digits (larger ones as the largest of them) and returned as the
largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, EVERY, BLOCK, SLICE = 5, 50, 4096, 4096
_LARGEST = 10**38 - 1


def whole(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double> of whole numbers) of the rows that take part."""
    e = F.col(embedding)
    fine = e.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(fine)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: _floor(x)).alias("v"))


def _floor(x: F.Column) -> F.Column:
    most = 1.7976931348623157e308
    scaled = F.greatest(F.least(x.cast("double") * 256.0, F.lit(most)), F.lit(-most))  # finite also where the product is not
    return F.when(F.abs(scaled) < 2.0**62, F.floor(scaled).cast("double")).otherwise(scaled)  # larger doubles are whole already


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == dims).all():
        return flat.reshape(len(lens), dims).astype(np.float64)
    out = np.zeros((len(lens), dims))
    at = np.concatenate([[0], np.cumsum(lens)])
    for i, n in enumerate(lens):
        n = min(int(n), dims)  # components beyond the queries' length meet zeros
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


class Block:
    """One block of queries."""

    def __init__(self, rows: list[tuple[int, list[float]]]) -> None:
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.dims = max((len(r[1]) for r in rows), default=0)
        self.q = np.zeros((len(rows), self.dims))
        for i, r in enumerate(rows):
            self.q[i, : len(r[1])] = r[1]
        self.norm = np.abs(self.q).sum(1)
        self.cutoff = np.full(len(rows), -np.inf)

    def scores(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries x rows) scores, own rows at -inf, and the queries' error bounds (0 while products are exact)."""
        with np.errstate(all="ignore"):
            s = self.q @ x.T
            bound = self.norm * (np.abs(x).max() if x.size else 0.0)
        s[self.ids[:, None] == ids[None, :]] = -np.inf
        return s, np.where(bound < 2.0**53, 0.0, bound * 1e-12)


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            part = b.slice(k, SLICE)
            yield part.column(0).to_numpy(), matrix(part.column(1), dims)


def _best(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of a row of scores, ties to the smaller id."""
    if len(s) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= edge)
    else:
        at = np.arange(len(s))
    return at[np.lexsort((ids[at], -s[at]))][:k]


def search_block(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """(query_id, vec_id, score as decimal-safe long, rank) of one block against all rows."""
    sc = rows.sparkSession.sparkContext
    n, first = len(block.ids), sc.broadcast(block)

    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = first.value
        top = np.full((n, k), -np.inf)
        for ids, x in _parts(batches, b.dims):
            s, err = b.scores(ids, x)
            with np.errstate(all="ignore"):
                s = np.nan_to_num(s - err[:, None], nan=-np.inf, posinf=-np.inf, neginf=-np.inf)  # a lower bound, where there is one
            both = np.concatenate([top, s], 1)
            top = -np.partition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both
        q, at = np.nonzero(top > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(top[q, at])], names=["q", "s"])

    lists = rows.mapInArrow(local_lists, "q long, s double")
    kth = lists.groupBy("q").agg(F.sort_array(F.collect_list("s"), False).alias("s")).select("q", F.when(F.size("s") >= k, F.element_at("s", k)).otherwise(F.lit(float("-inf"))).alias("t"))
    for r in kth.collect():  # a number for each query of the block
        block.cutoff[r["q"]] = r["t"]
    first = sc.broadcast(block)

    def sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = first.value
        for ids, x in _parts(batches, b.dims):
            s, err = b.scores(ids, x)
            out_q, out_i = [], []
            with np.errstate(all="ignore"):
                hit = ~(s + err[:, None] < b.cutoff[:, None])  # what can't be told is resolved
            hit &= b.ids[:, None] != ids[None, :]
            for q in np.flatnonzero(hit.any(1)).tolist():
                at = np.flatnonzero(hit[q])
                if not err[q]:
                    at = at[_best(ids[at], s[q, at], k)]
                out_q += [q] * len(at)
                out_i += at.tolist()
            i = np.array(out_i, np.int64)
            exact = [sum(int(a) * int(c) for a, c in zip(b.q[q], x[j], strict=True)) for q, j in zip(out_q, out_i, strict=True)]
            exact = [max(-_LARGEST, min(_LARGEST, x)) for x in exact]
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[np.array(out_q, np.int64)]), pa.array(ids[i]), pa.array(exact, pa.decimal128(38, 0))], names=["query_id", "vec_id", "score"])

    entries = rows.mapInArrow(sufficient, "query_id long, vec_id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score long: the k best of each query row (id divisible by ``every``)."""
    rows = whole(vectors, vec_id, embedding)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = queries.count()
    n = max(1, -(-total // block))
    if n > 1:
        queries = cut(queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(2 * n))), "queries")
    out = None
    for i in range(2 * n if n > 1 else 1):
        part = queries.where(F.col("b") == i).drop("b") if n > 1 else queries
        found = search_block(rows, Block([(r["vec_id"], r["v"]) for r in part.toLocalIterator()]), k)
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.least(F.greatest("score", F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("score"))
