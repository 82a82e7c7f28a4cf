"""Sparse vectors as (id, dim, weight) postings, and the pair of a dense and a sparse search.

A text's weights are its saturated term frequencies, a query's the terms' inverse document frequencies, so that their dot product over the dimensions
they share is BM25. A dimension is the 64-bit hash of a token. ``search`` joins stored postings on dimensions; where a query set has common
dimensions that makes a row for nearly every query and text. ``scan`` sends the queries to the texts instead, in blocks of a bounded size, and each task multiplies its texts'
weights with them and keeps its k best of each query, so that nothing but those is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import saturate
from .retrieval import Best

K1, B = 1.2, 0.75


def dimensions(texts: DataFrame, tokens: Column) -> DataFrame:
    """(dim): the distinct dimensions of some texts."""
    return texts.select(F.explode(F.array_distinct(tokens)).alias("t")).select(F.xxhash64("t").alias("dim")).distinct()


def _frequencies(rows: DataFrame, tokens: Column, key: str, dims: DataFrame | None) -> DataFrame:
    """(key, len, dim, tf); texts without tokens have no row."""
    tk = rows.select(key, tokens.alias("tk")).where("size(tk) > 0")
    each = tk.select(key, F.size("tk").alias("len"), F.explode("tk").alias("t")).select(key, "len", F.xxhash64("t").alias("dim"))
    return (each if dims is None else each.join(dims, "dim", "left_semi")).groupBy(key, "len", "dim").agg(F.count("*").alias("tf"))


def documents(docs: DataFrame, tokens: Column, key: str = "id", dims: DataFrame | None = None) -> DataFrame:
    """(key, dim, weight) of texts; lengths count against the average of all texts, those without tokens too. With ``dims`` only postings of those
    dimensions, dropped before anything is shuffled where their table is small enough to be broadcast."""
    average = docs.agg(F.avg(F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(0)))).first()[0] or 1.0
    f = _frequencies(docs, tokens, key, dims)
    return f.select(key, "dim", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / average))).alias("weight"))


def inverse(vectors: DataFrame, total: int) -> DataFrame:
    """(dim, idf) over the postings of ``total`` texts."""
    df = vectors.groupBy("dim").agg(F.count("*").alias("df"))
    return df.select("dim", F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def queries(texts: DataFrame, tokens: Column, idf: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, dim, weight) of query texts: each distinct token at its inverse document frequency; unknown tokens have none."""
    q = texts.select(key, F.explode(F.array_distinct(tokens)).alias("t")).select(key, F.xxhash64("t").alias("dim"))
    return q.join(idf, "dim").select(key, "dim", F.col("idf").alias("weight"))


def top(scores: DataFrame, k: int, query_key: str = "query_id", key: str = "id", digits: int | None = None) -> DataFrame:
    """The k best of each query with their rank, ties to the smaller key."""
    s = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, asked: DataFrame, k: int, query_key: str = "query_id", key: str = "id", digits: int | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k largest dot products of each query."""
    a = asked.select(query_key, "dim", F.col("weight").alias("q"))
    dots = vectors.join(a, "dim").groupBy(query_key, key).agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return top(dots, k, query_key, key, digits)


#: Queries sent to the tasks at a time, texts multiplied at a time.
BLOCK, TEXTS = 1000, 512


def inverse_of(docs: DataFrame, tokens: Column, dims: DataFrame) -> DataFrame:
    """(dim, idf) of the given dimensions over all texts; counted where the texts lie."""
    total = docs.count()
    each = docs.select(F.explode(F.array_distinct(tokens)).alias("t")).select(F.xxhash64("t").alias("dim"))
    return inverse(each.join(dims, "dim", "left_semi"), total)


def scan(docs: DataFrame, tokens: Column, asked: DataFrame, k: int, query_key: str = "query_id", key: str = "id", digits: int = 6) -> DataFrame:
    """(query_key, key, score, rank): the rows of ``search`` over the texts' postings, without writing or shuffling those.

    asked: (query_key, dim, weight). More than BLOCK queries run in several rounds."""
    spark, size = docs.sparkSession, F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(0))
    average = docs.agg(F.avg(size)).first()[0] or 1.0
    rows = docs.select(key, F.transform(tokens, lambda t: F.xxhash64(t)).alias("dims")).where("size(dims) > 0")
    types = (asked.schema[query_key].dataType, docs.schema[key].dataType)
    kind = f"{query_key} {types[0].simpleString()}, {key} {types[1].simpleString()}, score double"
    schema = pa.schema([(query_key, to_arrow_type(types[0])), (key, to_arrow_type(types[1])), ("score", pa.float64())])
    rounds, out = max(1, -(-asked.select(query_key).distinct().count() // BLOCK)), None
    for r in range(rounds):
        part = (asked if rounds == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(rounds)) == r)).collect()  # about BLOCK queries' tokens
        names = sorted({x[query_key] for x in part})
        dims = np.unique(np.array([x["dim"] for x in part], np.int64))
        q = np.zeros((len(dims), len(names)))
        at = {n: i for i, n in enumerate(names)}
        for x in part:
            q[np.searchsorted(dims, x["dim"]), at[x[query_key]]] += x["weight"]
        sent = spark.sparkContext.broadcast((names, dims, q))

        def scored(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            names, dims, q = sent.value
            best = Best(len(names), k)
            for whole in batches:
                for i in range(0, whole.num_rows if len(dims) else 0, TEXTS):
                    b = whole.slice(i, TEXTS)
                    n = np.diff(b.column(1).offsets.to_numpy())
                    flat = b.column(1).flatten().to_numpy()
                    where = np.minimum(np.searchsorted(dims, flat), len(dims) - 1)
                    hit = dims[where] == flat
                    own = np.repeat(np.arange(len(n)), n)[hit] * len(dims) + where[hit]
                    tf = np.bincount(own, minlength=len(n) * len(dims)).reshape(len(n), -1)
                    scores = np.round((tf * (K1 + 1) / (tf + (K1 * (1 - B + B * n / average))[:, None])) @ q, digits)
                    shared = (tf > 0).astype(np.float32) @ (q > 0).astype(np.float32) > 0
                    best.add(range(len(names)), b.column(0).to_numpy(zero_copy_only=False), np.where(shared, scores, -np.inf).T)
            yield best.batch(names, schema)

        found = rows.mapInArrow(scored, kind).where(F.col("score") > float("-inf"))
        out = found if out is None else out.unionByName(found)
    return top(out, k, query_key, key)


def pair(dense: DataFrame, sparse: DataFrame, k: int, threshold: float = 0.0, dense_weight: float = 0.7, sparse_weight: float = 0.3, query_key: str = "query_id", key: str = "id", digits: int | None = None) -> DataFrame:
    """Both searches' hits of each query fused: weighted dense scores that reach the threshold, and saturated sparse scores, which have none; a missing side counts 0."""
    d = dense.where(F.col("score") >= threshold).select(query_key, key, F.col("score").alias("d"))
    both = d.join(sparse.select(query_key, key, F.col("score").alias("s")), [query_key, key], "full")
    score = F.coalesce("d", F.lit(0.0)) * dense_weight + F.coalesce(saturate("s"), F.lit(0.0)) * sparse_weight
    return top(both.select(query_key, key, score.alias("score")), k, query_key, key, digits)
