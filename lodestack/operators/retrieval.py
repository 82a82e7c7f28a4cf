"""Top-k retrieval over chunk tables: keyword, dense, fused, graph, hybrid, with filters before the cut.

Scores order descending and ties by key, so every result is one result. Filters are applied before the top k, which gives k rows whenever k
rows qualify."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank_decay, saturate

OVERLAP = 0.3
GRAPH_NEIGHBOUR, GRAPH_RELATION = 0.8, 0.9


def top_k(df: DataFrame, k: int | None, score: str = "score", key: str = "id", digits: int | None = None) -> DataFrame:
    s = F.round(score, digits) if digits is not None else F.col(score)
    out = df.withColumn(score, s).orderBy(F.col(score).desc(), F.col(key))
    return out if k is None else out.limit(k)


def keyword_score(content: str, query: str) -> Column | None:
    """Share of the query's words, repeats counted, that stand in the text; None for a blank query."""
    terms = query.lower().split()
    if not terms:
        return None
    text = F.lower(F.col(content))
    return sum((text.contains(F.lit(t)).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def keyword_search(chunks: DataFrame, query: str, k: int, threshold: float = 0.0, content: str = "content", key: str = "id") -> DataFrame:
    s = keyword_score(content, query)
    scored = chunks.withColumn("score", F.lit(0.0) if s is None else s)
    return top_k(scored.where(F.lit(False)) if s is None else scored.where(F.col("score") > threshold), k, key=key)


def _doubles(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(v: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed vector, in double precision; a zero vector scores 0."""
    q = _doubles(query)
    norm = F.sqrt(dot(v, v.cast("array<double>"))) * float(np.linalg.norm(np.asarray(query, float)))
    return F.when(norm == 0, 0.0).otherwise(dot(v, q) / norm)


def usable(vector: str = "vector") -> Column:
    """Vectors that have a direction: not null, all components finite, not all zero."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)


def dense_search(vectors: DataFrame, query: Sequence[float], k: int | None, threshold: float | None = None, vector: str = "vector", key: str = "id", digits: int | None = None) -> DataFrame:
    """The k best rows, or with k None all rows that reach the threshold. Rows whose vector is null or holds null or non-finite components take no part."""
    v = F.col(vector)
    fine = vectors.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))))
    scored = fine.withColumn("score", cosine(v, query))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return top_k(scored, k, key=key, digits=digits)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


#: Queries and rows whose scores a task holds at once: 16 MB, however many there are of either.
TILE = (1024, 2048)


class Best:
    """The k best (score, id) of each of n queries among what was added, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.held: list[list[tuple[float, object]]] = [[] for _ in range(n)]

    def add(self, queries: Sequence[int], ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each of the queries, a column for each id."""
        if not scores.size:
            return
        queries = np.asarray(queries)
        for at in np.flatnonzero(scores.max(axis=1) >= self.least[queries]).tolist():
            i, s = int(queries[at]), scores[at]
            edge = max(self.least[i], np.partition(s, -self.k)[-self.k] if len(s) > self.k else -np.inf)
            at = np.flatnonzero(s >= edge)
            if len(at):
                held = sorted([*self.held[i], *zip(s[at].tolist(), ids[at].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[: self.k]
                self.held[i] = held
                if len(held) == self.k:
                    self.least[i] = held[-1][0]

    def products(self, queries: Sequence[int], q: np.ndarray, ids: np.ndarray, x: np.ndarray, digits: int) -> None:
        """Adds the rounded products of the queries' vectors q with the vectors x of the ids, tile by tile."""
        queries, (many, rows) = np.asarray(queries), TILE
        for j in range(0, len(x), rows):
            for i in range(0, len(q), many):
                s = q[i : i + many] @ x[j : j + rows].T
                self.add(queries[i : i + many], ids[j : j + rows], np.round(s, digits, out=s))

    def batch(self, names: Sequence[object], schema: pa.Schema) -> pa.RecordBatch:
        """(query, id, score) of all that is held."""
        rows = [(name, i, s) for name, held in zip(names, self.held, strict=True) for s, i in held]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


def dense_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", query_key: str = "query_id", digits: int = 6, most: int = 10_000) -> DataFrame:
    """Cosine top k of many query vectors: each task scores its rows in matrix products, batch by batch, and sends its k best of each query.

    Vectors that are null, hold null or non-finite components or are all zero take no part, as rows or as queries. The queries are broadcast; more than ``most`` run in several rounds.
    Of many rounds each reads its rows in few tasks, as every task sends k rows of each query."""
    from pyspark.sql.pandas.types import to_arrow_type

    vectors, queries = vectors.where(usable(vector)), queries.where(usable(vector))
    sc, total = vectors.sparkSession.sparkContext, queries.count()
    rounds = max(1, -(-total // most))
    types = {f.name: f.dataType for f in [*vectors.schema, *queries.schema]}
    schema = pa.schema([(query_key, to_arrow_type(types[query_key])), (key, to_arrow_type(types[key])), ("score", pa.float64())])
    near = vectors.select(key, vector)
    near = near if rounds == 1 else near.coalesce(max(2, -(-sc.defaultParallelism // rounds)))  # a union of single partitions would be one task
    out = None
    for r in range(rounds):
        part = queries if rounds == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(rounds)) == r)
        rows = part.select(query_key, vector).collect()
        sent = sc.broadcast(([x[query_key] for x in rows], unit(np.array([x[vector] for x in rows], float).reshape(len(rows), -1))))

        def best(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            held = Best(len(names), k)
            for b in batches:
                if b.num_rows and names:
                    held.products(range(len(names)), q, b.column(0).to_numpy(zero_copy_only=False), unit(matrix(b.column(1))), digits)
            yield held.batch(names, schema)

        found = near.mapInArrow(best, f"{query_key} {types[query_key].simpleString()}, {key} {types[key].simpleString()}, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = 0.7, sparse_weight: float = 0.3, key: str = "id", digits: int | None = None) -> DataFrame:
    """Weighted sum of dense scores and saturated sparse scores; a missing side counts 0."""
    both = dense.select(key, F.col("score").alias("d")).join(sparse.select(key, F.col("score").alias("s")), key, "full")
    score = F.coalesce("d", F.lit(0.0)) * dense_weight + F.coalesce(saturate("s"), F.lit(0.0)) * sparse_weight
    return top_k(both.select(key, score.alias("score")), k, key=key, digits=digits)


def boost(vector_hits: DataFrame, graph_hits: DataFrame, k: int, overlap: float = OVERLAP, key: str = "id", digits: int | None = None) -> DataFrame:
    """Vector hits, raised by a share of the graph score where both have the chunk, and the graph's own hits."""
    both = vector_hits.select(key, F.col("score").alias("v")).join(graph_hits.select(key, F.col("score").alias("g")), key, "full")
    score = F.when(F.col("v").isNull(), F.col("g")).when(F.col("g").isNull(), F.col("v")).otherwise(F.col("v") + F.col("g") * overlap)
    return top_k(both.select(key, score.alias("score")), k, key=key, digits=digits)


def graph_scores(entities: DataFrame, relations: DataFrame, ranked: DataFrame, semantic: DataFrame | None = None, legacy: bool = False) -> DataFrame:
    """Chunks of ranked entities (name, rank from 0) and of their neighbours: the best score of each chunk.

    ``semantic`` holds (chunk, score) of semantic hits, which join the maximum unless ``legacy`` drops them."""
    e = entities.select(F.lower("name").alias("name"), "source_chunks")
    base = ranked.select(F.lower("name").alias("name"), rank_decay(F.col("rank")).alias("base"))
    own = base.join(e, "name").select(F.explode("source_chunks").alias("id"), F.col("base").alias("score"))
    ends = relations.select(F.lower("source").alias("name"), F.lower("target").alias("other"), F.col("source_chunks").alias("c"))
    ends = ends.unionByName(ends.select(F.col("other").alias("name"), F.col("name").alias("other"), "c"))
    touched = base.join(ends, "name")
    through = touched.select(F.explode("c").alias("id"), (F.col("base") * GRAPH_NEIGHBOUR).alias("score"))
    beside = touched.select(F.col("other").alias("name"), "base").join(e, "name").select(F.explode("source_chunks").alias("id"), (F.col("base") * GRAPH_NEIGHBOUR).alias("score"))
    hits = own.unionByName(through).unionByName(beside)
    if semantic is not None and not legacy:
        hits = hits.unionByName(semantic.select("id", "score"))
    return hits.groupBy("id").agg(F.max("score").alias("score"))


def semantic_chunks(hits: DataFrame, tables: DataFrame, relation: bool = False, key: str = "name") -> DataFrame:
    """(id, score) of the chunks of semantic entity or relation hits: rank decay, relations at nine tenths."""
    w = Window.orderBy(F.col("score").desc(), key)  # hits are a top k
    ranked = hits.withColumn("rank", F.row_number().over(w) - 1)
    weight = GRAPH_RELATION if relation else 1.0
    return ranked.join(tables, key).select(F.explode("source_chunks").alias("id"), (rank_decay(F.col("rank")) * weight).alias("score"))


def rerank(hits: DataFrame, scorer: Column | None, k: int, key: str = "id") -> DataFrame:
    """Replaces scores by a scorer's (a column, such as a pandas UDF of query and text); without one the scores stay."""
    return top_k(hits if scorer is None else hits.withColumn("score", scorer), k, key=key)


def late_interaction(query: str, text: str) -> float | None:
    """The offline pair scorer: for each distinct word of the query the closest word of the text, by the share of letters that they begin with in
    common, on the average. None without words on either side."""
    words = [sorted(set(re.findall(r"[^\W_]+", x.lower()))) for x in (query, text)]
    if not words[0] or not words[1]:
        return None
    return sum(_closest(a, words[1]) for a in words[0]) / len(words[0])


def _closest(a: str, words: list[str]) -> float:
    """The largest share of common first letters; only words of the same first letter, which stand together, can have any."""
    best = 0.0
    for b in words[bisect_left(words, a[0]) : bisect_left(words, chr(ord(a[0]) + 1))]:
        n = min(len(a), len(b))
        if n > best * max(len(a), len(b)):
            best = max(best, next((i for i in range(n) if a[i] != b[i]), n) / max(len(a), len(b)))
    return best


def rerank_batch(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, scorer: Callable[[str, str], float | None] = late_interaction, key: str = "id", query_key: str = "query_id", digits: int = 6) -> DataFrame:
    """(query, id, score, rank) of many queries' hits after a scorer of (query text, chunk text), in Arrow batches; the best k of each query.

    Fetch ``candidates(k)`` hits a query before. A pair that the scorer can't score (None, NaN, a ValueError) keeps its old score, as does
    one whose text is missing. Only chunks that are hits are read into the scorer."""

    @F.pandas_udf("double")
    def run(asked: pd.Series, texts: pd.Series, old: pd.Series) -> pd.Series:
        def one(q: str | None, t: str | None, s: float) -> float:
            try:
                x = None if q is None or t is None else scorer(q, t)
            except ValueError:
                x = None
            return s if x is None or x != x else round(x, digits)

        return pd.Series([one(*row) for row in zip(asked, texts, old, strict=True)], dtype=float)

    pairs = hits.select(query_key, key, F.col("score").cast("double").alias("score")).join(queries.select(query_key, F.col("text").alias("_asked")), query_key).join(chunks.select(key, F.col("content").alias("_content")), key, "left")
    scored = pairs.withColumn("score", run("_asked", "_content", "score")).select(query_key, key, "score")
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(k: int) -> int:
    """How many hits to fetch for a rerank to k."""
    return max(3 * k, 10)


def token_overlap(content: str, query: str) -> Column:
    """The offline scorer: share of the query's distinct words in the text's words."""
    q = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))])
    return F.size(F.array_intersect(q, F.split(F.lower(F.col(content)), r"(?U)\s+"))) / F.size(q)


def palace(chunks: DataFrame, wing: str | None = None, hall: str | None = None, room: str | None = None) -> DataFrame:
    """Conversation chunks of the given place."""
    h = F.col("heading_hierarchy")
    halls = F.coalesce("signature", F.get(h, 2))
    rooms = F.coalesce("symbol", F.when(F.col("signature").isNull() & (F.size(h) < 4), F.get(h, 2)).otherwise(F.get(h, 3)))
    out = chunks
    for want, have in ((wing, F.get(h, 1)), (hall, halls), (room, rooms)):
        if want is not None:
            out = out.where((F.col("language") == "conversation") & (have == want))
    return out


def memory_search(chunks: DataFrame, vectors: DataFrame, query: Sequence[float], k: int, threshold: float | None = None, most: int = 100, key: str = "id", digits: int | None = None, **place: str | None) -> DataFrame:
    """Chunks of a place (wing, hall, room) by their vectors' cosine, best first: the place is chosen before the top k, whose size is
    clamped to 1..most; hits meet their chunks by id."""
    inside = palace(chunks, **place)
    k = max(1, min(k, most))
    hits = dense_search(vectors.join(inside.select(key), key, "left_semi"), query, k, threshold, key=key, digits=digits).select(key, "score")
    return top_k(inside.join(F.broadcast(hits), key), k, key=key)  # at most ``most`` hits


def search(mode: str, **legs: Callable[[], DataFrame]) -> DataFrame:
    """naive: the vector leg; local and global: the graph leg; hybrid: both."""
    if mode == "naive":
        return legs["vector"]()
    if mode in ("local", "global"):
        return legs["graph"]()
    if mode == "hybrid":
        return legs["hybrid"]()
    raise ValueError(f"unknown mode {mode!r}")


def cascade(*tiers: DataFrame) -> DataFrame:
    """The first tier that has a row."""
    for t in tiers[:-1]:
        if not t.isEmpty():
            return t
    return tiers[-1]


def embed(text: str, dims: int = 1024) -> list[float]:
    """The offline embedder: a deterministic unit vector from a hash of the text (no semantics)."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    out = np.empty(dims)
    for i in range(dims):
        h = (h * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        out[i] = (h >> 33) / 2**31 * 2 - 1
    return (out / np.linalg.norm(out)).tolist()


def embedded(df: DataFrame, text: str, vector: str = "vector", dims: int = 1024, embedder: Callable[[str, int], list[float]] = embed) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: embedder(x or "", dims))

    return df.withColumn(vector, run(text))


def bm25(docs: DataFrame, query: str, k: int, tokens: Column, key: str = "id", k1: float = 1.2, b: float = 0.75, every: bool = True, digits: int | None = None) -> DataFrame:
    """BM25 of the query's distinct tokens; with ``every`` a row must hold them all. Statistics come from one pass over all rows."""
    terms = sorted({t for t in re.split(r"[^\w]+|_", query.lower()) if t})
    rows = docs.select(key, tokens.alias("tk")).select(key, F.size("tk").alias("len"), *[(F.size("tk") - F.size(F.array_remove("tk", t))).alias(f"f{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(terms))]).first()
    if not terms or not stats["n"]:
        return rows.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    part = []
    for i in range(len(terms)):
        idf = float(np.log(1 + (stats["n"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)))
        f = F.col(f"f{i}")
        part.append(f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / float(stats["avg"] or 1))) * idf)
    held = F.lit(True) if every else F.lit(False)
    for i in range(len(terms)):
        held = (held & (F.col(f"f{i}") > 0)) if every else (held | (F.col(f"f{i}") > 0))
    return top_k(rows.where(held).select(key, sum(part[1:], part[0]).alias("score")), k, key=key, digits=digits)
