"""Hybrid retrieval of many queries in one plan: dense chunks, graph terms, semantic entities and relations, and their merge.

Queries are (query_id, text, vector). A query whose vector is null or can't be compared, as after a failed embedding, has no dense and no
semantic leg and is answered by its graph terms alone. Queries are a stated set: their words and vectors are sent to the tasks in blocks,
the tables are read where they lie."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank_decay, words
from .retrieval import GRAPH_NEIGHBOUR, GRAPH_RELATION, OVERLAP, dense_batch, embed, embedded
from .sparse import top

NEAREST, WORDS = 5, 2000


def entity_points(entities: DataFrame, dims: int = 1024, embedder: Callable[[str, int], list[float]] = embed) -> DataFrame:
    """(id, vector, source_chunks) of entities: what their name and description embed to, one row a name regardless of case."""
    text = F.concat_ws("\n", "name", F.coalesce("description", F.lit("")))
    rows = entities.where("name is not null").select(F.lower("name").alias("id"), text.alias("text"), "source_chunks")
    return embedded(rows, "text", dims=dims, embedder=embedder).select("id", "vector", "source_chunks")


def relation_points(relations: DataFrame, dims: int = 1024, embedder: Callable[[str, int], list[float]] = embed) -> DataFrame:
    """(id, vector, source_chunks) of relations: what their ends, type and description embed to."""
    rows = relations.where("source is not null and target is not null")
    text = F.concat_ws("\n", F.concat_ws(" ", "source", "relation_type", "target"), F.coalesce("description", F.lit("")))
    name = F.lower(F.concat_ws("|", "source", "target", "relation_type"))
    return embedded(rows.select(name.alias("id"), text.alias("text"), "source_chunks"), "text", dims=dims, embedder=embedder).select("id", "vector", "source_chunks")


def _best(hits: DataFrame) -> DataFrame:
    return hits.where("id is not null").groupBy("query_id", "id").agg(F.max("score").alias("score"))


def semantic_leg(queries: DataFrame, points: DataFrame, weight: float = 1.0, nearest: int = NEAREST) -> DataFrame:
    """(query_id, id, score): the chunks of each query's nearest points of cosine 0 or more, at the cosine times the decay of its rank."""
    hits = dense_batch(points.select("id", "vector"), queries.select("query_id", "vector"), nearest).where("score >= 0")
    named = hits.select("query_id", F.col("id").alias("point"), (F.col("score") * rank_decay(F.col("rank") - 1) * weight).alias("score"))
    chunks = named.join(points.select(F.col("id").alias("point"), "source_chunks"), "point")
    return _best(chunks.select("query_id", F.explode("source_chunks").alias("id"), "score"))


def graph_leg(queries: DataFrame, entities: DataFrame, relations: DataFrame, k: int, block: int = WORDS) -> DataFrame:
    """(query_id, id, score): the chunks of the k entities a query's words find, names equal to a word before names that hold it, word by
    word, at the decay of their rank, and their neighbours' chunks at four fifths of it."""
    spoken = queries.select("query_id", F.posexplode(words("text")).alias("at", "word")).withColumn("word", F.lower("word"))
    spoken = spoken.groupBy("query_id", "word").agg(F.min("at").alias("at"))
    e = entities.where("name is not null").select(F.lower("name").alias("name"), "source_chunks")
    names, asked = e.select("name").distinct(), sorted(r["word"] for r in spoken.select("word").distinct().collect())  # the query set's words
    found = None
    for i in range(0, max(len(asked), 1), block):
        some = F.array(*[F.lit(w) for w in asked[i : i + block]]).cast("array<string>")
        here = names.select("name", F.explode(F.filter(some, lambda w: F.contains(F.col("name"), w))).alias("word"))
        found = here if found is None else found.unionByName(here)
    ranked = found.join(spoken, "word").withColumn("kind", (F.col("name") != F.col("word")).cast("int"))
    first = ranked.groupBy("query_id", "name").agg(F.min(F.struct("at", "kind")).alias("o"))
    w = Window.partitionBy("query_id").orderBy("o", "name")
    base = first.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query_id", "name", rank_decay(F.col("rank")).alias("base"))
    r = relations.select(F.lower("source").alias("name"), F.lower("target").alias("other"))
    sides = r.unionByName(r.select(F.col("other").alias("name"), F.col("name").alias("other"))).distinct()
    beside = base.join(sides, "name").groupBy("query_id", F.col("other").alias("name")).agg((F.max("base") * GRAPH_NEIGHBOUR).alias("base"))
    chunks = base.unionByName(beside).join(e, "name").select("query_id", F.explode("source_chunks").alias("id"), F.col("base").alias("score"))
    return _best(chunks)


def hybrid(queries: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame, k: int, *, entity_points: DataFrame | None = None, relation_points: DataFrame | None = None, threshold: float = 0.0, overlap: float = OVERLAP, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank, legs) of the k best chunks (id, vector) of each query. The dense leg fetches max(2k, 10) that reach the
    threshold, the graph leg, terms and semantic points together, k; a chunk of both scores its dense score and a share of its graph score."""
    fetch = max(2 * k, 10)
    dense = dense_batch(chunks.select("id", "vector"), queries.select("query_id", "vector"), fetch, digits=9).where(F.col("score") >= threshold)
    graph = graph_leg(queries, entities, relations, k)
    for points, weight in ((entity_points, 1.0), (relation_points, GRAPH_RELATION)):
        if points is not None:
            graph = graph.unionByName(semantic_leg(queries, points, weight))
    graph = top(_best(graph), k, digits=9)
    both = dense.select("query_id", "id", F.col("score").alias("d")).join(graph.select("query_id", "id", F.col("score").alias("g")), ["query_id", "id"], "full")
    score = F.when(F.col("d").isNull(), F.col("g")).when(F.col("g").isNull(), F.col("d")).otherwise(F.col("d") + F.col("g") * overlap)
    legs = F.when(F.col("g").isNull(), "dense").when(F.col("d").isNull(), "graph").otherwise("both")
    return top(both.select("query_id", "id", score.alias("score"), legs.alias("legs")), k, digits=digits)
