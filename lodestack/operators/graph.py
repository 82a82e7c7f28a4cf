"""Knowledge graph: merge, search, neighbours, removal, statistics; navigation trees."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_name, tunnel_ends
from .storage import shared_folder

ENTITY = "name string, entity_type string, description string, source_chunks array<string>"
RELATION = "source string, target string, relation_type string, description string, weight double, source_chunks array<string>"


def parse_extraction(payload: str, chunk: str) -> tuple[list[dict], list[dict]]:
    """Entities and relations of a model's JSON, bare or in a code fence; items without their required keys are left out."""
    m = re.search(r"```(?:json)?\s*(.*?)```", payload, re.S)
    try:
        x = json.loads(m.group(1) if m else payload[payload.find("{") : payload.rfind("}") + 1])
    except ValueError:
        return [], []
    ents = [{"name": e["name"], "entity_type": e.get("type") or e.get("entity_type") or "unknown", "description": e.get("description", ""), "source_chunks": [chunk]} for e in x.get("entities", []) if isinstance(e, dict) and e.get("name")]
    rels = [{"source": r["source"], "target": r["target"], "relation_type": r.get("relation_type") or r.get("type") or "related_to", "description": r.get("description", ""), "weight": 1.0, "source_chunks": [chunk]} for r in x.get("relations", []) if isinstance(r, dict) and r.get("source") and r.get("target")]
    return ents, rels


def normalised(entities: DataFrame) -> DataFrame:
    """Names in canonical form; empty ones are left out."""
    return entities.withColumn("name", entity_name("name")).where("name <> ''")


def merge_entities(entities: DataFrame, order: str = "position") -> DataFrame:
    """One entity per name regardless of case, rows taken by ``order``: first type, last name, descriptions that add something joined
    by '; ', chunks united in order of appearance."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        text, chunks = "", {}
        for d, c in zip(g["description"], g["source_chunks"], strict=True):
            if d and d not in text:
                text = f"{text}; {d}" if text else d
            chunks.update(dict.fromkeys(c if c is not None else ()))
        return pd.DataFrame([{"name": g["name"].iloc[-1], "entity_type": g["entity_type"].iloc[0], "description": text, "source_chunks": list(chunks)}])

    return entities.withColumn("_key", F.lower("name")).groupBy("_key").applyInPandas(merge, ENTITY)


def triple() -> list[Column]:
    return [F.lower("source"), F.lower("target"), F.lower("relation_type")]


def merge_relations(relations: DataFrame, order: str = "position") -> DataFrame:
    """The first relation of each triple regardless of case."""
    w = Window.partitionBy(*triple()).orderBy(order)
    return relations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return entities.agg(F.countDistinct(F.lower("name")).alias("entities")).join(relations.agg(F.countDistinct(F.concat_ws("|", *triple())).alias("relations")), F.lit(True))


def term_search(entities: DataFrame, query: str, most: int) -> DataFrame:
    """Entities by the query's words in turn: equal names, then names that contain the word; (name, rank from 0)."""
    terms = query.lower().split()
    name = F.lower("name")
    if not terms:
        return entities.select("name", F.lit(0).alias("rank")).where(F.lit(False))
    place = [F.when(name == t, F.struct(F.lit(i).alias("term"), F.lit(0).alias("kind"))).when(name.contains(t), F.struct(F.lit(i).alias("term"), F.lit(1).alias("kind"))) for i, t in enumerate(terms)]
    found = entities.withColumn("at", F.coalesce(*place)).where("at is not null").select("name", "at.term", "at.kind")
    cut = found.orderBy("term", "kind", F.lower("name")).limit(most)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy("term", "kind", F.lower("name"))) - 1).select("name", "rank")  # at most ``most`` rows


def view(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Nodes and edges of the graph in one table: part, id (a node's name, an edge's source), target and type.
    Nodes without a name and edges without an end are left out; a missing type is 'entity' or 'relation'."""
    kind = lambda c, other: F.coalesce(c, F.lit(other)).alias("type")
    nodes = entities.where("name is not null").select(F.lit("node").alias("part"), F.col("name").alias("id"), F.lit(None).cast("string").alias("target"), kind("entity_type", "entity"))
    edges = relations.where("source is not null and target is not null").select(F.lit("edge").alias("part"), F.col("source").alias("id"), "target", kind("relation_type", "relation"))
    return nodes.unionByName(edges)


def view_counts(view: DataFrame) -> DataFrame:
    """entity_count and relation_count of a view."""
    return view.agg(F.count_if(F.col("part") == "node").alias("entity_count"), F.count_if(F.col("part") == "edge").alias("relation_count"))


def ends(relations: DataFrame) -> DataFrame:
    """(name, other, and the relation's columns) from both ends, in lower case."""
    r = relations.select(F.lower("source").alias("name"), F.lower("target").alias("other"), "relation_type", "source_chunks")
    return r.unionByName(r.select(F.col("other").alias("name"), F.col("name").alias("other"), "relation_type", "source_chunks"))


def neighbours(relations: DataFrame, names: DataFrame) -> DataFrame:
    """(name, other) of every relation that touches a name."""
    return names.select(F.lower("name").alias("name")).distinct().join(ends(relations), "name").select("name", "other").distinct()


def remove_chunk(entities: DataFrame, relations: DataFrame, chunk: str) -> tuple[DataFrame, DataFrame]:
    """Without the chunk: entities that had no other go, as do relations that mention it."""
    had = F.array_contains("source_chunks", chunk)
    kept = entities.withColumn("_had", had).withColumn("source_chunks", F.array_remove("source_chunks", chunk)).where(~F.col("_had") | (F.size("source_chunks") > 0)).drop("_had")
    return kept, relations.where(~had)


def top_types(entities: DataFrame, k: int = 8, kind: str = "entity_type") -> DataFrame:
    return entities.groupBy(F.col(kind).alias("entity_type")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "entity_type").limit(k)


def _durable(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: the plan behind them ends there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def traverse(nodes: DataFrame, start: str, depth: int, most: int = 2000, tunnels: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Nodes reached from ``start`` over parent and child edges with their least depth, level by level; tunnels with both ends reached.

    Each level joins the edges to the last level's nodes, less those reached before, and is checkpointed, so plans do not grow with the depth. At most ``most`` nodes are kept, the nearest first, then by kind, label and id."""
    edges = nodes.where("parent_node_id is not null").select(F.col("node_id").alias("a"), F.col("parent_node_id").alias("b"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    frontier = seen = nodes.where(F.col("node_id") == start).select("node_id", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        step = frontier.join(edges, F.col("node_id") == F.col("a")).select(F.col("b").alias("node_id")).distinct()
        frontier = _durable(step.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # one checkpoint a level
    out = seen.join(nodes, "node_id").orderBy("depth", "kind", "label", "node_id").limit(most)
    if tunnels is None:
        return out, None
    got = out.select("node_id")
    both = tunnels.join(got.withColumnRenamed("node_id", "from_node_id"), "from_node_id", "left_semi").join(got.withColumnRenamed("node_id", "to_node_id"), "to_node_id", "left_semi")
    return out, both


def walk(nodes: DataFrame, start: str, depth: int, most: int = 2000) -> tuple[DataFrame, bool]:
    """(nodes with position and depth, truncated): the nodes that a queue from ``start`` meets, a node's parent before its children by kind,
    label and id. It ends after ``most`` nodes; truncated says whether the queue then still held any. Without the start there are no rows.

    A level is joined to the last one, which is no more than ``most`` rows and so is broadcast, and cut to what may still come; later
    levels are never looked at. A parent that is no node is passed over. Ids are unique."""
    first = nodes.select("node_id", "kind", "label", "parent_node_id")
    rank = ["at", "side", "kind", "label", "node_id"]

    def met(level: DataFrame) -> DataFrame:
        """New nodes next to the level, each by its first way there."""
        at = F.broadcast(level.select(F.col("position").alias("at"), F.col("node_id").alias("a"), F.col("parent_node_id").alias("up")))
        up = first.join(at, F.col("node_id") == F.col("up")).withColumn("side", F.lit(0))
        down = first.join(at, F.col("parent_node_id") == F.col("a")).withColumn("side", F.lit(1))
        ways = up.unionByName(down).groupBy("node_id").agg(F.min(F.struct(*rank, "parent_node_id")).alias("x")).select("x.*")
        return ways.join(F.broadcast(seen.select("node_id")), "node_id", "left_anti")

    def whole() -> DataFrame:
        got = F.broadcast(seen.where(F.col("position") < most).select("node_id", "depth", "position"))
        return nodes.drop("depth", "position").join(got, "node_id").orderBy("position")

    found = first.where(F.col("node_id") == start).limit(1)
    level = seen = _durable(found.select("node_id", "parent_node_id", F.lit(0).alias("depth"), F.lit(0).alias("position")))
    n = seen.count()
    last = n
    for d in range(1, depth + 1):
        if not last:
            break
        if n >= most:  # the node that filled it was not asked for its neighbours
            return whole(), not met(level.where(F.col("position") < n - 1)).isEmpty()
        best = met(level).orderBy(*rank).limit(most - n + 1)  # one more tells whether it is cut
        order = F.row_number().over(Window.orderBy(*rank)) - 1 + n  # over at most that many rows
        level = _durable(best.select("node_id", "parent_node_id", F.lit(d).alias("depth"), order.alias("position")))
        last = level.count()
        seen, n = seen.unionByName(level), n + last
        if n > most:
            break
    return whole(), n > most


def tunnels_touching(tunnels: DataFrame, ids: list[str]) -> DataFrame:
    """Tunnels with either end in the list."""
    return tunnels.where(F.col("from_node_id").isin(ids) | F.col("to_node_id").isin(ids)).dropDuplicates(["tunnel_id"])


def with_ends(tunnels: DataFrame) -> DataFrame:
    """Ends in order; tunnels from a node to itself are not valid and go."""
    low, high = tunnel_ends("from_node_id", "to_node_id")
    return tunnels.where("from_node_id <> to_node_id").withColumns({"from_node_id": low, "to_node_id": high})


#: Allowed parents: drawers stand alone, closets in drawers, rooms in either.
PARENTS = {"drawer": (), "closet": ("drawer",), "room": ("drawer", "closet")}


def parent_violations(nodes: DataFrame) -> DataFrame:
    p = nodes.select(F.col("node_id").alias("p_id"), F.col("kind").alias("p_kind"))
    joined = nodes.join(p, F.col("parent_node_id") == F.col("p_id"), "left")
    bad = [((F.col("kind") == k) & (F.col("parent_node_id").isNotNull() if not allowed else ~F.coalesce(F.col("p_kind").isin(*allowed), F.lit(False)))) for k, allowed in PARENTS.items()]
    return joined.where(reduce(lambda a, b: a | b, bad))
