"""Conversations taken in as one job: chunks, source rows, navigation nodes, lessons and audit rows, and the stored tables they go to.

Sources are (source_path, format, wing, hall, room), messages (source_id, role, content, turn_index) whose source_id is a source's path. A
source named twice counts once, with its greatest row; messages of no source are left out; a source without messages has no chunks and
a count of 0. Null contents are empty texts. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import confidence, lesson_id, pattern_key, sha_prefix, slug, strip
from . import chunking, storage
from .transcripts import MAX_LESSONS, MIN_CONFIDENCE, MIN_OCCURRENCES

PALACE = ["wing", "hall", "room"]
KEYS = {"sources": ["source_path"], "chunks": ["source_path"], "nodes": ["node_id"], "lessons": ["lesson_id"]}


def placed(sources: DataFrame, project: str) -> DataFrame:
    """One row a path. A source with a hall or room but no wing lies in the project's; one without any of them lies nowhere."""
    one = sources.groupBy("source_path").agg(F.max(F.struct("format", *PALACE)).alias("x")).select("source_path", "x.*")
    return one.withColumn("wing", F.when(F.coalesce(*PALACE).isNotNull(), F.coalesce("wing", F.lit(project))))


def nodes(sources: DataFrame, project: str) -> DataFrame:
    """Drawers of the wings, closets of the halls in them, rooms in closets or, without a hall, in drawers; each once."""
    none = F.lit(None).cast("string")

    def at(kind: str, *path: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), slug(path[-1]), F.lit("-"), sha_prefix(32, F.lit("v2"), F.lit(project), F.lit(kind), *[F.col(c) for c in path]))

    drawer, closet = at("drawer", "wing"), at("closet", "wing", "hall")
    kinds = {
        "drawer": [drawer, F.col("wing"), none, F.col("wing"), none, none],
        "closet": [closet, F.col("hall"), drawer, F.col("wing"), F.col("hall"), none],
        "room": [at("room", *PALACE), F.col("room"), F.when(F.col("hall").isNull(), drawer).otherwise(closet), *[F.col(c) for c in PALACE]],
    }
    names = ["node_id", "label", "parent_node_id", *PALACE]
    rows = [F.when(label.isNotNull(), F.struct(F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(cols, names, strict=True)])) for kind, cols in kinds.items() for label in cols[1:2]]
    out = placed(sources, project).where("wing is not null").select(*PALACE).distinct().select(F.explode(F.array_compact(F.array(*rows))).alias("x"))
    return out.select("x.node_id", F.lit(project).alias("project_id"), "x.kind", "x.label", "x.parent_node_id", *[f"x.{c}" for c in PALACE]).distinct()


def lessons(messages: DataFrame, project: str, least: int = MIN_OCCURRENCES, min_confidence: int = MIN_CONFIDENCE, most: int = MAX_LESSONS) -> DataFrame:
    """Of each source its most frequent sure motifs. A lesson that several sources teach is kept as the last path has it."""
    g = messages.where(strip("content") != "").groupBy("source_id", "role", F.col("content").alias("canonical_text")).agg(F.count("*").alias("occurrence_count"))
    sure = g.where(F.col("occurrence_count") >= least).withColumns({"confidence_percent": confidence("canonical_text", "occurrence_count"), "pattern_key": pattern_key("role", "canonical_text")})
    best = Window.partitionBy("source_id").orderBy(F.col("occurrence_count").desc(), "canonical_text", "pattern_key")
    taken = sure.where(F.col("confidence_percent") >= min_confidence).withColumn("k", F.row_number().over(best)).where(F.col("k") <= most)
    row = F.struct(F.col("source_id").alias("source_transcript_path"), "pattern_key", "role", "canonical_text", "occurrence_count", "confidence_percent")
    return taken.groupBy(lesson_id(F.lit(project), "pattern_key").alias("lesson_id")).agg(F.max(row).alias("x")).select("lesson_id", F.lit(project).alias("project_id"), "x.*")


def records(messages: DataFrame, sources: DataFrame, project: str, at: int) -> dict[str, DataFrame]:
    """sources, chunks, nodes, lessons and audit of the messages; ``at`` is the time of the change in milliseconds."""
    known, now = placed(sources, project), F.lit(at).cast("long").alias("updated_at")
    own = messages.withColumn("content", F.coalesce("content", F.lit(""))).join(known.select(F.col("source_path").alias("source_id")), "source_id", "left_semi")
    plain = chunking.conversation(own.select("source_id", "role", "content", "turn_index")).drop("heading_hierarchy", "symbol", "signature")
    chunks = plain.join(known.drop("format"), "source_path").withColumn("heading_hierarchy", F.array_compact(F.array(F.lit("conversation"), *PALACE)))
    counted = own.groupBy(F.col("source_id").alias("source_path")).agg(F.count("*").alias("message_count"))
    rows = known.join(counted, "source_path", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    params = F.to_json(F.struct(F.lit(project).alias("project_id"), F.col("source_path").alias("path"), F.col("message_count").alias("ingested_chunks")))
    return {
        "sources": rows.select(F.lit(project).alias("project_id"), "*", now),
        "chunks": chunks.withColumnsRenamed({"room": "symbol", "hall": "signature"}),
        "nodes": nodes(sources, project).select("*", now),
        "lessons": lessons(own, project).select("*", now),
        "audit": rows.select(F.lit("memory.ingest_conversation").alias("operation"), F.lit("ok").alias("outcome"), params.alias("params"), now),
    }


def commit(found: dict[str, DataFrame], folder: str, buckets: int = 64) -> dict[str, storage.Stored]:
    """Writes records to the bucketed tables of a folder, which are created when missing. Chunks give way to those of the same source,
    other rows to newer ones of their key. Each table changes as a whole; a commit that broke off can be repeated with the same result. The audit
    rows are added last, so they tell of commits that went through."""
    spark, out = found["sources"].sparkSession, {}
    for name, key in KEYS.items():
        table = out[name] = storage.Stored(spark, f"{folder}/{name}")
        if not table.manifests.numbers():
            storage.Stored.create(found[name], table.folder, key, buckets, dealt=name == "chunks")  # numbered by source: they lie by their key
        elif name == "chunks":
            table.replace(found["sources"].select("source_path"), found[name], dealt=True)
        else:
            table.upsert(found[name])
    found["audit"].write.mode("append").parquet(f"{folder}/audit")
    return out
