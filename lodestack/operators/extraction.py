"""Entities and relations from chunks with gleaning: passes over each chunk until nothing is missed, then one row per entity and relation.

An extractor is a function of a text and of what was found before (None in the first pass, then {"entities": [...], "relations": [...]}) that
returns a model's answer as text; it runs in the tasks. A chunk whose first pass fails in every try gives one row of kind ``failed`` and nothing
else; a later pass that fails ends its chunk's passes and keeps what was found. Null texts count as empty; empty input gives no rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import parse_extraction

MENTION = "chunk string, kind string, seq int, name string, target string, type string, description string"
ROUNDS, TRIES, LONGEST = 1, 2, 2000

Extractor = Callable[[str, dict | None], str]


def _items(payload: str, chunk: str) -> tuple[list[dict], list[dict]]:
    """As parse_extraction, but an answer that is no JSON object is an error."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", payload, re.S)
    body = fenced.group(1) if fenced else payload[payload.find("{") : payload.rfind("}") + 1]
    if not isinstance(json.loads(body), dict):
        raise ValueError("no object")
    return parse_extraction(payload, chunk)


def passes(text: str, chunk: str, extractor: Extractor, rounds: int = ROUNDS, tries: int = TRIES) -> tuple[list[dict], list[dict]]:
    """What the first pass and at most ``rounds`` further ones find; raises what the last try of the first pass raised."""
    for n in range(tries):
        try:
            entities, relations = _items(extractor(text, None), chunk)
            break
        except (ValueError, OSError):
            if n == tries - 1:
                raise
    for _ in range(rounds):
        try:
            more, links = _items(extractor(text, {"entities": entities, "relations": relations}), chunk)
        except (ValueError, OSError):
            break
        if not more and not links:
            break
        entities, relations = entities + more, relations + links
    return entities, relations


def mentions(chunks: DataFrame, extractor: Extractor, rounds: int = ROUNDS, tries: int = TRIES, key: str = "id", content: str = "content", store: str | None = None) -> DataFrame:
    """(chunk, kind, seq, name, target, type, description): a row per entity and relation of each chunk in the order found; of kind ``failed``
    with the error as description. A task holds one batch's findings. Extractors are dear: give ``store``, a folder that all tasks share, and the rows are
    written there once and read again; without it every use of the result runs the extractor anew."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for chunk, text in zip(frame["chunk"], frame["text"], strict=True):
                try:
                    entities, relations = passes(text, chunk, extractor, rounds, tries)
                except (ValueError, OSError) as e:
                    rows.append((chunk, "failed", 0, None, None, None, str(e)))
                    continue
                rows += [(chunk, "entity", i, str(e["name"]), None, str(e["entity_type"]), str(e["description"] or "")) for i, e in enumerate(entities)]
                rows += [(chunk, "relation", i, str(r["source"]), str(r["target"]), str(r["relation_type"]), str(r["description"] or "")) for i, r in enumerate(relations)]
            yield pd.DataFrame(rows, columns=["chunk", "kind", "seq", "name", "target", "type", "description"])

    found = chunks.select(F.col(key).cast("string").alias("chunk"), F.coalesce(content, F.lit("")).alias("text")).mapInPandas(run, MENTION)
    if store is None:
        return found
    found.write.parquet(store)
    return found.sparkSession.read.schema(MENTION).parquet(store)


def entities(found: DataFrame, summarise: Callable[[str, str], str] | None = None, longest: int = LONGEST) -> DataFrame:
    """(name, entity_type, description, chunks): one row per name regardless of case, mentions in the order of chunk and seq: the first type,
    the last name, distinct descriptions of which each adds something joined by '; ', and the number of chunks.

    Mentions are reduced to distinct descriptions before an entity's rows meet, and the chunks are counted, not listed: they stay in the
    mentions. A description of more than ``longest`` characters is replaced by ``summarise(name, description)``."""
    e = found.where("kind = 'entity'").withColumn("key", F.lower("name")).withColumn("at", F.struct("chunk", "seq"))
    texts = e.groupBy("key", "description").agg(F.min("at").alias("at"))
    told = texts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "description"))), lambda x: x["description"]).alias("all"))
    joined = F.aggregate("all", F.lit(""), lambda a, d: F.when((d == "") | F.contains(a, d), a).when(a == "", d).otherwise(F.concat(a, F.lit("; "), d)))
    facts = e.groupBy("key").agg(F.max_by("name", "at").alias("name"), F.min_by("type", "at").alias("entity_type"))
    counts = e.select("key", "chunk").distinct().groupBy("key").agg(F.count("*").alias("chunks"))
    out = facts.join(told, "key").join(counts, "key").select("name", "entity_type", joined.alias("description"), "chunks")
    if summarise is None:
        return out

    @F.pandas_udf("string")
    def shorter(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else summarise(n, x).strip() for n, x in zip(names, texts, strict=True)], dtype=object)

    long = F.when(F.length("description") > longest, F.col("description"))
    return out.withColumn("description", F.coalesce(shorter("name", long), "description"))


def relations(found: DataFrame) -> DataFrame:
    """(source, target, relation_type, description, chunks): the first mention of each triple regardless of case, and the number of chunks."""
    r = found.where("kind = 'relation'").withColumn("at", F.struct("chunk", "seq"))
    triple = [F.lower("name").alias("a"), F.lower("target").alias("b"), F.lower("type").alias("t")]
    first = r.groupBy(*triple).agg(F.min(F.struct("at", "name", "target", "type", "description")).alias("x"))
    counts = r.select(*triple, "chunk").distinct().groupBy("a", "b", "t").agg(F.count("*").alias("chunks"))
    return first.join(counts, ["a", "b", "t"]).select(F.col("x.name").alias("source"), "x.target", F.col("x.type").alias("relation_type"), "x.description", "chunks")


def long_words(text: str, found: dict | None = None, least: int = 10) -> str:
    """The offline extractor: words of at least ``least`` ASCII letters are entities, neighbours among them are relations. Its first pass tells only
    the entities of an even number of letters, later ones those that are missing."""
    words = [w.lower() for w in re.findall(rf"[A-Za-z]{{{least},}}", text)]
    known = None if found is None else {e["name"] for e in found["entities"]}
    names = [w for w in dict.fromkeys(words) if (len(w) % 2 == 0 if known is None else w not in known)]
    links = [] if found else [{"source": a, "target": b} for a, b in dict.fromkeys(zip(words, words[1:], strict=False)) if a != b]
    return json.dumps({"entities": [{"name": w, "type": "word", "description": f"{len(w)} letters"} for w in names], "relations": links})
