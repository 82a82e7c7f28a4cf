"""Transcripts: parsers, repeated motifs, lossless compression, lessons, facts and the wake-up pack."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, confidence, lesson_id, pattern_key, strip

MESSAGES = "role string, content string, turn_index int"
ROLES = ("system", "user", "assistant", "tool")
MIN_OCCURRENCES, MIN_CONFIDENCE, MAX_LESSONS = 2, 70, 8


def flatten(v: object) -> str:
    """Text of a JSON value: arrays joined by spaces without empty parts; of objects 'text', else 'parts', else all values."""
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, list):
        return " ".join(x for x in map(flatten, v) if x)
    for key in ("text", "parts"):
        if key in v:
            return flatten(v[key])
    return " ".join(x for x in map(flatten, v.values()) if x)


def role_of(v: object) -> str:
    r = str(v or "").lower()
    return r if r in ROLES else "unknown"


def parse(payload: str | None, form: str) -> list[dict]:
    """Messages of an export: 'openai' and 'claude' are arrays of messages, 'jsonl' has one a line and numbers them by physical line. A null
    payload has none; anything else that is not JSON of that form is a ValueError."""
    if payload is None:
        return []
    if form == "jsonl":
        items = [(n, json.loads(x)) for n, x in enumerate(payload.split("\n")) if x.strip()]
    else:
        whole = json.loads(payload)
        if not isinstance(whole, list):
            raise ValueError("an export is not an array of messages")
        items = list(enumerate(whole))
    if bad := [n for n, m in items if not isinstance(m, dict)]:
        raise ValueError(f"message {bad[0]} is not an object")
    return [{"role": role_of(m.get("role")), "content": flatten(m.get("content")), "turn_index": n} for n, m in items]


def parsed(exports: DataFrame) -> DataFrame:
    """(source_id, role, content, turn_index) of exports (source_id, format, payload); a malformed one is an error that names its source."""

    @F.pandas_udf(f"array<struct<{MESSAGES.replace(' ', ':').replace(',:', ',')}>>")
    def run(source: pd.Series, payload: pd.Series, form: pd.Series) -> pd.Series:
        out = []
        for s, p, f in zip(source, payload, form, strict=True):
            try:
                out.append(parse(p, f))
            except ValueError as e:
                raise ValueError(f"malformed export {s}: {e}") from e
        return pd.Series(out)

    return exports.select("source_id", F.explode(run("source_id", "payload", "format")).alias("m")).select("source_id", "m.*")


def motifs(messages: DataFrame, least: int = MIN_OCCURRENCES, min_confidence: int = 0, role: str = "role", text: str = "content", turn: str = "turn_index") -> DataFrame:
    """Texts that repeat in a role: key, count, confidence and turns, most frequent first. Counts are summed before they are shuffled."""
    g = messages.where(strip(text) != "").groupBy(F.col(role).alias("role"), F.col(text).alias("canonical_text")).agg(F.count("*").alias("occurrence_count"), F.sort_array(F.collect_list(turn)).alias("turn_indexes"))
    out = g.where(F.col("occurrence_count") >= least).withColumns({"confidence_percent": confidence("canonical_text", "occurrence_count"), "pattern_key": pattern_key("role", "canonical_text")})
    return out.where(F.col("confidence_percent") >= min_confidence).orderBy(F.col("occurrence_count").desc(), "canonical_text", "pattern_key")


def compress(messages: DataFrame, least: int = MIN_OCCURRENCES, min_confidence: int = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(turns, motifs): a turn is a reference to a motif or verbatim text."""
    m = motifs(messages, least, min_confidence)
    ref = m.select("role", F.col("canonical_text").alias("content"), "pattern_key")
    out = messages.join(ref, ["role", "content"], "left")
    kind = F.when(F.col("pattern_key").isNotNull(), "motif").otherwise("verbatim")
    return out.select("turn_index", "role", kind.alias("kind"), "pattern_key", F.when(F.col("pattern_key").isNull(), F.col("content")).alias("content")), m


def expand(turns: DataFrame, m: DataFrame) -> DataFrame:
    """The messages again; a reference to no motif is an error."""
    out = turns.join(m.select("pattern_key", "canonical_text"), "pattern_key", "left")
    text = F.when(F.col("kind") == "verbatim", F.col("content")).otherwise(F.coalesce("canonical_text", F.raise_error(F.concat(F.lit("unknown motif "), F.col("pattern_key")))))
    return out.select("role", text.alias("content"), "turn_index").orderBy("turn_index")


def mean_confidence(m: DataFrame) -> DataFrame:
    return m.agg(F.coalesce(F.floor(F.sum("confidence_percent") / F.count("*")), F.lit(0)).alias("confidence"))


def lessons(m: DataFrame, project: str, min_confidence: int = MIN_CONFIDENCE, most: int = MAX_LESSONS) -> DataFrame:
    """The surest motifs with their lesson ids."""
    best = m.where(F.col("confidence_percent") >= min_confidence).orderBy(F.col("confidence_percent").desc(), F.col("occurrence_count").desc(), "pattern_key").limit(most)
    return best.withColumn("lesson_id", lesson_id(F.lit(project), "pattern_key"))


def _fact_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), F.regexp_replace(strip(x), SPACES, " ").alias("fact")))
    return F.filter(lines, lambda x: (x["fact"] != "") & ~x["fact"].rlike(r"^(#|Source:|Format:|Wing:|Hall:|Room:|\[turn:)"))


def facts(docs: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """(key, pos, fact): lines that state something, each once at its first place."""
    found = docs.select(F.col(key).alias(key), _fact_lines(F.col(text)).alias("x"))  # a text's lines are in one row, so nothing is shuffled
    names = found.select(key, "x", F.array_distinct(F.transform("x", lambda y: y["fact"])).alias("facts"))
    if most is not None:
        names = names.withColumn("facts", F.slice("facts", 1, most))
    first = F.transform("facts", lambda f: F.struct(F.element_at(F.col("x.pos"), F.array_position(F.col("x.fact"), f).cast("int")).alias("pos"), f.alias("fact")))
    return names.select(key, F.explode(first).alias("y")).select(key, "y.pos", "y.fact")


def diary_digest(diary: DataFrame, most: int, key: str = "entry_id", project: str = "project_id") -> DataFrame:
    """(project_id, entry_count, date_from, date_to, summary, highlights): of each project the range of its entries and the first ``most``
    facts in the order of the diary, latest entry first, facts distinct within an entry. A project without facts has an empty list.

    Tasks cut each project's facts to ``most`` before the shuffle, and no more of them meet in a row."""
    lines = diary.select(project, key, "entry_date", "updated_at", F.array_distinct(F.transform(_fact_lines(F.col("content")), lambda y: y["fact"])).alias("facts"))
    rows = lines.select(project, key, "entry_date", "updated_at", F.posexplode(F.slice("facts", 1, most)).alias("pos", "fact"))
    order = [F.col("entry_date").desc(), F.col("updated_at").desc(), F.col(key), F.col("pos")]
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(project).orderBy(*order))).where(F.col("n") <= most)
    told = first.groupBy(project).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "fact"))), lambda x: x["fact"]).alias("highlights"))
    n = F.col("entry_count")
    counts = diary.groupBy(project).agg(F.count("*").alias("entry_count"), F.min("entry_date").alias("date_from"), F.max("entry_date").alias("date_to"))
    text = F.concat(F.lit("Summarized "), n.cast("string"), F.when(n == 1, " diary entry").otherwise(" diary entries"), F.lit(" across the requested range."))
    both = counts.alias("c").join(told.alias("t"), F.col(f"c.{project}").eqNullSafe(F.col(f"t.{project}")), "left")
    return both.select(f"c.{project}", "entry_count", "date_from", "date_to", text.alias("summary"), F.coalesce("highlights", F.array().cast("array<string>")).alias("highlights"))


def wake_up(sources: DataFrame, texts: DataFrame, max_sources: int, max_facts: int, key: str = "source_id", updated: str = "updated_at") -> DataFrame:
    """Facts of the latest sources in the order of the sources until enough are had; a fact may recur in another source."""
    latest = sources.orderBy(F.col(updated).desc(), key).limit(max_sources)
    all_facts = facts(texts.join(latest.select(key), key, "left_semi"), key, "content")
    return all_facts.join(latest.select(key, updated), key).orderBy(F.col(updated).desc(), key, "pos").limit(max_facts).select(key, "pos", "fact")


def captured(events: DataFrame, project: str) -> DataFrame:
    """Hook events with their default places."""
    return events.withColumns({"wing": F.coalesce("wing", F.lit(project)), "hall": F.coalesce("hall", F.concat(F.lit("hook:"), F.col("event"))), "room": F.coalesce("room", F.concat(F.lit("event:"), F.col("event")))})
