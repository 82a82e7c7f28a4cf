"""State tables: keyed upserts, scoped filters, exact ordered pages, audit, diary, approvals, documents."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import calendar_like, fts_tokens, like_contains, strip

# The largest page and the default page of each table; pages over the first are refused, 0 takes the second.
CAPS = {"audit": (500, 50), "diary": (500, 20), "lessons": (500, 20), "sources": (500, 50), "nodes": (1000, 100), "tunnels": (1000, 200)}
MOST_OF_ALL = 1000

# The order of each table's pages.
ORDERS = {
    "audit": (("id", False),),
    "sources": (("updated_at", False), ("transcript_path", True)),
    "diary": (("entry_date", False), ("updated_at", False), ("entry_id", True)),
    "lessons": (("confidence_percent", False), ("occurrence_count", False), ("pattern_key", True)),
    "nodes": (("kind", True), ("label", True), ("node_id", True)),
    "tunnels": (("from_node_id", True), ("to_node_id", True), ("tunnel_id", True)),
}


def order_columns(table: str) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in ORDERS[table]]


# --- mutation --------------------------------------------------------------------------------------------------------------


def latest(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, key: Sequence[str], updated: str = "updated_at", keep_first: Sequence[str] = ()) -> DataFrame:
    """The table with the changes' rows in place of those of the same key; ``keep_first`` columns keep their oldest value.

    Of changes with the same key the last one by ``updated`` counts, of equal ones the one with the largest other columns. Only the changed keys are looked up in the table."""
    rest = [F.col(c).desc() for c in changes.columns if c not in (*key, updated)]
    new = latest(changes, key, F.col(updated).desc(), *rest)
    if keep_first:
        old = table.select(*key, *[F.col(c).alias(f"_{c}") for c in keep_first])
        new = new.join(old, list(key), "left")
        for c in keep_first:
            new = new.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return table.join(new.select(*key), list(key), "left_anti").unionByName(new.select(table.columns))


def delete(table: DataFrame, gone: DataFrame, key: Sequence[str], only: Column | None = None) -> DataFrame:
    """Without the given keys, or only those rows of them that meet a condition."""
    if only is None:
        return table.join(gone.select(*key).distinct(), list(key), "left_anti")
    mark = gone.select(*key).distinct().withColumn("_gone", F.lit(True))
    return table.join(mark, list(key), "left").where(F.col("_gone").isNull() | ~only).drop("_gone")


def replace_source(chunks: DataFrame, new: DataFrame, path: str = "source_path", prefix: str | None = None) -> DataFrame:
    """Chunks with those of the new rows' paths, or of a path prefix, replaced."""
    if prefix is not None:
        return chunks.where(~F.col(path).startswith(prefix)).unionByName(new)
    return chunks.join(new.select(path).distinct(), path, "left_anti").unionByName(new)


def changes(old: DataFrame, new: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, change): new, updated, removed or unchanged by content hash."""
    a, b = old.select(path, F.sha2(content, 256).alias("a")), new.select(path, F.sha2(content, 256).alias("b"))
    kind = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "updated").otherwise("unchanged")
    return a.join(b, path, "full").select(path, kind.alias("change"))


# --- pages -----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    next_cursor: str | None


def encode_cursor(offset: int, tie: str | None = None) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": offset} | ({"t": tie} if tie else {}), separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    if not cursor:
        return 0
    try:
        o = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))["o"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("malformed cursor") from e
    if not isinstance(o, int) or o < 0:
        raise ValueError("malformed cursor")
    return o


def page_size(table: str, limit: int = 0) -> int:
    most, default = CAPS[table]
    if limit < 0:
        raise ValueError("negative limit")
    if limit > min(most, MOST_OF_ALL):
        raise ValueError(f"limit {limit} is over {most}")
    return limit or default


def page(df: DataFrame, table: str, limit: int = 0, cursor: str | None = None) -> Page:
    """One page in the table's order: one row more is read to learn whether there is a next one."""
    n, o = page_size(table, limit), decode_cursor(cursor)
    rows = df.orderBy(*order_columns(table)).offset(o).limit(n + 1)
    more = rows.count() > n
    return Page(rows.limit(n), df.count(), encode_cursor(o + n) if more else None)


def page_at(df: DataFrame, table: str, limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order_columns(table)).offset(offset).limit(limit)


def _after(order: Sequence[tuple[str, bool]], values: Sequence[str | None], types: dict[str, str]) -> Column:
    """A filter for rows behind the given order values (not true for others, so that it can be pushed down): equal in the first columns and behind in the next one. Nulls come first in rising order, last in falling."""
    out, same = F.lit(False), F.lit(True)
    for (c, up), v in zip(order, values, strict=True):
        x, have = F.lit(v).cast(types[c]), F.col(c)
        if v is None:
            behind = have.isNotNull() if up else F.lit(False)
        else:
            behind = have > x if up else (have < x) | have.isNull()
        out = out | (same & behind)
        same = same & have.eqNullSafe(x)
    return out


def seek(df: DataFrame, table: str, limit: int = 0, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """One page and the cursor of the next one (None after the last) by the order values of the page's last row: a filter that reaches the scan
    instead of rows that are sorted and dropped, so page n costs what the first one does, and rows that come in before it don't shift it.

    The table's order must end in a key. Offset cursors of ``page`` are refused, as are malformed ones."""
    n, order, types = page_size(table, limit), ORDERS[table], dict(df.dtypes)
    if cursor:
        try:
            values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))["k"]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("malformed cursor") from e
        if not isinstance(values, list) or len(values) != len(order) or not all(v is None or isinstance(v, str) for v in values):
            raise ValueError("malformed cursor")
        df = df.where(_after(order, values, types))
    rows = df.orderBy(*order_columns(table)).limit(n + 1)
    keys = rows.select(*[F.col(c).cast("string") for c, _ in order]).collect()  # at most a page
    more = len(keys) > n
    at = base64.urlsafe_b64encode(json.dumps({"k": list(keys[n - 1])}, separators=(",", ":")).encode()).decode().rstrip("=") if more else None
    return rows.limit(n), at


# --- filters -----------------------------------------------------------------------------------------------------------------


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key: a chunk, a node, a profile, a document."""
    return df.where(F.col(key) == F.lit(value))


def latest_profile(profiles: DataFrame, project: str) -> DataFrame:
    """The stored profile of a project: one row or none."""
    return by_id(profiles, "project_id", project).select("profile_json").limit(1)


def schema_version(migrations: DataFrame) -> DataFrame:
    """The highest version applied; 0 before the first one."""
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def effective_risk(families: DataFrame) -> DataFrame:
    """The risk level of each project from its families (project_id, family): high with unsafe tools, else medium."""
    unsafe = F.coalesce(F.bool_or(F.col("family") == "unsafe-tools"), F.lit(False))
    return families.groupBy("project_id").agg(F.when(unsafe, "high").otherwise("medium").alias("risk_level"))


def source_paths(chunks: DataFrame, path: str = "source_path") -> DataFrame:
    """The distinct sources of a chunk table, in order."""
    return chunks.select(path).distinct().orderBy(path)


def scoped(df: DataFrame, project: str, **equal: object) -> DataFrame:
    """Rows of a project; of the other filters those that are given."""
    out = df.where(F.col("project_id") == project)
    for c, v in equal.items():
        if v is not None:
            out = out.where(F.col(c) == F.lit(v))
    return out


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "entry_date") -> DataFrame:
    """Inclusive, dates compared as text; a start behind the end is an error."""
    if start and end and start > end:
        raise ValueError("start date is after end date")
    if start:
        df = df.where(F.col(column) >= start)
    return df.where(F.col(column) <= end) if end else df


def fts(df: DataFrame, query: str, *columns: str, every: bool = True) -> DataFrame:
    """Rows whose columns together hold every token of the query (or any)."""
    import re

    want = sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})
    if not want:
        return df.where(F.lit(False))
    have = fts_tokens(F.concat_ws(" ", *columns))
    q = F.array(*[F.lit(t) for t in want])
    return df.where(F.size(F.array_except(q, have)) == 0 if every else F.arrays_overlap(q, have))


def diary_search(diary: DataFrame, query: str, start: str | None = None, end: str | None = None, like: bool = False) -> DataFrame:
    rows = date_range(diary, start, end).withColumn("_tags", F.array_join("tags", " "))
    if like:
        found = rows.where(like_contains("content", query) | F.coalesce(like_contains("mood", query), F.lit(False)) | like_contains("_tags", query))
    else:
        found = fts(rows, query, "mood", "_tags", "content")
    return found.drop("_tags").orderBy(*order_columns("diary"))


def diary_entry(entries: DataFrame) -> DataFrame:
    """Checked entries with their ids (one a day and project) and clean tags."""
    date = F.when(calendar_like("entry_date"), F.col("entry_date")).otherwise(F.raise_error(F.concat(F.lit("bad date "), F.col("entry_date"))))
    tags = F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(strip(t))), lambda t: t != ""))
    return entries.withColumns({"entry_date": date, "tags": tags, "mood": F.nullif(strip("mood"), F.lit("")), "entry_id": F.concat(F.lit("diary-"), F.substring(F.sha2(F.concat_ws(":", "project_id", "entry_date"), 256), 1, 32))})


def diary_summary(diary: DataFrame) -> DataFrame:
    return diary.groupBy("project_id").agg(F.count("*").alias("entries"), F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date"))


# The outcomes of an audit event.
OUTCOMES = ("success", "failure", "denied", "unknown")


def outcome(c: str = "outcome") -> Column:
    return F.when(F.lower(c).isin(*OUTCOMES), F.lower(c)).otherwise("unknown")


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy(outcome().alias("outcome")).agg(F.count("*").alias("n"))


# --- managed documents ----------------------------------------------------------------------------------------------------------


def doc_violations(docs: DataFrame, max_bytes: int, max_docs: int) -> DataFrame:
    """(path, problem) of documents that break a rule."""
    n = docs.where(~F.col("deleted")).count()
    problem = F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|\x00"), "unsafe path").when(F.octet_length("content") > max_bytes, "too large").when(F.lit(n > max_docs), "too many documents")
    return docs.select("path", problem.alias("problem")).where("problem is not null")


def move_to_trash(docs: DataFrame, paths: list[str]) -> DataFrame:
    return docs.withColumn("deleted", F.col("deleted") | F.col("path").isin(paths))


def restore(docs: DataFrame, paths: list[str]) -> DataFrame:
    return docs.withColumn("deleted", F.col("deleted") & ~F.col("path").isin(paths))


def empty_trash(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("deleted"))


def rename(docs: DataFrame, old: str, new: str) -> DataFrame:
    return docs.withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path")))


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """A backup: each table as Parquet with a manifest of its schema."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(k, v.schema.json()) for k, v in tables.items()], "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")


def restored(spark: object, folder: str) -> dict[str, DataFrame]:
    return {r["name"]: spark.read.parquet(f"{folder}/{r['name']}") for r in spark.read.json(f"{folder}/_manifest").collect()}
