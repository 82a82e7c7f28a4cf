"""Filter interaction audit: what each filter removes in every order of application.

The orders form a trie whose edges apply one filter to the survivors of those before it. Which documents survive depends on the set of
filters applied, not on their order, so the trie is walked depth first with one persisted table of survivors for each set: an order that
comes to a set seen before shares its counts. At every edge the documents that the filter really removes from the survivors are
counted. A set's survivors are filtered from its parent's, persisted while its subtree is walked and released behind it, so at most one
table a level is held; an executor that is lost costs its blocks, which Spark computes again from the written flags.

Texts are read once and reduced to a row of flags per document; copies are found by SHA-256 of the text. Counts stay in a written table
with a row per part, set and filter.

Null texts count as empty. A null id is smaller than none and greater than none: such a document is no copy of another and no other is its copy; it has no
labels. Equal rows are counted each, and rows of the same id are not copies of each other. Of several labels of an id, one with the
value suffices. Empty tables give no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder, spent

#: The filters of the query, in order. All but the last are conditions of a text; E needs the whole table.
NAMES = ("A", "B", "C", "D", "E")


def failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) of each document: its language, the filters it fails as bits (A: 1), and its labels."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(failures(text))), F.lit(0))
    base = cut(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), bits.alias("failed")), "flags")
    first = cut(base.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first"), "first")
    known = cut(labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")), "labels")
    named = base.where("doc_id is not null").join(first, "h", "left").join(known, "doc_id", "left")
    no = F.lit(False)
    copy = F.coalesce(F.col("first") < F.col("doc_id"), no).cast("int") * (1 << 4)
    rows = named.select("part", (F.col("failed") + copy).alias("failed"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    out = cut(rows.unionByName(base.where("doc_id is null").select("part", "failed", no.alias("good"), no.alias("toxic"))), "failed")
    spent(base, first, known)
    return out


def edges(rows: DataFrame, n: int) -> DataFrame:
    """(part, state, filter, here, removed, good, toxic) for every set of applied filters and every filter that is not in it: survivors
    of the set, and what the filter removes of them. The number of sets is 2**n, whatever the table."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    seen: set[int] = set()

    def fails(i: int) -> Column:
        return F.col("failed").bitwiseAND(1 << i) != 0

    def visit(state: int, alive: DataFrame) -> None:
        seen.add(state)
        alive.persist()
        nxt = [i for i in range(n) if not state >> i & 1]
        counts = [F.struct(F.lit(i).alias("filter"), F.count_if(fails(i)).alias("removed"), F.count_if(fails(i) & F.col("good")).alias("good"), F.count_if(fails(i) & F.col("toxic")).alias("toxic")) for i in nxt]
        here = alive.groupBy("part").agg(F.count("*").alias("here"), F.array(*counts).alias("e"))
        here.select("part", F.lit(state).alias("state"), "here", F.inline("e")).write.mode("append").parquet(folder)
        for i in nxt:
            child = state | 1 << i
            if child not in seen and child != (1 << n) - 1:
                visit(child, alive.where(~fails(i)))
        alive.unpersist()

    visit(0, rows)
    return spark.read.schema("part string, state int, here long, filter int, removed long, good long, toxic long").parquet(folder)


def audit(rows: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """One row per part, order and step, from (part, failed, good, toxic): kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and the filter's removals summed over all orders."""
    n = len(names)
    every = edges(rows, n)
    full = (1 << n) - 1
    steps = [{"filter_order": "".join(names[j] for j in order), "step": step + 1, "filter": i, "state": sum(1 << j for j in order[:step])} for order in permutations(range(n)) for step, i in enumerate(order)]
    told = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, filter int, state int>>")
    parts = every.where("state = 0").select("part").distinct()
    plan = parts.select("part", F.inline(told))
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)]), F.bit_count("state") + 1)
    whole = F.sum(F.when(F.col("state") == 0, F.col("removed")))
    alone = F.sum(F.when(F.col("state") == F.element_at(F.array(*[F.lit(full - (1 << i)) for i in range(n)]), F.col("filter") + 1), F.col("removed")))
    totals = every.groupBy("part", "filter").agg(whole.alias("fails"), alone.alias("alone"), F.sum(F.col("removed") * weight).alias("shapley"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    at = plan.join(every, ["part", "state", "filter"], "left").join(totals, ["part", "filter"], "left")
    removed = zero("removed")
    return at.select(
        "part", "filter_order", "step", (zero("here") - removed).alias("kept"), removed.alias("removed"), (zero("fails") - removed).alias("redundant"),
        zero("alone").alias("unique_fails"), zero("good").alias("good_lost"), zero("toxic").alias("toxic_lost"), zero("shapley").alias("shapley"),
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = flags(docs, labels)
    out = audit(rows)
    spent(rows)  # the result reads the counts alone
    return out
