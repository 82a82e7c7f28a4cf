"""Searches in the way of web search boxes: words, "quoted phrases", OR, and - in front of what must not stand in a text.

A query is alternatives, split at the word OR; an alternative is a list of parts that must all hold, each a phrase (a word is a phrase of
one token) that may be negated. Quotes without an end, lone dashes and an OR without a side are left out. Texts are ranked by how often the
wanted tokens stand in them, later places counting less: of each token sum 1/j**2 over its places j = 1, 2, ..., over pi**2/6, at a weight
of 0.1, averaged over the query's distinct wanted tokens."""

from __future__ import annotations

import re
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fts_tokens
from .state import date_range, order_columns

Part = tuple[bool, tuple[str, ...]]
WEIGHT = 0.1


def parse(query: str) -> list[list[Part]]:
    """Alternatives of (wanted, tokens) parts; none of a query without tokens."""
    out: list[list[Part]] = [[]]
    for dash, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not dash and word.lower() == "or":
            out.append([])
            continue
        negated = bool(dash) or word.startswith("-")
        tokens = tuple(t for t in re.split(r"[\W_]+", (quoted or word).lower()) if t)
        if tokens:
            out[-1].append((not negated, tokens))
    return [a for a in out if a]


def _holds(tk: Column, tokens: tuple[str, ...]) -> Column:
    if len(tokens) == 1:
        return F.array_contains(tk, tokens[0])
    want, n = F.array(*[F.lit(t) for t in tokens]), len(tokens)
    starts = F.when(F.size(tk) >= n, F.sequence(F.lit(1), F.size(tk) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_contains(tk, tokens[0]) & F.exists(starts, lambda i: F.slice(tk, i, n) == want)


def matches(tk: Column, tree: list[list[Part]]) -> Column:
    out = F.lit(False)
    for parts in tree:
        every = F.lit(True)
        for wanted, tokens in parts:
            h = _holds(tk, tokens)
            every = every & (h if wanted else ~h)
        out = out | every
    return out


def rank(tk: Column, tree: list[list[Part]]) -> Column:
    terms = sorted({t for parts in tree for wanted, tokens in parts if wanted for t in tokens})
    if not terms:
        return F.lit(0.0)
    total = F.lit(0.0)
    for t in terms:
        n = F.size(tk) - F.size(F.array_remove(tk, t))
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        total = total + F.aggregate(places, F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    return total * (WEIGHT * 6 / pi**2 / len(terms))


def search(diary: DataFrame, query: str, start: str | None = None, end: str | None = None, k: int | None = None, digits: int | None = None) -> DataFrame:
    """Entries of a date range that match the query, with ``rank``, best first, then in the diary's order. A query without tokens falls back to
    the entries that contain it as written, in any case, in content, mood or tags, at rank 0."""
    rows, tree = date_range(diary, start, end), parse(query)
    if tree:
        tk = rows.withColumn("_tk", F.coalesce(fts_tokens("content"), F.array().cast("array<string>")))
        r = rank(F.col("_tk"), tree)
        found = tk.where(matches(F.col("_tk"), tree)).withColumn("rank", r if digits is None else F.round(r, digits)).drop("_tk")
    else:
        has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
        found = rows.where(has(F.col("content")) | has(F.col("mood")) | has(F.array_join("tags", " "))).withColumn("rank", F.lit(0.0))
    out = found.orderBy(F.col("rank").desc(), *order_columns("diary"))
    return out if k is None else out.limit(k)
