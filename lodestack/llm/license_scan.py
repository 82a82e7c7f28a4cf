"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lowered. A block is a window of 3/2 of the template's words that slides
over all places of template tokens. A block matches a template when it holds ``percent`` of the
template's distinct words (containment). The join is exact: the template's tokens are ordered by their count in all documents, rarest
first; a block that matches must hold one of the first |T| - ceil(c*|T|) + 1 (prefix filter), cannot be shorter than ceil(c*|T|)
(length filter); what passes is counted as the window slides. `Template.blocks` lays windows at every quarter of the template only.

The templates are few and fixed, so each task holds them all. Null and empty texts have no words. Rows are treated one by one; other columns are ignored.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, slices, texts
from .decontam import term_counts

PERCENT = 80

# Phrases that name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The notices by which public licenses are commonly stated.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc-by": "This work is licensed under the Creative Commons Attribution International License. To view a copy of this license, visit",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
}


class Template:
    def __init__(self, label: str, text: str, counts: dict[bytes, int], percent: int) -> None:
        self.label = label
        words = alnum_words(text.encode())
        self.words = len(words)
        self.tokens = sorted(set(words), key=lambda w: (counts.get(w, 0), w))  # rarest first
        self.rank = {w: i for i, w in enumerate(self.tokens)}
        self.need = -(-len(self.tokens) * percent // 100)
        self.prefix = frozenset(self.tokens[: len(self.tokens) - self.need + 1])
        self.width, self.step = max(1, self.words * 3 // 2), max(1, self.words // 4)

    def blocks(self, words: list[bytes], distinct: set[bytes]) -> list[tuple[int, int, float]]:
        """(from word, to word, containment) of every block that matches."""
        if distinct.isdisjoint(self.prefix) or len(self.rank.keys() & distinct) < self.need or len(words) < self.need:
            return []
        rank = np.fromiter((self.rank.get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(rank >= 0)
        first = np.flatnonzero((rank >= 0) & (rank < len(self.prefix)))
        # Only blocks around a prefix token can match.
        k = np.unique(np.concatenate([np.arange(max(0, (p - self.width) // self.step), p // self.step + 1) for p in first.tolist()]))
        out = []
        for start in (k * self.step).tolist():
            lo, hi = np.searchsorted(at, start), np.searchsorted(at, start + self.width)
            held = np.unique(rank[at[lo:hi]])
            if not len(held) or held[0] > len(self.tokens) - self.need or len(held) < self.need:
                continue  # positional filter: behind the rarest held token there must be enough tokens
            out.append((start, min(start + self.width, len(words)), len(held) / len(self.tokens)))
        return out

    def windows(self, words: list[bytes], distinct: set[bytes]) -> list[tuple[int, int, float]]:
        """The same of every window that begins with a template token. A window that begins elsewhere holds no token that the
        one from its first token on does not hold, so no match at another start is lost."""
        if distinct.isdisjoint(self.prefix) or len(self.rank.keys() & distinct) < self.need or len(words) < self.need:
            return []
        rank = np.fromiter((self.rank.get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(rank >= 0)
        ends = np.searchsorted(at, at + self.width)
        if (ends - np.arange(len(at))).max() < self.need:
            return []
        r, out, count, held, hi = rank[at].tolist(), [], [0] * len(self.tokens), 0, 0
        for i, (start, end) in enumerate(zip(at.tolist(), ends.tolist(), strict=True)):
            while hi < end:
                held += count[r[hi]] == 0
                count[r[hi]] += 1
                hi += 1
            if held >= self.need:
                out.append((start, min(start + self.width, len(words)), held / len(self.tokens)))
            count[r[i]] -= 1
            held -= count[r[i]] == 0
        return out


def phrase_places(words: list[bytes], distinct: set[bytes], phrases: list[tuple[tuple[bytes, ...], str]]) -> list[tuple[int, str]]:
    out = []
    for p, label in phrases:
        if not all(w in distinct for w in p):
            continue
        at = -1
        while True:
            try:
                at = words.index(p[0], at + 1)
            except ValueError:
                break
            if tuple(words[at : at + len(p)]) == p:
                out.append((at, label))
    return out


def scanner(docs: DataFrame, *, text: str = "text", percent: int = PERCENT, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """A struct column for a text column: n_words, places (start, label), blocks (label, start, end, containment).

    The counts that order the templates' tokens are taken over all ``docs``."""
    templates = TEMPLATES if templates is None else templates
    spelled = [(tuple(alnum_words(p.encode())), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    vocab: dict[bytes, int] = {}
    for t in templates.values():
        for w in alnum_words(t.encode()):
            vocab.setdefault(w, len(vocab))
    counts = term_counts(docs, text, SimpleNamespace(vocab=vocab))
    known = {w: int(counts[i]) for w, i in vocab.items()}
    all_templates = [Template(label, t, known, percent) for label, t in templates.items()]
    place = pa.struct([("start", pa.int64()), ("label", pa.string())])
    block = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
    kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(place)), ("blocks", pa.list_(block))])

    @F.arrow_udf("struct<n_words:bigint,places:array<struct<start:bigint,label:string>>,blocks:array<struct<label:string,start:bigint,end:bigint,containment:double>>>")
    def scan(column: pa.Array) -> pa.Array:
        rows = []
        for part in slices([pa.RecordBatch.from_arrays([column], names=["t"])], "t"):
            for t in texts(part.column(0)):
                words = alnum_words(t)
                distinct = set(words)
                rows.append({
                    "n_words": len(words),
                    "places": [{"start": s, "label": x} for s, x in phrase_places(words, distinct, spelled)],
                    "blocks": [{"label": x.label, "start": a, "end": b, "containment": c} for x in all_templates for a, b, c in x.windows(words, distinct)],
                })
        return pa.array(rows, kind)

    return scan(text)


def digest(docs: DataFrame, **more: object) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document."""
    rows = docs.select("doc_id", "text")
    r = rows.select("doc_id", scanner(rows, **more).alias("r"))
    starts, base, found = F.col("r.places.start"), F.col("r.places.label"), F.col("r.blocks.label")
    score = F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("r.blocks.containment"), F.lit(0.0)))
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return r.select(
        "doc_id", F.col("r.n_words").alias("n_words"), F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, found)).alias("labels"), score.alias("score"),
    )
