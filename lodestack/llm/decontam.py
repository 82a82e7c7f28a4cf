"""Benchmark decontamination over a distributed positional inverted index.

The training corpus is indexed document-partitioned: each slice of documents holds its own postings
(term -> ascending word positions) for every term that the test items use, so no posting list of the corpus
ever meets in one place and nothing is shuffled. A first pass counts the test terms over all documents; the
second one intersects, window by window, the offset-adjusted posting lists from the rarest term onward and
returns exact phrase matches (and, with ``slop``, ordered proximity matches).

The test items are sent to all tasks in blocks of at most ``block_words`` words, a bound that is checked: more
items make more blocks, one with the driver and the tasks at a time, each matched against all documents; between two
blocks the documents and what was found in them are written to the shared folder. The hits of a document are united.

Null texts have no words. Items without words, or with a null id, have no window. Rows are treated one by one,
so repeated rows and ids give repeated results. Input columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, slices, spent, texts

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Bytes of text that are indexed at a time, and pairs of a window and a place that are checked at a time.
_SLICE_BYTES, _PAIRS = 1 << 20, 200_000


class TestItems:
    """Windows of a block of test items as arrays: term numbers by window, and the item of each window."""

    __test__ = False

    def __init__(self, rows: list[tuple[object, bytes]], window: int) -> None:
        self.vocab: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[object]] = {}
        for item, text in rows:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in alnum_words(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                seen.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.windows = list(seen)
        self.items = [sorted(x, key=str) for x in seen.values()]
        self.counts = np.zeros(len(self.vocab), np.int64)

    def ranked(self, counts: np.ndarray) -> None:
        """Orders each window's terms by their count in the corpus, rarest first, as an index on the rarest."""
        self.counts = counts
        w, longest = len(self.windows), max(map(len, self.windows), default=0)
        self.length = np.array([len(x) for x in self.windows], np.int64)
        self.terms, self.offsets = np.full((w, longest), -1, np.int64), np.zeros((w, longest), np.int64)
        for i, win in enumerate(self.windows):
            order = sorted(range(len(win)), key=lambda k: (counts[win[k]], win[k], k))
            self.offsets[i, : len(win)], self.terms[i, : len(win)] = order, [win[k] for k in order]
        by = np.argsort(self.terms[:, 0], kind="stable") if w else np.zeros(0, np.int64)
        self.of_term = by
        self.first = np.searchsorted(self.terms[by, 0], np.arange(len(self.vocab) + 1)) if w else np.zeros(len(self.vocab) + 1, np.int64)


def term_ids(vocab: dict[bytes, int], docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all words in a row (-1: no test term), a -2 after each document; where each document starts."""
    get, parts, starts, at = vocab.get, [], np.zeros(len(docs), np.int64), 0
    for i, words in enumerate(docs):
        starts[i] = at
        parts.append(np.array([get(w, -1) for w in words] + [-2], np.int32))
        at += len(words) + 1
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), starts


class PositionalIndex:
    """Postings of the test terms in one slice of documents."""

    def __init__(self, ids: np.ndarray, n_terms: int) -> None:
        self.ids = ids
        at = np.flatnonzero(ids >= 0)
        order = np.argsort(ids[at], kind="stable")
        self.positions = at[order]
        self.first = np.searchsorted(ids[at][order], np.arange(n_terms + 1))

    def phrases(self, items: TestItems) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence: the rarest term's postings less its offset, kept while the
        next rarer term's list, less its own offset, has the same start."""
        none = np.zeros(0, np.int64)
        if not len(items.windows):
            return none, none
        n_post, n_win = np.diff(self.first), np.diff(items.first)
        both = np.flatnonzero((n_post > 0) & (n_win > 0))
        wins, starts = [none], [none]
        for t in both.tolist():
            w = items.of_term[items.first[t] : items.first[t + 1]]
            every = self.positions[self.first[t] : self.first[t + 1]]
            step = max(1, _PAIRS // len(every))
            for ww, p in ((w[k : k + step], every[i : i + _PAIRS]) for k in range(0, len(w), step) for i in range(0, len(every), _PAIRS)):
                s = (p[None, :] - items.offsets[ww, 0][:, None]).ravel()
                v = np.repeat(ww, len(p))
                keep = (s >= 0) & (s + items.length[v] <= len(self.ids))
                s, v = s[keep], v[keep]
                for j in range(1, items.terms.shape[1]):
                    if not len(s):
                        break
                    term = items.terms[v, j]
                    keep = (term < 0) | (self.ids[np.minimum(s + items.offsets[v, j], len(self.ids) - 1)] == term)
                    s, v = s[keep], v[keep]
                wins.append(v)
                starts.append(s)
        return np.concatenate(wins), np.concatenate(starts)

    def near(self, window: tuple[int, ...], slop: int, document: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of ordered occurrences of the window's terms with at most ``slop`` other words in between,
        within a document; the shortest one from each start."""
        found = []
        for start in self.positions[self.first[window[0]] : self.first[window[0] + 1]].tolist():
            at = start
            for t in window[1:]:
                lst = self.positions[self.first[t] : self.first[t + 1]]
                k = np.searchsorted(lst, at, "right")
                at = int(lst[k]) if k < len(lst) else -1
                if at < 0 or at - start - len(window) + 1 > slop:
                    at = -1
                    break
            if at >= 0 and document[at] == document[start]:
                found.append((start, at + 1))
        return found


def scan(docs: list[bytes | None], items: TestItems, slop: int = 0) -> list[tuple[int, list[tuple[int, int]], list[object]]]:
    """Of each text: its number of words, the merged spans (word from, word to) that match, the matching item ids."""
    words = [alnum_words(d) for d in docs]
    ids, starts = term_ids(items.vocab, words)
    index = PositionalIndex(ids, len(items.vocab))
    win, at = index.phrases(items)
    end = at + items.length[win] if len(win) else at
    if slop and len(items.windows):
        document = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        more = [(w, s, e) for w, win_terms in enumerate(items.windows) for s, e in index.near(win_terms, slop, document)]
        if more:
            x = np.array(more, np.int64)
            win, at, end = np.r_[win, x[:, 0]], np.r_[at, x[:, 1]], np.r_[end, x[:, 2]]
    out: list[tuple[int, list[tuple[int, int]], list[object]]] = [(len(w), [], []) for w in words]
    if not len(win):
        return out
    doc = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((end, at))
    for d, w, s, e in zip(doc[order].tolist(), win[order].tolist(), (at - starts[doc])[order].tolist(), (end - starts[doc])[order].tolist(), strict=True):
        spans = out[d][1]
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
        out[d][2].append(w)
    for n, (_, _, hit) in enumerate(out):
        if hit:
            found = {item for w in set(hit) for item in items.items[w]}
            out[n] = (out[n][0], out[n][1], sorted(found, key=str))
    return out


def term_counts(docs: DataFrame, text: str, items: TestItems) -> np.ndarray:
    """How often each test term occurs in all texts: a sum of fixed-size vectors, one per task, in the executors."""
    vocab = items.vocab
    size = len(vocab)
    if not size:
        return np.zeros(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, text, _SLICE_BYTES):
            ids, _ = term_ids(vocab, [alnum_words(x) for x in texts(batch.column(0))])
            total += np.bincount(ids[ids >= 0], minlength=size)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["term", "n"])

    counts = np.zeros(size, np.int64)
    for r in docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most the block's terms
        counts[r["term"]] = r["n"]
    return counts


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> list[DataFrame]:
    """The items in blocks of at most about block_words words (an item is never split), by their ids' order of hash."""
    sized = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    words = sized.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0  # an upper bound of the words
    n = max(1, int(-(-words // block_words)))
    return [sized.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i) for i in range(n)]


def find(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> Callable[[DataFrame], DataFrame]:
    """Builds the matcher of ``items``: a function that adds to a DataFrame with the text column one struct column
    ``matches`` (n_words long, spans array<struct<start,end>>, items array<string>), reading whole texts.

    The terms' counts that order the intersections come from ``docs``."""
    parts, spark = item_blocks(items, item_id, item_text, block_words), docs.sparkSession
    kind = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
    inner = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def matcher(block: DataFrame) -> Callable[..., Column]:
        t = TestItems([(r["item"], r["text"].encode()) for r in block.toLocalIterator()], window)
        t.ranked(term_counts(docs, text, t))
        sent = spark.sparkContext.broadcast(t)  # at most block_words words

        @F.arrow_udf(kind)
        def match(column: pa.Array, before: pa.Array) -> pa.Array:
            rows, at = [], 0
            for part in slices([pa.RecordBatch.from_arrays([column], names=["t"])], "t", _SLICE_BYTES):
                for (n_words, spans, found), old in zip(scan(texts(part.column(0)), sent.value, slop), before.slice(at, part.num_rows).to_pylist(), strict=True):
                    known = old or {"spans": [], "items": []}
                    rows.append({"n_words": n_words, "spans": united([*spans, *((x["start"], x["end"]) for x in known["spans"])]), "items": sorted({*map(str, found), *known["items"]})})
                at += part.num_rows
            return pa.array(rows, inner)

        return match

    def run(df: DataFrame) -> DataFrame:
        out, held = df.withColumn("matches", F.lit(None).cast(kind)), None
        for i, block in enumerate(parts):
            out = out.withColumn("matches", matcher(block)(out[text], out["matches"]))
            if i < len(parts) - 1:  # only one block is with the driver and the tasks at a time
                out = cut(out, "matches")
                if held is not None:
                    spent(held)
                held = out
        return out

    return run


def united(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The spans in order, those that touch as one."""
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def digest(docs: DataFrame, items: DataFrame, **more: object) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    rows = docs.select("doc_id", "text")
    m = find(rows, items, **more)(rows).select("doc_id", "matches")
    hits = F.aggregate("matches.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return m.select(
        "doc_id", F.col("matches.n_words").alias("n_words"), hits.alias("n_hit"), F.size("matches.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("matches.items", ","), 256).alias("items_sha256"), (F.size("matches.spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **more: object) -> DataFrame:
    """The documents without any match, columns unchanged."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    return find(inner, items, **more)(inner).where(F.size("matches.spans") == 0).select("row.*")


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
