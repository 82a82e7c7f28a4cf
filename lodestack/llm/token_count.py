"""Token counts of a unigram tokenizer without building tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming carries the best score
and its piece count. The tie rule is the tokenizer's: pieces are tried by start from left to right, and a path replaces
the best one of a place only if its score is strictly higher. A character that no piece spells costs the unknown penalty (the lowest score less
10), may be taken alone where no one-character piece starts, and counts as its UTF-8 bytes, as byte fallback writes it; scores add up in double precision.

Spaces become U+2581, and one is put before the text. No piece of the vocabulary holds U+2581 behind another character (this is
checked when it is loaded), so the best path of a text is that of its words one after the other, and a bounded memory of words
saves work without changing any count. A vocabulary for which this does not hold is run over whole texts.

Vocabulary: pieces with scores, from a public model file; its path is a parameter. Null texts count 0 tokens, as empty ones do.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0


def _fields(data: bytes) -> list[tuple[int, object]]:
    """(field number, value) of a serialised protocol message."""
    import struct

    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            out.append((key >> 3, varint()))
        elif kind == 2:
            n = varint()
            out.append((key >> 3, data[at : at + n]))
            at += n
        elif kind == 5:
            out.append((key >> 3, struct.unpack("<f", data[at : at + 4])[0]))
            at += 4
        else:
            out.append((key >> 3, data[at : at + 8]))
            at += 8
    return out


def load(path: str = MODEL) -> list[tuple[str, float]]:
    """Normal pieces and scores of a model file, in its order: pieces are field 1, each with text 1, score 2, type 3 (1 if absent)."""
    out = []
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            if x.get(3, 1) == 1:
                out.append((x[1].decode(), float(x.get(2, 0.0))))
    return out


class Unigram:
    BOUND = 500_000

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        best: dict[str, float] = {}
        for p, s in pieces:
            if p:
                best.setdefault(p, s)
        self.auto = ahocorasick.Automaton()
        for p, s in best.items():
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.unknown = min(best.values()) - PENALTY
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in best)
        self.memory: dict[str, int] = {}

    def viterbi(self, s: str) -> int:
        """Pieces on the best path through s, by the tokenizer's tie rule."""
        n = len(s)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        for end, (length, score) in self.auto.iter(s):
            ends[end + 1].append((end + 1 - length, score))
            if length == 1:
                single[end] = True
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            best, pieces = None, 0
            options = sorted(ends[e])
            if not single[e - 1]:
                options.append((e - 1, self.unknown))
                options.sort()
            for start, own in options:
                now = score[start] + own
                if best is None or now > best:
                    best = now
                    known = single[e - 1] or start < e - 1
                    pieces = count[start] + (1 if known else len(s[e - 1].encode("utf-8", "surrogatepass")))
            score[e], count[e] = best, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        s = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return self.viterbi(s)
        total, get = 0, self.memory.get
        for w in s.split(SPACE)[1:] if SPACE + SPACE not in s and not s.endswith(SPACE) else ():
            n = get(w)
            if n is None:
                n = self._remember(w, SPACE + w)
            total += n
        if total:
            return total
        for w in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", s):
            n = get("\0" + w)
            total += self._remember("\0" + w, w) if n is None else n
        return total

    def _remember(self, key: str, s: str) -> int:
        n = self.viterbi(s)
        if len(key) <= 64:
            if len(self.memory) >= self.BOUND:
                self.memory.clear()
            self.memory[key] = n
        return n


def counter(path: str = MODEL) -> Callable[[str], Column]:
    """A function from a text column's name to the column of its token counts; each worker loads the vocabulary once."""
    pieces = load(path)

    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        one = _tokenizer(pieces)
        return pa.array(one.count(t) for t in column.to_pylist())

    return count


_loaded: dict[tuple[tuple[str, float], ...], Unigram] = {}


def _tokenizer(pieces: list[tuple[str, float]]) -> Unigram:
    key = tuple(pieces)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Unigram(pieces)
    return _loaded[key]


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_tokens of each document."""
    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), counter(path)("text").alias("n_tokens"))
