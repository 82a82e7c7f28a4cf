"""Line dedup by an exact set-similarity join.

A line's words stand between spaces, tabs and returns, lower-cased. Its tokens are its distinct 5-word shingles; a line of
fewer words has its whole word sequence as its one token. A line goes when a line at an earlier place (doc_id, line number) is
alike: the Jaccard similarity of their token sets reaches the threshold. Lines without words are always left alone.

1. All tokens are counted in a sketch of fixed size; tokens are ordered by rarity class, then by hash.
2. Written down for each line: a name (128 bits of hash of its words), the size of its token set, and the
   prefix n - ceil(t*n) + 1 of its tokens in that order. Lines of equal words are one line from here on, counted by their first place.
3. The written tokens are counted, before the shuffle and after it; tokens that stand in one line only go at once.
4. Lines that share a prefix token are paired under the length filter, the positional filter and a filter by 64 bits of parity of their whole token
   sets (a bit in which two lines differ stands for a token that one of them lacks, so it loses no pair): first each with a few, of
   the earliest lines of its frequent tokens (in more than FEW lines) those it has most tokens in common with; then those still without an earlier
   match with all earlier lines of all their tokens. So a family of copies takes linear work, and tokens of a few lines are joined once.
5. Jaccard is verified on the lines' whole token sets, which only the lines of pairs that are left get built from the texts again.

Texts become tokens (1, 2 and 5) in one of two ways with the same results: in DataFrame functions (``arrow=False``, the default), or in Arrow
batches (the README has figures of both). The joins are DataFrame operations in both.

Tables that a checked count finds small are broadcast; beyond the bound the same joins are shuffled, and lines that stand very often
are still joined without a shuffle, as their number is bounded by their share.

A null text has no lines and stays null; an empty one has one empty line. Null ids stand after all others. Rows that repeat an id
share its place: the same line at the same place of two such rows does not go. Extra columns pass through. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, pack, spent, unpack

SIZE, PERCENT = 5, 80
#: Slots of the rarity sketch in DataFrame functions, and in Arrow batches (a byte each is sent to all executors).
SLOTS, ARROW_SLOTS = 1 << 16, 1 << 22
#: Rows that are sent to all executors at most: of one number as key, and of names, places or lists. More are joined by a shuffle.
BROADCAST, BROADCAST_ROWS = 2_000_000, 400_000
#: Names that hold more than this share of all lines are no more than this many.
HOT = 4096
#: Heads that a line is compared with before it meets all lines of its tokens.
HEADS = 3
#: Tokens of no more lines than these meet all lines at once: the pairs of so few are few.
FEW = 4
NAME, BITS = ["l1", "l2"], ["b1"]


def _words(line: Column) -> Column:
    plain = F.replace(F.replace(F.lower(line), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def _hashed(lines: DataFrame) -> DataFrame:
    """``line`` becomes ``h``, the hashes of its words."""
    rest = [c for c in lines.columns if c != "line"]
    return lines.select(*rest, _words(F.col("line")).alias("w")).select(*rest, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def _shingle(h: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(h, i + k if k else i) for k in range(size)])


def _shingles(size: int) -> Column:
    """The hashes of h's shingles, null for a line of fewer words. (The outer transform only gives h a name that is cheap to refer
    to for each shingle.)"""
    of = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: _shingle(h, i, size))
    return F.get(F.transform(F.array(F.when(F.size("h") >= size, F.col("h"))), of), 0)


def _prefix(n: Column, percent: int) -> Column:
    """A line that shares none of so many of its first tokens with another is not alike to it."""
    return n - F.ceil(n * percent / F.lit(100.0)).cast("int") + 1


def _parity(tokens: Column) -> Column:
    """64 bits: a token counts in one of them, by its last six bits, and it says whether an odd number does."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda seen, t: seen.bitwiseXOR(bit(t)))


def _rarity(docs: DataFrame, size: int) -> bytes:
    """For each slot of the sketch the rarity class, 2 per doubling of its count over all tokens, from 1 to 127: a string of SLOTS
    bytes, whatever the input. Texts are counted without a split into lines: shingles across line ends count too, which shifts the order of
    tokens a little, the same for all lines, and no result."""
    words = _hashed(docs.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("line")))
    at = words.select("h", F.explode_outer(F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size))).alias("i"))  # outer: else each line is split twice for a filter
    tokens = at.select("i", _shingle(F.col("h"), F.col("i"), size).alias("s")).where("i is not null")
    counts = tokens.groupBy(F.pmod("s", F.lit(SLOTS)).alias("slot")).agg(F.count("*").alias("n"))
    level = F.least(F.floor(F.log2(F.col("n") + 1) * 2), F.lit(126)) + 1
    rows = counts.groupBy(F.floor(F.col("slot") / 256).alias("part")).agg(F.collect_list(F.struct("slot", level.cast("int").alias("c"))).alias("x"))
    out = bytearray(b"\x01" * SLOTS)
    for r in rows.collect():
        for x in r["x"]:
            out[x["slot"]] = x["c"]
    return bytes(out)


def _place() -> Column:
    """doc_id and line number as one number; null ids last."""
    big = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)"))
    return (big * F.lit(2**32).cast("decimal(11,0)") + F.col("pos").cast("decimal(11,0)")).cast("decimal(35,0)")


def _few(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if its count allows it."""
    return F.broadcast(small) if small.count() <= most else small


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def lines_of(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (hash of the text), pos, l1 and l2 (the name), n (tokens; of a line of fewer words minus its number of words), b1
    (parity bits of all tokens), s (prefix tokens) of every line."""
    classes = F.split(F.lit(",".join(map(str, _rarity(docs, size)))), ",").cast("array<bigint>")  # folded to one literal, of small numbers as each text of the plan holds it

    def token(s: Column) -> Column:
        return F.shiftleft(F.coalesce(F.get(classes, s.bitwiseAND(SLOTS - 1).cast("int")), F.lit(1).cast("long")), 56).bitwiseOR(s.bitwiseAND((1 << 56) - 1))

    rows = _numbered(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    sets = _hashed(rows).select("doc_id", "th", "pos", "h", F.sort_array(F.array_distinct(F.transform(_shingles(size), token))).alias("s"))
    n = F.coalesce(F.size("s"), F.lit(-1))
    named = sets.select("doc_id", "th", "pos", F.xxhash64("h").alias("l1"), F.xxhash64(F.lit(1), "h").alias("l2"), F.when(n > 0, n).otherwise(-F.size("h")).alias("n"), "s")
    bits = [F.coalesce(_parity(F.col("s")), F.lit(0).cast("long")).alias(b) for b in BITS]
    return named.select("doc_id", "th", "pos", *NAME, "n", *bits, F.when(F.col("n") > 0, F.slice("s", 1, _prefix(F.col("n"), percent))).alias("s"))


class Tokens:
    """Lines of lower-cased texts as flat arrays of words and shingles, straight from an Arrow column's bytes.

    A word's hash is a polynomial of scrambled bytes modulo 2**64: the difference of two running sums, shifted to the word's start."""

    MOST = 2 << 20
    _BASE = 0x9E3779B97F4A7C13  # odd, so it has an inverse

    def __init__(self, size: int) -> None:
        self.size = size
        self.value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 13, 32]] = True
        self._powers(self.MOST)

    def _powers(self, n: int) -> None:
        base, back = np.uint64(self._BASE), np.uint64(pow(self._BASE, -1, 1 << 64))
        self.power, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (base, back))

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of at most about MOST bytes of text (a longer text stays whole): the rows, their bytes, where each text begins."""
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            if not len(col):
                continue
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
            start = 0
            while start < len(col):
                upto = max(start + 1, int(np.searchsorted(offsets, offsets[start] + self.MOST, "right")) - 1)
                yield batch.slice(start, upto - start), data[offsets[start] : offsets[upto]], offsets[start : upto + 1] - offsets[start]
                start = upto

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash and line of each word, hash and line of each shingle, lines of each text); lines are numbered through all texts."""
        n = len(raw)
        if n >= len(self.power):
            self._powers(n)
        ends_line = raw == 10
        marks = np.zeros(n + 1, np.int32)
        marks[1:] = ends_line
        np.add.at(marks, offsets[1:-1], 1)
        line_at = np.cumsum(marks, dtype=np.int32)
        total = int(line_at[-1]) + 1 if len(offsets) > 1 else 0
        breaks = np.concatenate([[0], np.cumsum(ends_line)])
        lines = np.diff(breaks[offsets]) + 1
        blank = self.blank[raw]
        edge = np.ones(n + 1, bool)  # no word goes on from the byte before
        edge[1:n] = blank[:-1]
        edge[offsets] = True
        first = np.flatnonzero(~blank & edge[:n])
        last = np.flatnonzero(~blank & np.append(edge[1:n] | blank[1:], True)[:n]) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[:n], out=sums[1:])
        h = mix64((sums[last] - sums[first]) * self.inverse[first] + (last - first).astype(np.uint64))
        line = line_at[first].astype(np.uint16 if total < 1 << 16 else np.int32)
        m, size = len(h) - self.size + 1, self.size
        if m <= 0:
            return h, line, h[:0], line[:0], lines
        inside = np.flatnonzero(line[:m] == line[size - 1 :])
        acc = np.full(len(inside), size, np.uint64)
        for k in range(size):
            acc = mix64(acc) * np.uint64(0x9E3779B97F4A7C15) + h[inside + k]
        return h, line, mix64(acc), line[inside], lines


def _distinct(s: np.ndarray, at: np.ndarray, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each line, by rarity class if given, then by hash; and their lines."""
    order = np.argsort(s)
    if rare is not None:
        order = order[np.argsort(rare[(s[order] & np.uint64(len(rare) - 1)).astype(np.int64)], kind="stable")]
    order = order[np.argsort(at[order], kind="stable")]
    s, at = s[order], at[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
    return s[new], at[new]


def _lowered(docs: DataFrame) -> DataFrame:
    return _numbered(docs).where("text is not null").withColumn("text", F.lower("text"))


def _arrow_rarity(docs: DataFrame, size: int) -> np.ndarray:
    """The rarity classes of ARROW_SLOTS slots, counted over all tokens: vectors of fixed size, summed in the executors."""
    pieces, kind, slots = 16, "piece long, blob binary", ARROW_SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens, held, n = np.zeros(slots, np.uint32), Tokens(size), [], 0
        for _, raw, offsets in tokens.parts(batches):
            held.append((tokens.of(raw, offsets)[2] & np.uint64(slots - 1)).astype(np.int64))
            n += len(held[-1])
            if n > slots:
                total += np.bincount(np.concatenate(held), minlength=slots).astype(np.uint32)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=slots).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int64()), pa.array([pack(x) for x in total.reshape(pieces, -1)], pa.binary())], names=["piece", "blob"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = sum(unpack(b, np.uint32)[0].astype(np.int64) for b in part.column("blob").to_pylist())
        level = np.minimum(np.floor(np.log2(total + 1) * 2), 126).astype(np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([pack(level)], pa.binary())})

    got = {r["piece"]: unpack(r["blob"], np.uint8)[0] for r in _lowered(docs).select("text").mapInArrow(count, kind).groupBy("piece").applyInArrow(add, kind).collect()}
    return np.concatenate([got[i] for i in range(pieces)]) if got else np.zeros(slots, np.uint8)


def _arrow_lines(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """lines_of in Arrow batches."""
    sent = docs.sparkSession.sparkContext.broadcast(_arrow_rarity(docs, size))  # a byte for each slot

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(size)
        for rows, raw, offsets in tokens.parts(batches):
            h, line, s, at, lines = tokens.of(raw, offsets)
            total = int(lines.sum())
            words = np.bincount(line, minlength=total)
            begin = np.cumsum(words) - words
            within = (np.arange(len(h)) - begin[line]).astype(np.uint64)
            names, full = [np.zeros(total, np.uint64) for _ in range(2)], np.flatnonzero(words)
            for seed, name in enumerate(names):
                if len(full):
                    name[full] = mix64(np.add.reduceat(mix64(h ^ mix64(within * np.uint64(2) + np.uint64(seed + 1))), begin[full]))
            s, at = _distinct(s, at, sent.value)
            n = np.bincount(at, minlength=total)
            bits, some = [np.zeros(total, np.uint64) for _ in BITS], np.flatnonzero(n)
            for b in bits:
                if len(some):
                    b[some] = np.bitwise_xor.reduceat(np.uint64(1) << (s & np.uint64(63)), (np.cumsum(n) - n)[some])
            p = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
            s = s[np.arange(len(s)) - (np.cumsum(n) - n)[at] < p[at]]
            which = np.repeat(np.arange(len(lines)), lines)
            pos = np.arange(total) - (np.cumsum(lines) - lines)[which]
            ids = rows.select(["doc_id", "th"]).take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [ids.column(0), ids.column(1), pa.array(pos.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in names], pa.array(np.where(n > 0, n, -words).astype(np.int32)), *[pa.array(x.view(np.int64)) for x in bits],
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]).astype(np.int32)), pa.array(s.view(np.int64)))],
                names=["doc_id", "th", "pos", *NAME, "n", *BITS, "s"],
            )

    return _lowered(docs).mapInArrow(deal, "doc_id long, th long, pos int, l1 long, l2 long, n int, b1 long, s array<long>")


def _token_sets(lines: DataFrame, size: int, arrow: bool) -> DataFrame:
    """(l1, l2, tokens) for (l1, l2, line)."""
    if not arrow:
        return _hashed(lines).select(*NAME, F.array_distinct(_shingles(size)).alias("tokens"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(size)
        for rows, raw, offsets in tokens.parts(batches):
            s, at = _distinct(*tokens.of(raw, offsets)[2:4])
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rows.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*rows.select(NAME).columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))], names=[*NAME, "tokens"])

    return lines.select(*NAME, F.lower("line").alias("text")).mapInArrow(sets, "l1 long, l2 long, tokens array<long>")


def _pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs of lines with a common prefix token, the right one earlier, that can be alike. n counts a line's tokens, r is a
    token's place in their order.

    Length filter: neither has more tokens than the threshold allows. Positional filter: the common tokens up to this one, and those behind it. Parity
    filter: common tokens are at most half of what both sizes exceed the differing bits by. Then by pair: common tokens are those of both prefixes, and behind the prefix that ends first."""
    a, b = left.alias("a"), right.alias("b")
    na, nb, ra, rb = (F.col(x) for x in ("a.n", "b.n", "a.r", "b.r"))
    length = (na * percent <= nb * 100) & (nb * percent <= na * 100)
    most = F.least(ra, rb) + F.least(na - ra, nb - rb)
    differ = sum(F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in BITS)
    position, parity = most * (100 + percent) >= (na + nb) * percent, (na + nb - differ) * (100 + percent) >= 2 * percent * (na + nb)
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.place") > F.col("b.place")) & length & position & parity)
    pairs = met.groupBy(F.col("a.l1").alias("l1"), F.col("a.l2").alias("l2"), F.col("b.l1").alias("m1"), F.col("b.l2").alias("m2")).agg(
        F.count("*").alias("common"), F.max(F.greatest(na - _prefix(na, percent), nb - _prefix(nb, percent))).alias("rest"), F.max(na + nb).alias("both")
    )
    return pairs.where((F.col("common") + F.col("rest")) * (100 + percent) >= F.col("both") * percent).select(*NAME, "m1", "m2", "common")


def _alike(pairs: DataFrame, docs: DataFrame, posts: DataFrame, size: int, percent: int, arrow: bool) -> DataFrame:
    """The lines (l1, l2) of those pairs whose Jaccard similarity reaches the threshold."""
    names = cut(pairs.select(*NAME).union(pairs.select("m1", "m2")).distinct(), "names")
    first = posts.select("doc_id", "th", "pos", *NAME).join(_few(names), NAME, "left_semi").distinct()
    where = cut(first.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", *NAME)).alias("found")), "found")  # at most a text's lines
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    met = rows.join(_few(where), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th")))
    at = met.select(F.split("text", "\n", -1).alias("lines"), F.explode("found").alias("x")).select("x.l1", "x.l2", F.get("lines", F.col("x.pos")).alias("line"))
    tokens = cut(_token_sets(at, size, arrow), "tokens")
    other = tokens.select(F.col("l1").alias("m1"), F.col("l2").alias("m2"), F.col("tokens").alias("other"))
    both = pairs.join(tokens, NAME).join(other, ["m1", "m2"])
    same = F.size(F.array_intersect("tokens", "other"))
    out = cut(both.where(same * (100 + percent) >= (F.size("tokens") + F.size("other")) * percent).select(*NAME).distinct(), "alike")
    spent(names, where, tokens)
    return out


def _posts(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each line those of its prefix tokens that another line has written too: t, and r, its place in the order. Then the tokens that
    more than FEW lines have written."""
    counts = cut(single.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    rows = single.select("doc_id", "th", "pos", *NAME, "n", *BITS, F.posexplode("s").alias("r", "t"))
    out = cut(rows.join(_few(counts.select("t"), BROADCAST), "t", "left_semi"), "posts")
    frequent = cut(counts.where(F.col("c") > FEW).select("t"), "frequent")
    spent(counts)
    return out, frequent


def late_lines(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, short: bool = True, arrow: bool = False) -> DataFrame:
    """(doc_id, th, pos) of every line that goes; without ``short`` lines of fewer than ``size`` words stay."""
    dealt = _arrow_lines(docs, size, percent) if arrow else lines_of(docs, size, percent)
    lines = cut(dealt, "lines").where("n <> 0" if short else "n > 0").withColumn("place", _place())
    places = lines.groupBy(*NAME).agg(F.min("place").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    repeated = cut(places, "repeated")
    first = _few(repeated.select(*NAME, "first"))
    single = lines.where("n > 0").join(first, NAME, "left").where("first is null or place = first").drop("first")

    posts, frequent = _posts(single)
    posted = posts.select(_place().alias("place"), *NAME, "n", *BITS, "t", "r")
    often = posted.join(_few(frequent), "t", "left_semi")
    heads = often.groupBy("t").agg(F.min(F.struct("place", *NAME, "n", *BITS, "r")).alias("x")).select("t", "x.*")
    best = Window.partitionBy(*NAME).orderBy(F.col("common").desc(), "m1", "m2")
    nearest = cut(_pairs(often, heads, percent).withColumn("k", F.row_number().over(best)).where(F.col("k") <= HEADS).select(*NAME, "m1", "m2"), "nearest")
    one = _alike(nearest, docs, posts, size, percent, arrow)
    others = cut(_pairs(posted.join(_few(one), NAME, "left_anti"), posted, percent).select(*NAME, "m1", "m2"), "others")
    two = _alike(others, docs, posts, size, percent, arrow)

    gone = one.union(two).withColumn("gone", F.lit(True))
    verdict = cut(repeated.join(gone, NAME, "full").select(*NAME, "first", "copies", F.coalesce("gone", F.lit(False)).alias("gone")), "verdict")
    spent(posts, frequent, nearest, others, repeated, one, two)
    return _occurrences(lines.select("doc_id", "th", "pos", "place", *NAME), verdict)


def _occurrences(lines: DataFrame, verdict: DataFrame) -> DataFrame:
    """The places of the verdict's lines that go. Lines with more than a 4096th of all repeats are few, so they are broadcast."""
    late = F.col("gone") | (F.col("place") > F.col("first"))
    total, n = verdict.agg(F.sum("copies"), F.count("*")).first()
    if n <= BROADCAST_ROWS:
        met = lines.join(F.broadcast(verdict), NAME)
    else:
        often = F.broadcast(verdict.where(F.col("copies") > max(1, (total or 0) // HOT)))
        seldom = verdict.where(F.coalesce("copies", F.lit(1)) <= max(1, (total or 0) // HOT))
        met = lines.join(often, NAME).unionByName(lines.join(often.select(*NAME), NAME, "left_anti").join(seldom, NAME))
    return met.where(late).select("doc_id", "th", "pos")


def _by_document(late: DataFrame) -> DataFrame:
    return late.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("late")).select(F.col("doc_id").alias("late_id"), F.col("th").alias("late_th"), "late")


def digest(docs: DataFrame, **more: int) -> DataFrame:
    """doc_id, n_lines long, n_removed long, removed string (line numbers from 0, comma-joined) of each document."""
    late = _by_document(late_lines(docs, **more))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(breaks, F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(late, F.col("doc_id").eqNullSafe(F.col("late_id")) & (F.col("th") == F.col("late_th")), "left")
    gone = F.coalesce(F.col("late"), F.expr("cast(array() as array<int>)"))
    return out.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


def dedup(docs: DataFrame, *, drop_emptied: bool = True, **more: int) -> DataFrame:
    """The documents with their late lines taken out of the text, columns unchanged. A document of which nothing but
    blanks is left because of it goes, unless ``drop_emptied`` is false."""
    late = cut(_by_document(late_lines(docs.select("doc_id", "text"), **more)), "late")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"))
    joined = rows.join(_few(late), F.col("doc_id").eqNullSafe(F.col("late_id")) & (F.col("th") == F.col("late_th")), "left")
    split = joined.select("row", "late", F.when(F.col("late").isNotNull(), F.split("row.text", "\n", -1)).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("late"))
    new = F.when(F.col("late").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    out = split.withColumn("new", new)
    if drop_emptied:
        out = out.where(F.col("late").isNull() | (F.length(F.trim(F.translate("new", "\n\t\r", "   "))) > 0))
    return out.select(*[F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
