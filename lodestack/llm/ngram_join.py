"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct 5-word shingles as 64-bit hashes (with fewer words, the whole sequence as one).
Two documents link when their sets' Jaccard similarity reaches the threshold. The join bounds the overlap of a query with
groups of documents by the group's token union and opens only the groups that can hold a partner, on two levels:

* the first group is all other documents. Tokens are dealt out by hash range, as compressed arrays of
  shortened hashes, and each range finds which tokens stand in two rows at least. A document of whose tokens fewer than
  threshold * n also stand elsewhere cannot link with anything. Shortened hashes only add to the overlap, so
  the bound stays safe;
* what remains is collapsed to distinct sets, ordered by token rarity (a sketch that grows with the tokens, up to 64 MB) and tied together by its prefix
  tokens into clusters outside of which no partner can be. Within a cluster similar sets are put in groups of a few
  sets each; a token-group matrix stores each group's token union, and only groups whose overlap reaches the bound are
  opened and verified by exact Jaccard.

A cluster of more than ``cap`` sets is split into blocks that each meet the cluster's most connected sets; only sets
that did not join the cluster's main component visit other blocks, those with which they share a prefix token. So one large family of near copies takes linear
work, in many tasks, and no link between different sets is lost.

Null, empty and blank texts have no tokens and link with nothing. Rows with a null id take no part in links and have a null
component. Repeated rows and texts are one set. Columns other than the named ones are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, cut, give_back, mix64, pack, press, slices, space_words, spent, texts, unpack, unpress
from .graph import components

SHINGLE, PERCENT, CAP, GROUP = 5, 80, 2000, 16
SKETCH_BITS = 20, 26  # of the rarity sketch, at least and at most
_RANGE_BYTES = 16 << 20
_SLICE_BYTES = 4 << 20
#: Sets that may link, as far as their documents' ids are sent to the texts; beyond it the texts are shuffled to them.
SENT = 2_000_000


def shingles(words: list[bytes], size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word sequences of the given length."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    width = min(size, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = mix64(acc) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(mix64(acc))


def set_id(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def bound(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap that a partner of a set of n tokens has."""
    return -(-n * percent // 100)


# --- level 1: all other documents as one group ---------------------------------------------------------------------


def _deal(size: int, ranges: int, buckets: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to blobs: for each hash range the shortened tokens with their document; for each bucket of
    documents their sizes and set ids."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(batches, "text", _SLICE_BYTES):
            ids = batch.column(0).to_numpy().astype(np.int64)
            sets = [shingles(space_words(t), size, hashes) for t in texts(batch.column(1))]
            n, sid = np.array([len(s) for s in sets], np.int64), [set_id(s) for s in sets]
            tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            del sets  # arrays of the size of the slice go as soon as they are spent: the workers keep what they have taken
            tokens >>= np.uint64(64 - bits)
            order = np.argsort(tokens, kind="stable")
            tokens, rows = tokens[order], np.repeat(np.arange(len(n), dtype=np.uint32), n)[order]
            del order
            key, blob = [], []
            home = _home(ids, buckets)
            if len(tokens):  # tokens that several rows of this slice hold are counted here and sent once, for no row
                many, new = _met(tokens, rows)
                here = np.bincount(rows[many], minlength=len(n)).astype(np.uint32)
                rows[many] = len(n)
                keep = ~many | new
                tokens, rows = tokens[keep], rows[keep]
                for b in np.unique(home[here > 0]):
                    m = np.flatnonzero((home == b) & (here > 0))
                    m = m[np.argsort(ids[m], kind="stable")]
                    key.append(ranges + buckets + int(b))
                    blob.append(press(np.diff(ids[m], prepend=np.int64(0)), here[m]))
            at = _edges(tokens, ranges, bits)
            for r in range(ranges):
                a, b = at[r], at[r + 1]
                if a < b:
                    own, where = np.unique(rows[a:b], return_inverse=True)
                    own = own[own < len(n)]  # the last number, if it is behind them, is of no row
                    key.append(r)
                    blob.append(press(np.diff(tokens[a:b], prepend=np.uint64(0)), where.astype(np.uint32), np.diff(ids[own], prepend=np.int64(0))))
            for b in np.unique(home):
                m = np.flatnonzero(home == b)
                key.append(ranges + int(b))
                blob.append(pack(ids[m], n[m], np.frombuffer(b"".join(sid[i] for i in m), np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(blob, pa.binary())], names=["key", "blob"])

    return deal


def _met(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted tokens, one at least: whether a token stands in several rows, and whether it is the first of its kind."""
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    start = np.flatnonzero(new)
    other = np.zeros(len(tokens), bool)
    other[1:] = rows[1:] != rows[:-1]
    other &= ~new
    return np.repeat(np.logical_or.reduceat(other, start), np.diff(start, append=len(tokens))), new


def _edges(sorted_tokens: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    limits = np.array([-(-(r << bits) // ranges) for r in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_tokens, limits), [len(sorted_tokens)]]).astype(np.int64)


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _small(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A range blob's tokens, their documents' numbers, the documents' ids."""
    t, r, i = unpress(blob, np.uint64, np.uint32, np.int64)
    return np.cumsum(t, dtype=np.uint64), r, np.cumsum(i, dtype=np.int64)


def _shared(ranges: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Of a range: for each document, how many of its tokens stand in another row too."""

    def shared(key: tuple, part: pa.Table) -> pa.Table:
        if key[0].as_py() >= ranges:  # sizes with set ids, and counts, pass through
            home, sizes = (key[0].as_py() - ranges) % buckets, key[0].as_py() < ranges + buckets
            k = pa.array([home] * part.num_rows, pa.int64())
            return pa.table({"home": k, "sizes": pa.array([sizes] * part.num_rows, pa.bool_()), "blob": part.column("blob").combine_chunks()})
        give_back()  # what the range before held
        tokens, rows, ids, real, base = [], [], [], [], 0
        for blob in part.column("blob"):
            t, r, i = _small(blob.as_py())
            tokens.append(t)
            rows.append(r.astype(np.int64 if base + len(i) >= 1 << 31 else np.int32) + base)
            ids += [i, np.zeros(1, np.int64)]  # one more for the tokens of no row
            real += [np.ones(len(i), bool), np.zeros(1, bool)]
            base += len(i) + 1
        t, r, i, known = np.concatenate(tokens), np.concatenate(rows), np.concatenate(ids), np.concatenate(real)
        del tokens, rows, ids, real
        order = np.argsort(t, kind="stable")
        t, r = t[order], r[order]
        del order
        often = _met(t, r)[0]
        count = np.bincount(r[often], minlength=base)[known]
        doc, where = np.unique(i[known], return_inverse=True)
        total = np.bincount(where, weights=count).astype(np.int64)
        doc, total = doc[total > 0], total[total > 0]
        home = _home(doc, buckets)
        keys = np.unique(home)
        blobs = [press(np.diff(doc[home == b], prepend=np.int64(0)), total[home == b].astype(np.uint32)) for b in keys]
        return pa.table({"home": pa.array(keys, pa.int64()), "sizes": pa.array([False] * len(keys), pa.bool_()), "blob": pa.array(blobs, pa.binary())})

    return shared


def _candidates(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket of documents: doc_id, n, sid, candidate (the overlap with all others reaches the bound)."""

    def decide(part: pa.Table) -> pa.Table:
        ids, n, sid, doc, count = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for blob, sizes in zip(part.column("blob").to_pylist(), part.column("sizes").to_pylist(), strict=True):
            if sizes:
                a, b, c = unpack(blob, np.int64, np.int64, np.uint8)
                ids.append(a)
                n.append(b)
                raw = c.tobytes()
                sid += [raw[k : k + 16] for k in range(0, len(raw), 16)]
            else:
                a, b = unpress(blob, np.int64, np.uint32)
                doc.append(np.cumsum(a, dtype=np.int64))
                count.append(b)
        i, m = np.concatenate(ids), np.concatenate(n)
        d, where = np.unique(np.concatenate(doc), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(count), minlength=len(d)) if len(d) else np.zeros(0)
        at = np.minimum(np.searchsorted(d, i), max(0, len(d) - 1))
        got = np.where(d[at] == i, total[at], 0) if len(d) else np.zeros(len(i))
        return pa.table({"doc_id": pa.array(i), "n": pa.array(m), "sid": pa.array(sid, pa.binary()), "candidate": pa.array((got >= bound(m, percent)) & (m > 0))})

    return decide


def sets_of(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, sid, candidate) of the rows with an id, written down."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(parts, -(-held // _RANGE_BYTES))
    bits = min(64, max(40, (held // 4 + 1).bit_length() + 13))
    dealt = rows.mapInArrow(_deal(size, ranges, ranges, bits), "key long, blob binary")
    homes = dealt.groupBy("key").applyInArrow(_shared(ranges, ranges), "home long, sizes boolean, blob binary")
    return cut(homes.groupBy("home").applyInArrow(_candidates(percent), "doc_id long, n long, sid binary, candidate boolean"), "sets")


# --- level 2: clusters, blocks and the token-group matrix ------------------------------------------------------------


def sketch_bits(n_tokens: int) -> int:
    """So many that about two tokens or fewer fall on a slot: in a fuller sketch rare tokens look like frequent ones, and prefixes of these tie
    sets that have little in common. The most is 64 MB."""
    least, most = SKETCH_BITS
    return min(most, max(least, (n_tokens // 2).bit_length()))


def _rank(count: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: exact below 128, then eight steps each time they double."""
    return np.where(count < 128, count, 128 + np.minimum(127, np.floor(8 * np.log2(np.maximum(count, 128) / 128)))).astype(np.uint8)


def _sketch(sets: DataFrame, bits: int, most: int = 1 << 20) -> np.ndarray:
    """Ranks of the counts of tokens by their low bits, over all sets: 2**bits bytes, summed in the executors. A task sends the slots that it
    has counted whenever it has taken ``most`` tokens."""
    slots, pieces = 1 << bits, 64
    width = slots // pieces

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        slot, n = np.unique(np.concatenate(held), return_counts=True)
        at = np.searchsorted(slot, np.arange(pieces + 1) * width)
        some = np.flatnonzero(np.diff(at))
        blobs = [press(np.diff(slot[at[p] : at[p + 1]], prepend=np.uint32(p * width)), n[at[p] : at[p + 1]].astype(np.uint32)) for p in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], names=["piece", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, taken = [], 0
        for b in batches:
            for blob in b.column(0).to_pylist():
                held.append((np.frombuffer(blob, np.uint64) & np.uint64(slots - 1)).astype(np.uint32))
                taken += len(held[-1])
                if taken >= most:
                    yield counted(held)
                    held, taken = [], 0
        if taken:
            yield counted(held)

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for blob in part.column("blob"):
            slot, n = unpress(blob.as_py(), np.uint32, np.uint32)
            total[np.cumsum(slot, dtype=np.int64)] += n
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([pack(_rank(total))], pa.binary())})

    kind = "piece long, blob binary"
    out = np.zeros(slots, np.uint8)
    for r in sets.select("tokens").mapInArrow(count, kind).groupBy("piece").applyInArrow(add, kind).toLocalIterator():
        out[r["piece"] * width : (r["piece"] + 1) * width] = unpack(r["blob"], np.uint8)[0]
    return out


def _keys(t: np.ndarray, rare: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set's prefix tokens, of which it shares one at least with each partner."""
    n, grid = len(t), np.log(100.0 / percent) if percent < 100 else 0.0
    p = t[np.lexsort((t, rare[(t & np.uint64(len(rare) - 1)).astype(np.int64)]))][: n - bound(n, percent) + 1]
    size = np.uint64(int(np.log(n) / grid + 1e-9) if grid else n)  # sizes of partners are in the same class or the next
    return np.concatenate([mix64(p ^ mix64(np.full(1, s, np.uint64))) for s in (size, size + np.uint64(1))])


def _ties(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal keys: edges (member, first), and where each key first stands."""
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    first = at[new][np.cumsum(new) - 1] if len(keys) else at
    e = np.unique(np.stack([at[~new], first[~new]], 1), axis=0) if len(keys) else np.zeros((0, 2), np.int64)
    return e[e[:, 0] != e[:, 1]], keys[new], at[new]


def _prefixes(sets: DataFrame, sent: Broadcast, percent: int, ranges: int) -> DataFrame:
    """Edges (a, b) between sets that share a prefix token and can reach the threshold by their sizes; equal keys are tied
    within each slice first, so that a frequent token sends one row per slice."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sent.value
        for b in batches:
            sid, keys, at = b.column(0).to_pylist(), [], []
            for i, blob in enumerate(b.column(1).to_pylist()):
                keys.append(_keys(np.frombuffer(blob, np.uint64), rare, percent))
                at.append(np.full(len(keys[-1]), i, np.int64))
            if not keys:
                continue
            e, k, first = _ties(np.concatenate(keys), np.concatenate(at))
            r = (k >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            order = np.argsort(r, kind="stable")
            r, k, first = r[order], k[order], first[order]
            out_r, out_b = [], []
            for x in np.unique(r):
                lo, hi = np.searchsorted(r, x), np.searchsorted(r, x, "right")
                own, where = np.unique(first[lo:hi], return_inverse=True)
                out_r.append(int(x))
                out_b.append(pack(k[lo:hi], where.astype(np.uint32), np.frombuffer(b"".join(sid[j] for j in own), np.uint8)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_r + [-1 - int(x) % ranges for x in e[:, 0]], pa.int64()), pa.array(out_b + [None] * len(e), pa.binary()), pa.array([None] * len(out_r) + [sid[x] for x in e[:, 0]], pa.binary()), pa.array([None] * len(out_r) + [sid[x] for x in e[:, 1]], pa.binary())],
                names=["r", "blob", "a", "b"],
            )

    def tie(part: pa.Table) -> pa.Table:
        keys, at, sid = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        pairs_a, pairs_b = [], []
        for blob, a, b in zip(part.column("blob").to_pylist(), part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
            if blob is None:
                pairs_a.append(a)
                pairs_b.append(b)
                continue
            k, w, raw = unpack(blob, np.uint64, np.uint32, np.uint8)
            keys.append(k)
            at.append(w.astype(np.int64) + len(sid))
            raw = raw.tobytes()
            sid += [raw[x : x + 16] for x in range(0, len(raw), 16)]
        number: dict[bytes, int] = {}
        name = np.array([number.setdefault(s, len(number)) for s in sid], np.int64)
        known = list(number)
        e, _, _ = _ties(np.concatenate(keys), name[np.concatenate(at)] if len(sid) else np.zeros(0, np.int64))
        return pa.table({"a": pa.array(pairs_a + [known[x] for x in e[:, 0]], pa.binary()), "b": pa.array(pairs_b + [known[x] for x in e[:, 1]], pa.binary())})

    return sets.select("sid", "tokens").mapInArrow(prefix, "r long, blob binary, a binary, b binary").groupBy("r").applyInArrow(tie, "a binary, b binary")


class TokenGroups:
    """A token-group matrix over some sets: which tokens stand in each group's union."""

    def __init__(self, sets: list[np.ndarray], cluster: list[bytes], percent: int, group: int = GROUP) -> None:
        self.percent, self.n = percent, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.universe, ids = np.unique(flat, return_inverse=True)
        start = np.concatenate([[0], np.cumsum(self.n)])
        self.tokens = [ids[start[i] : start[i + 1]] for i in range(len(sets))]
        # Similar sets side by side: by cluster, then by their least scrambled token, then by size.
        least = [int(mix64(s).min()) if len(s) else 0 for s in sets]
        order = sorted(range(len(sets)), key=lambda i: (cluster[i], least[i], self.n[i]))
        self.groups: list[np.ndarray] = []
        now: list[int] = []
        for i in order:
            if now and (len(now) == group or cluster[i] != cluster[now[0]]):
                self.groups.append(np.array(now))
                now = []
            now.append(i)
        if now:
            self.groups.append(np.array(now))
        self.members = [np.concatenate([self.tokens[i] for i in g]) for g in self.groups]
        self.cuts = [np.concatenate([[0], np.cumsum(self.n[g])[:-1]]).astype(np.int64) for g in self.groups]
        unions = [np.unique(m) for m in self.members]
        tok = np.concatenate(unions) if unions else np.zeros(0, np.int64)
        grp = np.repeat(np.arange(len(unions)), [len(u) for u in unions])
        o = np.argsort(tok, kind="stable")
        self.of_token = grp[o]
        self.first = np.searchsorted(tok[o], np.arange(len(self.universe) + 1))
        self.small = np.array([self.n[g].min() for g in self.groups], np.int64)
        self.large = np.array([self.n[g].max() for g in self.groups], np.int64)
        self.mask = np.zeros(len(self.universe), np.int8)

    def overlaps(self, q: int) -> np.ndarray:
        """For each group, how many of the query's tokens stand in its union: an upper bound of any member's overlap."""
        t = self.tokens[q]
        lo, hi = self.first[t], self.first[t + 1]
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.of_token[at], minlength=len(self.groups))

    def links(self, queries: list[int], label: np.ndarray) -> list[tuple[int, int]]:
        """Links that join different labels, as far as they are needed: a spanning forest of all links of the queries."""
        found = []
        for q in queries:
            n = self.n[q]
            if not n:
                continue
            open_ = np.flatnonzero((self.overlaps(q) >= bound(n, self.percent)) & (self.small * self.percent <= n * 100) & (n * self.percent <= self.large * 100))
            for g in open_.tolist():
                members = self.groups[g]
                if (label[members] == label[q]).all():
                    continue
                self.mask[self.tokens[q]] = 1
                same = np.add.reduceat(self.mask[self.members[g]], self.cuts[g], dtype=np.int64)
                self.mask[self.tokens[q]] = 0
                hit = members[(100 + self.percent) * same >= self.percent * (n + self.n[members])]
                for m in hit.tolist():
                    if label[m] != label[q]:
                        found.append((q, m))
                        label[label == label[m]] = label[q]
        return found


def _verify(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block: verified links (a, b) that connect its sets; rows with a label are known to be one with their label."""

    def verify(part: pa.Table) -> pa.Table:
        sid, ask, label = part.column("sid").to_pylist(), part.column("ask").to_pylist(), part.column("label").to_pylist()
        keep = {}
        for i, s in enumerate(sid):
            if s not in keep or ask[i]:
                keep[s] = i
        rows = list(keep.values())
        blobs, cluster = part.column("tokens").to_pylist(), part.column("cluster").to_pylist()
        number: dict[bytes, int] = {}
        lab = np.array([number.setdefault(label[i], len(number)) for i in rows], np.int64)
        tg = TokenGroups([np.frombuffer(blobs[i], np.uint64) for i in rows], [cluster[i] for i in rows], percent)
        e = tg.links([k for k, i in enumerate(rows) if ask[i]], lab)
        return pa.table({"a": pa.array([sid[rows[x]] for x, _ in e], pa.binary()), "b": pa.array([sid[rows[y]] for _, y in e], pa.binary())})

    return verify


def _everywhere(rows: DataFrame) -> DataFrame:
    """The rows once for each block of their cluster."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).withColumn("home", F.xxhash64("cluster", "block")).drop("block")


def _visits(members: DataFrame, sent: Broadcast, percent: int) -> DataFrame:
    """(sid, home) of each left-over set and each other block that holds a set with one of its prefix keys. ``members`` are the sets of large
    clusters: sid, tokens, home, left_over. A set has no partner in any other block."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sent.value
        for b in slices(batches, "tokens", 1 << 20):
            keys = [np.unique(_keys(np.frombuffer(t, np.uint64), rare, percent)).view(np.int64) for t in b.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[b.column(c).take(at) for c in (0, 2, 3)]], names=["key", "sid", "home", "left_over"])

    rows = members.select("sid", "tokens", "home", "left_over").mapInArrow(keyed, "key long, sid binary, home long, left_over boolean")
    asked = rows.where("left_over").select("key", "sid", F.col("home").alias("own"))
    return asked.join(rows.select("key", "home").distinct(), "key").where("home <> own").select("sid", "home").distinct()


def _texts_of(docs: DataFrame, reps: DataFrame, sent: int = SENT) -> DataFrame:
    """(text, sid) of the documents that stand for a set. Few of the texts are wanted, so their ids go to the texts, which stay where they are."""
    few = reps.count() <= sent
    return docs.select("doc_id", "text").join(F.broadcast(reps) if few else reps, "doc_id").select("text", "sid")


def links(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of every row with an id, and (v, root): the component of each set that links with another."""
    spark = docs.sparkSession
    kind = "a binary, b binary"
    known = sets_of(docs, size, percent)
    reps = cut(known.where("candidate").groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "reps")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in slices(batches, "text"):
            sets = [shingles(space_words(t), size, hashes) for t in texts(b.column(0))]
            keep = [i for i, (s, want) in enumerate(zip(sets, b.column(1).to_pylist(), strict=True)) if set_id(s) == want]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(sets[i]) for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["sid", "tokens"])

    sets = cut(_texts_of(docs, reps).mapInArrow(tokens, "sid binary, tokens binary").dropDuplicates(["sid"]), "tokens")
    n_tokens, n_sets = sets.agg(F.sum(F.octet_length("tokens") / 8), F.count("*")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rarity = spark.sparkContext.broadcast(_sketch(sets, sketch_bits(int(n_tokens or 0))))
    ties = cut(_prefixes(sets, rarity, percent, max(parts, int((n_tokens or 0) // 2_000_000))), "ties")
    cluster = cut(components(ties), "clusters")
    count = cluster.groupBy("root").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / cap)
    tasks = max(parts, int((n_tokens or 0) // 2_000_000))
    where = cluster.join(count, "root").select("v", F.col("root").alias("cluster"), "members", blocks.alias("blocks"))
    placed = sets.join(where, F.col("sid") == F.col("v")).select("sid", "tokens", "cluster", "members", "blocks")
    alone = F.col("members") <= cap
    home = F.when(alone, F.pmod(F.xxhash64("cluster"), F.lit(tasks))).otherwise(F.xxhash64("cluster", F.pmod(F.xxhash64("sid"), F.col("blocks").cast("long"))))
    rows = placed.select("sid", "tokens", "cluster", "blocks", alone.alias("alone"), home.alias("home"), F.lit(True).alias("ask"), F.col("sid").alias("label"))
    columns = ["sid", "tokens", "cluster", "home", "ask", "label"]
    large = count.where(F.col("members") > cap)
    any_large = not large.isEmpty()
    first = rows
    if any_large:  # the most connected sets of a large cluster meet each of its blocks
        degree = ties.groupBy("b").agg(F.count("*").alias("degree"))
        ranked = degree.join(cluster, F.col("b") == F.col("v")).join(large, "root").withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy(F.col("degree").desc(), "b")))
        hubs = ranked.where("k <= 4").select(F.col("b").alias("sid"))
        first = rows.unionByName(_everywhere(rows.join(hubs, "sid", "left_semi")))
    verified = cut(first.select(*columns).groupBy("home").applyInArrow(_verify(percent), kind), "links")
    roots = cut(components(verified), "roots")
    if any_large:  # sets outside of a large cluster's main component visit those of its blocks that can hold a partner
        inside = rows.where(~F.col("alone")).select("sid", "cluster", "blocks", "home").join(roots, F.col("sid") == F.col("v"), "left").withColumn("root", F.coalesce("root", "sid"))
        main = inside.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        marked = cut(inside.join(main, "cluster").select("sid", "cluster", "blocks", "home", F.col("root").alias("label"), (F.col("root") != F.col("main")).alias("left_over")), "marked")
        visits = _visits(marked.join(sets, "sid"), rarity, percent)
        guests = marked.where("left_over").drop("home").join(visits, "sid").select("sid", "cluster", "home", "label", F.lit(True).alias("ask"))
        hosts = marked.select("sid", "cluster", "home", "label", F.lit(False).alias("ask"))
        again = guests.unionByName(hosts).join(sets, "sid").select(*columns)
        more = again.groupBy("home").applyInArrow(_verify(percent), kind)
        found, less = cut(verified.unionByName(more), "links"), roots
        roots = cut(components(found), "roots")
        spent(found, less, marked)
    spent(reps, sets, ties, cluster, verified)
    return known, roots


def _of_sets(known: DataFrame, roots: DataFrame) -> DataFrame:
    """(sid, component_id) of every set that is not empty."""
    sid = known.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = sid.join(roots, F.col("sid") == F.col("v"), "left").withColumn("root", F.coalesce("root", "sid"))
    top = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only sets whose component starts elsewhere than at their own least document need the second join.
    return named.join(top, "root").select("sid", "component_id")


def near_copies(docs: DataFrame, **more: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; component_id is the least id that links reach."""
    known, roots = links(docs, **more)
    of_set = _of_sets(known, roots)
    linked = known.where("n > 0").join(of_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = known.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    nameless = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), _count_only(more.get("size", SHINGLE))("text").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionByName(empty).unionByName(nameless)


def _count_only(size: int) -> Callable[[str], F.Column]:
    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        hashes = WordHash()
        return pa.array([len(shingles(space_words(t), size, hashes)) for t in texts(column)], pa.int64())

    return count


def _set_ids(size: int) -> Callable[[str], F.Column]:
    @F.arrow_udf("binary")
    def name(column: pa.Array) -> pa.Array:
        hashes = WordHash()
        return pa.array([set_id(shingles(space_words(t), size, hashes)) for t in texts(column)], pa.binary())

    return name


def representatives(docs: DataFrame, **more: int) -> DataFrame:
    """The documents without those whose component starts at a smaller id; columns unchanged. Rows with a null id stay. Rows that share an
    id are judged each by its own text: those of one text share their fate, and one that links with nothing stays."""
    names = docs.columns
    known, roots = links(docs.select("doc_id", "text"), **more)
    named = known.where("n > 0").join(_of_sets(known, roots), "sid")
    found = cut(named.where("component_id <> doc_id").select(F.col("doc_id").alias("gone"), F.col("sid").alias("gone_sid")).distinct(), "gone")
    several = cut(known.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select(F.col("doc_id").alias("several")), "several")

    def own(df: DataFrame) -> DataFrame:
        return df.select(*[df[f"`{c}`"] for c in names])

    if several.isEmpty():
        return own(docs.join(found, docs["doc_id"] == found["gone"], "left_anti"))
    # Ids with rows of different sets: only their texts are read again, and rows go by id and set.
    once = docs.join(several, docs["doc_id"] == several["several"], "left_anti")
    kept = own(once.join(found, once["doc_id"] == found["gone"], "left_anti"))
    mixed = docs.join(several, docs["doc_id"] == several["several"], "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("id"), _set_ids(more.get("size", SHINGLE))("text").alias("sid"))
    rest = mixed.join(found, (F.col("id") == F.col("gone")) & (F.col("sid") == F.col("gone_sid")), "left_anti")
    return kept.unionByName(rest.select(*[F.col(f"row.`{c}`") for c in names]))
