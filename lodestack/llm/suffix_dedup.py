"""Exact substring dedup by interval expansion on Burrows-Wheeler transforms.

Of each document every byte goes that is covered by a string of ``length`` bytes which also starts in a document with a smaller id.
Texts are taken as UTF-8 bytes, matches never cross documents, overlaps count, and strings are judged on the input.

Equal strings meet by their minimizer, the least hash of the 16-byte grams in them: a document's strings with the same minimizer
form a segment, and equal strings lie in segments of equal minimizer whatever surrounds them.

1. Minimizers are dealt out by hash range as compressed arrays; a segment whose minimizer stands in one document only is dropped. What is
   frequent within a slice of documents is settled there and sent once.
2. The other segments are dealt out with their bytes. Equal segments of a slice are sent once, for their least document.
3. In each range the distinct segments' strings of which an equal hash stands elsewhere in the range are put in a Burrows-Wheeler
   transform; all others stand in one segment. Intervals are expanded breadth first by backward
   extension, which yields the common prefix lengths in increasing order; it stops at ``length``, and places still without one
   share at least that much with their neighbour. The least document of each such interval decides its strings.
4. Each document unites its removed runs.

Texts are sorted into buckets by their id once; both passes over them read that one exchange. A null text is empty. Rows with a null id keep all
and remove nothing; rows that repeat an id don't remove each other. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pack, slices, texts, unpack

LENGTH, GRAM = 50, 16
_BUCKET_BYTES, _SLICE, _BATCH = 8 << 20, 1 << 20, 3 << 17
_SUBS = 64  # parts of a range, so that a transform stays near _BATCH bytes
_KIND = "key long, blob binary"
U = np.uint64


def home_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(doc_id), buckets), as Spark computes it."""
    p1, p2, p3, p4, p5 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)
    turn = lambda x, k: (x << U(k)) | (x >> U(64 - k))
    h = (U(42) + p5 + U(8)) ^ (turn(ids.astype(np.int64).view(U) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return np.mod((h ^ (h >> U(32))).view(np.int64), buckets)


def gram_hashes(t: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes, never 0, of all grams: whole bytes are joined to words of up to 8, and words are mixed."""
    width = min(8, gram)
    w, have = t.astype(U), 1
    while have < width:
        more = min(have, width - have)
        w = w[: len(w) - more] | (w[more:] << U(8 * have)) if more == have else w[: len(w) - more] | (w[more:] >> U(8 * (have - more)) << U(8 * have))
        have += more
    n = len(t) - gram + 1
    h = w[:n] * U(0x9E3779B97F4A7C15)
    for at in [*range(width, gram - width, width), gram - width] if gram > width else []:
        h ^= h >> U(32)
        h += w[at : at + n] * U(0xC2B2AE3D27D4EB4F)
        h *= U(0x165667B19E3779F9)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    h |= U(1)
    return h


def segments(docs: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, last start, minimizer) of each segment, in order of document and start."""
    none = np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    total = int(sizes.sum())
    if total < length:
        return none, none, none, none.view(U)
    m, width = gram_hashes(np.frombuffer(b"".join(docs), np.uint8), gram), length - gram + 1
    have = 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    end = np.cumsum(sizes)
    first = end - sizes
    for a, z in zip(np.maximum(first, end - length + 1).tolist(), end.tolist(), strict=True):
        m[a:z] = 0  # strings from here would leave the document
    new = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]])
    start, last = new[:-1], new[1:] - 1
    fine = m[start] != 0
    start, last = start[fine], last[fine]
    doc = np.searchsorted(end, start, "right")
    return doc, start - first[doc], last - first[doc], m[start]


def _ordinals(doc: np.ndarray) -> np.ndarray:
    """0, 1, ... within each document of a sorted array."""
    start = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    at = np.arange(len(doc))
    return at - np.maximum.accumulate(np.where(start, at, 0)) if len(doc) else at


def _range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """The range of well-mixed keys."""
    return (((key >> U(32)) * U(ranges)) >> U(32)).astype(np.int64)


def _rows(keys: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "blob"])


def _by_home(ids: np.ndarray, buckets: int, offset: int, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Blobs of the columns, behind the ids' differences, by home bucket."""
    if not len(ids):
        return [], []
    home = home_of(ids, buckets)
    order = np.argsort(home, kind="stable")
    home = home[order]
    cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
    keys, blobs = [], []
    for a, b in zip(cuts, [*cuts[1:], len(home)], strict=True):
        o = order[a:b]
        keys.append(offset + int(home[a]))
        blobs.append(pack(np.diff(ids[o], prepend=np.int64(0)), *[c[o] for c in columns]))
    return keys, blobs


# --- 1: which minimizers stand in two documents ------------------------------------------------------------------------


def _deal_keys(length: int, gram: int, ranges: int, buckets: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            ids = b.column(0).to_numpy().astype(np.int64)
            doc, _, _, key = segments([t or b"" for t in texts(b.column(1))], length, gram)
            if not len(doc):
                continue
            at, key = _ordinals(doc), mix64(key) & ~U((1 << (64 - bits)) - 1)  # shortened keys only add candidates
            order = np.argsort(key)
            k, d, o = key[order], doc[order], at[order]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            start = np.flatnonzero(new)
            own = ids[d]
            many = (np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start))[np.cumsum(new) - 1]
            keys, blobs = _by_home(own[many], buckets, ranges, o[many].astype(np.uint32))  # settled here
            send = ~many | new  # what is settled goes out once, so that others learn of it
            k, d, o = k[send], d[send], o[send]
            r = _range_of(k, ranges)  # grows with the key
            cuts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            for x, y in zip(cuts, [*cuts[1:], len(r)], strict=True):
                doc_here, where = np.unique(d[x:y], return_inverse=True)
                keys.append(int(r[x]))
                blobs.append(pack(np.diff(k[x:y] >> U(64 - bits), prepend=U(0)), where.astype(np.uint32), o[x:y].astype(np.uint32), np.diff(ids[doc_here], prepend=np.int64(0))))
            yield _rows(keys, blobs)

    return deal


def _meet_keys(ranges: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Of a range: (document, segment number) of every minimizer that stands in two documents."""

    def meet(key: tuple, part: pa.Table) -> pa.Table:
        r = key[0].as_py()
        if r >= ranges:
            return pa.table({"key": pa.array([r - ranges] * part.num_rows, pa.int64()), "blob": part.column("blob").combine_chunks()})
        k, ids, o = [], [], []
        for blob in part.column("blob").to_pylist():
            a, w, c, i = unpack(blob, U, np.uint32, np.uint32, np.int64)
            k.append(np.cumsum(a, dtype=U))
            ids.append(np.cumsum(i, dtype=np.int64)[w])
            o.append(c)
        k, ids, o = np.concatenate(k), np.concatenate(ids), np.concatenate(o)
        order = np.argsort(k)
        k, ids, o = k[order], ids[order], o[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        start = np.flatnonzero(new)
        many = (np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start))[np.cumsum(new) - 1]
        keys, blobs = _by_home(ids[many], buckets, 0, o[many])
        return pa.Table.from_batches([_rows(keys, blobs)])

    return meet


# --- 2: the segments' bytes --------------------------------------------------------------------------------------------


def _sorted_docs(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of a bucket, in order of id and text: ids, whether they are null, the number among rows of the same id, texts."""
    ids = part.column("doc_id").to_pylist()
    t = [x or b"" for x in texts(part.column("text"))]
    order = sorted(range(len(t)), key=lambda i: (ids[i] is None, ids[i] or 0, t[i]))
    null = np.array([ids[i] is None for i in order], bool)
    num = np.array([ids[i] or 0 for i in order], np.int64)
    return num, null, _ordinals(num), [t[i] for i in order]


def _deal_segments(length: int, gram: int, ranges: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def deal(docs: pa.Table, shared: pa.Table) -> pa.Table:
        known: list[np.ndarray] = []
        for blob in shared.column("blob").to_pylist():
            i, o = unpack(blob, np.int64, np.uint32)
            known.append(np.stack([np.cumsum(i, dtype=np.int64), o.astype(np.int64)], 1))
        if not known or not docs.num_rows:
            return pa.Table.from_batches([_rows([], [])])
        pairs = np.concatenate(known)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        ids, null, twin, text = _sorted_docs(docs)
        first = np.searchsorted(pairs[:, 0], ids), np.searchsorted(pairs[:, 0], ids, "right")
        least: dict[bytes, int] = {}  # segment bytes -> the first (so the least) document of the bucket
        entries, settled = [], []
        at = 0
        while at < len(ids):
            upto, held = at, 0
            while upto < len(ids) and (upto == at or held + len(text[upto]) <= _SLICE):
                held += len(text[upto])
                upto += 1
            doc, lo, hi, key = segments(text[at:upto], length, gram)
            wanted = np.zeros(len(doc), bool)
            begin = np.searchsorted(doc, np.arange(upto - at + 1))
            for d in range(upto - at):
                g = at + d
                if not null[g] and first[0][g] < first[1][g]:
                    n = pairs[first[0][g] : first[1][g], 1]
                    wanted[begin[d] + n[n < begin[d + 1] - begin[d]]] = True
            for d, a, z, k in zip((doc[wanted] + at).tolist(), lo[wanted].tolist(), hi[wanted].tolist(), key[wanted].tolist(), strict=True):
                s = text[d][a : z + length]
                m = least.setdefault(s, d)
                if ids[m] < ids[d]:
                    settled.append((d, a, z + length))  # the same segment stands in a smaller document of this bucket
                else:
                    entries.append((k, d, a, s))
            at = upto
        keys, blobs = [], []
        if settled:
            x = np.array(settled, np.int64)
            keys, blobs = _by_home(ids[x[:, 0]], buckets, ranges, twin[x[:, 0]].astype(np.uint32), x[:, 1].astype(np.uint32), x[:, 2].astype(np.uint32))
        if entries:
            k = mix64(np.array([e[0] for e in entries], U))
            r, sub = _range_of(k, ranges), (k % U(_SUBS)).astype(np.uint8)
            order = np.argsort(r, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], r[order][1:] != r[order][:-1]]))
            for x, y in zip(cuts, [*cuts[1:], len(r)], strict=True):
                e = [entries[i] for i in order[x:y]]
                d = np.array([i[1] for i in e], np.int64)
                keys.append(int(r[order[x]]))
                blobs.append(pack(np.diff(ids[d], prepend=np.int64(0)), twin[d].astype(np.uint32), np.array([i[2] for i in e], np.uint32), np.array([len(i[3]) for i in e], np.uint32), sub[order[x:y]], np.frombuffer(b"".join(i[3] for i in e), np.uint8)))
        return pa.Table.from_batches([_rows(keys, blobs)])

    return deal


# --- 3: the Burrows-Wheeler transform ------------------------------------------------------------------------------------


def bounded_order(t: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of t (values below 512) in order of their first ``length`` values at least, by prefix doubling."""
    n, have = len(t), 7
    padded = np.concatenate([t.astype(np.int64), np.zeros(have, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(have):
        key <<= 9
        key |= padded[k : k + n]
    while True:
        order = np.argsort(key)
        if have >= length:
            return order.astype(np.int32)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]]))
        key = rank * (n + 2)
        if have < n:
            key[: n - have] += rank[have:]
        have *= 2


def common_starts(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, True where an interval of suffixes that share ``length`` values begins). 0 separates texts.

    Level l expands the intervals of strings of l values by each value before them. The interval of the longer string ends where
    its suffixes' common prefix with the next one is l; where that is new it is noted, and the interval is expanded in turn."""
    n = len(t)
    order = bounded_order(t, length)
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    bwt = t[order - 1]  # the value before each suffix
    bwt[order == 0] = 0  # nothing stands before the first
    back = inverse[order - 1]  # where the suffix that is one value longer stands
    back[bwt == 0] = -1  # strings with a separator are never asked for
    head = np.concatenate([t[order], [-1]]).astype(np.int16)
    split = head[1:] != head[:-1]  # a suffix after which the first value changes
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    owner = np.full(n + 2, -1, np.int32)
    stamp = 0
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(length):
        if not len(lo):
            break
        sizes = hi - lo
        if stamp + len(lo) > 2_000_000_000:
            owner[:] = -1
            stamp = 0
        who = np.repeat(np.arange(stamp, stamp + len(lo), dtype=np.int32), sizes)
        j = np.arange(len(who), dtype=np.int32) + np.repeat((lo - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
        stamp += len(lo)
        to = back[j]
        real = to >= 0
        to, who = to[real], who[real]
        owner[to] = who
        ends = to[(owner[to + 1] != who) | split[to]]
        starts = to[(owner[to - 1] != who) | split[to - 1] | (to == 0)]
        ends.sort()
        starts.sort()
        fresh = ~edge[ends + 1]
        edge[ends[fresh] + 1] = True
        lo, hi = starts[fresh], ends[fresh] + 1
    return order, edge[:n]


def repeated(t: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Of the strings of ``length`` bytes that begin where ``valid`` holds, in order: whether an equal hash begins another of them."""
    out = np.zeros(len(valid), bool)
    at = np.flatnonzero(valid)
    if len(at) < 2:
        return out
    h = gram_hashes(t, length)[at]
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        out[at] = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    return out


def least_owner(segs: list[bytes], owner: np.ndarray, length: int) -> list[np.ndarray]:
    """For each start of a string of ``length`` in each segment the least owner of a segment that holds it.

    A string whose hash stands in one place only has its own segment's owner. The transform is built of the rest, run by run: equal
    strings have equal hashes, so all places of each are in it."""
    sizes = np.fromiter(map(len, segs), np.int64, len(segs))
    whole = np.frombuffer(b"".join(segs), np.uint8)
    end = np.cumsum(sizes)
    first = end - sizes
    of = np.repeat(np.arange(len(segs)), sizes)
    out = owner[of]
    some = repeated(whole, np.arange(len(whole)) + length <= end[of], length)
    edge_at = np.flatnonzero(some[1:] != some[:-1]) + 1
    bounds = np.concatenate([[0], edge_at, [len(some)]])
    lo, hi = bounds[:-1][some[bounds[:-1]]] if len(some) else bounds[:0], bounds[1:][some[bounds[:-1]]] if len(some) else bounds[:0]
    if len(lo):
        runs = hi - lo + length - 1  # bytes of each run's strings; a run ends before the last length - 1 bytes of its segment
        begin = np.cumsum(runs + 1) - (runs + 1)
        run = np.repeat(np.arange(len(runs)), runs + 1)
        within = np.arange(len(run)) - begin[run]
        inside = within < runs[run]
        t = np.zeros(len(run), np.int16)
        t[inside] = whole[(lo[run] + within)[inside]].astype(np.int16) + 1
        order, edge = common_starts(t, length)
        valid = (within + length <= runs[run])[order]
        group = np.cumsum(edge)[valid]
        at = order[valid]
        place = lo[run[at]] + within[at]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        least = np.minimum.reduceat(owner[of[place]], np.flatnonzero(new))
        out[place] = least[np.cumsum(new) - 1]
    return [out[b : b + s - length + 1] for b, s in zip(first.tolist(), sizes.tolist(), strict=True)]


def _runs(number: dict[bytes, int], seg: np.ndarray, ids: np.ndarray, twin: np.ndarray, lo: np.ndarray, length: int, buckets: int) -> tuple[list[int], list[bytes]]:
    """Removed runs of the entries (segment, document, twin, place), by home bucket."""
    owner = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(owner, seg, ids)
    least = least_owner(list(number), owner, length)
    n = np.fromiter(map(len, least), np.int64, len(least))
    first = np.cumsum(n) - n
    flat = np.concatenate(least)
    e = np.repeat(np.arange(len(seg)), n[seg])
    within = np.arange(len(e)) - np.repeat(np.cumsum(n[seg]) - n[seg], n[seg])
    gone = flat[first[seg[e]] + within] < ids[e]
    e, within = e[gone], within[gone]
    if not len(e):
        return [], []
    a = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (within[1:] != within[:-1] + 1)]))
    z = np.concatenate([a[1:], [len(e)]]) - 1
    own = e[a]
    return _by_home(ids[own], buckets, 0, twin[own].astype(np.uint32), (lo[own] + within[a]).astype(np.uint32), (lo[own] + within[z] + length).astype(np.uint32))


def _expand(length: int, ranges: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Of a range: the removed runs of each document."""

    def expand(key: tuple, part: pa.Table) -> pa.Table:
        r = key[0].as_py()
        if r >= ranges:
            return pa.table({"key": pa.array([r - ranges] * part.num_rows, pa.int64()), "blob": part.column("blob").combine_chunks()})
        got, raws, at = [], [], 0
        for blob in part.column("blob").to_pylist():
            i, w, a, n, sub, raw = unpack(blob, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8)
            end = np.cumsum(n, dtype=np.int64) + at
            got.append((sub, np.cumsum(i, dtype=np.int64), w, a.astype(np.int64), end - n, end))
            raws.append(raw)
            at = int(end[-1])
        sub, ids, twin, lo, start, end = (np.concatenate(x) for x in zip(*got, strict=True))
        raw = np.concatenate(raws).tobytes()
        order = np.argsort(sub, kind="stable")
        sub, held = sub[order], np.cumsum((end - start)[order])
        keys, blobs, x = [], [], 0
        while x < len(order):  # equal strings are in the same part; parts are taken together up to _BATCH bytes
            y = int(np.searchsorted(held, (held[x - 1] if x else 0) + _BATCH))
            y = int(np.searchsorted(sub, sub[min(y, len(sub) - 1)], "right"))
            o = order[x:y]
            number: dict[bytes, int] = {}
            seg = np.fromiter((number.setdefault(raw[p:q], len(number)) for p, q in zip(start[o].tolist(), end[o].tolist(), strict=True)), np.int64, len(o))
            k, b = _runs(number, seg, ids[o], twin[o], lo[o], length, buckets)
            keys += k
            blobs += b
            x = y
        return pa.Table.from_batches([_rows(keys, blobs)])

    return expand


# --- 4: what is left -----------------------------------------------------------------------------------------------------


def _finish(docs: pa.Table, runs: pa.Table) -> pa.Table:
    got = [np.zeros((0, 4), np.int64)]
    for blob in runs.column("blob").to_pylist():
        i, w, a, z = unpack(blob, np.int64, np.uint32, np.uint32, np.uint32)
        got.append(np.stack([np.cumsum(i, dtype=np.int64), w.astype(np.int64), a.astype(np.int64), z.astype(np.int64)], 1))
    x = np.concatenate(got)
    x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
    ids, null, twin, text = _sorted_docs(docs)
    first, last = np.searchsorted(x[:, 0], ids), np.searchsorted(x[:, 0], ids, "right")
    spans, kept = [], []
    for d, t in enumerate(text):
        mine = x[first[d] : last[d]]
        mine = mine[mine[:, 1] == twin[d]] if not null[d] else mine[:0]
        if not len(mine):
            spans.append([])
            kept.append(t)
            continue
        reach = np.maximum.accumulate(mine[:, 3])
        new = np.concatenate([[True], mine[1:, 2] > reach[:-1]])
        a = np.flatnonzero(new)
        s, e = mine[a, 2].tolist(), reach[np.concatenate([a[1:], [len(mine)]]) - 1].tolist()
        spans.append([{"start": p, "end": q} for p, q in zip(s, e, strict=True)])
        kept.append(b"".join(t[p:q] for p, q in zip([0, *e], [*s, len(t)], strict=True)))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out_ids = pa.array([None if z else int(i) for i, z in zip(ids, null, strict=True)], pa.int64())
    return pa.table({"doc_id": out_ids, "n_bytes": pa.array([len(t) for t in text], pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})


def dedup(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start,end>> (removed bytes), kept binary of each document."""
    gram = min(GRAM, max(1, length // 3))
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // _BUCKET_BYTES))
    homes = rows.withColumn("key", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)))  # texts meet their results here, twice; rows without an id have none
    dealt = rows.where("doc_id is not null").mapInArrow(_deal_keys(length, gram, n, n, min(64, max(40, (held // 16 + 1).bit_length() + 14))), _KIND)
    shared = dealt.groupBy("key").applyInArrow(_meet_keys(n, n), _KIND)
    strings = homes.groupBy("key").cogroup(shared.groupBy("key")).applyInArrow(_deal_segments(length, gram, n, n), _KIND)
    runs = strings.groupBy("key").applyInArrow(_expand(length, n, n), _KIND)
    return homes.groupBy("key").cogroup(runs.groupBy("key")).applyInArrow(_finish, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(docs: DataFrame, **more: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return dedup(docs, **more).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
