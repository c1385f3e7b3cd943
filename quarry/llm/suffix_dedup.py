"""Suffix-array dedup of byte passages.

A byte goes if a ``window``-byte string that covers it also starts in a document with a smaller id.

1. Anchors. In every window the k-gram with the smallest hash is the window's anchor: equal windows
   have equal anchors, and about one byte in (window - k + 2) / 2 is one. Anchors found in one document
   only go (one shuffle of 16 bytes an anchor).
2. Contexts. For each anchor left, the bytes under all windows that chose it are sent to the anchor's
   bucket, equal contexts of a batch combined.
3. Suffix sort. Contexts that share an anchor by chance share little beside it: their windows are left
   out by the bytes that all windows on one side of an anchor hold. In a bucket, the suffixes that start
   at equal distance before the anchor are sorted by words of eight bytes, of which only ties are read on.
   The common extension of neighbours is found by binary search over prefix polynomial hashes: log2(window)
   steps. Neighbours with an extension of a whole window are a run of equal windows (compared byte by
   byte, against collisions); the smallest id in a run keeps it.
4. The spans found come back to their documents by id and text hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling as R
from .common import NULLS, Workspace, append, column, fresh, keyed_ordinal, row_groups, text_buffer, text_of
from .shared import ANCHOR_SCHEMA, anchor_rows, shared_anchors

CHUNK = 1 << 20


def slices(offs: np.ndarray, limit: int, overlap: int):
    """Chunks of (row, start, end): whole rows, or parts of a long row that overlap."""
    for lo, hi in row_groups(offs, limit):
        if hi - lo > 1 or offs[hi] - offs[lo] <= limit:
            yield [(r, int(offs[r]), int(offs[r + 1])) for r in range(lo, hi)]
        else:
            for s in range(int(offs[lo]), int(offs[hi]), limit):
                yield [(lo, s, min(s + limit + overlap, int(offs[hi])))]


def _anchored(buf, offs, window, k):
    """For each chunk: its bytes, the row and start of each anchor's context and its end, and the hash."""
    for parts in slices(offs, CHUNK, window - 1):
        one = buf[parts[0][1] : parts[-1][2]]
        rows = np.array([p[0] for p in parts])
        lens = np.array([p[2] - p[1] for p in parts])
        o = np.concatenate([[0], np.cumsum(lens)])
        pos, h, first, last = R.anchors(R.byte_prefix(one), o, window, k)
        part = np.searchsorted(o, pos, "right") - 1
        yield one, rows[part], parts[0][1], pos, h, first, last + window


def _find(batches, window, k):
    for b in batches:
        ids = column(b, "o").to_numpy()
        buf, offs = text_buffer(column(b, "t"))
        hs, ds = [], []
        for _, row, _, _, h, _, _ in _anchored(buf, offs, window, k):
            hs.append(h)
            ds.append(ids[row])
        if hs:
            yield anchor_rows(np.concatenate(hs), np.concatenate(ds))


#: The places of a context, packed, as they are many: document id, hash of its text, start.
PLACE = np.dtype([("o", "<i8"), ("th", "<i8"), ("s", "<i4")])
CONTEXTS = "h long, at int, ctx binary, places binary"


def _binary(offs, data: np.ndarray):
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _flat(column):
    """The bytes of a binary column end to end, and their offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _contexts(batches, window, k):
    for b in batches:
        ids, ths = column(b, "o").to_numpy(), column(b, "th").to_numpy()
        buf, offs = text_buffer(column(b, "t"))
        wanted = column(b, "hs")
        wv, wo = np.asarray(wanted.flatten()).view(np.uint64), np.asarray(wanted.offsets).astype(np.int64)
        wv = wv[: wo[-1] - wo[0]] if len(wo) else wv
        row_of = np.repeat(np.arange(len(ids)), np.diff(wo))
        mark = R.mix(wv + R.mix(row_of.astype(np.uint64)))
        mark.sort()
        cols = [[] for _ in range(7)]
        for one, row, base, pos, h, s, e in _anchored(buf, offs, window, k):
            m = R.mix(h + R.mix(row.astype(np.uint64)))
            i = np.searchsorted(mark, m)
            keep = (i < len(mark)) & (mark[np.minimum(i, len(mark) - 1)] == m) if len(mark) else np.zeros(len(m), bool)
            if not keep.any():
                continue
            row, pos, h, s, e = (x[keep] for x in (row, pos, h, s, e))
            p = R.byte_prefix(one)
            c = R.mix(R.span(p, s, e) + ((pos - s) * 1024 + (e - s)).astype(np.uint64))
            for lst, x in zip(cols, (h, c, pos - s, s + base, e + base, row, s + base - offs[row]), strict=True):
                lst.append(x)
        if not cols[0]:
            continue
        h, c, at, s, e, row, own = (np.concatenate(x) for x in cols)
        order = np.lexsort((row, c, h))
        h, c, at, s, e, row, own = (x[order] for x in (h, c, at, s, e, row, own))
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(head)
        occ = np.append(first, len(h))
        lens = (e - s)[first]
        places = np.empty(len(h), PLACE)
        places["o"], places["th"], places["s"] = ids[row], ths[row], own
        ctx = _binary(np.append(0, np.cumsum(lens)), buf[R.ragged(s[first], lens)])
        yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(at[first].astype(np.int32)), ctx, _binary(occ * PLACE.itemsize, places)], names=["h", "at", "ctx", "places"])


class Suffixes:
    """Suffixes of a byte buffer, sorted to a depth; neighbours' common extensions by hashed prefixes."""

    def __init__(self, buf: np.ndarray, depth: int):
        self.buf, self.depth = buf, depth
        self.p = R.byte_prefix(buf)
        self.inv = R.inverse(len(self.p))
        raw = np.append(buf, np.zeros(8, np.uint8))
        self.words = np.ndarray(len(buf) + 1, ">u8", raw, strides=(1,))  # the eight bytes from each place on

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at x and y, at most depth."""
        px, py, ix, iy = self.p[x], self.p[y], self.inv[x], self.inv[y]
        out = np.full(len(x), self.depth, np.int64)
        rest = np.flatnonzero((self.p[x + self.depth] - px) * ix != (self.p[y + self.depth] - py) * iy)
        x, y, px, py, ix, iy = (v[rest] for v in (x, y, px, py, ix, iy))
        lo, hi = np.zeros(len(rest), np.int64), np.full(len(rest), self.depth - 1, np.int64)
        for _ in range((self.depth - 1).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.p[x + mid] - px) * ix == (self.p[y + mid] - py) * iy
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[rest] = lo
        return out

    def sort(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes by group (which must not descend), then by content: radix sort by words.

        Suffixes that tie in all words so far stand together and are sorted by the next eight bytes; a
        suffix that ties with no other is done.
        """
        order = np.arange(len(starts))
        todo, tie = order.copy(), group
        for lo in range(0, self.depth, 8):
            if not len(todo):
                break
            word = self.words[starts[order[todo]] + lo].astype(np.uint64) >> R.U(8 * max(0, lo + 8 - self.depth))
            by = np.lexsort((word, tie))
            order[todo], word = order[todo[by]], word[by]
            new = np.ones(len(todo) + 1, bool)
            new[1:-1] = (tie[1:] != tie[:-1]) | (word[1:] != word[:-1])
            stay = ~(new[:-1] & new[1:])
            todo, tie = todo[stay], np.cumsum(new[:-1])[stay]
        return order

    def runs(self, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes, and the run of equal windows that each place in it belongs to."""
        order = self.sort(starts, group)
        a, b = starts[order[:-1]], starts[order[1:]]
        same = np.zeros(len(order), bool)
        near = group[order[1:]] == group[order[:-1]]
        near[near] = self.extension(a[near], b[near]) >= self.depth
        idx = np.flatnonzero(near)
        reach = np.arange(self.depth)
        for lo in range(0, len(idx), 1 << 16):
            i = idx[lo : lo + (1 << 16)]
            if not (self.buf[a[i, None] + reach] == self.buf[b[i, None] + reach]).all():
                return self._exact(starts, group)
        same[1:] = near
        return order, np.cumsum(~same)

    def _exact(self, starts, group):
        """After a hash collision: the same by plain comparison of bytes."""
        raw = self.buf.tobytes()
        key = [(int(g), raw[s : s + self.depth]) for s, g in zip(starts, group, strict=True)]
        order = np.array(sorted(range(len(key)), key=key.__getitem__), np.int64)
        new = np.array([True, *(key[order[i]] != key[order[i - 1]] for i in range(1, len(order)))])
        return order, np.cumsum(new)


def paired(p, begin, at, lens, window, n, dist):
    """Which windows of different contexts can equal one of another context; the rest needn't be sorted.

    All windows that start at most ``half`` before their anchor hold the window - half bytes from it on, and
    all that start earlier the half + 1 bytes before it and what the earliest of them holds from it on. So
    equal windows have equal bytes there, and most contexts that share a short anchor by chance don't.
    """
    top = int(at.max())
    half = top // 2
    a = begin + at
    late, early = np.flatnonzero(at - (lens - window) <= half), np.flatnonzero(at > half)
    keys = np.concatenate([R.mix(R.span(p, a[late], a[late] + window - half), 1), R.mix(R.span(p, a[early] - half - 1, a[early] + window - top), 2)])
    _, kind, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count[kind] > 1
    sides = np.zeros((2, len(at)), bool)
    sides[0, late], sides[1, early] = shared[: len(late)], shared[len(late) :]
    return np.where(dist <= half, np.repeat(sides[0], n), np.repeat(sides[1], n))


def repeats(h, at, buf, offs, low, window):
    """For contexts end to end in buf, sorted by anchor h: the smallest id that holds each window.

    low is a context's smallest document id. Returns a value per window start, row after row.
    """
    lens = np.diff(offs)
    nwin = lens - window + 1
    p = R.byte_prefix(buf)
    c = R.mix(R.span(p, offs[:-1], offs[1:]) + (at * 1024 + lens).astype(np.uint64))
    order = np.lexsort((c, h))
    # equal contexts of other batches are one; bytes decide
    first = np.ones(len(order), bool)
    if len(order) > 1:
        i, j = order[1:], order[:-1]
        same = (h[i] == h[j]) & (c[i] == c[j]) & (lens[i] == lens[j])
        hit = np.flatnonzero(same)
        reps = lens[i[hit]]
        x = buf[R.ragged(offs[i[hit]], reps)] == buf[R.ragged(offs[j[hit]], reps)]
        if len(hit):
            same[hit] = np.minimum.reduceat(x, np.append(0, np.cumsum(reps)[:-1]))
        first[1:] = ~same
    class_of = np.empty(len(order), np.int64)
    class_of[order] = np.cumsum(first) - 1
    rep = order[first]
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, class_of, low)
    n = nwin[rep]
    w_off = np.append(0, np.cumsum(n))
    out = np.repeat(least, n)
    hr = h[rep]
    edge = np.append(True, hr[1:] != hr[:-1])
    size = np.diff(np.append(np.flatnonzero(edge), len(hr)))
    several = np.repeat(size > 1, size)
    if several.any():
        r = np.flatnonzero(several)
        flat = R.ragged(w_off[r], n[r])
        starts = R.ragged(offs[rep[r]], n[r])
        dist = np.repeat(at[rep[r]], n[r]) - (starts - np.repeat(offs[rep[r]], n[r]))
        gid = np.repeat(np.cumsum(edge)[r], n[r])
        live = np.flatnonzero(paired(p, offs[rep[r]], at[rep[r]], lens[rep[r]], window, n[r], dist))
        flat, starts, dist, gid = (v[live] for v in (flat, starts, dist, gid))
        if len(live):
            by = np.lexsort((dist, gid))
            g = gid[by] * (window + 1) + dist[by]
            order, run = Suffixes(buf, window).runs(starts[by], g)
            m = np.full(run[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(m, run, out[flat[by[order]]])
            out[flat[by[order]]] = m[run]
    lens_out = nwin
    return out[R.ragged(w_off[class_of], lens_out)]


SPANS = "o long, th long, s long, e long"


def _bucket(tables, window):
    t = pa.Table.from_batches(tables).combine_chunks()
    h = t["h"].to_numpy()
    order = np.argsort(h, kind="stable")
    t = t.take(pa.array(order))
    h, at = h[order], t["at"].to_numpy().astype(np.int64)
    buf, offs = _flat(t["ctx"])
    places, oo = _flat(t["places"])
    places, oo = places.view(PLACE), oo // PLACE.itemsize
    docs, th, own = (np.ascontiguousarray(places[x]) for x in ("o", "th", "s"))
    n_occ = np.diff(oo)
    rank = np.minimum(docs, NULLS)
    low = np.minimum.reduceat(rank, oo[:-1])
    least = repeats(h, at, buf, offs, low, window)
    nwin = np.diff(offs) - window + 1
    w_off = np.append(0, np.cumsum(nwin))
    row = np.repeat(np.arange(len(h)), n_occ)
    step = max(1, (1 << 20) // max(1, int(nwin.max())))
    for a in range(0, len(row), step):
        r, d = row[a : a + step], docs[a : a + step]
        n = nwin[r]
        gone = least[R.ragged(w_off[r], n)] < np.repeat(rank[a : a + step], n)
        who = np.repeat(np.arange(len(r)), n)
        rel = np.arange(len(gone)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        begin = gone.copy()
        begin[1:] &= ~(gone[:-1] & (who[1:] == who[:-1]))
        stop = gone.copy()
        stop[:-1] &= ~(gone[1:] & (who[1:] == who[:-1]))
        b, e = np.flatnonzero(begin), np.flatnonzero(stop)
        if len(b):
            w = who[b]
            base = own[a : a + step][w].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(d[w]), pa.array(th[a : a + step][w]), pa.array(base + rel[b]), pa.array(base + rel[e] + window)], names=["o", "th", "s", "e"])


def _sort_buckets(batches, window, limit=1 << 18):
    """Rows come ordered by anchor; whole anchors are worked on in groups of about limit bytes."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(2).nbytes
        if size >= limit:
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            if cut:
                yield from _bucket(t.slice(0, cut).to_batches(), window)
                held = t.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
    if held:
        yield from _bucket(held, window)


def _cut(batch, names):
    ids = len(batch)
    buf, offs = text_buffer(column(batch, names[0]))
    spans = column(batch, names[1])
    out = [np.zeros(ids, np.int64) for _ in range(3)]
    kept = []
    values, so = spans.flatten(), np.asarray(spans.offsets).astype(np.int64)
    s, e = np.asarray(values.field(0)), np.asarray(values.field(1))
    so = so - so[0]
    valid = np.asarray(spans.is_valid())
    for r in range(ids):
        doc = buf[offs[r] : offs[r + 1]]
        out[0][r] = len(doc)
        if valid[r] and so[r + 1] > so[r]:
            gone = R.covered(len(doc), s[so[r] : so[r + 1]], e[so[r] : so[r + 1]])
            out[1][r] = gone.sum()
            out[2][r] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
            doc = doc[~gone]
        kept.append(doc.tobytes())
    return [pa.array(out[0]), pa.array(out[1]), pa.array(out[2]), pa.array(kept, pa.binary())]


def dedup_passages(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """docs with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (binary).

    A null text is empty; texts shorter than the window keep all. A null doc_id sorts last. Rows with
    one doc_id are documents that don't count as smaller than each other. Repeated windows in one
    document alone stay. Extra columns pass through; new columns give way to existing names.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix")
    base = docs.select(keyed_ordinal().alias("o"), text_of().alias("t"))
    found = ws.save(shared_anchors(base.mapInArrow(lambda it: _find(it, window, k), ANCHOR_SCHEMA)), "anchors")
    keyed = ws.save(base.withColumn("th", F.xxhash64("t")).join(found, "o").select("o", "th", "t", "hs"), "keyed")
    ws.drop(found)
    ctx = keyed.mapInArrow(lambda it: _contexts(it, window, k), CONTEXTS).repartition("h").sortWithinPartitions("h")
    spans = ws.save(ctx.mapInArrow(lambda it: _sort_buckets(it, window), SPANS), "spans")
    ws.drop(keyed)
    o, th, tt, sp, nb, nr, ns, kb = fresh(docs, "ord", "th", "tt", "spans", "n_bytes", "n_removed", "n_spans", "kept_bytes")
    per = spans.groupBy(F.col("o").alias(o), F.col("th").alias(th)).agg(F.collect_list(F.struct("s", "e")).alias(sp))
    full = docs.withColumns({o: keyed_ordinal(), tt: text_of()}).withColumn(th, F.xxhash64(tt)).join(per, [o, th], "left")
    fields = [T.StructField(nb, T.LongType()), T.StructField(nr, T.LongType()), T.StructField(ns, T.LongType()), T.StructField(kb, T.BinaryType())]
    return append(full, lambda b: _cut(b, (tt, sp)), fields).drop(o, th, tt, sp)

