"""Substring dedup by repeated-phrase automata.

A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id.

1. Confirm. Anchors (the word k-gram with the smallest hash in a window) that one document alone has
   go first. The windows around the others are hashed (64 bits) and combined by hash and block of
   documents; windows of several documents are confirmed, with the smallest id that holds each and a
   place in each block where one stands.
2. Compile. Documents are dealt into blocks of about ``block_bytes``. Each block gets the confirmed
   windows found in it, joins them to passages by their places, and compiles the passages' seeds (phrases
   so placed that each window holds one) into Aho-Corasick automata of at most ``shard_patterns``
   patterns, a word being one symbol. A phrase that all documents hold costs one row a block.
3. Locate. All documents of the block stream through its automata, and only windows that cover a hit are
   looked at: the confirmed window of the same hash is compared word by word, and if its first document
   is smaller the words go. Without hits nothing is located.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling as R
from .common import NULLS, Workspace, column, fresh, keyed_ordinal, row_groups, text_buffer, text_of, total_bytes
from .shared import ANCHOR_SCHEMA, anchor_rows, shared_anchors

CHUNK = 1 << 19
BASE = 40


def _chunks(batch, name):
    buf, offs = text_buffer(column(batch, name))
    for lo, hi in row_groups(offs, CHUNK):
        one = buf[offs[lo] : offs[hi]]
        starts, ends, wo = R.words(one, offs[lo : hi + 1] - offs[lo])
        yield lo, one, starts, ends, wo, R.prefix(R.word_hashes(one, starts, ends))


def _find(batches, window, k):
    for b in batches:
        ids = column(b, "o").to_numpy()
        hs, ds = [], []
        for lo, _, _, _, wo, p in _chunks(b, "t"):
            pos, h, _, _ = R.anchors(p, wo, window, k)
            hs.append(h)
            ds.append(ids[lo + np.searchsorted(wo, pos, "right") - 1])
        if hs:
            yield anchor_rows(np.concatenate(hs), np.concatenate(ds))


WINDOWS = "w long, block int, lo long, hi long, place long"


def _window_hashes(p, at, window):
    return R.mix(R.span(p, at, at + window), 1)


def _confirm(batches, window, k):
    for b in batches:
        ids, ths = np.minimum(column(b, "o").to_numpy(), NULLS), column(b, "th").to_numpy()
        block = column(b, "block").to_numpy()
        wanted = column(b, "hs")
        wv, wo_ = np.asarray(wanted.flatten()).view(np.uint64), np.asarray(wanted.offsets).astype(np.int64)
        mark = R.mix(wv + R.mix(np.repeat(np.arange(len(ids)), np.diff(wo_)).astype(np.uint64)))
        mark.sort()
        cols = [[] for _ in range(4)]
        for lo, _, _, _, wo, p in _chunks(b, "t"):
            pos, h, first, last = R.anchors(p, wo, window, k)
            row = np.searchsorted(wo, pos, "right") - 1
            m = R.mix(h + R.mix((lo + row).astype(np.uint64)))
            i = np.searchsorted(mark, m)
            keep = mark[np.minimum(i, len(mark) - 1)] == m if len(mark) else np.zeros(len(m), bool)
            n = (last - first + 1)[keep]
            at = R.ragged(first[keep], n)
            r = np.repeat(row[keep], n)
            for lst, x in zip(cols, (_window_hashes(p, at, window), lo + r, at - wo[r], ids[lo + r]), strict=True):
                lst.append(x)
        if not cols[0]:
            continue
        w, r, at, d = (np.concatenate(x) for x in cols)
        blk = block[r]
        order = np.lexsort((d, blk, w))
        w, blk, d = (x[order] for x in (w, blk, d))
        head = np.ones(len(w), bool)
        head[1:] = (w[1:] != w[:-1]) | (blk[1:] != blk[:-1])
        a = np.flatnonzero(head)
        z = np.append(a[1:], len(w)) - 1
        r, at = r[order[a]], at[order[a]]
        place = (ths[r].astype(np.int64) << 32) | at
        yield pa.RecordBatch.from_arrays([pa.array(w[a].view(np.int64)), pa.array(blk[a]), pa.array(d[a]), pa.array(d[z] if len(z) else d), pa.array(place)], names=["w", "block", "lo", "hi", "place"])


def seeds(holders: np.ndarray, window: int) -> np.ndarray:
    """Word positions (a row per seed) of the phrases that stand for the windows at holders (ascending).

    Consecutive windows are one passage. Every window of a passage holds one of its seeds, the half-window
    phrases at each half window of it, so the automata need a seventh of the windows as patterns.
    """
    half = (window + 1) // 2
    first = np.append(True, np.diff(holders) != 1)
    head = np.flatnonzero(first)
    n = np.diff(np.append(head, len(holders)))
    count = (n + half - 2) // half + 1
    at = np.repeat(holders[head], count) + half * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return at[:, None] + np.arange(half)


def compile_shards(symbols: np.ndarray, shard_patterns: int):
    """Aho-Corasick automata over the distinct rows of symbols (a phrase's words as numbers).

    Yields (automaton, its words in ascending order, phrase length in words, characters of a word).
    """
    import ahocorasick

    size = symbols.shape[1]
    for a in range(0, len(symbols), shard_patterns):
        used, coded = np.unique(symbols[a : a + shard_patterns], return_inverse=True)
        digits = 1
        while BASE**digits <= len(used):
            digits += 1
        auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        text, step = spelled(coded.ravel() + 1, digits), size * digits
        for i in range(0, len(text), step):
            auto.add_word(text[i : i + step])
        auto.make_automaton()
        yield auto, used, size, digits


def spelled(codes: np.ndarray, digits: int) -> str:
    """Numbers to the base BASE, a character a digit, each place with characters of its own.

    So few characters can follow one another that a step of an automaton is short, and a match begins
    and ends where words do. 0 stands for the words of no pattern.
    """
    out = np.empty((len(codes), digits), np.uint32)
    for d in range(digits):
        out[:, d] = codes // BASE ** (digits - 1 - d) % BASE + 1 + d * BASE
    return out.tobytes().decode("utf-32-le")


def _holders(places, ths, wo, p, w, window):
    """The word position in the block of the window w that stands at each place (text hash, position in it)."""
    order = np.argsort(ths, kind="stable")
    th, at = places >> 32, places & 0xFFFFFFFF
    i = np.searchsorted(ths[order], th)
    out = np.full(len(places), -1, np.int64)
    todo = np.arange(len(places))
    while len(todo):  # texts of one 32-bit hash are tried one after the other
        todo = todo[i[todo] < len(order)]
        row = order[i[todo]]
        same = ths[row] == th[todo]
        todo, row = todo[same], row[same]
        s = wo[row] + at[todo]
        fits = s + window <= wo[row + 1]
        s = np.where(fits, s, 0)
        hit = fits & (_window_hashes(p, s, window) == w[todo])
        out[todo[hit]] = s[hit]
        todo = todo[~hit]
        i[todo] += 1
    return out


def _hits(symbols, wo, patterns, window, shard_patterns):
    """Starts of the windows that cover a hit of the automata of patterns (a row per phrase)."""
    near = np.zeros(len(symbols) + 1, np.int64)
    for auto, used, size, digits in compile_shards(patterns, shard_patterns):
        i = np.minimum(np.searchsorted(used, symbols), len(used) - 1)
        code = np.where(used[i] == symbols, i + 1, 0)
        for a, z in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True):
            if z - a < window:
                continue
            e = np.fromiter((x for x, _ in auto.iter(spelled(code[a:z], digits))), np.int64)
            if len(e):
                e = (e + 1) // digits + a
                np.add.at(near, np.maximum(e - window, a), 1)
                np.add.at(near, np.minimum(e - size, z - window) + 1, -1)
    return np.flatnonzero(np.cumsum(near[:-1]) > 0)


def _locate(left: pa.Table, right: pa.Table, names, window, shard_patterns):
    """Appends n_words, n_removed and kept to the documents of one block."""
    tt, oo, hh = names
    n = left.num_rows
    ids = np.minimum(left[oo].to_numpy(), NULLS)
    buf, offs = text_buffer(left[tt])
    starts, ends, wo = R.words(buf, offs)
    hashes = np.empty(len(starts), np.uint64)
    for lo, hi in row_groups(offs, CHUNK):
        a, z = wo[lo], wo[hi]
        hashes[a:z] = R.word_hashes(buf[offs[lo] : offs[hi]], starts[a:z] - offs[lo], ends[a:z] - offs[lo])
    gone = np.zeros(len(starts) + 1, np.int64)
    if right.num_rows and len(starts) >= window:
        pw, pm, place = right["w"].to_numpy().view(np.uint64), right["mn"].to_numpy(), right["place"].to_numpy()
        order = np.argsort(pw, kind="stable")
        order = order[np.append(True, pw[order[1:]] != pw[order[:-1]])]
        pw, pm, place = pw[order], pm[order], place[order]
        p = R.prefix(hashes)
        holder = _holders(place, left[hh].to_numpy().astype(np.int64), wo, p, pw, window)
        s = _hits(hashes, wo, hashes[seeds(np.unique(holder[holder >= 0]), window)], window, shard_patterns)
        w = _window_hashes(p, s, window)
        i = np.minimum(np.searchsorted(pw, w), len(pw) - 1)
        hit = (pw[i] == w) & (holder[i] >= 0)
        s, i = s[hit], i[hit]
        hit = pm[i] < ids[np.searchsorted(wo, s, "right") - 1]
        s, i = s[hit], i[hit]
        for lo in range(0, len(s), 1 << 18):
            t, own = s[lo : lo + (1 << 18)], holder[i[lo : lo + (1 << 18)]]
            t = t[np.all([hashes[t + j] == hashes[own + j] for j in range(window)], axis=0)]
            np.add.at(gone, t, 1)
            np.add.at(gone, t + window, -1)
    out = np.cumsum(gone[:-1]) > 0
    kept, n_words, n_gone = [], np.diff(wo), np.zeros(n, np.int64)
    raw = buf.tobytes()
    for r in range(n):
        a, z = int(wo[r]), int(wo[r + 1])
        stay = np.flatnonzero(~out[a:z]) + a
        n_gone[r] = z - a - len(stay)
        kept.append(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]).decode("utf-8", "replace"))
    return [pa.array(n_words.astype(np.int64)), pa.array(n_gone), pa.array(kept, pa.string())]


def dedup_phrases(docs: DataFrame, window: int = 13, k: int = 5, block_bytes: int = 4 << 20, shard_patterns: int = 60_000) -> DataFrame:
    """docs with ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space).

    Words are runs of bytes other than space and 09-0D. A null text has none. Documents of fewer words
    than the window keep all. A null doc_id sorts last; rows of one doc_id are documents that don't
    count as smaller than each other. Extra columns pass through; new ones give way to existing names.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "phrases")
    n_blocks = max(1, -(-total_bytes(docs) // block_bytes))
    base = docs.select(keyed_ordinal().alias("o"), text_of().alias("t"))
    found = ws.save(shared_anchors(base.mapInArrow(lambda it: _find(it, window, k), ANCHOR_SCHEMA)), "anchors")
    block = lambda o, th: F.pmod(F.xxhash64(o, th), F.lit(n_blocks)).cast("int")
    keyed = base.join(found, "o").select("o", "t", "hs", F.hash("t").alias("th")).withColumn("block", block("o", "th"))
    rows = keyed.mapInArrow(lambda it: _confirm(it, window, k), WINDOWS)
    w = Window.partitionBy("w")
    sure = rows.withColumns({"mn": F.min("lo").over(w), "mx": F.max("hi").over(w)}).where("mn < mx and hi > mn")
    phrases = ws.save(sure.select("block", "w", "mn", "place"), "phrases")
    ws.drop(found)
    o, tt, th, blk, nw, nr, kept = fresh(docs, "ord", "tt", "th", "block", "n_words", "n_removed", "kept")
    full = docs.withColumns({o: keyed_ordinal(), tt: text_of()}).withColumn(th, F.hash(tt)).withColumn(blk, block(o, th))
    new = [T.StructField(nw, T.LongType()), T.StructField(nr, T.LongType()), T.StructField(kept, T.StringType())]
    keep = docs.columns
    schema = T.StructType([*docs.schema.fields, *new])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = _locate(left, right, (tt, o, th), window, shard_patterns)
        return pa.Table.from_arrays([*(left[c] for c in keep), *cols], names=schema.names)

    return full.groupBy(blk).cogroup(phrases.groupBy("block")).applyInArrow(work, schema)
