"""SentencePiece encoding and decoding with the n best segmentations.

The lattice has a node per byte and an arc per vocabulary piece (scored as in the model file), and byte
pieces at ten below the lowest score. Pieces never cross the start of a word, so a text is a chain of
segments: a run of spaces with the word after it, or a line feed. Forward Viterbi scores are computed for
all distinct segments of a chunk side by side; with backward scores they tell how much a segment's second
best costs. The n best of a text differ from its best in at most n - 1 segments, which may be taken to be
those of least such cost. Over their lattice a backward A* search runs with the forward scores as exact
heuristics: complete paths come off the heap in order of score.

As in the library, a space is put before a text, U+2581 reads as a space, and nothing else is changed.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling as R
from .common import append, column, fresh, row_groups, text_buffer, text_of

CHUNK = 1 << 19
WIDE = 64
SLOTS = 1 << 20


class Pieces:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        self.lookup: dict[bytes, tuple[float, int]] = {}
        for i in range(n):
            if sp.is_byte(i):
                v = int(sp.id_to_piece(i)[3:-1], 16)
                self.bytes[i], self.byte_ids[v] = bytes([v]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                b = sp.id_to_piece(i).replace("▁", " ").encode()
                if b" " in b.lstrip(b" ") or b"\n" in b:
                    raise ValueError("a piece of this model crosses the start of a word")
                self.bytes[i] = b
                self.lookup[b] = (sp.get_score(i), i)
        self.unknown = min(s for s, _ in self.lookup.values() if s > -1e8) - 10.0
        self.most = max(map(len, self.lookup))
        self.lengths = sorted({len(k) for k in self.lookup} | {1}, reverse=True)
        keys = list(self.lookup)
        buf = np.frombuffer(b"".join(keys), np.uint8)
        e = np.cumsum([len(k) for k in keys])
        s = e - np.array([len(k) for k in keys])
        h = R.mix(R.span(R.byte_prefix(buf), s, e) + (e - s).astype(np.uint64))
        self.key = np.zeros(SLOTS, np.uint64)
        self.val = np.zeros(SLOTS, np.int32)
        rest = {}
        for hv, k in zip(h.tolist(), keys, strict=True):
            i = hv >> 44
            if self.key[i] == 0:
                self.key[i], self.val[i] = hv, self.lookup[k][1]
            else:
                rest[hv] = self.lookup[k][1]
        self.rest = np.array(sorted(rest), np.uint64), np.array([rest[x] for x in sorted(rest)], np.int32)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.scores = np.full(n, self.unknown)
        for s_, i in self.lookup.values():
            self.scores[i] = s_

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashed byte strings; -1 for none."""
        i = (h >> np.uint64(44)).astype(np.int64)
        k = self.key[i]
        out = np.where(k == h, self.val[i], -1)
        odd = np.flatnonzero((k != h) & (k != 0))
        if len(odd) and len(self.rest[0]):
            j = np.minimum(np.searchsorted(self.rest[0], h[odd]), len(self.rest[0]) - 1)
            hit = self.rest[0][j] == h[odd]
            out[odd[hit]] = self.rest[1][j[hit]]
        return out

    def arcs(self, seg: bytes):
        """Arcs into each node: lists of (start, score, id)."""
        into = [[] for _ in range(len(seg) + 1)]
        for j in range(1, len(seg) + 1):
            for i in range(max(0, j - self.most), j):
                hit = self.lookup.get(seg[i:j])
                if hit:
                    into[j].append((i, *hit))
            if not into[j] or into[j][-1][0] != j - 1:
                into[j].append((j - 1, self.unknown, int(self.byte_ids[seg[j - 1]])))
        return into

    def viterbi(self, into):
        """Forward scores by plain dynamic programming, and the best ids."""
        f, back = [0.0] + [-np.inf] * (len(into) - 1), [None] * len(into)
        for j in range(1, len(into)):
            for i, s, k in into[j]:
                if f[i] + s > f[j]:
                    f[j], back[j] = f[i] + s, (i, k)
        ids, j = [], len(into) - 1
        while j:
            j, k = back[j]
            ids.append(k)
        return f, ids[::-1]

    def nbest(self, segs: list[bytes], n: int) -> list[tuple[float, list[list[int]]]]:
        """The n best of a chain of segments: score and ids by segment. Backward A*, forward scores ahead."""
        into, f, owner = [[]], [0.0], [0]
        for k, seg in enumerate(segs):
            base = len(into) - 1
            own = self.arcs(seg)
            fk, _ = self.viterbi(own)
            into += [[(i + base, s, p) for i, s, p in x] for x in own[1:]]
            top = f[base]
            f += [top + x for x in fk[1:]]
            owner += [k] * len(seg)
        heap, tick, out = [(-f[-1], 0, 0, len(f) - 1, 0.0, None)], 0, []
        while heap and len(out) < n:
            _, _, _, j, g, path = heapq.heappop(heap)
            if j == 0:
                ids = [[] for _ in segs]
                while path:
                    (k, p), path = path
                    ids[k].append(p)
                out.append((g, ids))
                continue
            for i, s, p in into[j]:
                tick += 1
                heapq.heappush(heap, (-(g + s + f[i]), i, tick, i, g + s, ((owner[j], p), path)))
        return out

    def segments(self, buf: np.ndarray, offs: np.ndarray):
        """Bytes with the leading space, segment starts, and offsets of each row's segments."""
        lens = np.diff(offs)
        full = lens > 0
        new = np.insert(buf, offs[:-1][full], 0x20)
        no = np.append(0, np.cumsum(lens + full))
        edge = np.zeros(len(new) + 1, bool)
        edge[no] = True
        sp, nl = new == 0x20, new == 0x0A
        start = nl.copy()
        start[1:] |= nl[:-1] | (sp[1:] & ~sp[:-1])
        start |= edge[:-1]
        at = np.flatnonzero(start)
        return new, at, np.searchsorted(at, no)

    def encode_segments(self, buf, starts, ends):
        """For distinct segments: ids end to end, their offsets, the best score and the second best's cost."""
        n = len(starts)
        lens = ends - starts
        order = np.argsort(-lens, kind="stable")
        best, cost = np.zeros(n), np.full(n, np.inf)
        count, long = np.zeros(n, np.int64), {}
        wide = int((lens > WIDE).sum())
        for u in order[:wide].tolist():
            seg = buf[starts[u] : ends[u]].tobytes()
            into = self.arcs(seg)
            f, got = self.viterbi(into)
            long[u], count[u] = got, len(got)
            best[u] = f[-1]
            b = [-np.inf] * (len(f) - 1) + [0.0]
            second = -np.inf
            on, j = set(), 0
            for p in got:
                on.add((j, j + len(self.bytes[p])))
                j += len(self.bytes[p])
            for j in range(len(f) - 1, 0, -1):
                for i, s, _ in into[j]:
                    b[i] = max(b[i], s + b[j])
                    if (i, j) not in on:
                        second = max(second, f[i] + s + b[j])
            cost[u] = f[-1] - second
        order = order[wide:]
        m = len(order)
        if m:
            s, length = starts[order], lens[order]
            p = R.byte_prefix(buf)
            top = int(length[0])
            # place j of the k-th longest segment is at base[j] + k: only places that segments have take room
            c = np.searchsorted(-length, -np.arange(top + 2), "right")
            base = np.append(0, np.cumsum(c))
            f = np.full(base[-1], -np.inf)
            f[:m] = 0.0
            back = np.zeros(len(f), np.int32)
            size = np.zeros(len(f), np.int8)
            inv = R.inverse(len(p))
            heads = [p[s]]
            downs = [inv[s]]
            arcs = []
            for j in range(1, top + 1):
                n_j = int(c[j])
                heads.append(p[s[:n_j] + j])
                downs.append(inv[s[:n_j] + j])
                own = self.byte_ids[buf[s[:n_j] + j - 1]]
                fj, bj, sj = (x[base[j] : base[j] + n_j] for x in (f, back, size))
                for l in self.lengths:
                    if l > j:
                        continue
                    i = j - l
                    got = self.find(R.mix((heads[j] - heads[i][:n_j]) * downs[i][:n_j] + np.uint64(l)))
                    fi = f[base[i] : base[i] + n_j]
                    if l == 1:
                        own = np.where(got >= 0, got, own)
                        at, pid, w = None, own, self.scores[own]
                        v = fi + w
                        a = np.flatnonzero(v > fj)
                        fj[a], bj[a], sj[a] = v[a], pid[a], l
                    else:
                        at = np.flatnonzero(got >= 0)
                        if not len(at):
                            continue
                        pid = got[at]
                        w = self.scores[pid]
                        v = fi[at] + w
                        up = v > fj[at]
                        a = at[up]
                        fj[a], bj[a], sj[a] = v[up], pid[up], l
                    arcs.append((i, j, at, w))
            b = np.full(len(f), -np.inf)
            b[base[length] + np.arange(m)] = 0.0
            on = np.zeros(len(f), bool)
            j = length.copy()
            path, who = [], []
            live = np.arange(m)
            while len(live):
                x = base[j[live]] + live
                on[x] = True
                path.append(back[x])
                who.append(live)
                j[live] -= size[x]
                live = live[j[live] > 0]
            second = np.full(m, -np.inf)
            for i, j, at, w in sorted(arcs, key=lambda x: -x[0]):
                at = np.arange(c[j]) if at is None else at
                v = w + b[base[j] + at]
                b[base[i] + at] = np.maximum(b[base[i] + at], v)
                off = ~(on[base[j] + at] & (size[base[j] + at] == j - i))
                second[at[off]] = np.maximum(second[at[off]], f[base[i] + at[off]] + v[off])
            total = f[base[length] + np.arange(m)]
            best[order], cost[order] = total, total - second
            path, who = np.concatenate(path[::-1]), np.concatenate(who[::-1])
            own = np.bincount(who, minlength=m)
            count[order] = own
        offs = np.append(0, np.cumsum(count))
        flat = np.zeros(offs[-1], np.int32)
        for u, x in long.items():
            flat[offs[u] : offs[u + 1]] = x
        if m:
            flat[R.ragged(offs[order], own)] = path[np.argsort(who, kind="stable")]
        return flat, offs, best, cost

    def encode(self, buf, offs, n):
        """For each row: best ids, scores of the n best, and for the others their segments that differ."""
        new, at, so = self.segments(buf, offs)
        ends = np.append(at[1:], len(new)) if len(at) else at
        h = R.mix(R.span(R.byte_prefix(new), at, ends) + (ends - at).astype(np.uint64))
        _, first, inv = np.unique(h, return_index=True, return_inverse=True)
        flat, fo, best, cost = self.encode_segments(new, at[first], ends[first])
        count = np.diff(fo)
        for r in range(len(offs) - 1):
            a, z = int(so[r]), int(so[r + 1])
            u = inv[a:z]
            c = count[u]
            ids = flat[R.ragged(fo[u], c)]
            total = float(best[u].sum())
            scores, others = [total], []
            if n > 1 and z > a:
                w = cost[u]
                pick = np.arange(len(u)) if len(u) < n else np.sort(np.lexsort((np.arange(len(u)), w))[: n - 1])
                where = np.append(0, np.cumsum(c))
                segs = [new[at[a + i] : ends[a + i]].tobytes() for i in pick.tolist()]
                base = total - float(best[u[pick]].sum())
                for score, got in self.nbest(segs, n)[1:]:
                    scores.append(base + score)
                    others.append([(int(where[i]), int(c[i]), x) for i, x in zip(pick.tolist(), got, strict=True) if x != ids[where[i] : where[i + 1]].tolist()])
            yield ids, scores, others

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])[1:]

    def decode_rows(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        """The texts of rows of ids that lie end to end."""
        at = np.append(0, np.cumsum(self.size[ids]))[offs]
        raw = self.flat[R.ragged(self.start[ids], self.size[ids])]
        stay = np.ones(len(raw), bool)
        stay[at[:-1][np.diff(at) > 0]] = False  # the space put before a text
        ends = np.append(0, np.cumsum(np.diff(at) - (np.diff(at) > 0))).astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), len(offs) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[stay].tobytes())])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that no text has may give other bytes
            out = pa.array([self.decode(ids[a:z]).decode("utf-8", "replace") for a, z in zip(offs[:-1], offs[1:], strict=True)], pa.string())
        return out


@functools.lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def vocabulary(path: str | None = None) -> bytes:
    """The model file: path, or the public one that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, n_best: int = 4) -> DataFrame:
    """docs with ``ids``, ``scores`` (of the n best, descending; fewer if there are no more) and ``others``.

    ``others[i]`` turns the best into the (i + 2)th: at each ``at`` take ``ids`` in place of ``len`` ids.
    Map only; the model file (under 1 MB) goes with the code. Null and empty texts have no ids and score 0.
    Of equal scores any order may come. Repeated rows are encoded each. Rows leave in groups of about CHUNK
    bytes of text, so that memory is bounded by that or by the longest text, whose lattice is made whole by
    segments. Extra columns pass through; new ones give way to existing names.
    """
    t, ids, scores, others = fresh(docs, "t", "ids", "scores", "others")
    edit = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    kind = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def run(b):
        m = pieces(model)
        buf, offs = text_buffer(column(b, t))
        a, s, o = [], [], []
        for x, y, z in m.encode(buf, offs, n_best):
            a.append(x)
            s.append(y)
            o.append([[{"at": p, "len": q, "ids": v} for p, q, v in e] for e in z])
        io = np.append(0, np.cumsum([len(x) for x in a])).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(io), pa.array(np.concatenate(a), pa.int32())), pa.array(s, pa.list_(pa.float64())), pa.array(o, kind)]

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(scores, T.ArrayType(T.DoubleType())), T.StructField(others, T.ArrayType(T.ArrayType(edit)))]
    return append(docs.withColumn(t, F.replace(text_of(), F.lit("▁"), F.lit(" "))), run, fields, by=t, limit=CHUNK).drop(t)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """encoded with ``decoded``, the text of the ids; null ids decode to an empty text, in groups of rows as above."""
    (d,) = fresh(encoded, "decoded")

    def run(b):
        lists = column(b, ids)
        offs = np.append(0, np.cumsum(np.where(np.asarray(lists.is_valid()), lists.value_lengths().fill_null(0), 0)))
        return [pieces(model).decode_rows(np.asarray(lists.flatten()).astype(np.int64), offs)]

    return append(encoded, run, [T.StructField(d, T.StringType())], by=ids, limit=CHUNK)
