"""Benchmark decontamination: size-partitioned MinHash containment search.

Containment of an item of q shingles in a text of u is bound to a Jaccard similarity only if u is
bounded, so both sides are partitioned by size. Items are grouped by size up to Q (powers of two). For
each group a document is read as pieces of 4Q shingles that overlap by Q, so that an item of the group
lies whole in one; pieces are partitioned by their size up to u (powers of two). For a partition the
threshold t becomes the similarity j = t q / (q + u - t q), and ceil(ln(1 - recall) / ln(1 - j)) bands
of one MinHash each find an item with that probability. Items of up to 16 shingles are looked up by
their shingles themselves. Each candidate's exact shingle containment in the whole document decides.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling as R
from . import shingles as S
from .common import append, fresh, text_of

SMALL = 16


def bands(q: int, u: int, t: float, recall: float) -> int:
    j = t * q / (q + u - t * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - j))


class Index:
    """A block of items: their shingle sets, and per size group and band the MinHash values."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, recall: float, n: int):
        self.threshold, self.recall, self.n = threshold, recall, n
        batch = pa.RecordBatch.from_arrays([pa.array([t or "" for _, t in items], pa.string())], names=["t"])
        self.sets, self.ids = [], [i for i, _ in items]
        for _, h, so in S.sequences(batch, "t", n):
            h, so = S.distinct(h, so)
            self.sets += [h[so[i] : so[i + 1]] for i in range(len(so) - 1)]
        self.groups = defaultdict(list)
        small = []
        for i, s in enumerate(self.sets):
            if 0 < len(s) <= SMALL:
                small.append(i)
            elif len(s):
                self.groups[1 << (len(s) - 1).bit_length()].append(i)
        flat = np.concatenate([self.sets[i] for i in small]) if small else np.zeros(0, np.uint64)
        own = np.repeat(np.array(small, np.int64), [len(self.sets[i]) for i in small]) if small else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.small = flat[order], own[order]
        self.bands = {}
        for q, members in self.groups.items():
            flat = np.concatenate([self.sets[i] for i in members])
            at = np.append(0, np.cumsum([len(self.sets[i]) for i in members]))[:-1]
            for k in range(bands(q // 2 + 1, 4 * q, threshold, recall)):
                v = np.minimum.reduceat(permute(flat, k), at)
                order = np.argsort(v, kind="stable")
                self.bands[q, k] = v[order], np.array(members)[order]

    def _match(self, keys, owners, values, docs):
        """Pairs (doc, item) where a doc's value is among the keys."""
        a, z = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        hit = np.flatnonzero(z > a)
        n = (z - a)[hit]
        return np.repeat(docs[hit], n), owners[R.ragged(a[hit], n)]

    def candidates(self, h: np.ndarray, so: np.ndarray) -> np.ndarray:
        """Distinct pairs (row, item) that the bands propose."""
        found = []
        size = np.diff(so)
        row = np.repeat(np.arange(len(size)), size)
        if len(self.small[0]) and len(h):
            found.append(self._match(*self.small, h, row))
        for q in self.groups:
            step, width = 3 * q, 4 * q
            count = np.where(size > 0, np.maximum(1, -(-(size - q) // step)), 0)
            r = np.repeat(np.arange(len(size)), count)
            i = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            begin = so[r] + i * step
            length = np.minimum(width, so[r + 1] - begin)
            u = np.maximum(1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64), 1)
            for part in np.unique(u):
                p = np.flatnonzero(u == part)
                lo = q // 2 + 1
                if part < self.threshold * lo:
                    continue
                k_most = min(bands(lo, max(int(part), lo), self.threshold, self.recall), bands(lo, 4 * q, self.threshold, self.recall))
                flat = h[R.ragged(begin[p], length[p])]
                at = np.append(0, np.cumsum(length[p]))[:-1]
                for k in range(k_most):
                    keys, owners = self.bands[q, k]
                    found.append(self._match(keys, owners, np.minimum.reduceat(permute(flat, k), at), r[p]))
        if not found:
            return np.zeros((0, 2), np.int64)
        pairs = np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], 1)
        return np.unique(pairs, axis=0)

    def search(self, h, so):
        """(row, item, shared shingles) with shared >= threshold * size, exactly."""
        out = []
        sets = {}
        for r, i in self.candidates(h, so).tolist():
            if r not in sets:
                sets[r] = np.unique(h[so[r] : so[r + 1]])
            doc, item = sets[r], self.sets[i]
            shared = int((doc[np.minimum(np.searchsorted(doc, item), len(doc) - 1)] == item).sum())
            if shared >= self.threshold * len(item) - 1e-9:
                out.append((r, i, shared))
        return out


def permute(h: np.ndarray, k: int) -> np.ndarray:
    a = (0x9E3779B97F4A7C15 * (2 * k + 3)) % 2**64 | 1
    x = h * np.uint64(a)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def indexes(benchmark: DataFrame, threshold: float, recall: float, n: int, block: int):
    """Indexes of at most ``block`` items each, so that what is sent to the executors is bounded."""
    items = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), text_of().alias("t")).toLocalIterator():
        items.append((r.i, r.t))
        if len(items) == block:
            yield Index(items, threshold, recall, n)
            items = []
    if items:
        yield Index(items, threshold, recall, n)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, recall: float = 0.999, n: int = 5, block: int = 20_000) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): items held to the threshold or more.

    One pass over the documents for each block of items; no shuffle. Null or empty texts on either side
    match nothing. Null ids pass through as null. Repeated rows and items match each on its own, so there are
    no ties. Texts are read whole, however long; an item may also lie scattered over a document, as its
    containment in the whole text decides, but only one that lies in a piece is promised ``recall``. Without
    documents or items there are no rows. Other columns are ignored.
    """
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    out = docs.sparkSession.createDataFrame([], schema)
    for ix in indexes(benchmark, threshold, recall, n, block):

        def run(batches, ix=ix):
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(ids[lo + r], ix.ids[i], len(ix.sets[i]), s) for lo, h, so in S.sequences(b, "t", n) for r, i, s in ix.search(h, so)]
                if rows:
                    d, i, q, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(q, pa.int64()), pa.array(s, pa.int64()), pa.array([a / b for a, b in zip(s, q, strict=True)], pa.float64())], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        out = out.union(base.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, recall: float = 0.999, n: int = 5, block: int = 20_000) -> DataFrame:
    """docs without the rows that hold a benchmark item; map only, all columns as they were.

    Null and empty texts stay, repeated rows stay or go alike, no items leave all. Helper columns give way.
    """
    out = docs
    for ix in indexes(benchmark, threshold, recall, n, block):
        t, hits = fresh(out, "t", "hits")

        def count(b, ix=ix, t=t):
            c = np.zeros(b.num_rows, np.int64)
            for lo, h, so in S.sequences(b, t, n):
                for r, _, _ in ix.search(h, so):
                    c[lo + r] += 1
            return [pa.array(c)]

        out = append(out.withColumn(t, text_of()), count, [T.StructField(hits, T.LongType())]).where(F.col(hits) == 0).drop(t, hits)
    return out
