"""Exact top-k inner products by no-random-access aggregation.

In a block of vectors each dimension is a list sorted by value. A query reads all lists in step, each
from the end where its contribution is largest, and adds up what it reads by vector. What has been read of
a vector, the lists' frontiers and their least values bound its score from above and below. Reading stops
when no vector outside what was read can still be among the k best (the frontiers' sum is under the k-th
lower bound, or under a bound known from a sample) and at most half of the others can (upper bounds); the
scores of those are then resolved in full, from the vectors themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 2.0**52
SAMPLE = 2048


def usable(c):
    """Not null, and without null or non-finite components."""
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(c):
    """floor(1024 x) of each component; beyond +-2^52 it stays there, as an ordinary score would leave 64 bits."""
    big = lambda x: F.floor(F.greatest(F.least(x.cast("double") * 1024, F.lit(LIMIT)), F.lit(-LIMIT)))
    return F.transform(c, lambda x: big(x).cast("long"))


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def products(v: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products, where no component of v is beyond most; of Python integers if 64 bits may not do."""
    return v.astype(object) @ q.astype(object) if most * largest(q) * len(q) >= 2**63 else v @ q


def matrix(column, d: int) -> np.ndarray:
    """Rows of numbers as one matrix of d columns; shorter rows end in zeros, longer ones lose nothing."""
    offs = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.int64)
    lens = np.diff(offs)
    out = np.zeros((len(lens), max(d, int(lens.max()) if len(lens) else 0)), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], lens)] = flat
    return out


class Lists:
    """A block's sorted lists. ``read`` counts the list entries read, ``total`` those of all queries' lists."""

    STEPS = 8

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.n, self.d = v.shape
        self.who = np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(v.T, self.who, 1).astype(float)
        self.most = largest(v)
        self.read = self.total = 0

    def contenders(self, live: np.ndarray, q: np.ndarray, use: np.ndarray, k: int, floor: float) -> np.ndarray:
        """Rows of the block that may be among the k best rows of ``live`` (a mask), by reading the lists of ``use``."""
        n, up = self.n, q > 0
        best, worst = np.where(up, self.sorted[use, -1], self.sorted[use, 0]) * q, np.where(up, self.sorted[use, 0], self.sorted[use, -1]) * q
        least = np.minimum(worst, 0).sum()
        step = max(1, -(-n // self.STEPS))
        part, depth = np.zeros(n), 0
        self.total += n * len(use)
        seen, may = [], live
        while depth < n:
            more = min(step, n - depth)
            for d, x, rising in zip(use.tolist(), q.tolist(), up.tolist(), strict=True):
                at = slice(n - depth - more, n - depth) if rising else slice(depth, depth + more)
                rows = self.who[d, at]
                seen.append((d, rows))
                part[rows] += self.sorted[d, at] * x  # a list holds a row once
            depth += more
            self.read += more * len(use)
            frontier = np.where(up, self.sorted[use, n - depth], self.sorted[use, depth - 1]) * q
            if frontier.sum() >= floor and 2 * depth < n:
                continue  # outsiders may still qualify
            lower = part + least
            bar = max(floor, np.partition(lower[live], -k)[-k])
            if frontier.sum() >= bar:
                continue
            rest = np.full(n, frontier.sum())  # what the lists may still give each row
            front = dict(zip(use.tolist(), frontier.tolist(), strict=True))
            for d, rows in seen:
                rest[rows] -= front[d]
            slack = 1e-9 * (np.abs(best).sum() + np.abs(worst).sum())  # sums of frontiers are of floats
            may = live & (part + rest >= bar - slack)
            if 2 * np.count_nonzero(may) <= n:
                break
        return np.flatnonzero(may)

    def search(self, own: int, q: np.ndarray, k: int, floor: float):
        """(vec_id, score) of the k best, ties to smaller ids; rows of the query's own id take no part."""
        d = min(self.d, len(q))
        q = q[:d]
        use = np.flatnonzero(q != 0)
        q = q[use]
        other = self.ids != own
        live = np.flatnonzero(other)
        if len(live) > 4 * k and len(use) and self.most * largest(q) * len(q) < 2**53:
            live = self.contenders(other, q.astype(float), use, k, floor)
        score = products(self.v[np.ix_(live, use)] if len(use) < self.d else self.v[live], q, self.most)
        keep = score >= floor
        live, score = live[keep], score[keep]
        if score.dtype == object:
            best = sorted(range(len(score)), key=lambda i: (-score[i], self.ids[live[i]]))[:k]
        else:
            if len(score) > 4 * k:
                top = score >= np.partition(score, -k)[-k]
                live, score = live[top], score[top]
            best = np.lexsort((self.ids[live], -score))[:k]
        return self.ids[live[best]], score[best].astype(np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    vectors and queries: vec_id, vec (array<long>). Queries go in blocks of ``block``, so what is sent to
    the executors is bounded. A first look at a bounded sample of vectors gives each query a score that k
    vectors reach; no block returns less. Rows with a query's own vec_id aren't its candidates; a repeated
    vector row is a candidate each time, a repeated query one query. Vectors of unequal length are compared
    as if ended by zeros. A score that is one of the best and leaves 64 bits is an error. Rows with null
    ids take no part. No candidates, no rows. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    base = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vec")
    some = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    s_ids = some["vec_id"].to_numpy()
    out = spark.createDataFrame([], schema)
    held: list[tuple[int, list[int]]] = []

    def blocks():
        for r in queries.where("vec_id is not null").select("vec_id", "vec").distinct().toLocalIterator():
            held.append((r[0], r[1]))
            if len(held) == block:
                yield list(held)
                held.clear()
        if held:
            yield list(held)

    for part in blocks():
        q_ids = np.array([r[0] for r in part], np.int64)
        d = max(len(r[1]) for r in part)
        q = np.zeros((len(part), d), np.int64)
        for i, r in enumerate(part):
            q[i, : len(r[1])] = r[1]
        s = matrix(some["vec"].combine_chunks(), d)[:, :d] if len(s_ids) else np.zeros((0, d), np.int64)
        s_most = largest(s)
        floors = np.full(len(part), -np.inf)
        for i in range(len(part)):
            sc = products(s, q[i], s_most)[s_ids != q_ids[i]]
            if len(sc) >= k:
                least = (np.sort(sc) if sc.dtype == object else np.partition(sc, -k))[-k]
                floors[i] = float(least)
                if floors[i] > int(least):
                    floors[i] = np.nextafter(floors[i], -np.inf)

        def run(batches, q_ids=q_ids, q=q, floors=floors):
            for b in batches:
                if not b.num_rows:
                    continue
                lists = Lists(b.column(0).to_numpy(), matrix(b.column(1), q.shape[1]))
                got = [(i, *lists.search(own, vec, k, f)) for own, vec, f, i in zip(q_ids, q, floors, range(len(q)), strict=True)]
                n = [len(x[1]) for x in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([x[1] for x in got]).astype(np.int64)), pa.array(np.concatenate([x[2] for x in got]).astype(np.int64))], names=["query_id", "vec_id", "score"])

        out = out.union(base.mapInArrow(run, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
