"""Toxicity: a counterfactual-regularised classifier.

A logistic regression over the distinct words of a text and their first five letters (both hashed). It
is trained on a bounded sample of labelled texts. For each training text there is a counterfactual:
identity terms in it swapped for others of their group, or, without any, a neutral mention of one. The
squared change of the score's logit is penalised, so that naming a group moves no score. The threshold is
set by a part of the sample that a second fit leaves out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling as R
from .common import append, column, fresh, row_groups, text_buffer, text_of

#: Identity terms by group; terms of a group stand in for each other.
TERMS = [
    ["women", "men", "girls", "boys", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "musulmans", "chrétiens", "juifs", "muslime", "christen", "juden", "musulmanes", "cristianos", "judíos"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer", "schwul", "lesbisch", "homosexual"],
    ["black", "white", "asian", "latino", "african", "european", "noirs", "blancs", "schwarze", "weiße", "negros", "blancos"],
    ["immigrants", "refugees", "foreigners", "natives", "immigrés", "einwanderer", "inmigrantes"],
    ["deaf", "blind", "disabled", "elderly", "young", "sourds", "aveugles", "taube", "blinde", "sordos", "ciegos"],
]
DIMS = 1 << 18
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row, and their offsets."""
    buf = R.lower(buf)
    starts, ends, wo = R.words(buf, offs)
    for _ in range(4):  # punctuation at the ends of a word
        starts = starts + ((starts < ends - 1) & _EDGE[buf[np.minimum(starts, max(len(buf) - 1, 0))]]) if len(buf) else starts
        ends = ends - ((starts < ends - 1) & _EDGE[buf[ends - 1]]) if len(buf) else ends
    p = R.byte_prefix(buf)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(wo))
    whole = R.mix(R.span(p, starts, ends) + (ends - starts).astype(np.uint64)) >> np.uint64(46)
    stem = R.mix(R.span(p, starts, np.minimum(starts + 5, ends)), 3) >> np.uint64(46)
    long = ends - starts > 5
    key = np.concatenate([row * DIMS + whole.astype(np.int64), row[long] * DIMS + stem[long].astype(np.int64)])
    key = np.unique(key)
    return key % DIMS, np.searchsorted(key // DIMS, np.arange(len(offs)))


def _term_features() -> list[list[np.ndarray]]:
    out = []
    for group in TERMS:
        raw = [t.encode() for t in group]
        f, o = features(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
        out.append([f[o[i] : o[i + 1]] for i in range(len(raw))])
    return out


def counterfactual(x: np.ndarray, i: int, terms) -> np.ndarray:
    """The features of text i after each identity term in it became another of its group."""
    have, gain, lose = set(x.tolist()), [], []
    for group in terms:
        for j, t in enumerate(group):
            if t[0] in have and have.issuperset(t.tolist()):
                lose.append(t)
                gain.append(group[(j + 1 + i % (len(group) - 1)) % len(group)])
    if not lose:
        g = terms[i % len(terms)]
        gain.append(g[(i // len(terms)) % len(g)])
    keep = have - {v for t in lose for v in t.tolist()}
    return np.array(sorted(keep | {v for t in gain for v in t.tolist()}), np.int64)


def fit(rows: list[np.ndarray], y: np.ndarray, penalty: float = 1.0, l2: float = 1e-2, l1: float = 0.2, steps: int = 60, min_rows: int = 5):
    """Weights and bias by full-batch Adam, small weights shrunk to 0 (l1). rows: distinct features of each text."""
    w, bias = np.zeros(DIMS), 0.0
    if len(y) == 0 or y.min() == y.max():
        return w, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.0)))  # without labels nothing is rejected
    terms = _term_features()
    pairs = [counterfactual(x, i, terms) for i, x in enumerate(rows)]
    named = np.unique(np.concatenate([v for g in terms for v in g]))
    df = np.bincount(np.concatenate(rows), minlength=DIMS)
    live = df >= min_rows
    live[named] |= df[named] > 0
    ids = np.flatnonzero(live)
    slot = np.full(DIMS, -1)
    slot[ids] = np.arange(len(ids))

    def csr(xs):
        s = [slot[x] for x in xs]
        s = [v[v >= 0] for v in s]
        return np.concatenate(s) if s else np.zeros(0, int), np.repeat(np.arange(len(s)), [len(v) for v in s])

    (cx, rx), (cp, rp) = csr(rows), csr(pairs)
    n, m = len(y), len(ids)
    rate = y.mean()
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
    v, g1, g2 = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    v[m] = 0.0
    for step in range(1, steps + 1):
        z = np.bincount(rx, v[cx], n) + v[m]
        zp = np.bincount(rp, v[cp], n) + v[m]
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        change = 2 * penalty * (z - zp)
        g = np.append(np.bincount(cx, (err + change)[rx], m) - np.bincount(cp, change[rp], m), err.sum()) / n
        g[:m] += l2 * v[:m]
        g1 = 0.9 * g1 + 0.1 * g
        g2 = 0.999 * g2 + 0.001 * g * g
        v -= 0.1 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-8)
        v[:m] = np.sign(v[:m]) * np.maximum(np.abs(v[:m]) - 0.1 * l1, 0)
    w[ids] = v[:m]
    return w, float(v[m])


def margins(rows: list[np.ndarray], w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[x].sum() for x in rows]) + bias


def threshold(z: np.ndarray, y: np.ndarray, cost: float) -> float:
    """The margin from which on to reject: most recall less ``cost`` times the share of clean rows rejected."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    kept = np.append(0, np.cumsum(y)) / y.sum()
    clean = 1 - np.append(0, np.cumsum(1 - y)) / (1 - y).sum()
    gain = 1 - kept - cost * clean
    edge = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gain[1:-1][z[1:] == z[:-1]] = -np.inf
    best = np.flatnonzero(gain == gain.max())
    return float(edge[best[len(best) // 2]])


def calibrated(rows: list[np.ndarray], y: np.ndarray, cost: float = 4.0, least: int = 25, **options):
    """fit() on all rows, its bias moved by what a fit without three tenths of them says of those.

    With fewer than ``least`` rows of either label in the part left out the bias stays.
    """
    w, bias = fit(rows, y, **options)
    out = R.mix(np.arange(len(y), dtype=np.uint64), 17) % np.uint64(10) < np.uint64(3)
    if min(y[out].sum(), (1 - y[out]).sum()) >= least and 0 < y[~out].sum() < (~out).sum():
        part = fit([x for x, o in zip(rows, out, strict=True) if not o], y[~out], **options)
        bias -= min(0.0, threshold(margins([x for x, o in zip(rows, out, strict=True) if o], *part), y[out], cost))
    return w, bias


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, **options):
    """A model from at most max_rows labelled texts that are not held out (a fixed choice by hash of the id).

    Labels that are null or not 0 or 1, or of null ids or ids without a document, don't count; a label row that
    repeats counts once, an id with both labels or with several documents counts with each. A null text is
    empty, long texts count whole. One task learns, and the driver gets the weights that aren't 0. Without labels, or with one label only, the model is a constant; without labels it rejects nothing. What is
    sent to the executors (``pick``) and learned from has max_rows rows at most per document of an id.
    """
    pick = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    pick = pick.select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    pick = pick.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    some = docs.select("doc_id", text_of().alias("t")).join(F.broadcast(pick), "doc_id").select("doc_id", "y", "t")

    def run(batches):
        for b in batches:
            buf, offs = text_buffer(column(b, "t"))
            for lo, hi in row_groups(offs, 2 << 20):
                f, o = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(f.astype(np.int32)))], names=["doc_id", "y", "f"])

    def learn(batches):
        t = pa.Table.from_batches(batches, schema=pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("f", pa.list_(pa.int32()))]))
        t = t.sort_by([("doc_id", "ascending"), ("y", "ascending")])
        rows = [np.asarray(r.values).astype(np.int64) if len(r) else np.zeros(0, np.int64) for r in t["f"]]
        w, bias = calibrated(rows, t["y"].to_numpy().astype(float), **options)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at, w[at], np.array([bias]))], names=["at", "w", "bias"])

    sample = some.mapInArrow(run, "doc_id long, y int, f array<int>").repartition(1)
    model = sample.mapInArrow(learn, "at binary, w binary, bias binary").first()  # one task learns: the driver needs no memory for it
    w = np.zeros(DIMS)
    if model is None:  # no rows, no task
        return calibrated([], np.zeros(0), **options)
    w[np.frombuffer(model["at"], np.int64)] = np.frombuffer(model["w"])
    return w, float(np.frombuffer(model["bias"])[0])


def score(docs: DataFrame, model) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted``: map only, so no rows, no result.

    A null text scores as an empty one; equal texts score alike, and whole. Extra columns pass through; new
    ones give way to existing names.
    """
    w, bias = model[0].astype(np.float32), model[1]
    t, s, p = fresh(docs, "t", "score", "predicted")

    def run(b):
        buf, offs = text_buffer(column(b, t))
        out = np.full(b.num_rows, bias)
        for lo, hi in row_groups(offs, 2 << 20):
            f, o = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            c = np.append(0.0, np.cumsum(w[f], dtype=np.float64))
            out[lo:hi] += c[o[1:]] - c[o[:-1]]
        z = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        return [pa.array(z), pa.array((z >= 0.5).astype(np.int32))]

    return append(docs.withColumn(t, text_of()), run, [T.StructField(s, T.DoubleType()), T.StructField(p, T.IntegerType())]).drop(t)
