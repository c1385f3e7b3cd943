"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

Documents of equal shingle sets are one class. Tokens (shingles) have one global order, rarer first by
a fixed-size sketch of their counts. If two sets have Jaccard t or more, then for any l the prefixes of
n - ceil(t n) + l tokens share at least l tokens. Each class picks the l of least estimated cost (tokens
to scan plus candidates to verify, from the sketch); a pair must share min(l, l') tokens in the prefixes
for that level before its whole sets are compared.

Only components are asked for, so links inside one needn't all be found. Round 1 verifies each class
against pivots of its postings, which joins groups of near copies in linear work. What is left are pairs
of classes in different components, and all that can still be links are found:

* A class whose postings would give more candidates than it has tokens is dense. Dense classes get their
  prefixes anew, over whole sets: the tokens that no other component holds come first and need no
  posting, the others follow by their exact counts, and the prefix is lengthened by LONGER tokens. A pair
  is formed at its first common token only, and only if the tokens shared in the prefixes and those
  behind them can still make up the similarity. Another round of pivots comes before this join.
* All other pairs must pass the multi-match test of the first prefixes. A posting's pairs inside its
  largest component are not formed at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import LAST, Workspace, column, fresh, ordinal, row_groups, sizes, text_of
from .rolling import mix

BUCKETS = 1 << 16
LEVELS = 8
VERIFY = 20.0
LONGER = 32
PAIRS = 4 << 20
#: Orders of the class ids, by exclusive or, in which a posting's first class is a pivot; SECOND for dense classes.
ORDERS = [0, 0x5555555555555555, -0x5555555555555556, -1]
SECOND = [0x3333333333333333, 0x6666666666666666, -0x3333333333333334, -0x6666666666666667]
PIVOTS = 4


def _facts(batches, n):
    counts = np.zeros(BUCKETS, np.int64)
    names = ["o", "th", "nid", "n", "bucket", "cnt"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    for b in batches:
        ids, th = column(b, "o").to_numpy(), column(b, "th").to_numpy()
        for lo, h, so in S.sequences(b, "t", n):
            h, so = S.distinct(h, so)
            counts += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
            m = len(so) - 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + m]), pa.array(th[lo : lo + m]), pa.array(set_ids(h, so).view(np.int64)), pa.array(np.diff(so)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=names)
    at = np.flatnonzero(counts)
    z = len(at)
    yield pa.RecordBatch.from_arrays([*(pa.nulls(z, k) for k in kinds[:4]), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=names)


def set_ids(h: np.ndarray, so: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set."""
    p = np.append(np.uint64(0), np.cumsum(mix(h, 9)))
    q = np.append(np.uint64(0), np.cumsum(mix(h, 11)))
    return mix((p[so[1:]] - p[so[:-1]]) ^ mix(q[so[1:]] - q[so[:-1]], 5))


def _prefixes(batches, n, t_num, t_den, sketch):
    """Tokens of prefixes. A hash's upper bits are replaced by their rank, rarer first: one sort gives the order of tokens."""
    base = max(1.0, float(sketch.mean()))
    by_rank = np.argsort(sketch, kind="stable").astype(np.uint64)
    rank = np.empty(BUCKETS, np.uint64)
    rank[by_rank.astype(np.int64)] = np.arange(BUCKETS, dtype=np.uint64)
    top, low = np.uint64(48), np.uint64((1 << 48) - 1)
    counts = sketch[by_rank.astype(np.int64)]
    for b in batches:
        seen = set()
        for _, h, so in S.sequences(b, "t", n):
            h, so = S.distinct((rank[(h >> top).astype(np.int64)] << top) | (h & low), so)
            size = np.diff(so)
            at = (h >> top).astype(np.int64)
            ids = set_ids((by_rank[at] << top) | (h & low), so)
            keep = np.array([s > 0 and not (i in seen or seen.add(i)) for i, s in zip(ids.tolist(), size.tolist(), strict=True)], bool)
            cost = np.append(0.0, np.cumsum(np.maximum(counts[at] - base, 1.0)))
            need = -(-t_num * size // t_den)
            one = size - need + 1
            best, level = np.full(len(size), np.inf), np.ones(len(size), np.int64)
            for l in range(1, LEVELS + 1):
                end = so[:-1] + np.minimum(one + l - 1, size)
                c = (cost[end] - cost[so[:-1]]) * (1 + VERIFY / l)
                better = (c < best) & (l <= np.maximum(need, 1))
                best, level = np.where(better, c, best), np.where(better, l, level)
            r = np.flatnonzero(keep)
            if not len(r):
                continue
            count = np.minimum(one + level - 1, size)[r]
            at = np.repeat(so[r], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rr = np.repeat(r, count)
            lev = np.maximum(1, at - so[rr] - one[rr] + 2)
            cols = (h[at].view(np.int64), ids[rr].view(np.int64), size[rr].astype(np.int32), lev.astype(np.int32), level[rr].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["tok", "nid", "n", "lev", "ell"])


def _overlaps(batches, n):
    """For pairs of texts the sizes of their shingle sets and of the sets' intersection. Texts are each read once for PAIRS bytes of pairs."""
    for b in (x.slice(lo, hi - lo) for x in batches for lo, hi in row_groups(sizes(column(x, "x")) + sizes(column(x, "y")), PAIRS)):
        x, y = column(b, "a").to_numpy(), column(b, "b").to_numpy()
        if not len(x):
            continue
        ids, first, code = np.unique(np.concatenate([y, x]), return_index=True, return_inverse=True)
        sets, at = [], np.empty(len(ids), np.int64)
        for name, mine in (("y", np.flatnonzero(first < len(y))), ("x", np.flatnonzero(first >= len(y)))):
            if not len(mine):
                continue
            at[mine] = len(sets) + np.arange(len(mine))
            rows = first[mine] - (len(y) if name == "x" else 0)
            texts = pa.RecordBatch.from_arrays([column(b, name).take(pa.array(rows))], names=["t"])
            for _, h, so in S.sequences(texts, "t", n):
                h, so = S.distinct(h, so)
                sets += np.split(h, so[1:-1])
        size = np.array([len(s) for s in sets])
        kinds, tokens = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(tokens, np.cumsum(size)[:-1])
        code = at[code]
        cy, cx = code[: len(y)], code[len(y) :]
        mark, both, last = np.zeros(len(kinds), bool), np.zeros(len(x), np.int64), -1
        for i in np.argsort(cy, kind="stable").tolist():
            if cy[i] != last:
                if last >= 0:
                    mark[sets[last]] = False
                last = cy[i]
                mark[sets[last]] = True
            both[i] = np.count_nonzero(mark[sets[cx[i]]])
        yield pa.RecordBatch.from_arrays([column(b, "a"), column(b, "b"), pa.array(both), pa.array(size[cx] + size[cy])], names=["a", "b", "i", "s"])


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that the links (a, b) reach, by alternating large and small stars.

    Each round is written; no link is ever collected. Nodes without links don't appear.
    """
    e = ws.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = state(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        new = ws.save(small, "links")
        ws.drop(e)
        e, was, now = new, now, state(new)
        if now == was:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def stars(comp: DataFrame) -> DataFrame:
    """Links (a, b) of the same components, from each node to the smallest: components() of them and a few more ends soon."""
    return comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).where("a > b")


def verified(ws: Workspace, pairs: DataFrame, texts: DataFrame, n: int, t_num: int, t_den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have that Jaccard similarity."""
    one = pairs.join(texts.select(F.col("nid").alias("a"), F.col("t").alias("x")), "a")
    two = one.join(texts.select(F.col("nid").alias("b"), F.col("t").alias("y")), "b").select("a", "b", "x", "y")
    both = two.mapInArrow(lambda it: _overlaps(it, n), "a long, b long, i long, s long")
    return both.where(F.col("i") * t_den >= t_num * (F.col("s") - F.col("i"))).select("a", "b")


def labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with the component of their class; one without links is its own."""
    return rows.join(comp.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))


def best_pivots(near: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, once each: for each class the pivots with which it shares the most tokens."""
    rank = F.row_number().over(Window.partitionBy("nid").orderBy(F.desc("c"), "p"))
    some = near.withColumn("r", rank).where(F.col("r") <= PIVOTS)
    return some.select(F.greatest("nid", "p").alias("a"), F.least("nid", "p").alias("b")).distinct()


def _whole(batches, n):
    """All shingles of texts of classes: (nid, n, comp, tok)."""
    names = ["nid", "n", "comp", "tok"]
    for b in batches:
        cols = [column(b, c).to_numpy() for c in names[:3]]
        for lo, h, so in S.sequences(b, "t", n):
            h, so = S.distinct(h, so)
            row = np.repeat(np.arange(lo, lo + len(so) - 1), np.diff(so))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[row]) for c in cols), pa.array(h.view(np.int64))], names=names)


def dense_links(ws: Workspace, dense: DataFrame, texts: DataFrame, links: DataFrame, similar, n: int, t_num: int, t_den: int) -> DataFrame:
    """Links of the components of links and of those between dense classes (nid, n, comp) of different ones, by prefixes of whole sets."""
    whole = dense.join(texts, "nid").mapInArrow(lambda it: _whole(it, n), "nid long, n int, comp long, tok long")
    whole = ws.save(whole, "whole")
    held = whole.groupBy("tok").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    low = F.col("tok").bitwiseAND(F.lit((1 << 47) - 1))
    key = F.shiftleft(F.least(F.col("df"), F.lit(32767)), 47).bitwiseOR(low)  # rarer first; ties by hash
    sets = whole.join(held.select("tok", "df"), "tok").groupBy("nid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(key)).alias("set"))
    m = F.size("set")
    # the class's other n - m tokens stand before these in the order and are in no pair
    one = m - F.ceil(F.col("n") * t_num / F.lit(t_den)).cast("int") + 1
    info = sets.select("nid", "n", m.alias("m"), one.alias("one"), F.slice("set", 1, F.least(m, one + LONGER)).alias("pre")).where("one > 0")
    info = ws.save(info, "dense-prefixes")
    ws.drop(whole)
    post = info.select("*", F.explode(F.slice("pre", F.lit(1), F.col("one"))).alias("tok"))
    both = lambda x, y: F.array_intersect(f"{x}pre", f"{y}pre")

    def able(x, y):
        """What is shared in the prefixes, and behind the one that ends first, makes the similarity possible."""
        fit = (F.col(f"{x}n") * t_den >= F.col(f"{y}n") * t_num) & (F.col(f"{y}n") * t_den >= F.col(f"{x}n") * t_num)
        need = (F.col(f"{x}n") + F.col(f"{y}n")) * t_num
        last = [F.element_at(f"{z}pre", -1) for z in (x, y)]
        rest = [F.col(f"{z}m") - F.size(f"{z}pre") for z in (x, y)]
        behind = F.when(last[0] < last[1], rest[0]).when(last[0] > last[1], rest[1]).otherwise(F.least(*rest))
        small = F.least(f"{x}m", f"{y}m") * (t_num + t_den) >= need
        return fit & small & ((F.size(both(x, y)) + behind) * (t_num + t_den) >= need)

    def renamed(df, x, *names):
        return df.select(*(F.col(c).alias(f"{x}{c}") for c in ("nid", "n", "m", "pre", *names)))

    comp = ws.save(components(ws, links), "components")
    lab = labelled(post.select("tok", "nid"), comp)
    firsts = lab.groupBy("tok").agg(*(F.min(F.struct(F.col("nid").bitwiseXOR(F.lit(x)), "nid", "comp")).alias(f"p{i}") for i, x in enumerate(SECOND)))
    firsts = firsts.select(F.col("tok"), F.array_distinct(F.array(*(F.struct(f"p{i}.nid", f"p{i}.comp") for i in range(len(SECOND))))).alias("ps"))
    near = lab.join(firsts, "tok").select("nid", "comp", F.explode("ps").alias("q")).where("comp <> q.comp").select("nid", F.col("q.nid").alias("p")).distinct()
    near = near.join(renamed(info, "x_"), F.col("nid") == F.col("x_nid")).join(renamed(info, "y_"), F.col("p") == F.col("y_nid")).where(able("x_", "y_"))
    found = ws.save(similar(best_pivots(near.select("nid", "p", F.size(both("x_", "y_")).alias("c")))), "verified")
    links = stars(comp).union(found)

    comp = ws.save(components(ws, links), "components")
    own = labelled(post, comp)
    per = own.groupBy("tok", "comp").agg(F.count("*").alias("c"))
    mixed = per.groupBy("tok").agg(F.max(F.struct("c", "comp"))["comp"].alias("most"), F.count("*").alias("k")).where("k > 1").select("tok", "most")
    live = ws.save(own.join(mixed, "tok"), "dense-live")
    left = renamed(live.where("comp <> most"), "l_", "comp", "tok")
    live = renamed(live, "", "comp", "tok", "most")
    ok = (F.col("l_comp") != F.col("comp")) & ((F.col("comp") == F.col("most")) | (F.col("l_nid") < F.col("nid")))
    cand = left.join(live, (F.col("l_tok") == F.col("tok")) & ok & able("l_", "") & (F.element_at(both("l_", ""), 1) == F.col("tok")))
    cand = ws.save(cand.select(F.greatest("l_nid", "nid").alias("a"), F.least("l_nid", "nid").alias("b")).distinct(), "candidates")
    return stars(comp).union(ws.save(similar(cand), "verified"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """(o, th, doc_n, component, comp) per row of docs: o the id to compare by, th the text's hash, comp the group.

    Null and empty texts, and texts of white space, have no shingles and stand alone. A null doc_id
    sorts last. Rows with one doc_id and other texts are linked by their texts only.
    """
    t_num, t_den = similarity
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram-join")
    base = docs.select(ordinal().alias("o"), text_of().alias("t")).withColumn("th", F.xxhash64("t"))
    facts = ws.save(base.mapInArrow(lambda it: _facts(it, shingle), "o long, th long, nid long, n long, bucket int, cnt long"), "facts")
    sketch = np.zeros(BUCKETS)
    for r in facts.where("bucket is not null").groupBy("bucket").agg(F.sum("cnt").alias("c")).collect():  # BUCKETS rows at most
        sketch[r.bucket] = r.c
    meta = facts.where("bucket is null").select("o", "th", "nid", "n")
    reps = meta.where("n > 0").groupBy("nid").agg(F.min(F.struct("o", "th")).alias("r")).select("nid", F.col("r.o").alias("o"), F.col("r.th").alias("th"))

    rows = base.mapInArrow(lambda it: _prefixes(it, shingle, t_num, t_den, sketch), "tok long, nid long, n int, lev int, ell int")
    raw = ws.save(rows, "prefixes")
    firsts = raw.groupBy("tok").agg(*(F.min(F.col("nid").bitwiseXOR(F.lit(x))).alias(f"p{i}") for i, x in enumerate(ORDERS)))
    ends = [F.col(f"p{i}").bitwiseXOR(F.lit(x)) for i, x in enumerate(ORDERS)]
    several = firsts.select("tok", F.array_distinct(F.array(*ends)).alias("pivots"), ends[0].alias("x"), ends[-1].alias("y")).where("x != y").drop("x", "y")
    post = ws.save(raw.join(several, "tok").dropDuplicates(["tok", "nid"]), "postings")
    ws.drop(raw)
    texts = base.join(reps.join(post.select("nid").distinct(), "nid"), ["o", "th"]).select("nid", "t").dropDuplicates(["nid"])
    texts = ws.save(texts, "texts")
    similar = lambda pairs: verified(ws, pairs, texts, shingle, t_num, t_den)

    near = post.select("nid", "ell", F.explode("pivots").alias("p")).where("nid != p").groupBy("nid", "p").agg(F.count("*").alias("c"), F.first("ell").alias("ell")).where("c >= ell")
    links = ws.save(similar(best_pivots(near)), "verified")
    comp = ws.save(components(ws, links), "components")

    own = ws.save(labelled(post.drop("pivots"), comp), "labelled")
    per = own.groupBy("tok", "comp").agg(F.count("*").alias("c"))
    most = F.max(F.struct("c", "comp"))
    mixed = per.groupBy("tok").agg(most["comp"].alias("most"), most["c"].alias("inside"), F.sum("c").alias("all"), F.count("*").alias("k")).where("k > 1").drop("k")
    live = ws.save(own.join(mixed, "tok"), "live")
    ws.drop(post, own)
    pairs_of = F.when(F.col("comp") == F.col("most"), F.col("all") - F.col("inside")).otherwise(F.col("all") - 1)
    dense = ws.save(live.groupBy("nid").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.sum(pairs_of).alias("w")).where("w > n").drop("w"), "dense")

    live = live.drop("inside", "all").join(dense.select("nid", F.lit(True).alias("dense")), "nid", "left").withColumn("dense", F.col("dense").isNotNull())
    left = live.where("comp <> most").select("tok", *(F.col(c).alias(f"l_{c}") for c in ("nid", "n", "lev", "ell", "comp", "dense")))
    ok = (F.col("l_comp") != F.col("comp")) & ((F.col("comp") == F.col("most")) | (F.col("l_nid") < F.col("nid"))) & ~(F.col("l_dense") & F.col("dense"))
    fits = (F.col("l_n") * t_den >= F.col("n") * t_num) & (F.col("n") * t_den >= F.col("l_n") * t_num)
    ell = F.least("ell", "l_ell")
    level = F.greatest("lev", "l_lev") <= ell
    cand = left.join(live, (left.tok == live.tok) & ok & fits & level)
    cand = cand.groupBy(F.least("nid", "l_nid").alias("b"), F.greatest("nid", "l_nid").alias("a")).agg(F.count("*").alias("c"), F.first(ell).alias("need")).where("c >= need").select("a", "b")
    links = stars(comp).union(ws.save(similar(ws.save(cand, "candidates")), "verified"))
    links = dense_links(ws, dense, texts, links, similar, shingle, t_num, t_den)
    comp = ws.save(components(ws, links), "components")
    ws.drop(texts)

    of = meta.join(comp.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    least = of.where("n > 0").groupBy("comp").agg(F.min("o").alias("component"))
    out = of.join(least, "comp", "left").select("o", "th", F.col("n").alias("doc_n"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("o")).alias("component"), "comp")
    return out


def label(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row; the id of a component of null ids only is null."""
    out = near_duplicates(docs, **options)
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(null("o").alias("doc_id"), F.col("doc_n").alias("n_shingles"), null("component").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: that of the smallest id. Rows without shingles stay."""
    o, th, t, n = fresh(docs, "o", "th", "t", "doc_n")
    all_rows = near_duplicates(docs, **options)
    first = all_rows.where("doc_n > 0").groupBy("comp").agg(F.min(F.struct("o", "th")).alias("r")).select(F.col("r.o").alias(o), F.col("r.th").alias(th), F.lit(1).alias(n))
    bare = all_rows.where("doc_n = 0").select(F.col("o").alias(o), F.col("th").alias(th), F.lit(0).alias(n)).distinct()
    found = first.union(bare)
    keyed = docs.withColumns({o: ordinal(), t: text_of()}).withColumn(th, F.xxhash64(t)).drop(t)
    out = keyed.join(found, [o, th])
    solo = F.row_number().over(Window.partitionBy(o, th).orderBy(F.lit(1)))
    (r,) = fresh(out, "r")
    return out.withColumn(r, solo).where((F.col(r) == 1) | (F.col(n) == 0)).select(docs.columns)

