"""Chat formatting of reply trees, with DataFrame operations only.

Unary runs of replies are contracted first: by pointer doubling (a self-join a round, log2 of the longest
run) each node learns the head of its run and its place in it. Iterative self-joins then extend paths run
by run from the roots to the leaves. A tree's paths are ranked by mean score and the chosen ones formatted.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts a backslash is written ``\\e``,
``<`` ``\\l`` and ``[`` ``\\b`` (in roles also a line feed ``\\w``), so that no control string of this or
the usual templates can occur inside a text; ``unescape`` turns it back exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(c):
    for a, b in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c):
    for a, b in (("\\l", "<"), ("\\b", "["), ("\\w", "\n"), ("\\e", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of each tree as conversations.

    nodes: tree, node, parent, role, text, score. Returns tree, path (from 1), path_score, n_turns,
    formatted, loss_spans (start, len in code points of formatted: each assistant text). A null text,
    role or score is empty or 0. A null tree is a tree. A parent that isn't there makes a root. Nodes of a
    cycle have no root and are on no path. A null node is on no path, as nothing can answer it; of rows that
    repeat (tree, node) the least by parent, role, text and score counts. Paths of equal score rank by their
    nodes. No rows, no conversations. Other columns are ignored. A level of branching runs costs one job.
    """
    ws = Workspace(nodes.sparkSession, "chat")
    n = nodes.select("tree", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    rest = F.min(F.struct("parent", "role", "text", "score")).alias("r")
    n = ws.save(n.where("node is not null").groupBy("tree", "node").agg(rest).select("tree", "node", "r.parent", "r.role", "r.text", "r.score"), "nodes")
    up = n.select(F.col("tree").alias("t2"), F.col("node").alias("p2"))
    kids = n.groupBy(F.col("tree").alias("t3"), F.col("parent").alias("p3")).agg(F.count("*").alias("kids"))
    here = n.join(up, n.tree.eqNullSafe(up.t2) & (n.parent == up.p2), "left").join(kids, n.tree.eqNullSafe(kids.t3) & (n.parent == kids.p3), "left")
    head = F.col("p2").isNull() | (F.col("kids") != 1)
    state = here.select("tree", "node", "score", F.col("p2").alias("parent"), F.when(head, F.col("node")).otherwise(F.col("p2")).alias("anc"), F.when(head, 0).otherwise(1).cast("long").alias("dist"), head.alias("done"))
    state = ws.save(state, "runs")
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):
        if state.where(~F.col("done")).isEmpty():
            break
        ends = state.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("anc").alias("a2"), F.col("dist").alias("d2"), F.col("done").alias("f2"))
        open_ = state.where(~F.col("done"))
        hop = open_.join(ends, open_.tree.eqNullSafe(ends.t2) & (open_.anc == ends.n2))
        hop = hop.select("tree", "node", "score", "parent", F.col("a2").alias("anc"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("f2").alias("done"))
        new = ws.save(state.where("done").union(hop), "runs")
        ws.drop(state)
        state = new
    state = state.where("done")

    runs = state.groupBy("tree", "anc").agg(F.sum("score").alias("sum"), F.count("*").alias("len"), F.max(F.when(F.col("dist") == 0, F.col("parent"))).alias("above"))
    of = state.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("anc").alias("from_run"))
    runs = ws.save(runs.join(of, runs.tree.eqNullSafe(of.t2) & (runs.above == of.n2), "left").select("tree", "anc", "sum", "len", "from_run"), "tree-of-runs")
    inner = runs.where("from_run is not null").select(F.col("tree").alias("t4"), F.col("from_run").alias("r4")).distinct()
    front = runs.where("from_run is null").select("tree", F.array("anc").alias("way"), "sum", "len")
    leaves = None
    while True:
        at = F.element_at("way", -1)
        ended = front.join(inner, front.tree.eqNullSafe(inner.t4) & (at == inner.r4), "left_anti")
        leaves = ended if leaves is None else leaves.union(ended)
        down = runs.select(F.col("tree").alias("t2"), F.col("anc").alias("a2"), F.col("sum").alias("s2"), F.col("len").alias("l2"), F.col("from_run").alias("f2"))
        front = front.join(down, front.tree.eqNullSafe(down.t2) & (at == down.f2)).select("tree", F.concat("way", F.array("a2")).alias("way"), (F.col("sum") + F.col("s2")).alias("sum"), (F.col("len") + F.col("l2")).alias("len"))
        front = ws.save(front, "paths")
        if front.isEmpty():
            break
    mean = F.col("sum") / F.col("len")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(mean.desc(), "way"))
    best = leaves.withColumns({"path_score": mean, "path": rank}).where(F.col("path") <= top)
    best = best.select("tree", "path", "path_score", F.posexplode("way").alias("k", "run"))
    placed = state.select(F.col("tree").alias("t2"), "node", "anc", "dist")
    turns = best.join(placed, best.tree.eqNullSafe(placed.t2) & (best.run == placed.anc)).select("tree", "path", "path_score", "k", "dist", "node")
    said = n.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "role", "text")
    turns = turns.join(said, turns.tree.eqNullSafe(said.t2) & (turns.node == said.n2))

    body = escape(F.col("text"))
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\w"))
    turns = turns.withColumns({"front": F.concat(F.lit(OPEN), role, F.lit("\n")), "body": body})
    size = F.length("front") + F.length("body") + len(CLOSE)
    w = Window.partitionBy("tree", "path").orderBy("k", "dist")
    turns = turns.withColumn("start", (F.sum(size).over(w) - F.length("body") - len(CLOSE)).cast("long"))
    mask = F.when(F.col("role") == "assistant", F.struct("start", F.length("body").cast("long").alias("len")))
    each = F.struct("k", "dist", F.concat("front", "body", F.lit(CLOSE)).alias("piece"), mask.alias("mask"))
    grouped = turns.groupBy("tree", "path").agg(F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(each)).alias("turns"))
    return grouped.select("tree", "path", "path_score", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"), F.filter("turns.mask", lambda m: m.isNotNull()).alias("loss_spans"))


def turns_of(formatted):
    """Array of (role, text), read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, "<\\|im_start\\|>", -1), lambda x: x != "")
    end = lambda x: F.length(x) - len(CLOSE)
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.locate("\n", x) + 1, end(x) - F.locate("\n", x))).alias("text")))


def loss_texts(formatted, spans):
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["len"].cast("int"))))


def conversations(rows: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each turn answers the one before. Null turns come first; ties by role, then text."""
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    n = F.row_number().over(w).cast("long")
    return rows.select(F.col("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
