"""Which anchors do several documents share? The candidate search of both passage operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rank_of


def anchor_rows(h: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """A row per anchor hash: its smallest document, and the others (null if none)."""
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(h))) - 1
    offs = np.zeros(len(at) + 1, np.int32)
    np.cumsum(size, out=offs[1:])
    more = pa.ListArray.from_arrays(pa.array(offs), pa.array(d[~head]), mask=pa.array(size == 0))
    return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(d[at]), more], names=["h", "o", "more"])


ANCHOR_SCHEMA = "h long, o long, more array<long>"


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(o, hs): for each document the anchors that another document has too.

    rows has at most one row for an anchor and Arrow batch, so the hottest anchor costs a row per
    batch, not per document, in the one shuffle by anchor.
    """
    w = Window.partitionBy("h")
    hi = F.when(F.col("more").isNull(), F.col("o")).otherwise(F.array_max("more"))
    both = rows.withColumns({"lo": F.min("o").over(w), "hi": F.max(hi).over(w)}).where(rank_of("lo") < rank_of("hi"))
    each = both.select("h", F.explode(F.concat(F.array("o"), F.coalesce("more", F.array().cast("array<long>")))).alias("o"))
    return each.groupBy("o").agg(F.collect_list("h").alias("hs"))
