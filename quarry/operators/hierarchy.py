"""Hierarchies: parent keys, path strings and closure tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import from_string


def adjacency(nodes: DataFrame, key: str, parent: str, depth_limit: int | None = 5) -> DataFrame:
    """nodes that a root (null parent) reaches, with level (from 0), path (keys joined by /) and path_array.

    One join a level, at most depth_limit, so circles end. The levels are disjoint: a tree of any size is
    spread over the cluster. None as depth_limit takes all levels: each is written before the next, and a
    node that is its own ancestor ends its circle.
    """
    level = nodes.where(F.col(parent).isNull()).withColumns({"level": F.lit(0), "path": F.col(key).cast("string"), "path_array": F.array(F.col(key))})
    if depth_limit is None:
        from ..plans.query import recursive

        return recursive(level, lambda last: below(nodes, key, parent, last).where(~F.array_contains(F.slice("path_array", 1, F.col("level")), F.col(key))))
    out = [level]
    for _ in range(depth_limit):
        level = below(nodes, key, parent, level)
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def below(nodes: DataFrame, key: str, parent: str, level: DataFrame) -> DataFrame:
    """The children of a level's nodes."""
    up = level.where(F.col(key).isNotNull()).select(F.col(key).alias("_up"), F.col("level").alias("_level"), F.col("path").alias("_path"), F.col("path_array").alias("_array"))
    return nodes.where(F.col(parent).isNotNull()).join(up, F.col(parent) == F.col("_up")).select(
        *nodes.columns, (F.col("_level") + 1).alias("level"), F.concat_ws("/", "_path", F.col(key).cast("string")).alias("path"), F.concat("_array", F.array(F.col(key))).alias("path_array")
    )


def materialized_path(nodes: DataFrame, path: str, separator: str = "/", root: str | None = None) -> DataFrame:
    out = nodes.withColumns({"depth": (F.length(path) - F.length(F.replace(F.col(path), F.lit(separator)))) / len(separator), "path_array": from_string(F.col(path), separator)})
    out = out.withColumn("depth", F.col("depth").cast("int"))
    return out.where(F.col(path).startswith(root + separator)) if root else out


def closure(nodes: DataFrame, key: str, links: DataFrame, ancestor: str, descendant: str, depth: str) -> DataFrame:
    """A row per ancestor of a node, with depth, and the node's number of descendants (itself too, if stored)."""
    count = links.groupBy(F.col(ancestor).alias("_a")).agg(F.count("*").alias("descendant_count"))
    up = links.select(F.col(descendant).alias("_d"), F.col(depth).alias("depth"))
    out = nodes.join(up, F.col(key) == F.col("_d"), "left").join(count, F.col(key) == F.col("_a"), "left")
    return out.drop("_d", "_a").withColumn("descendant_count", F.coalesce("descendant_count", F.lit(0)))


BUILD = {
    "adjacency": lambda df, s, o, tables: adjacency(df, o.get("id_field", s.primary_key), o.get("parent_field", "parent_id"), o.get("depth_limit", 5)),
    "materialized_path": lambda df, s, o, tables: materialized_path(df, o["path_field"], o.get("path_separator", "/"), o.get("root_path")),
    "closure_table": lambda df, s, o, tables: closure(df, s.primary_key, tables(o["closure_table"]), o.get("ancestor_field", "ancestor_id"), o.get("descendant_field", "descendant_id"), o.get("depth_field", "depth")),
}
