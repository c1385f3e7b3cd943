"""Many-to-many tags through a junction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import string_agg
from ..errors import ValidationError


def keys(j):
    o = j.options
    return o["join_table"], o.get("main_foreign_key", j.owner_key), o.get("tag_foreign_key", "tag_id"), o.get("tag_field", "name")


def join(frame: DataFrame, alias: str, j, schema, tables) -> DataFrame:
    """frame with list (tags joined by ", ") and count (distinct tags), one row as before.

    Junction and tags are aggregated by the main key before they meet the frame, so nothing fans out.
    """
    table, main, tag, name = keys(j)
    tags = tables(schema.table).select(F.col(schema.primary_key).alias("_k"), F.col(name).alias("_n"))
    own = tables(table).select(F.col(main).alias("_m"), F.col(tag).alias("_t")).join(tags, F.col("_t") == F.col("_k")).distinct()
    per = own.groupBy("_m").agg(string_agg(F.col("_n"), ", ").alias(f"{alias}__list"), F.count_distinct("_k").alias(f"{alias}__count"))
    key = f"{j.parent}__{j.owner_key}"
    return frame.join(per, F.col(f"`{key}`") == F.col("_m"), "left").drop("_m").withColumn(f"{alias}__count", F.coalesce(f"{alias}__count", F.lit(0)))


def facet(frame: DataFrame, key: str, j, schema, tables, wanted: list, mode: str = "any") -> DataFrame:
    """Rows with any (one is enough) or all of the wanted tags: a semi-join."""
    table, main, tag, name = keys(j)
    hits = tables(table).select(F.col(main).alias("_m"), F.col(tag).alias("_t")).join(tables(schema.table).where(F.col(name).isin(wanted)).select(F.col(schema.primary_key).alias("_t"), F.col(name).alias("_n")), "_t")
    if mode == "all":
        hits = hits.groupBy("_m").agg(F.count_distinct("_n").alias("_c")).where(F.col("_c") == len(set(wanted)))
    elif mode not in ("any", "single"):
        raise ValidationError(f"facets are any, single or all, not {mode!r}")
    return frame.join(hits.select("_m"), F.col(f"`{key}`") == F.col("_m"), "left_semi")


def count_filter(frame: DataFrame, key: str, j, tables, compare) -> DataFrame:
    """Rows whose number of distinct tags (0 if none) passes compare(Column)."""
    table, main, tag, _ = keys(j)
    per = tables(table).groupBy(F.col(main).alias("_m")).agg(F.count_distinct(tag).alias("_c"))
    out = frame.join(per, F.col(f"`{key}`") == F.col("_m"), "left")
    return out.where(compare(F.coalesce("_c", F.lit(0)))).drop("_m", "_c")
