"""Join patterns. Each takes the frame so far and gives it with the join's columns, named alias__column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from . import hierarchy, tagging

COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def extra_fields(j) -> tuple[str, ...]:
    """Columns that a join kind adds to those of its table."""
    kind = j.options.get("hierarchy_type", j.kind)
    if j.kind == "star_dimension":
        return ("display",) if j.options.get("display_field") else ()
    if j.kind == "snowflake_dimension":
        return tuple(f"{n['table']}_{f}" for n in j.options["normalization_joins"] for f in n.get("fields", ()))
    if j.kind == "tagging":
        return ("list", "count")
    if kind in ("adjacency", "adjacency_list"):
        return ("level", "path", "path_array")
    if kind == "materialized_path":
        return ("depth", "path_array")
    if kind == "closure_table":
        return ("depth", "descendant_count")
    if j.kind == "full_outer_join":
        return ("coalesced",) if j.options.get("display_field") else ()
    if j.kind == "lateral_join":
        return tuple(j.options.get("columns", ()))
    return ()


def renamed(df: DataFrame, alias: str, columns=None) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{alias}__{c}") for c in (columns or df.columns)])


def apply(frame: DataFrame, alias: str, j, params: tuple, query) -> DataFrame:
    """frame with join j under that alias."""
    domain, tables = query.domain, query.tables
    schema = domain.schemas.get(j.schema)
    at = lambda c: F.col(f"`{j.parent}__{c}`")
    own = lambda c: F.col(f"`{alias}__{c}`")
    side = lambda: tables(schema.table).select(*schema.fields)  # noqa: E731  hidden keys too: names resolve to visible ones only
    o, kind = j.options, j.kind
    how = {"inner": "inner", "right": "right", "full": "full"}.get(o.get("join_type", kind), "left")

    if kind == "hierarchical":
        kind = {"adjacency_list": "adjacency"}.get(o.get("hierarchy_type", "adjacency"), o.get("hierarchy_type"))
    if kind in ("adjacency", "materialized_path", "closure_table"):
        right = hierarchy.BUILD[kind](side(), schema, o, tables)
        return frame.join(renamed(right, alias), at(j.owner_key) == own(j.related_key), "left")
    if kind == "tagging":
        return tagging.join(frame, alias, j, schema, tables)
    if kind == "cross_join":
        return frame.crossJoin(renamed(side(), alias))
    if kind == "lateral_join":
        sub = o["query"](Outer(query))
        return lateral(frame, sub.select(*[F.col(c).alias(f"{alias}__{c}") for c in o["columns"]]), o.get("join_type", "left"))
    if kind == "self_join":
        on = COMPARE[{"equal": "=", "not_equal": "!=", "greater": ">", "less": "<"}.get(o.get("condition_type", "="), o.get("condition_type", "="))](at(o["self_key"]), own(o.get("target_key", schema.primary_key)))
        for f, op, g in o.get("and", ()):
            on = on & COMPARE[op](at(f), own(g))
        return frame.join(renamed(side(), alias), on, how)
    if kind == "conditional_join":
        return frame.join(renamed(side(), alias), reduce(lambda a, b: a & b, [condition(c, at, own, j, alias) for c in o["conditions"]]), how)

    right = side()
    if kind == "dimension":
        right = right.select(j.related_key, o["dimension"]) if o["dimension"] != j.related_key else right.select(j.related_key)
    if kind == "star_dimension" and o.get("display_field"):
        right = right.withColumn("display", F.col(o["display_field"]))
    if kind == "full_outer_join":
        how = "full"
    right = renamed(right, alias)
    if kind == "snowflake_dimension":
        prev, prefix = alias, f"{alias}__"
        for n in o["normalization_joins"]:
            step = f"{alias}_{n['table']}"
            more = renamed(tables(n["table"]), step)
            right = right.join(more, F.col(f"`{prev}__{n.get('foreign_key', n['table'] + '_id')}`") == F.col(f"`{step}__{n.get('key', 'id')}`"), "left")
            right = right.withColumns({f"{prefix}{n['table']}_{f}": F.col(f"`{step}__{f}`") for f in n.get("fields", ())})
            prev = step
    on = at(o.get("dimension_key", j.owner_key)) == own(j.related_key)
    if params:
        names = [p["name"] for p in o.get("parameters", ())]
        extra = o.get("condition")
        if extra:
            on = on & extra(own, dict(zip(names, params, strict=True)))
    out = frame.join(right, on, how)
    if kind == "full_outer_join" and o.get("display_field"):
        out = out.withColumn(f"{alias}__coalesced", F.coalesce(own(o["display_field"]), F.lit("No match")))
    return out


def condition(c, at, own, j, alias) -> Column:
    if callable(c):
        return c(at, own)
    head, *args = c
    if head == "field_comparison":
        left, op, right = args
        return COMPARE[op](at(left), own(right))
    if head == "date_range":
        d, a, b = args
        return at(d).between(own(a), own(b))
    if head == "custom_sql":
        return F.expr(args[0].replace("{parent}", f"{j.parent}__").replace("{join}", f"{alias}__"))
    raise ValidationError(f"unknown join condition {head!r}")


class Outer:
    """The columns of the outer query, for a correlated subquery."""

    def __init__(self, query):
        self.query = query

    def __getitem__(self, f: str) -> Column:
        return self.query.scope.resolve(f).outer()


def lateral(frame: DataFrame, sub: DataFrame, how: str) -> DataFrame:
    if how not in ("left", "inner", "cross"):
        raise ValidationError(f"a lateral join is left, inner or cross, not {how!r}: the right side refers to the left")
    return frame.lateralJoin(sub, how=how) if how == "cross" else frame.lateralJoin(sub, F.lit(True), how)


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str]) -> DataFrame:
    """left with the columns of the last right row at or before it: one shuffle and sort, no pairs.

    Both sides go through one window by key and time; right rows come first on equal times. Rows of left
    keep their number. A null time or key finds nothing.
    """
    from pyspark.sql import Window

    packed = F.struct(*[F.col(c).alias(c) for c in columns])
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in by], F.col("_t").isNotNull())
    a = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_row"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_got"))
    b = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), packed.alias("_got"))
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_got", F.last("_got", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", *[F.when(known, F.col(f"_got.{c}")).alias(f"asof_{c}" if c in left.columns else c) for c in columns])
