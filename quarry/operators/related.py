"""Filters on related rows, nesting of related rows, and retargeting, along association paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import arrays

AGG = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def chain(domain, tables, path) -> tuple[DataFrame, str, str]:
    """The tables of a path joined (inner): columns a<i>__column, the name of the key to the start, the last alias."""
    out, schema = None, domain.source
    for i, a in enumerate(path):
        s = domain.schemas[a.queryable]
        df = tables(s.table).select(*[F.col(c).alias(f"a{i}__{c}") for c in s.fields])
        out = df if out is None else out.join(df, F.col(f"a{i - 1}__{a.owner_key}") == F.col(f"a{i}__{a.related_key}"))
        schema = s
    return out, f"a0__{path[0].related_key}", f"a{len(path) - 1}"


def walk(domain, steps: list[str], partial: bool = False):
    """Associations for a dotted path; each step goes by the shortest way. partial: the last step may be a field."""
    path, schema = [], domain.source
    for i, s in enumerate(steps):
        if partial and i and i == len(steps) - 1 and s in schema.visible:
            break
        way = domain.path(s, schema)
        path += way
        schema = domain.schemas[way[-1].queryable]
    return path, schema


STRATEGIES = ("exists", "in", "join", "aggregation", "any", "all")


def strategy_of(test, wanted: str | None = None) -> str:
    """How a test is met: an aggregate or ANY/ALL by its form, a list by in, the rest by exists, unless another is wanted."""
    head = test[0].lower() if isinstance(test, tuple) and test and isinstance(test[0], str) else None
    form = "aggregation" if head in AGG and len(test) == 3 else head if head in ("any", "all") and len(test) == 3 else None
    if wanted is not None and wanted not in STRATEGIES:
        raise ValidationError(f"unknown strategy {wanted!r}")
    if form:
        if wanted not in (None, form):
            raise ValidationError(f"{test!r} is a test by {form}, not by {wanted}")
        return form
    if wanted in ("aggregation", "any", "all"):
        raise ValidationError(f"{test!r} is no test by {wanted}")
    return wanted or ("in" if isinstance(test, (list, set, frozenset)) else "exists")


def subfilter_keys(domain, tables, spec: str, test, exprs) -> tuple[DataFrame, str, Column | None]:
    """Keys of the related rows that pass, and the source's key. With an aggregate: all keys with _v."""
    parts = spec.split(".")
    agg = isinstance(test, tuple) and test and isinstance(test[0], str) and test[0].lower() in AGG and len(test) == 3
    try:
        path, schema = walk(domain, parts)
        field = None
    except ValidationError:
        path, schema = walk(domain, parts[:-1])
        field = parts[-1]
        if field not in schema.visible:
            raise ValidationError(f"{schema.table} has no field {field!r}") from None
    df, key, last = chain(domain, tables, path)
    col = F.col(f"{last}__{field}") if field else None
    if agg:
        name = test[0].lower()
        per = df.groupBy(F.col(key).alias("_k")).agg((F.count(F.lit(1)) if col is None else AGG[name](col)).alias("_v"))
        return per, path[0].owner_key, name
    if field is None:
        raise ValidationError(f"{spec!r} needs a field or an aggregate")
    return df.where(recent(col, test, exprs)).select(F.col(key).alias("_k")), path[0].owner_key, None


def recent(c: Column, test, exprs) -> Column:
    if isinstance(test, tuple) and test and test[0] in ("recent", "within_days", "within_hours", "since_date"):
        kind, v = test
        if kind == "recent":
            return c > F.current_date() - F.make_ym_interval(F.lit(v["years"] if isinstance(v, dict) else v))
        if kind == "since_date":
            return c > F.lit(v)
        return c > F.current_timestamp() - F.make_dt_interval(F.lit(v if kind == "within_days" else 0), F.lit(v if kind == "within_hours" else 0))
    return exprs.compare(c, test)


def subfilter(frame: DataFrame, query, spec, test, negate=False, strategy=None, exprs=None) -> DataFrame:
    """Rows of frame with a related row that passes (a semi-join; negated an anti-join), or whose aggregate does."""
    strategy = strategy or strategy_of(test)
    if strategy in ("any", "all"):
        return quantified(frame, query, spec, test, negate, exprs)
    keys, own, agg = subfilter_keys(query.domain, query.tables, spec, test, exprs)
    at = F.col(f"`root__{own}`") == F.col("_k")
    if agg is None and strategy == "in" and negate:
        # NOT IN: true without keys; else a null key on either side makes it unknown
        facts = keys.agg(F.count(F.lit(1)).alias("_n"), F.count("_k").alias("_m"))
        rest = frame.join(keys, at, "left_anti").crossJoin(F.broadcast(facts))
        return rest.where((F.col("_n") == 0) | (F.col("_n") == F.col("_m")) & F.col(f"`root__{own}`").isNotNull()).drop("_n", "_m")
    if agg is None:
        return frame.join(keys, at, "left_anti" if negate else "left_semi")
    v = F.coalesce("_v", F.lit(0)) if agg == "count" else F.col("_v")
    ok = exprs.compare(v, test[1:])
    return frame.join(keys, at, "left").where(~ok if negate else ok).drop("_k", "_v")


def quantified(frame: DataFrame, query, spec, test, negate, exprs) -> DataFrame:
    """own field op ANY/ALL (the related values): by their number and extremes, and for = and <> whether one is equal."""
    from ..plans.exprs import OPS, extremes

    how, op, own_field = test[0].lower(), OPS[test[1]], test[2]
    path, schema = walk(query.domain, spec.split(".")[:-1])
    field = spec.split(".")[-1]
    if field not in schema.visible:
        raise ValidationError(f"{schema.table} has no field {field!r}")
    df, key, last = chain(query.domain, query.tables, path)
    col, mine = F.col(f"{last}__{field}"), exprs.sel(own_field)
    at = F.col(f"`root__{path[0].owner_key}`") == F.col("_k")
    per = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.count(col).alias("_m"), F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    out = frame.join(per, at, "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_m": F.coalesce("_m", F.lit(0))})
    if how == "any" and op == "eq" or how == "all" and op == "ne":
        pairs = df.select(F.col(key).alias("_k2"), col.alias("_x"), F.lit(True).alias("_same")).where("_x is not null").distinct()
        out = out.join(pairs, (F.col("_k") == F.col("_k2")) & (mine == F.col("_x")), "left")
        unknown = F.when((F.col("_n") > 0) & (mine.isNull() | (F.col("_n") > F.col("_m"))), F.lit(None).cast("boolean")).otherwise(F.lit(False))
        found = F.coalesce("_same", unknown)
        ok = found if how == "any" else ~found
        out = out.withColumn("_ok", ok).drop("_k2", "_x", "_same")
    else:
        out = out.withColumn("_ok", extremes(mine, op, how, *(F.col(c) for c in ("_n", "_m", "_lo", "_hi"))))
    return out.where(~F.col("_ok") if negate else F.col("_ok")).drop("_k", "_n", "_m", "_lo", "_hi", "_ok")


def either(frame: DataFrame, query, specs, exprs) -> DataFrame:
    """Rows that pass one of several subfilters: a flag joined for each, no row twice. An unknown aggregate stays unknown."""
    flags = []
    for i, (spec, test, negate) in enumerate(specs):
        keys, own, agg = subfilter_keys(query.domain, query.tables, spec, test, exprs)
        k, v = f"_k{i}", f"_v{i}"
        if agg is None:
            keys = keys.distinct().select(F.col("_k").alias(k), F.lit(True).alias(v))
            ok = F.coalesce(F.col(v), F.lit(False))
        else:
            keys = keys.select(F.col("_k").alias(k), F.col("_v").alias(v))
            ok = exprs.compare(F.coalesce(v, F.lit(0)) if agg == "count" else F.col(v), test[1:])
        frame = frame.join(keys, F.col(f"`root__{own}`") == F.col(k), "left")
        flags.append(~ok if negate else ok)
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return frame.where(out).drop(*[f"_{x}{i}" for x in "kv" for i in range(len(specs))])


class Subfilters:
    """A named set of subfilters that is kept apart from a query: added, grouped, changed, judged, and applied at last."""

    def __init__(self):
        self.parts: dict[str, tuple] = {}  # id -> (path, test, negate, strategy)
        self.groups: list[list[str]] = []  # ids of which one must pass

    def add(self, id: str, path: str, test, negate: bool = False, strategy: str | None = None) -> Subfilters:
        if id in self.parts:
            raise ValidationError(f"there is a subfilter {id!r} already")
        self.parts[id] = (path, test, negate, strategy_of(test, strategy))
        return self

    def add_compound(self, how: str, ids: list[str]) -> Subfilters:
        if how not in ("and", "or") or any(i not in self.parts for i in ids):
            raise ValidationError(f"a compound is and or or, of known subfilters, not {how!r} of {ids}")
        if how == "or":
            self.groups.append(list(ids))
        return self

    def remove(self, id: str) -> Subfilters:
        if id not in self.parts:
            raise ValidationError(f"no subfilter {id!r}")
        del self.parts[id]
        self.groups = [g for g in ([i for i in g if i != id] for g in self.groups) if g]
        return self

    def override_strategy(self, id: str, strategy: str) -> Subfilters:
        path, test, negate, _ = self.parts[id]
        self.parts[id] = (path, test, negate, strategy_of(test, strategy))
        return self

    def analyze(self, domain) -> dict:
        """Joins that the parts need, a score of their cost (2 a join, 3 an aggregate, 1 a test), and advice."""
        steps = {i: len(walk(domain, p[0].split("."), partial=True)[0]) for i, p in self.parts.items()}
        score = sum(2 * n + (3 if self.parts[i][3] in ("aggregation", "any", "all") else 1) for i, n in steps.items())
        advice = [f"{i}: {n} joins; a nearer association would be cheaper" for i, n in steps.items() if n > 2]
        seen: dict = {}
        for i, p in self.parts.items():
            if (other := seen.setdefault(repr(p[:3]), i)) != i:
                advice.append(f"{i} repeats {other}")
        return {"subfilters": len(self.parts), "joins": sum(steps.values()), "score": score, "level": "simple" if score < 8 else "moderate" if score < 20 else "complex", "suggestions": advice}

    def apply(self, query):
        """query with all of them: groups as one of their parts, the rest each."""
        grouped = {i for g in self.groups for i in g}
        for i, (path, test, negate, strategy) in self.parts.items():
            if i not in grouped:
                query = query.subfilter(path, test, negate, strategy)
        for g in self.groups:
            query = query.subfilter_any(*[self.parts[i][:3] for i in g])
        return query


def nest(frame: DataFrame, query, s: dict, exprs) -> DataFrame:
    """frame with a column of related rows, aggregated by key first, so that rows don't fan out."""
    path, schema = walk(query.domain, s["target"].split("."))
    if bad := [f for f in s["fields"] if f not in schema.visible]:
        raise ValidationError(f"{schema.table} has no fields {bad}")
    df, key, last = chain(query.domain, query.tables, path)
    for f, v in (s.get("filters") or {}).items():
        df = df.where(exprs.compare(F.col(f"{last}__{f}"), v))
    cols = [F.col(f"{last}__{f}") for f in s["fields"]]
    one = cols[0] if len(cols) == 1 else F.struct(*[c.alias(f) for c, f in zip(cols, s["fields"], strict=True)])
    order = F.struct(*[F.col(f"{last}__{f}") for f in s["order_by"]]) if s.get("order_by") else None
    kind = s.get("format", "json_agg")
    if kind == "count":
        agg = F.count(F.lit(1))
    elif kind == "string_agg":
        agg = arrays.string_agg(cols[0], s.get("separator", ","), order)
    elif kind in ("array_agg", "json_agg"):
        agg = arrays.agg(one, order)
        agg = F.to_json(agg, {"ignoreNullFields": "false"}) if kind == "json_agg" else agg
    else:
        raise ValidationError(f"unknown nesting format {kind!r}")
    per = df.groupBy(F.col(key).alias("_k")).agg(agg.alias(s["as"]))
    out = frame.join(per, F.col(f"`root__{path[0].owner_key}`") == F.col("_k"), "left").drop("_k")
    return out.withColumn(s["as"], F.coalesce(s["as"], F.lit(0))) if kind == "count" else out
