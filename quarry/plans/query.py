"""The query builder. Each call gives a new Query; df() lowers it to one DataFrame and runs nothing.
(A recursive frame is the one thing that runs, level by level, when it is added.)

Order of lowering: source, inferred joins, frames, laterals, unnests, filters, subfilters, groups, having,
windows, nesting, projection, order, offset and limit. Only joins that some clause refers to are made.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MultipleResults, NoResults, QueryError, ValidationError
from ..operators import joins, related, tagging
from ..operators.windows import DIRECTIONS, window
from ..sources.tables import IDENTIFIER, Tables, values
from .domain import Domain
from .exprs import Exprs, is_aggregate, label, on_aggregate
from .resolve import Scope


@dataclass(frozen=True)
class Query:
    spark: SparkSession
    domain: Domain
    tables: Tables
    base: object = None  # a DataFrame in place of the source table
    selected: tuple = ()
    filtered: tuple = ()
    grouped: tuple = ()
    group_kind: str = "group"
    kept: tuple = ()  # having
    ordered: tuple = ()
    windows: tuple = ()
    nested: tuple = ()
    subfilters: tuple = ()
    facets: tuple = ()
    laterals: tuple = ()
    unnests: tuple = ()
    frames: tuple = ()  # (name, DataFrame)
    joined: tuple = ()  # (name, on, how)
    first: int | None = None
    skip: int = 0
    unique: bool = False
    scope: object = field(default=None, compare=False)
    united: bool = False  # made by a set operation
    before: object = field(default=None, compare=False)  # the query that was pivoted

    # ---- building

    def _single(self, what):
        if self.united:
            raise ValidationError(f"{what} can't follow a set operation; use derived(query.df())")

    def _add(self, name, items):
        return replace(self, **{name: (*getattr(self, name), *items)})

    def select(self, *sels) -> Query:
        return replace(self, selected=uniq([*self.selected, *sels]))

    def filter(self, *preds) -> Query:
        """Conditions on rows; one on an aggregate goes to having."""
        rows = [p for p in preds if not on_aggregate(p)]
        return self._add("filtered", rows)._add("kept", [p for p in preds if on_aggregate(p)])

    def group_by(self, *sels, kind: str = "group") -> Query:
        """kind: group, rollup, cube, or sets (each selector then a tuple of selectors). ("literal_position", n): the nth selected."""
        self._single("a grouping")
        return replace(self._add("grouped", sels), group_kind=kind if kind != "group" else self.group_kind)

    def having(self, *preds) -> Query:
        return self._add("kept", preds)

    def order_by(self, *items) -> Query:
        """f (ascending, nulls first), ("asc"|"desc"|..._nulls_first|_last, f) or (f, direction)."""
        return self._add("ordered", items)

    def limit(self, n: int) -> Query:
        return replace(self, first=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def page(self, n: int, per_page: int = 20) -> Query:
        return replace(self, first=per_page, skip=(max(1, n) - 1) * per_page)

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def window(self, name: str, *args, over=(), order=(), frame=None, as_: str | None = None) -> Query:
        return self._add("windows", [(name, args, tuple(over), tuple(order), frame, as_ or name)])

    def subselect(self, target: str, fields: list[str] | None = None, format: str = "json_agg", as_: str | None = None, separator: str = ",", filters: dict | None = None, order_by: list[str] | None = None, alias_prefix: str = "") -> Query:
        """target: an association path; without fields a text "path[f1, f2]" or "path.f"."""
        self._single("a subselect")
        if fields is None:
            m = re.fullmatch(r"\s*([\w.]+?)\s*(?:\[([^\]]+)\]|\.(\w+))\s*", target)
            if not m:
                raise ValidationError(f"bad subselect {target!r}")
            target, fields = m[1], [f.strip() for f in (m[2] or m[3]).split(",")]
        as_ = as_ or alias_prefix + target.replace(".", "_")
        return self._add("nested", [{"target": target, "fields": fields, "format": format, "as": as_ or target.replace(".", "_"), "separator": separator, "filters": filters, "order_by": order_by}])

    def subselects(self, specs, **options) -> Query:
        """Several: texts as for subselect(), or dicts of its arguments."""
        out = self
        for s in specs:
            out = out.subselect(s, **options) if isinstance(s, str) else out.subselect(**{**options, **s})
        return out

    def subfilter(self, path: str, test, negate: bool = False, strategy: str | None = None) -> Query:
        """Rows with a related row that passes test. ("any"|"all", op, own field): that field op ANY/ALL (the related values).

        strategy: exists, in, join, aggregation, any or all, else by the test. With in, negate is SQL's NOT IN: a
        related null, or a null key of the row itself, leaves the row out.
        """
        return self._add("subfilters", [("and", [(path, test, negate, related.strategy_of(test, strategy))])])

    def subfilter_any(self, *specs) -> Query:
        """Rows that pass one of (path, test[, negate])."""
        return self._add("subfilters", [("or", [(*s, False)[:3] for s in specs])])

    def validate_fields(self, *fields) -> dict:
        return Scope(self.domain, self._frame_columns()).validate(fields)

    def tag_facet(self, join: str, wanted: list, mode: str = "any") -> Query:
        return self._add("facets", [(join, wanted, mode)])

    def tag_count(self, join: str, op: str, value) -> Query:
        return self._add("facets", [(join, (op, value), "count")])

    def lateral(self, alias: str, build, columns: list[str], how: str = "left") -> Query:
        """build(outer) gives a DataFrame with these columns; outer["field"] is the outer row's value."""
        if how not in ("left", "inner", "cross"):
            raise ValidationError(f"a lateral join is left, inner or cross, not {how!r}")
        return self._add("laterals", [(alias, build, tuple(columns), how)])

    def unnest(self, sel, as_: str, ordinality: str | None = None, outer: bool = False) -> Query:
        return self._add("unnests", [(sel, as_, ordinality, outer)])

    def with_cte(self, name: str, build, columns: list[str] | None = None) -> Query:
        """A named frame: a DataFrame, Query, or function of the frames so far (by name)."""
        if not IDENTIFIER.match(name) or any(name == n for n, _ in self.frames):
            raise ValidationError(f"bad or repeated name {name!r}")
        if callable(build) and not isinstance(build, (DataFrame, Query)):
            takes(build, 1, name)
        got = build(dict(self.frames)) if callable(build) and not isinstance(build, (DataFrame, Query)) else build
        got = got.df() if isinstance(got, Query) else got
        return self._add("frames", [(name, got.toDF(*columns) if columns else got)])

    def with_ctes(self, specs: dict) -> Query:
        """{name: (function of the frames, names it depends on)}: built dependencies first."""
        out, todo = self, dict(specs)
        while todo:
            have = {n for n, _ in out.frames}
            ready = [n for n, (_, deps) in todo.items() if set(deps) <= have]
            if not ready:
                raise ValidationError(f"frames depend on each other or on unknown ones: {sorted(todo)}")
            for n in ready:
                out = out.with_cte(n, todo.pop(n)[0])
        return out

    def with_recursive_cte(self, name: str, base, step, max_depth: int | None = None, columns: list[str] | None = None) -> Query:
        takes(step, 1, name)
        return self.with_cte(name, recursive(base(dict(self.frames)) if callable(base) and not isinstance(base, DataFrame) else base, step, max_depth), columns)

    def with_values(self, rows, columns=None, as_: str = "v", schema=None) -> Query:
        return self.with_cte(as_, values(self.spark, rows, columns, schema))

    def join_frame(self, name: str, on: list[tuple[str, str]] | object, how: str = "inner") -> Query:
        """Joins a named frame: on is [(field, frame column)] or a function of this query's resolver and the frame's."""
        return self._add("joined", [(name, on, how)])

    # ---- queries from queries

    def derived(self, df: DataFrame, name: str = "derived") -> Query:
        cols = {c: {"type": t} for c, t in df.dtypes}
        d = Domain.of({"name": name, "source": {"source_table": name, "primary_key": df.columns[0], "fields": df.columns, "columns": cols}, "schemas": {}})
        return Query(self.spark, d, self.tables, base=df)

    def _setop(self, other: Query, how: str, all_: bool, mapping: dict | None) -> Query:
        a, b = self.df(), other.df()
        if mapping:
            b = b.select(*[F.col(mapping.get(c, c)).alias(c) for c in a.columns])
        if len(a.columns) != len(b.columns):
            raise ValidationError(f"{how} of {len(a.columns)} and {len(b.columns)} columns")
        for x, y in zip(a.dtypes, b.dtypes, strict=True):
            if kind_of(x[1]) != kind_of(y[1]) and "void" not in (x[1], y[1]):
                raise ValidationError(f"{how} of {x[1]} ({x[0]}) and {y[1]} ({y[0]})")
        if how == "union":
            out = a.union(b) if all_ else a.union(b).distinct()
        elif how == "intersect":
            out = a.intersectAll(b) if all_ else a.intersect(b)
        else:
            out = a.exceptAll(b) if all_ else a.subtract(b)
        return replace(self.derived(out, how), united=True)

    def union(self, other, all: bool = False, mapping=None) -> Query:
        return self._setop(other, "union", all, mapping)

    def intersect(self, other, all: bool = False, mapping=None) -> Query:
        return self._setop(other, "intersect", all, mapping)

    def except_(self, other, all: bool = False, mapping=None) -> Query:
        return self._setop(other, "except", all, mapping)

    def pivot(self, target: str, strategy: str = "in", preserve_filters: bool = True) -> Query:
        """A query on target: its rows that the rows of this query lead to. in and exists: each once (a semi-join)."""
        if strategy not in ("in", "exists", "join"):
            raise ValidationError(f"unknown strategy {strategy!r}")
        self._single("a pivot")
        path = self.domain.path(target)
        src = replace(self, selected=(), grouped=(), ordered=(), windows=(), nested=(), filtered=self.filtered if preserve_filters else (), subfilters=self.subfilters if preserve_filters else ())
        rows = src._rows(Scope(src.domain, src._frame_columns()), required=preserve_filters)[0]
        chain, key, last = related.chain(self.domain, self.tables, path)
        schema = self.domain.schemas[path[-1].queryable]
        on = F.col(f"`root__{path[0].owner_key}`") == F.col(key)
        if strategy == "join":
            base = rows.join(chain, on).select(*[F.col(f"{last}__{c}").alias(c) for c in schema.fields])
        else:
            keys = chain.join(rows.select(f"`root__{path[0].owner_key}`"), on, "left_semi") if len(path) > 1 else None
            table = self.tables(schema.table).select(*schema.fields)
            if keys is None:
                base = table.join(rows.select(F.col(f"`root__{path[0].owner_key}`").alias("_k")), F.col(path[0].related_key) == F.col("_k"), "left_semi")
            else:
                base = table.join(keys.select(F.col(f"{last}__{schema.primary_key}").alias("_k")), F.col(schema.primary_key) == F.col("_k"), "left_semi")
        return Query(self.spark, self.domain.reroot(path[-1].queryable), self.tables, base=base, before=self)

    @property
    def has_pivot(self) -> bool:
        return self.before is not None

    def reset_pivot(self) -> Query:
        """The query before its last pivot."""
        return self if self.before is None else self.before

    # ---- lowering

    def _frame_columns(self):
        return {n: list(df.columns) for n, df in self.frames}

    def _rows(self, scope: Scope, extra=(), required: bool = True):
        """The filtered frame before grouping. extra: clauses to resolve, so that their joins are made."""
        frames = dict(self.frames)
        for _, as_, ordinal, _ in self.unnests:
            scope.frames[as_] = [as_] + ([ordinal] if ordinal else [])
        held = replace(self, scope=scope)
        lat = []
        for alias, build, columns, how in self.laterals:
            sub = build(joins.Outer(held))
            scope.frames[alias] = list(columns)
            lat.append((joins.renamed(sub, alias, columns), how))
        ex = Exprs(scope, self.spark)
        un = [(ex.sel(s), a, o, outer) for s, a, o, outer in self.unnests]
        on = []
        for name, cond, how in self.joined:
            cols = frames[name].columns
            of = lambda c, n=name: F.col(f"`{n}__{c}`")
            if callable(cond):
                on.append((name, cond(scope.resolve, of), how))
            else:
                if bad := [c for _, c in cond if c not in cols]:
                    raise ValidationError(f"{name} has no columns {bad}")
                c = F.lit(True)
                for f, g in cond:
                    c = c & (scope.resolve(f) == of(g))
                on.append((name, c, how))
        must = self.domain.required_filters if required else ()
        cond = ex.all_of([*must, *self.filtered])
        resolved = [e() for e in extra]
        for j, *_ in self.facets:
            scope.domain.joins[j]
        schema = self.domain.source
        df = self.base if self.base is not None else self.tables(schema.table)
        df = joins.renamed(df, "root", schema.fields)
        for alias, (j, params) in scope.needed.items():
            df = joins.apply(df, alias, j, params, held)
        for name, c, how in on:
            df = df.join(joins.renamed(frames[name], name), c, how)
        for sub, how in lat:
            df = joins.lateral(df, sub, how)
        for c, a, o, outer in un:
            if o:
                df = df.select("*", (F.posexplode_outer if outer else F.posexplode)(c).alias("_pos", f"{a}__{a}")).withColumn(f"{a}__{o}", F.col("_pos") + 1).drop("_pos")
            else:
                df = df.select("*", (F.explode_outer if outer else F.explode)(c).alias(f"{a}__{a}"))
        if cond is not None:
            df = df.where(cond)
        for how, specs in self.subfilters:
            if how == "and":
                for s in specs:
                    df = related.subfilter(df, self, *s, exprs=ex)
            else:
                df = related.either(df, self, specs, ex)
        for jid, wanted, mode in self.facets:
            j = self.domain.joins[jid]
            key = f"{j.parent}__{j.owner_key}"
            if mode == "count":
                df = tagging.count_filter(df, key, j, self.tables, lambda c, w=wanted: ex.compare(c, w))
            else:
                df = tagging.facet(df, key, j, self.domain.schemas[j.schema], self.tables, wanted, mode)
        return df, resolved

    def df(self) -> DataFrame:
        scope = Scope(self.domain, self._frame_columns())
        default = () if self.windows or self.nested or self.grouped else self.domain.default_selected or self.domain.source.visible
        chosen = list(uniq([*self.domain.required_selected, *(self.selected or default)]))
        groups = [self._placed(g, chosen) for g in (*self.domain.required_group_by, *self.grouped)]
        if self.group_kind == "group":
            groups += [k for g in groups if (k := self._dimension_key(g)) and k not in groups]
        ordered = [self._placed(o, chosen) for o in (*self.domain.required_order_by, *self.ordered)]
        names = []
        for s in chosen:
            n = self._name(s)
            while n in names:
                n = n + "_1"
            names.append(n)
        grouped = bool(groups) or any(is_aggregate(s) for s in chosen)
        return self._grouped(scope, chosen, names, groups, ordered) if grouped else self._plain(scope, chosen, names, ordered)

    def _placed(self, s, chosen):
        """("literal_position", n) is the nth selector."""
        if isinstance(s, tuple) and len(s) == 2 and s[0] == "literal_position":
            if not 1 <= s[1] <= len(chosen):
                raise ValidationError(f"there is no selector {s[1]}")
            s = chosen[s[1] - 1]
            return s[1] if isinstance(s, tuple) and s[0] == "field" else s
        if isinstance(s, tuple) and any(isinstance(x, tuple) and x and x[0] == "literal_position" for x in s):
            return tuple(self._placed(x, chosen) for x in s)
        return s

    def _dimension_key(self, g):
        """A dimension's value is grouped by with its key, as values may repeat."""
        jid, _, f = g.rpartition(".") if isinstance(g, str) else ("", "", "")
        j = self.domain.joins.get(jid)
        return f"{jid}.{j.related_key}" if j and j.kind == "dimension" and f == j.options["dimension"] else None

    def _name(self, s):
        return s._jc.toString() if isinstance(s, Column) and hasattr(s, "_jc") else label(s)

    def _plain(self, scope, chosen, names, ordered):
        ex = Exprs(scope, self.spark)
        out_names = {n: s for n, s in zip(names, chosen, strict=True)}
        sel = lambda s: ex.sel(out_names.get(s, s) if isinstance(s, str) and s in out_names else s)
        w_names = {w[5] for w in self.windows} | {n["as"] for n in self.nested}
        later = [o for o in ordered if self._order_field(o)[0] in w_names]
        cols = lambda: [ex.sel(s).alias(n) for s, n in zip(chosen, names, strict=True)]
        keys = lambda: [self._key(o, sel).alias(f"_o{i}") for i, o in enumerate(ordered) if o not in later]
        wins = lambda: [window(n, list(a), sel, over, order, frame).alias(as_) for n, a, over, order, frame, as_ in self.windows]
        df, (c, k, w) = self._rows(scope, [cols, keys, wins])
        for s in self.nested:
            df = related.nest(df, self, s, ex)
        df = df.select(*c, *w, *[F.col(f"`{s['as']}`") for s in self.nested], *k)
        return self._finish(df, ordered, later, [*names, *[x[5] for x in self.windows], *[s["as"] for s in self.nested]])

    def _grouped(self, scope, chosen, names, groups, ordered):
        if self.nested:
            raise ValidationError("nesting needs one row for each source row; it can't follow a grouping")
        ex = Exprs(scope, self.spark)
        sets = self.group_kind == "sets"
        flat = list(uniq([x for g in groups for x in (g if sets else [g])]))
        keys = {self._same(g): f"_g{i}" for i, g in enumerate(flat)}
        aggs, plan = [], []  # aggregates to make, and the output columns from them

        def out(s):
            if self._same(s) in keys:
                return F.col(keys[self._same(s)])
            if isinstance(s, tuple) and s and s[0] == "percent_of_total":
                base = out(s[1])
                from pyspark.sql import Window

                return base / F.sum(base).over(Window.partitionBy(*[out(d) for d in (s[2] if len(s) > 2 else [])]))
            if is_aggregate(s):
                aggs.append(ex.sel(s).alias(f"_a{len(aggs)}"))
                return F.col(f"_a{len(aggs) - 1}")
            if not isinstance(s, (str, tuple)) or isinstance(s, tuple) and s[0] in ("literal", "literal_string"):
                return ex.sel(s)
            if isinstance(s, tuple) and s[0] == "field":
                return out(s[1])
            if isinstance(s, tuple) and s[0] == "grouping":
                aggs.append(F.grouping(ex.sel(s[1])).alias(f"_a{len(aggs)}"))
                return F.col(f"_a{len(aggs) - 1}")
            raise ValidationError(f"{s!r} is neither grouped by nor aggregated")

        def lower():
            group_cols = [ex.sel(g).alias(keys[self._same(g)]) for g in flat]
            plan.extend(out(s).alias(n) for s, n in zip(chosen, names, strict=True))
            by = dict(zip(names, plan, strict=True))
            at = Exprs(scope, self.spark)
            at.sel = lambda s: by[s] if isinstance(s, str) and s in by else out(s) if isinstance(s, (str, tuple)) else F.lit(s)
            having = at.all_of(self.kept)
            order = [self._key(o, at.sel) for o in ordered if self._order_field(o)[0] not in {w[5] for w in self.windows}]
            wins = [window(n, list(a), at.sel, over, o, frame).alias(as_) for n, a, over, o, frame, as_ in self.windows]
            return group_cols, having, order, wins

        df, ((group_cols, having, order, wins),) = self._rows(scope, [lower])
        aggs = aggs or [F.count(F.lit(1)).alias("_n")]
        if not flat:
            df = df.agg(*aggs)
        elif self.group_kind == "group":
            df = df.groupBy(*group_cols).agg(*aggs)
        else:
            df = df.withColumns({keys[self._same(g)]: c for g, c in zip(flat, group_cols, strict=True)})
            cols = [F.col(keys[self._same(g)]) for g in flat]
            if sets:
                df = df.groupingSets([[F.col(keys[self._same(x)]) for x in g] for g in groups], *cols).agg(*aggs)
            else:
                df = (df.rollup if self.group_kind == "rollup" else df.cube)(*cols).agg(*aggs)
        if having is not None:
            df = df.where(having)
        later = [o for o in ordered if self._order_field(o)[0] in {w[5] for w in self.windows}]
        kept = [o for o in ordered if o not in later]
        df = df.select(*plan, *wins, *[c.alias(f"_o{ordered.index(o)}") for c, o in zip(order, kept, strict=True)])
        return self._finish(df, ordered, later, [*names, *[w[5] for w in self.windows]])

    def _same(self, s):
        return repr(s[1] if isinstance(s, tuple) and s and s[0] == "field" else s)

    def _order_field(self, o):
        if isinstance(o, tuple) and len(o) == 2:
            if isinstance(o[0], str) and o[0] in DIRECTIONS:
                return o[1], o[0]
            if isinstance(o[1], str) and o[1] in DIRECTIONS:
                return o[0], o[1]
        return o, "asc_nulls_first"

    def _key(self, o, sel):
        f, _ = self._order_field(o)
        return sel(f)

    def _finish(self, df, ordered, later, names):
        if self.unique:
            shown = {self._same(s) for s in self.selected} | {*names} | {repr(n) for n in names}
            if bad := [o for o in ordered if o not in later and self._same(self._order_field(o)[0]) not in shown]:
                raise ValidationError(f"a distinct query is ordered by what it selects, not by {bad}")
            df = df.distinct()
        if ordered:
            df = df.orderBy(*[DIRECTIONS[self._order_field(o)[1]](F.col(f"`{self._order_field(o)[0]}`" if o in later else f"_o{i}")) for i, o in enumerate(ordered)])
        if self.skip:
            df = df.offset(self.skip)
        if self.first is not None:
            df = df.limit(self.first)
        return df.select(*[F.col(f"`{n}`") for n in names])

    # ---- running

    def rows(self) -> list:
        return guarded(lambda: self.df().collect())

    def one(self):
        got = guarded(lambda: self.df().limit(2).collect())
        if not got:
            raise NoResults("no rows")
        if len(got) > 1:
            raise MultipleResults("more than one row")
        return got[0]

    def page_info(self, page: int, per_page: int = 20) -> dict:
        total = replace(self, first=None, skip=0, ordered=()).df().count()
        pages = -(-total // per_page)
        return {"page": page, "per_page": per_page, "total": total, "pages": pages, "has_next": page < pages, "has_previous": page > 1}


def guarded(run):
    """Spark's errors as this package's: QueryError, or Timeout or ConnectionFailed where their text says so."""
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JError

    from ..errors import ConnectionFailed, Timeout

    try:
        return run()
    except (PySparkException, Py4JError) as e:
        text = str(e)
        kind = Timeout if "TimeoutException" in text or "timed out" in text else ConnectionFailed if "Connection refused" in text else QueryError
        raise kind(text.split("\n")[0], cause=type(e).__name__) from e
    except OSError as e:
        raise ConnectionFailed(str(e)) from e


def takes(f, n: int, name: str) -> None:
    """An error if f can't be called with n arguments."""
    import inspect

    try:
        inspect.signature(f).bind(*[None] * n)
    except TypeError:
        raise ValidationError(f"the function of frame {name!r} must take {n} argument") from None


def uniq(items) -> tuple:
    """Items without repeats, in order; selectors may hold Columns, so they are told apart by their text."""
    out: dict = {}
    for x in items:
        out.setdefault(repr(x), x)
    return tuple(out.values())


def kind_of(t: str) -> str:
    if t in ("int", "bigint", "smallint", "tinyint", "double", "float") or t.startswith("decimal"):
        return "number"
    return "time" if t in ("date", "timestamp", "timestamp_ntz") else "string" if t.startswith(("string", "char", "varchar")) else t


#: Levels of a recursion that are united before they are written as one.
LEVELS = 64


def recursive(base: DataFrame, step, max_depth: int | None = None) -> DataFrame:
    """base, step(base), step(step(base)), ... until a step is empty. Each level is checkpointed, which cuts the lineage.

    There is no limit by default. If max_depth steps leave rows for another one, that is an error.
    """
    from .workspace import bare_checkpoint as checkpoint

    tiers: list[list[DataFrame]] = []

    def keep(rows, tier=0):
        if tier == len(tiers):
            tiers.append([])
        tiers[tier].append(rows)
        if len(tiers[tier]) == LEVELS:
            full, tiers[tier] = tiers[tier], []
            keep(checkpoint(reduce(DataFrame.union, full)), tier + 1)

    level, depth = checkpoint(base), 0
    while True:
        keep(level)
        level = checkpoint(step(level).toDF(*base.columns))
        if level.isEmpty():
            break
        if depth == max_depth:
            raise QueryError(f"the recursion has rows after {max_depth} steps")
        depth += 1
    return reduce(DataFrame.union, [rows for tier in reversed(tiers) for rows in tier])


def configure(spark: SparkSession, domain: Domain | dict, tables=None, validate: bool = True) -> Query:
    """A query on a domain. tables: a folder of Parquet files, a dict of DataFrames, a function, or the catalog."""
    d = domain if isinstance(domain, Domain) else Domain.of(domain, validate)
    return Query(spark, d, tables if isinstance(tables, Tables) else Tables(spark, tables))
