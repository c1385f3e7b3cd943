"""The declared model: tables, associations and joins, with validation and path search."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..errors import ConfigurationError, ValidationError

JOIN_KINDS = {
    "left", "inner", "right", "full", "dimension", "star_dimension", "snowflake_dimension", "tagging", "hierarchical", "adjacency", "materialized_path", "closure_table",
    "self_join", "cross_join", "full_outer_join", "conditional_join", "lateral_join",
}


@dataclass(frozen=True)
class Association:
    name: str
    queryable: str
    owner_key: str
    related_key: str


@dataclass(frozen=True)
class TableSchema:
    table: str
    primary_key: str
    fields: tuple[str, ...]
    columns: Mapping[str, Mapping] = field(default_factory=dict)
    redact: frozenset = frozenset()
    associations: Mapping[str, Association] = field(default_factory=dict)

    @property
    def visible(self) -> tuple[str, ...]:
        return tuple(f for f in self.fields if f not in self.redact)

    @staticmethod
    def of(d: Mapping) -> TableSchema:
        for k in ("source_table", "primary_key", "fields"):
            if k not in d:
                raise ConfigurationError(f"a schema needs {k!r}")
        columns = d.get("columns") or {f: {} for f in d["fields"]}
        if missing := [f for f in d["fields"] if f not in columns]:
            raise ConfigurationError(f"fields of {d['source_table']} without a column: {missing}")
        links = {n: Association(n, a["queryable"], a["owner_key"], a["related_key"]) for n, a in (d.get("associations") or {}).items()}
        return TableSchema(d["source_table"], d["primary_key"], tuple(d["fields"]), columns, frozenset(d.get("redact_fields") or ()), links)


@dataclass(frozen=True)
class Join:
    id: str
    kind: str
    parent: str  # id of the join it hangs on; "root" for the source
    schema: str
    owner_key: str
    related_key: str
    options: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class Domain:
    name: str
    source: TableSchema
    schemas: Mapping[str, TableSchema]
    joins: Mapping[str, Join] = field(default_factory=dict)
    required_filters: tuple = ()
    default_selected: tuple = ()
    required_selected: tuple = ()
    required_order_by: tuple = ()
    required_group_by: tuple = ()
    custom_columns: Mapping = field(default_factory=dict)
    filters: Mapping = field(default_factory=dict)
    data: object = None
    loose: bool = False  # a bare name that one join alone has is that join's field

    @staticmethod
    def of(d: Mapping, validate: bool = True) -> Domain:
        for k in ("source", "schemas"):
            if k not in d:
                raise ConfigurationError(f"a domain needs {k!r}")
        source, schemas = TableSchema.of(d["source"]), {n: TableSchema.of(s) for n, s in d["schemas"].items()}
        if validate:
            for owner, s in [("source", source), *schemas.items()]:
                for a in s.associations.values():
                    if a.queryable not in schemas:
                        raise ConfigurationError(f"association {owner}.{a.name} points to unknown schema {a.queryable!r}")
        joins: dict[str, Join] = {}
        _flatten(d.get("joins") or {}, source, "root", schemas, joins)
        _acyclic(joins)
        out = Domain(
            d.get("name", source.table), source, schemas, joins, tuple(d.get("required_filters") or ()), tuple(d.get("default_selected") or ()), tuple(d.get("required_selected") or ()),
            tuple(d.get("required_order_by") or ()), tuple(d.get("required_group_by") or ()), dict(d.get("custom_columns") or {}), dict(d.get("filters") or {}), d.get("domain_data"),
        )
        if validate:
            from .resolve import Scope

            scope = Scope(out)
            for f in [*out.default_selected, *out.required_selected, *(x[0] for x in out.required_filters if x and isinstance(x[0], str) and x[0] not in ("and", "or", "not"))]:
                if isinstance(f, str):
                    scope.resolve(f)
        return out

    @staticmethod
    def from_tables(tables: Mapping[str, DataFrame], source: str, keys: Mapping[str, str], links: list[tuple[str, str, str, str]], joins: Mapping | None = None, **more) -> Domain:
        """A domain read from the schemas of DataFrames. links: (table, its key, other table, its key), both ways."""
        def one(t):
            linked = {b: {"queryable": b, "owner_key": x, "related_key": y} for a, x, b, y in links if a == t}
            linked |= {a: {"queryable": a, "owner_key": y, "related_key": x} for a, x, b, y in links if b == t and a not in linked}
            cols = {f.name: {"type": f.dataType.simpleString()} for f in tables[t].schema}
            return {"source_table": t, "primary_key": keys.get(t) or next(iter(cols)), "fields": list(cols), "columns": cols, "associations": linked}

        return Domain.of({"name": source, "source": one(source), "schemas": {t: one(t) for t in tables}, "joins": joins or {}, **more})

    def reroot(self, schema: str) -> Domain:
        """A domain on another schema. Its associations are its joins, and theirs those below, each schema once on a way."""
        joins: dict[str, Join] = {}
        todo = deque([(self.schemas[schema], "root", {schema})])
        while todo:
            owner, parent, seen = todo.popleft()
            for a in owner.associations.values():
                if a.name not in joins and a.queryable not in seen:
                    joins[a.name] = Join(a.name, "left", parent, a.queryable, a.owner_key, a.related_key)
                    todo.append((self.schemas[a.queryable], a.name, {*seen, a.queryable}))
        return replace(self, name=schema, loose=True, source=self.schemas[schema], joins=joins, required_filters=(), default_selected=(), required_selected=(), required_order_by=(), required_group_by=(), custom_columns={})

    def path(self, target: str, start: TableSchema | None = None) -> list[Association]:
        """The shortest chain of associations from the source to a schema (or association) name; ties by declaration."""
        todo, seen = deque([(start or self.source, [])]), set()
        while todo:
            schema, way = todo.popleft()
            for a in schema.associations.values():
                if target in (a.name, a.queryable):
                    return [*way, a]
                if a.queryable not in seen:
                    seen.add(a.queryable)
                    todo.append((self.schemas[a.queryable], [*way, a]))
        raise ValidationError(f"no path from {self.source.table} to {target!r}")


class Declared:
    """A domain that is checked when its class is made: class Shop(Declared): source = {...}; schemas = {...}; joins = {...}."""

    domain: Domain

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        cls.domain = Domain.of({"name": cls.__name__.lower(), **{k: v for k, v in vars(cls).items() if not k.startswith("_") and k != "domain"}})


def _flatten(tree, schema, parent, schemas, out):
    for jid, opts in tree.items():
        opts = dict(opts or {})
        kind = opts.pop("type", "left")
        if kind not in JOIN_KINDS:
            raise ConfigurationError(f"join {jid} has unknown type {kind!r}")
        assoc = schema.associations.get(opts.pop("association", jid))
        free = kind in ("self_join", "cross_join", "lateral_join", "conditional_join", "full_outer_join")
        if assoc is None and not (free or "schema" in opts):
            raise ConfigurationError(f"join {jid} has no association in {schema.table}")
        target = assoc.queryable if assoc else opts.get("schema")
        if kind == "self_join" and target is None:
            target = next((n for n, s in schemas.items() if s.table == schema.table), None)
        if kind != "lateral_join" and target not in schemas:
            raise ConfigurationError(f"join {jid} needs a known schema, not {target!r}")
        for kinds, need in ((("dimension",), "dimension"), (("materialized_path",), "path_field"), (("closure_table",), "closure_table"), (("snowflake_dimension",), "normalization_joins"), (("self_join",), "self_key")):
            if kind in kinds and not opts.get(need):
                raise ConfigurationError(f"join {jid} of type {kind} needs {need!r}")
        sub = opts.pop("joins", {})
        if jid in out:
            raise ConfigurationError(f"join id {jid!r} is used twice")
        owner = assoc.owner_key if assoc else opts.get("owner_key", "")
        related = assoc.related_key if assoc else opts.get("related_key", "")
        out[jid] = Join(jid, kind, opts.pop("requires_join", parent), target or "", owner, related, opts)
        if sub:
            _flatten(sub, schemas[target], jid, schemas, out)


def _acyclic(joins):
    for jid in joins:
        seen, at = set(), jid
        while at != "root":
            if at in seen:
                raise ConfigurationError(f"joins depend on each other in a circle: {sorted(seen)}")
            if at not in joins:
                raise ConfigurationError(f"join {jid} requires unknown join {at!r}")
            seen.add(at)
            at = joins[at].parent
