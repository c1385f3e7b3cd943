"""Field names to columns. A frame's columns are named alias__column, so nothing is ambiguous."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FieldResolutionError, ValidationError

BRACKET = re.compile(r"^([A-Za-z_]\w*(?:\[\w+\])*)\[(\w+)\]$")


def name(alias: str, column: str) -> str:
    return f"{alias}__{column}"


class Scope:
    """What names mean in a query; records the joins that its fields need."""

    def __init__(self, domain, frames: dict[str, list[str]] | None = None):
        self.domain, self.frames = domain, frames or {}
        self.needed: dict[str, tuple] = {}  # join instance -> (join, parameters)

    def require(self, jid: str, params: tuple = ()) -> str:
        j = self.domain.joins[jid]
        if j.parent != "root":
            self.require(j.parent)
        if not params:
            self.needed.setdefault(jid, (j, params))
            return jid
        same = [a for a, (k, p) in self.needed.items() if k.id == jid and p == params]
        alias = same[0] if same else f"{jid}__p{sum(k.id == jid for k, _ in self.needed.values()) + 1}"
        self.needed.setdefault(alias, (j, params))
        return alias

    def fields(self) -> list[str]:
        out = [*self.domain.source.visible, *self.domain.custom_columns]
        for j in self.domain.joins.values():
            out += [f"{j.id}.{f}" for f in self._join_fields(j)]
        return out + [f"{a}.{c}" for a, cols in self.frames.items() for c in cols]

    def _join_fields(self, j):
        from ..operators.joins import extra_fields

        base = self.domain.schemas[j.schema].visible if j.schema else ()
        if j.kind == "dimension":
            base = (j.options["dimension"], j.related_key)
        return [*base, *extra_fields(j)]

    def validate(self, fields) -> dict:
        """{"valid": fields that resolve, "errors": {field: message}, "suggestions": {field: names}}."""
        out: dict = {"valid": [], "errors": {}, "suggestions": {}}
        for f in fields:
            try:
                self.column(f)
                out["valid"].append(f)
            except (FieldResolutionError, ValidationError) as e:
                out["errors"][f], out["suggestions"][f] = str(e), self.suggest(f)
        return out

    def suggest(self, f: str) -> list[str]:
        every = self.fields()
        tail = f.split(".")[-1].lower()
        return (difflib.get_close_matches(f, every, 5, 0.5) + [x for x in every if tail in x.lower()])[:5]

    def resolve(self, f: str) -> Column:
        return F.col(f"`{self.column(f)}`")

    def column(self, f: str) -> str:
        raw = f
        if m := BRACKET.match(f):
            chain = re.findall(r"\w+", m[1])
            for up, jid in zip(chain, chain[1:], strict=False):
                if jid in self.domain.joins and self.domain.joins[jid].parent != up:
                    raise FieldResolutionError(f"in {raw!r} join {jid!r} hangs on {self.domain.joins[jid].parent!r}, not on {up!r}")
            f = f"{chain[-1]}.{m[2]}"
        left, _, right = f.rpartition(".")
        src = self.domain.source
        if not left or left in (src.table, "root"):
            if right in src.visible:
                return name("root", right)
            if not left:
                found = [f"{a}.{right}" for a, cols in self.frames.items() if right in cols]
                if not found:
                    found = [f"{j.id}.{right}" for j in self.domain.joins.values() if right in self._join_fields(j)]
                if len(found) == 1 and (found[0].split(".")[0] in self.frames or self.domain.loose):
                    return self.column(found[0])
                if len(found) > 1:
                    raise FieldResolutionError(f"field {raw!r} is ambiguous: {', '.join(found)}", options=found)
                if found:
                    raise FieldResolutionError(f"field {raw!r} is not in the source; did you mean {found[0]!r}?", options=found)
            raise FieldResolutionError(f"unknown field {raw!r}; perhaps {self.suggest(raw)}", options=self.suggest(raw))
        if left in self.frames:
            if right not in self.frames[left]:
                raise FieldResolutionError(f"{left} has no column {right!r}; it has {self.frames[left]}")
            return name(left, right)
        jid, *params = split_params(left)
        if jid not in self.domain.joins:
            raise FieldResolutionError(f"unknown join in {raw!r}; perhaps {self.suggest(raw)}", options=self.suggest(raw))
        j = self.domain.joins[jid]
        if right not in self._join_fields(j):
            raise FieldResolutionError(f"join {jid!r} has no field {right!r}", options=self._join_fields(j))
        return name(self.require(jid, typed_params(j, params)), right)


def split_params(s: str) -> list[str]:
    """join:a:'b:c' -> its parts."""
    parts = re.findall(r"'(?:[^']*)'|[^:]+", s)
    return parts


def typed_params(j, given: list[str]) -> tuple:
    """Values of a parameterized join: typed by its declaration, defaults filled in."""
    spec = j.options.get("parameters") or []
    if len(given) > len(spec):
        raise ValidationError(f"join {j.id} takes {len(spec)} parameters, not {len(given)}")
    out = []
    for i, p in enumerate(spec):
        if i >= len(given):
            if p.get("required") and "default" not in p:
                raise ValidationError(f"join {j.id} needs parameter {p['name']!r}")
            out.append(p.get("default"))
            continue
        v, kind = given[i].strip("'"), p.get("type", "string")
        try:
            out.append({"integer": int, "float": float, "boolean": lambda x: {"true": True, "false": False}[x.lower()], "string": str}[kind](v))
        except (ValueError, KeyError):
            raise ValidationError(f"parameter {p['name']!r} of join {j.id} is no {kind}: {v!r}") from None
    return tuple(out)
