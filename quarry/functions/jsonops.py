"""JSON in text columns. Paths are $.a.b[0] or a.b[0]. Edits at a path are the one place with a pandas UDF."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ValidationError

STEP = re.compile(r"\.?([A-Za-z_][A-Za-z0-9_]*)|\[(\d+)\]")


def steps(path) -> list:
    """The keys and indexes of a path."""
    if isinstance(path, (list, tuple)):
        return list(path)
    rest, out = path[1:] if path.startswith("$") else path, []
    while rest:
        m = STEP.match(rest)
        if not m:
            raise ValidationError(f"bad JSON path {path!r}")
        out.append(m[1] if m[1] is not None else int(m[2]))
        rest = rest[m.end() :]
    return out


def full(path) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps(path))


def extract(c: Column, path) -> Column:
    """->: the JSON text of the value at a path, so strings are in quotes."""
    return F.to_json(F.try_variant_get(F.try_parse_json(c), full(path), "variant"))


def extract_text(c: Column, path) -> Column:
    """->>: text for strings, JSON text for the rest, NULL for JSON null."""
    return F.get_json_object(c, full(path))


def path_exists(c: Column, path) -> Column:
    """True also where the value is JSON null."""
    *head, last = steps(path)
    parent = F.get_json_object(c, full(head)) if head else c
    if isinstance(last, int):
        return F.coalesce(F.json_array_length(parent) > last, F.lit(False))
    return F.coalesce(F.array_contains(F.json_object_keys(parent), last), F.lit(False))


def exists(c: Column, key: str) -> Column:
    return path_exists(c, [key])


def contains(c: Column, pattern) -> Column:
    """@>: objects by key, arrays by element, plain values by type and value."""
    return F.coalesce(_contains(F.try_parse_json(c), json.loads(pattern) if isinstance(pattern, str) else pattern), F.lit(False))


def _kind(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (
        F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.isNotNull(), "number")
    )


def _contains(v: Column, p) -> Column:
    if isinstance(p, dict):
        out = _kind(v) == "object"
        for k, x in p.items():
            out = out & F.coalesce(_contains(F.try_variant_get(v, full([k]), "variant"), x), F.lit(False))
        return out
    if isinstance(p, list):
        own, out = F.try_variant_get(v, "$", "array<variant>"), _kind(v) == "array"
        for x in p:
            out = out & F.coalesce(F.exists(own, (lambda x: lambda e: F.coalesce(_contains(e, x), F.lit(False)))(x)), F.lit(False))
        return out
    if p is None:
        return F.is_variant_null(v)
    if isinstance(p, bool):
        return (_kind(v) == "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(p))
    if isinstance(p, str):
        return (_kind(v) == "string") & (F.try_variant_get(v, "$", "string") == F.lit(p))
    return (_kind(v) == "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(p)))


def contained(c: Column, whole) -> Column:
    """<@ for objects of plain values: each key of the column is in whole, with the same value."""
    whole = json.loads(whole) if isinstance(whole, str) else whole
    text = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    own = F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    if not whole:
        return F.coalesce(F.size(own) == 0, F.lit(False))
    known = F.create_map(*[F.lit(y) for k, v in whole.items() for y in (k, text(v))])
    same = F.forall(F.map_entries(own), lambda e: F.coalesce(F.element_at(known, e["key"]) == F.to_json(e["value"]), F.lit(False)))
    return F.coalesce(same, F.lit(False))


def typeof(c: Column) -> Column:
    """The type of JSON text; NULL if it isn't JSON."""
    return _kind(F.try_parse_json(c))


def build_object(*pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(_scalar(pairs[i].cast("string")), F.lit(":"), _scalar(pairs[i + 1])) for i in range(0, len(pairs), 2)]), F.lit("}"))


def build_array(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[_scalar(x) for x in items]), F.lit("]"))


def _scalar(c: Column) -> Column:
    """The JSON text of one value."""
    text = F.to_json(F.array(c))
    return F.coalesce(F.substring(text, 2, 2**31 - 1).substr(F.lit(1), F.length(text) - 2), F.lit("null"))


def agg(c: Column, order: Column | None = None, keep: Column | None = None) -> Column:
    from .arrays import agg as array_agg

    return F.to_json(array_agg(c, order, keep), {"ignoreNullFields": "false"})


def object_agg(k: Column, v: Column, keep: Column | None = None, last: bool = False) -> Column:
    """An object of all pairs, by key. A repeated key stays in json_object_agg; jsonb_object_agg (last) keeps its largest value."""
    pair = F.struct(F.coalesce(k.cast("string"), F.raise_error(F.lit("a key of a JSON object is null"))).alias("k"), v.alias("v"))
    pairs = F.array_sort(F.collect_list(pair if keep is None else F.when(keep, pair)))
    if last:
        after = F.slice(F.concat(F.transform(pairs, lambda e: e["k"]), F.array(F.lit(None).cast("string"))), F.lit(2), F.size(pairs))
        pairs = F.array_compact(F.zip_with(pairs, after, lambda e, n: F.when(~e["k"].eqNullSafe(n), e)))
    inner = F.transform(pairs, lambda e: F.concat(_scalar(e["k"]), F.lit(":"), _scalar(e["v"])))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")))


def _edit(kind: str, path, value):
    at = steps(path)

    @F.pandas_udf("string")
    def run(s):
        def one(text):
            if text is None:
                return None
            doc = json.loads(text)
            node = doc
            for k in at[:-1]:
                if isinstance(node, dict) and k in node or isinstance(node, list) and isinstance(k, int) and k < len(node):
                    node = node[k]
                else:
                    return text
            k = at[-1]
            if isinstance(node, dict):
                if kind == "remove":
                    node.pop(k, None)
                elif kind == "set" or k not in node:
                    node[k] = value
            elif isinstance(node, list) and isinstance(k, int):
                if kind == "insert":
                    node.insert(k, value)
                elif k < len(node):
                    node.pop(k) if kind == "remove" else node.__setitem__(k, value)
                elif kind == "set":
                    node.append(value)
            return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)

        return s.map(one, na_action="ignore")

    return run


def set_path(c: Column, path, value) -> Column:
    return _edit("set", path, value)(c)


def insert_path(c: Column, path, value) -> Column:
    return _edit("insert", path, value)(c)


def remove_path(c: Column, path) -> Column:
    return _edit("remove", path, None)(c)
