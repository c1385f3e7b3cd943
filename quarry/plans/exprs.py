"""Selectors and predicates to Columns.

Selectors: "field"; a number, bool or date; a Column; ("literal", v); ("field", sel, alias);
("case", [(predicate, sel), ...], else); ("case_of", sel, {value: result}, else); ("decode", sel, [(m, r)]);
("iif", predicate, a, b); ("custom_sql", "... {{x}} ...", {"x": "field"}); ("subquery", DataFrame or SQL);
("percent_of_total", agg, [dims]); ("func", name, [args]); (name, args...); (aggregate, sel, predicate);
("qualified_field", "join.field"); ("disambiguated_field", "field", join); ("array", name, [fields]), an
aggregate; ("case", field, {value: result, "else": result}).

Predicates: (field, value), (field, None), (field, [values]), (field, (op, value)), ("and"|"or", [..]), ("not", p),
("exists", q), (field, op, ("any"|"all", q)), (field, ("in", q)). q: a DataFrame, Query or SQL text.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import registry as R
from ..functions.dates import date_range

PLAIN = (bool, int, float, decimal.Decimal, dt.date, dt.datetime, dt.time, bytes)
OPS = {
    "=": "eq", "==": "eq", "eq": "eq", "!=": "ne", "<>": "ne", "not_eq": "ne", "ne": "ne", "<": "lt", "lt": "lt", ">": "gt", "gt": "gt", "<=": "le", "lte": "le", "le": "le", ">=": "ge", "gte": "ge", "ge": "ge",
}
COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "ge": lambda a, b: a >= b}
SPECIAL = {"and", "or", "not", "exists"}


def is_aggregate(sel) -> bool:
    if isinstance(sel, (list, tuple)) and sel and isinstance(sel[0], str):
        head = sel[0].lower()
        if head in ("count", "percent_of_total") or head in R.AGGREGATES:
            return True
        if head == "func":
            return sel[1].lower() == "count" or sel[1].lower() in R.AGGREGATES or any(map(is_aggregate, sel[2]))
        if head == "array" and is_named_array(sel):
            return True
        if head == "case" and isinstance(sel[1], str):
            return False
        if head == "case":
            return any(is_aggregate(v) for _, v in sel[1]) or (len(sel) > 2 and is_aggregate(sel[2]))
        if head == "literal":
            return False
        return any(is_aggregate(x) for x in sel[1:])
    return False


def is_named_array(sel) -> bool:
    return len(sel) == 3 and isinstance(sel[1], str) and isinstance(sel[2], list)


def on_aggregate(p) -> bool:
    """Whether a predicate compares an aggregate, so that it holds after grouping."""
    if not isinstance(p, (list, tuple)) or not p:
        return False
    if p[0] in ("and", "or"):
        return any(map(on_aggregate, p[1]))
    return on_aggregate(p[1]) if p[0] == "not" else is_aggregate(p[0])


def is_predicate(p) -> bool:
    return isinstance(p, (list, tuple)) and len(p) in (2, 3) and isinstance(p[0], (str, tuple))


def label(sel) -> str:
    """The default name of a selector: never random."""
    if isinstance(sel, str):
        return sel.split(".")[-1] if "[" not in sel else re.findall(r"\w+", sel)[-1]
    if isinstance(sel, (list, tuple)) and sel and isinstance(sel[0], str):
        if sel[0] == "field" and len(sel) == 3:
            return sel[2]
        if sel[0] == "func":
            return "_".join([sel[1].lower(), *[label(a) for a in sel[2] if isinstance(a, (str, tuple)) and a != "*"]])
        if sel[0] == "literal":
            return str(sel[1])
        if sel[0] == "array" and is_named_array(sel) or sel[0] == "case" and isinstance(sel[1], str):
            return sel[1]
        if sel[0] in ("qualified_field", "disambiguated_field"):
            return label(sel[1])
        return "_".join([sel[0], *[label(a) for a in sel[1:2] if isinstance(a, (str, tuple)) and a != "*"]])
    return str(sel)


class Exprs:
    def __init__(self, scope, spark, aliases: dict[str, Column] | None = None):
        self.scope, self.spark, self.aliases = scope, spark, aliases or {}

    # ---- selectors

    def field(self, f: str) -> Column:
        if f in self.aliases:
            return self.aliases[f]
        custom = self.scope.domain.custom_columns.get(f)
        if custom is not None:
            return custom(self) if callable(custom) else self.sql(custom["sql"], custom.get("fields", {})) if isinstance(custom, dict) else self.sel(custom)
        return self.scope.resolve(f)

    def sql(self, template: str, fields: dict) -> Column:
        """SQL text in which {{x}} stands for a resolved field."""
        missing = set(re.findall(r"{{\s*(\w+)\s*}}", template)) - set(fields)
        if missing:
            raise ValidationError(f"placeholders without a field: {sorted(missing)}")
        return F.expr(re.sub(r"{{\s*(\w+)\s*}}", lambda m: f"`{self.scope.column(fields[m[1]])}`", template))

    def sel(self, s) -> Column:
        if isinstance(s, Column):
            return s
        if isinstance(s, str):
            return self.field(s)
        if s is None or isinstance(s, PLAIN):
            return F.lit(s)
        if not isinstance(s, (list, tuple)) or not s:
            raise ValidationError(f"bad selector {s!r}")
        head, *args = s
        low = head.lower()
        if low == "field":
            return self.sel(args[0])
        if low in ("literal", "literal_string"):
            return F.lit(args[0])
        if low == "qualified_field":
            return self.field(args[0])
        if low == "disambiguated_field":
            return self.field(f"{args[1]}.{args[0]}")
        if low == "array" and is_named_array(s):
            return R.AGGREGATES["array_agg"](self.sel(args[1][0]) if len(args[1]) == 1 else self.sel(("row", *args[1])))
        if low == "row":
            return F.struct(*[self.sel(a).alias(n) for a, n in zip(args, distinct([label(a) for a in args]), strict=True)])
        if low == "case" and isinstance(args[0], str):
            return self._case([(self.sel(args[0]) == F.lit(m), self._result(r)) for m, r in args[1].items() if m != "else"], args[1].get("else"), plain=True)
        if low == "func":
            name, given = args[0], list(args[1])
            if given and given[0] == "DISTINCT":
                return F.count_distinct(*[self.sel(a) for a in given[1:]]) if name.lower() == "count" else self.sel((f"{name.lower()}_distinct", *given[1:]))
            return self.sel((name, *given))
        if low == "case":
            return self._case([(self.whole(p), self.sel(v)) for p, v in args[0]], args[1] if len(args) > 1 else None)
        if low in ("case_of", "decode"):
            c, pairs = self.sel(args[0]), args[1].items() if isinstance(args[1], dict) else args[1]
            return self._case([(c == F.lit(m), self._result(r)) for m, r in pairs], args[2] if len(args) > 2 else None, plain=True)
        if low == "iif":
            return F.when(self.whole(args[0]), self.sel(args[1])).otherwise(self.sel(args[2]))
        if low == "custom_sql":
            return self.sql(args[0], args[1] if len(args) > 1 else {})
        if low == "subquery":
            return self.frame(args[0]).scalar()
        if low == "percent_of_total":
            from pyspark.sql import Window

            total = self.sel(args[0])
            dims = [F.col(f"`{label(d)}`") for d in (args[1] if len(args) > 1 else [])]
            return total / F.sum(total).over(Window.partitionBy(*dims))
        if low == "count":
            return self._count(args)
        if low in R.AGGREGATES:
            cond = args.pop() if len(args) > 1 and is_predicate(args[-1]) and not is_selector(args[-1]) else None
            cols = [self.sel(a) if i not in R.VALUES_AT.get(low, ()) else a for i, a in enumerate(args)]
            if cond is None:
                return R.AGGREGATES[low](*cols)
            keep = self.whole(cond)
            if low in R.FILTERED:
                return R.FILTERED[low](keep, *cols)
            return R.AGGREGATES[low](F.when(keep, cols[0]), *cols[1:])
        at = R.VALUES_AT.get(low, ())
        cols = [a[1] if i in at and isinstance(a, tuple) and a and a[0] == "literal" else a if i in at else self.sel(a) for i, a in enumerate(args)]
        return R.call(head, cols)

    def _count(self, args):
        what = args[0] if args else "*"
        if what == "*":
            c = F.lit(1)
        elif what == "DISTINCT":
            return F.count_distinct(*[self.sel(a) for a in args[1:]])
        else:
            c = self.sel(what)
        return F.count(F.when(self.whole(args[1]), c)) if len(args) > 1 else F.count(c)

    def _result(self, r):
        return r if isinstance(r, Column) else F.lit(r)

    def _case(self, pairs, other, plain=False):
        out = F
        for p, v in pairs:
            out = out.when(p, v)
        return out if other is None else out.otherwise(self._result(other) if plain else self.sel(other))

    # ---- predicates

    def frame(self, q) -> DataFrame:
        return self.spark.sql(q) if isinstance(q, str) else q.df() if hasattr(q, "df") else q

    def all_of(self, preds) -> Column | None:
        cols = [c for c in (self.pred(p) for p in preds) if c is not None]
        return reduce(lambda a, b: a & b, cols) if cols else None

    def whole(self, p) -> Column:
        """A predicate; one without conditions holds."""
        c = self.pred(p)
        return F.lit(True) if c is None else c

    def pred(self, p) -> Column | None:
        if isinstance(p, Column):
            return p
        head = p[0]
        if head in ("and", "or"):
            cols = [c for c in (self.pred(x) for x in p[1]) if c is not None]
            return reduce((lambda a, b: a & b) if head == "and" else (lambda a, b: a | b), cols) if cols else None
        if head == "not":
            inner = self.pred(p[1])
            return None if inner is None else ~inner
        if head == "exists":
            return self.frame(p[1]).exists()
        col = self.sel(head)
        if len(p) == 3:
            op, (how, q) = p[1], p[2]
            return self.quantified(col, op, how, self.frame(q))
        return self.compare(col, p[1], head if isinstance(head, str) else None)

    def compare(self, c: Column, v, f: str | None = None) -> Column:
        if v is None:
            return c.isNull()
        if isinstance(v, (list, set, frozenset)):
            return c.isin([self.typed(f, x) for x in v]) if v else F.lit(False)
        if isinstance(v, tuple):
            op, *rest = v
            low = op.lower() if isinstance(op, str) else op
            if low == "is_null":
                return c.isNull()
            if low == "not_null" or low == "not" and rest == [None]:
                return c.isNotNull()
            if low in OPS:
                return COMPARE[OPS[low]](c, self.value(f, rest[0]))
            if low in ("between", "not_between"):
                a, b = rest if len(rest) == 2 else rest[0]
                out = c.between(self.value(f, a), self.value(f, b))
                return out if low == "between" else ~out
            if low in ("like", "ilike", "not_like", "not_ilike"):
                out = c.like(rest[0]) if low.endswith("_like") or low == "like" else c.ilike(rest[0])
                return ~out if low.startswith("not_") else out
            if low in ("in", "not_in"):
                out = self.compare(c, list(rest[0]), f) if isinstance(rest[0], (list, tuple, set)) else c.isin(self.frame(rest[0]))
                return out if low == "in" else ~out
            if low == "subquery":
                return self.compare(c, (rest[0], rest[1]), f)
            if low == "text_search":
                return text_search(c, rest[0])
            if low == "date":
                a, b = date_range(rest[0])
                return c.between(F.lit(a), F.lit(b))
            if low == "not":
                return ~self.compare(c, rest[0], f)
            if low in R.SCALARS and low in R.VALUES_AT:
                out = R.SCALARS[low](c, rest[0])
                return out if len(rest) == 1 else self.compare(out, rest[1])
            raise ValidationError(f"unknown operator {op!r}")
        if v == "not_null":
            return c.isNotNull()
        return c == self.value(f, v)

    def value(self, f, v):
        if isinstance(v, Column):
            return v
        if isinstance(v, tuple) and len(v) == 2 and v[0] in ("ref", "field"):
            return self.sel(v[1])
        if isinstance(v, tuple):
            return self.sel(v)
        return F.lit(self.typed(f, v))

    def typed(self, f, v):
        """Text given for an integer field is read as a number."""
        if isinstance(v, str) and f and re.fullmatch(r"-?\d+", v):
            kind = (self.scope.domain.source.columns.get(f) or {}).get("type", "")
            if kind in ("id", "integer", "bigint", "int", "long", "smallint"):
                return int(v)
        return v

    def quantified(self, c: Column, op: str, how: str, q: DataFrame) -> Column:
        """x op ANY/ALL (subquery) by the subquery's extremes, with SQL's treatment of NULL."""
        name, op = q.columns[0], OPS[op]
        facts = q.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(name).alias("m"), F.min(name).alias("lo"), F.max(name).alias("hi")).alias("v")).scalar()
        if how == "any" and op == "eq":
            return c.isin(q)
        if how == "all" and op == "ne":
            return ~c.isin(q)
        return extremes(c, op, how, *(facts.getField(k) for k in ("n", "m", "lo", "hi")))


def extremes(c: Column, op: str, how: str, n: Column, m: Column, lo: Column, hi: Column) -> Column:
    """x op ANY/ALL (a set) by the set's size, its values that aren't NULL, the smallest and the largest."""
    nulls = n > m
    if how == "any":
        if op == "eq":
            raise ValidationError("= any needs the values themselves")
        yes = (c != lo) | (c != hi) if op == "ne" else COMPARE[op](c, lo if op in ("gt", "ge") else hi)
        return F.when(n == 0, F.lit(False)).when(yes, F.lit(True)).when(c.isNull() | nulls, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    if how != "all":
        raise ValidationError(f"any or all, not {how!r}")
    if op == "ne":
        raise ValidationError("<> all needs the values themselves")
    no = ~((c == lo) & (c == hi)) if op == "eq" else ~COMPARE[op](c, hi if op in ("gt", "ge") else lo)
    return F.when(n == 0, F.lit(True)).when(no, F.lit(False)).when(c.isNull() | nulls, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def distinct(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        while n in out:
            n += "_1"
        out.append(n)
    return out


def is_selector(p) -> bool:
    """Whether a pair can only be a function call, as ("lower", "x") for an order."""
    return isinstance(p[0], str) and (p[0].lower() in R.SCALARS or p[0] in ("literal", "field")) and p[0] not in SPECIAL


def text_search(c: Column, query: str) -> Column:
    """Web-search words: all of them, "phrases", or, -without. Words by letters and digits, without stemming."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    flat = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    groups, either = [], False
    for neg, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not neg:
            either = True
            continue
        body = " ".join(re.findall(r"\w+", phrase or word))
        if not body:
            continue
        hit = flat.contains(f" {body} ") if " " in body else F.array_contains(words, body)
        hit = ~hit if neg else hit
        if either and groups:
            groups[-1] = groups[-1] | hit
        else:
            groups.append(hit)
        either = False
    return reduce(lambda a, b: a & b, groups) if groups else F.lit(False)
