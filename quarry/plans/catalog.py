"""Registered queries of the core engine: name -> callable, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import date_range
from ..operators import joins
from ..operators.hierarchy import adjacency, closure, materialized_path
from ..sources import tables as src
from ..sources.tables import Tables
from ..streaming.windows import windowed
from .domain import Domain
from .query import Query, configure
from .workspace import checkpoint

QUERIES = {}
SQL = {}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}
LINKS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
NATION = {"customer": {"joins": {"nation": {"joins": {"region": {}}}}}}


def on(spark: SparkSession, sf_dir: str, source: str, joins_: dict | None = None, only: tuple = (), **more) -> Query:
    names = only or tuple(KEYS)
    t = Tables(spark, sf_dir)
    return configure(spark, Domain.from_tables({n: t(n) for n in names}, source, KEYS, [x for x in LINKS if x[0] in names and x[2] in names], joins_, **more), t)


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: (lambda r: r.df() if isinstance(r, Query) else r)(f(lambda source, joins_=None, **m: on(spark, sf_dir, source, joins_, **m)))
        if sql:
            SQL[name] = sql
        return f

    return keep


def numbered(df):
    """An ordered df with n, the place of each row from 1. Each task numbers a range of the order; none holds all rows."""
    rows = checkpoint(df).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    before = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before, part == F.col("_part")).select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n"))


def r2(sel):
    return ("round", sel, 2)


# ---------------------------------------------------------------- flagship, projections

add("revenue_by_nation", "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY n_name")(
    lambda q: q("orders", NATION).select("nation.n_name", ("field", ("count", "*"), "n_orders"), ("field", r2(("sum", "o_totalprice")), "revenue")).filter(("o_totalprice", (">", 1000))).group_by("nation.n_name").order_by(("revenue", "desc"))
)
add("select_fields", "SELECT c_custkey, c_name, c_acctbal AS balance FROM customer")(lambda q: q("customer").select("c_custkey", "customer.c_name", "customer.c_name", ("field", "c_acctbal", "balance")))
add("select_default", "SELECT r_regionkey, r_name FROM region")(lambda q: q("region"))
add("custom_sql", "SELECT c_custkey, upper(c_name) || '/' || c_mktsegment AS tag, c_acctbal * 2 AS twice FROM customer")(
    lambda q: q("customer", custom_columns={"twice": {"sql": "{{b}} * 2", "fields": {"b": "c_acctbal"}}}).select("c_custkey", ("field", ("custom_sql", "upper({{n}}) || '/' || {{s}}", {"n": "c_name", "s": "c_mktsegment"}), "tag"), "twice")
)
add("row_struct", "SELECT c_custkey, c_name AS a, c_mktsegment AS b FROM customer")(lambda q: q("customer").select("c_custkey", ("field", ("row", "c_name", "c_mktsegment"), "r")).df().select("c_custkey", F.col("r.c_name").alias("a"), F.col("r.c_mktsegment").alias("b")))
add("literals", "SELECT r_regionkey, 1 AS one, 'x''y' AS s, TRUE AS t FROM region")(lambda q: q("region").select("r_regionkey", ("field", ("literal", 1), "one"), ("field", ("literal", "x'y"), "s"), ("field", True, "t")))
add("coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS s, nullif(o_orderpriority, o_orderstatus) AS p FROM orders")(
    lambda q: q("orders").select("o_orderkey", ("field", ("coalesce", ("nullif", "o_orderstatus", ("literal", "F")), ("literal", "none")), "s"), ("field", ("nullif", "o_orderpriority", "o_orderstatus"), "p"))
)
add("greatest_least", "SELECT p_partkey, greatest(p_size, 25, nullif(p_size, p_size)) AS g, least(p_size, 25) AS l, concat(p_brand, NULL, p_type) AS c FROM part")(
    lambda q: q("part").select("p_partkey", ("field", ("greatest", "p_size", 25, ("nullif", "p_size", "p_size")), "g"), ("field", ("least", "p_size", 25), "l"), ("field", ("concat", "p_brand", None, "p_type"), "c"))
)
add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders")(lambda q: q("orders").select("o_orderkey", ("field", ("case_of", "o_orderstatus", {"F": "done", "O": "open"}, "other"), "s")))
add("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND o_orderstatus = 'F' THEN 'a' WHEN o_totalprice < 1000 THEN 'b' ELSE 'c' END AS s FROM orders")(
    lambda q: q("orders").select("o_orderkey", ("field", ("case", [(("and", [("o_totalprice", (">", 100000)), ("o_orderstatus", "F")]), ("literal", "a")), (("o_totalprice", ("<", 1000)), ("literal", "b"))], ("literal", "c")), "s"))
)
add("decode_iif", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 END AS d, CASE WHEN o_totalprice >= 1000 THEN 'hi' ELSE 'lo' END AS i FROM orders")(
    lambda q: q("orders").select("o_orderkey", ("field", ("decode", "o_orderstatus", [("F", 1), ("P", 2)]), "d"), ("field", ("iif", ("o_totalprice", (">=", 1000)), ("literal", "hi"), ("literal", "lo")), "i"))
)
add("arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice / nullif(l_linenumber - 1, 0), 4) AS d FROM lineitem")(
    lambda q: q("lineitem").select("l_orderkey", "l_linenumber", ("field", ("round", ("mul", "l_extendedprice", ("sub", 1, "l_discount")), 4), "net"), ("field", ("round", ("div", "l_extendedprice", ("sub", "l_linenumber", 1)), 4), "d"))
)
add("scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders) AS m FROM customer")(lambda q: q("customer").select("c_custkey", ("field", ("subquery", q("orders").select(("max", "o_totalprice"))), "m")))
add("percent_of_total", "SELECT o_orderstatus, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share FROM orders GROUP BY o_orderstatus")(
    lambda q: q("orders").select("o_orderstatus", ("field", ("percent_of_total", ("sum", "o_totalprice")), "p")).group_by("o_orderstatus").df().select("o_orderstatus", F.round("p", 6).alias("share"))
)

# ---------------------------------------------------------------- functions

add("fn_string", "SELECT c_custkey, substr(c_name, 2, 4) AS a, trim('  ' || c_name || ' ') AS b, upper(c_name) AS c, lower(c_name) AS d, length(c_name) AS e, position('#' IN c_name) AS f, replace(c_name, '#', '-') AS g, split_part(c_name, '#', 2) AS h FROM customer")(
    lambda q: q("customer").select("c_custkey", ("field", ("substr", "c_name", 2, 4), "a"), ("field", ("trim", ("concat", ("literal", "  "), "c_name", ("literal", " "))), "b"), ("field", ("upper", "c_name"), "c"), ("field", ("lower", "c_name"), "d"), ("field", ("length", "c_name"), "e"), ("field", ("position", "#", "c_name"), "f"), ("field", ("replace", "c_name", "#", "-"), "g"), ("field", ("split_part", "c_name", "#", 2), "h"))
)
add("fn_math", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS c, round(c_acctbal) AS d, round(c_acctbal, 1) AS e, round(power(c_acctbal / 1000, 2), 6) AS f, round(sqrt(abs(c_acctbal)), 6) AS g, c_custkey % 7 AS h FROM customer")(
    lambda q: q("customer").select("c_custkey", ("field", ("abs", "c_acctbal"), "a"), ("field", ("ceil", "c_acctbal"), "b"), ("field", ("floor", "c_acctbal"), "c"), ("field", ("round", "c_acctbal"), "d"), ("field", ("round", "c_acctbal", 1), "e"), ("field", ("round", ("power", ("div", "c_acctbal", 1000), 2), 6), "f"), ("field", ("round", ("sqrt", ("abs", "c_acctbal")), 6), "g"), ("field", ("mod", "c_custkey", 7), "h"))
)
add("fn_date", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, o_orderdate + INTERVAL 3 DAY AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS s FROM orders")(
    lambda q: q("orders").select("o_orderkey", ("field", ("date_trunc", "month", "o_orderdate"), "m"), ("field", ("add", "o_orderdate", ("interval", 3, "days")), "d"), ("field", ("to_char", "o_orderdate", "YYYY-MM-DD HH24:MI"), "s"))
)
PARTS = ("year", "quarter", "month", "week", "day", "hour", "dow", "isodow", "doy")
add("fn_extract", "SELECT o_orderkey, " + ", ".join(f"extract({p} FROM o_orderdate)::BIGINT AS p_{p}" for p in PARTS) + ", epoch(o_orderdate)::BIGINT AS p_epoch FROM orders")(
    lambda q: q("orders").select("o_orderkey", *[("field", ("extract", "o_orderdate", p), f"p_{p}") for p in (*PARTS, "epoch")]).df().select("o_orderkey", *[F.col(f"p_{p}").cast("bigint").alias(f"p_{p}") for p in (*PARTS, "epoch")])
)
add("fn_age", "SELECT o_orderkey, date_diff('month', DATE '1990-01-01', o_orderdate::DATE) // 12 AS years, date_diff('month', DATE '1990-01-01', o_orderdate::DATE) % 12 AS months, (day(o_orderdate) - 1)::INT AS days FROM orders")(
    lambda q: q("orders").select("o_orderkey", ("field", ("age", "o_orderdate", F.lit("1990-01-01").cast("date")), "a")).df().select("o_orderkey", F.col("a.years").cast("bigint").alias("years"), F.col("a.months").cast("bigint").alias("months"), F.col("a.days").alias("days"))
)

# ---------------------------------------------------------------- predicates

FILTERS = {
    "filter_cmp": (("o_totalprice", (">=", 5000)), "o_totalprice >= 5000"),
    "filter_eq_alias": (("and", [("o_orderstatus", ("not_eq", "F")), ("o_orderkey", ("lte", "500"))]), "o_orderstatus <> 'F' AND o_orderkey <= 500"),
    "filter_between": (("o_totalprice", ("between", 1000, 50000)), "o_totalprice BETWEEN 1000 AND 50000"),
    "filter_not_between": (("o_totalprice", ("not_between", 1000, 50000)), "o_totalprice NOT BETWEEN 1000 AND 50000"),
    "filter_in": (("o_orderstatus", ["F", "P"]), "o_orderstatus IN ('F', 'P')"),
    "filter_in_empty": (("o_orderstatus", []), "FALSE"),
    "filter_like": (("or", [("o_orderpriority", ("like", "1%")), ("o_orderpriority", ("ilike", "%LOW"))]), "o_orderpriority LIKE '1%' OR o_orderpriority ILIKE '%LOW'"),
    "filter_null": ((("nullif", "o_orderstatus", ("literal", "F")), None), "nullif(o_orderstatus, 'F') IS NULL"),
    "filter_not_null": ((("nullif", "o_orderstatus", ("literal", "F")), "not_null"), "nullif(o_orderstatus, 'F') IS NOT NULL"),
    "filter_bool_tree": (("or", [("and", [("o_orderstatus", "F"), ("o_totalprice", ("<", 2000))]), ("not", ("o_orderkey", (">", 100))), ("and", [])]), "(o_orderstatus = 'F' AND o_totalprice < 2000) OR NOT o_orderkey > 100"),
    "filter_field_ref": (("o_orderkey", ("<", ("field", "o_custkey"))), "o_orderkey < o_custkey"),
    "filter_text_search": (("o_orderpriority", ("text_search", "urgent or low -medium")), "o_orderpriority ILIKE '%urgent%' OR o_orderpriority ILIKE '%low%'"),
    "filter_date": (("o_orderdate", ("date", "1996-02")), "o_orderdate BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-02-29 23:59:59.999999'"),
}
for _n, (_p, _s) in FILTERS.items():
    add(_n, f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_s}")(lambda q, p=_p: q("orders").select("o_orderkey", "o_totalprice").filter(p))
add("required_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")(lambda q: q("orders", required_filters=[("o_orderstatus", "F")]).select("o_orderkey").filter(("o_totalprice", (">", 1000))))
BIG = "SELECT o_custkey FROM orders WHERE o_totalprice > 400000"
big = lambda q: q("orders").select("o_custkey").filter(("o_totalprice", (">", 400000)))
add("subq_in", f"SELECT c_custkey FROM customer WHERE c_custkey IN ({BIG})")(lambda q: q("customer").select("c_custkey").filter(("c_custkey", ("in", big(q)))))
add("subq_not_in", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN ({BIG})")(lambda q: q("customer").select("c_custkey").filter(("c_custkey", ("not_in", big(q)))))
add("subq_any", "SELECT o_orderkey FROM orders WHERE o_totalprice > ANY (SELECT c_acctbal * 40 FROM customer)")(lambda q: q("orders").select("o_orderkey").filter(("o_totalprice", ">", ("any", q("customer").select(("mul", "c_acctbal", 40))))))
add("subq_all", "SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT c_acctbal * 40 FROM customer)")(lambda q: q("orders").select("o_orderkey").filter(("o_totalprice", ">=", ("all", q("customer").select(("mul", "c_acctbal", 40))))))
add("subq_exists", f"SELECT c_custkey FROM customer WHERE EXISTS ({BIG})")(lambda q: q("customer").select("c_custkey").filter(("exists", big(q))))

# ---------------------------------------------------------------- joins

add("join_left", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")(lambda q: q("orders", {"customer": {}}).select("o_orderkey", "customer.c_name"))
add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")(lambda q: q("orders", {"customer": {"type": "inner"}}).select("o_orderkey", "customer.c_name").filter(("customer.c_acctbal", (">", 0))))
add("join_nested", "SELECT o_orderkey, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")(lambda q: q("orders", NATION).select("o_orderkey", "customer[nation][region][r_name]"))
add("join_self", "SELECT a.n_name AS n_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(
    lambda q: q("nation", {"peer": {"type": "self_join", "self_key": "n_regionkey", "target_key": "n_regionkey", "join_type": "inner", "and": [("n_nationkey", "<", "n_nationkey")]}}).select("n_name", ("field", "peer.n_name", "other"))
)
add("join_cross", "SELECT a.r_name AS r_name, b.r_name AS other FROM region a CROSS JOIN region b")(lambda q: q("region", {"other": {"type": "cross_join", "schema": "region"}}).select("r_name", ("field", "other.r_name", "other")))
add("join_full", "SELECT n_name, r_name, coalesce(r_name, 'No match') AS shown FROM nation FULL JOIN region ON n_nationkey = r_regionkey")(
    lambda q: q("nation", {"r": {"type": "full_outer_join", "schema": "region", "owner_key": "n_nationkey", "related_key": "r_regionkey", "display_field": "r_name"}}).select("n_name", "r.r_name", ("field", "r.coalesced", "shown"))
)
add("join_theta", "SELECT s_suppkey, r_name FROM supplier JOIN region ON s_nationkey < r_regionkey")(lambda q: q("supplier", {"r": {"type": "conditional_join", "schema": "region", "join_type": "inner", "conditions": [("field_comparison", "s_nationkey", "<", "r_regionkey")]}}).select("s_suppkey", "r.r_name"))
add("join_range", "SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY")(
    lambda q: q("lineitem", {"o": {"type": "conditional_join", "schema": "orders", "join_type": "inner", "conditions": [("field_comparison", "l_orderkey", "=", "o_orderkey"), lambda at, own: at("l_shipdate").between(own("o_orderdate"), own("o_orderdate") + F.expr("INTERVAL '60' DAY"))]}}).select("l_orderkey", "l_linenumber", "l_shipdate", "o.o_orderdate")
)
SEGMENT = {"customer": {"parameters": [{"name": "segment", "type": "string", "required": True}, {"name": "least", "type": "float", "default": 0.0}], "condition": lambda own, p: (own("c_mktsegment") == p["segment"]) & (own("c_acctbal") >= p["least"])}}
add("join_param", "SELECT o_orderkey, a.c_name AS builder, b.c_name AS rich FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey AND a.c_mktsegment = 'BUILDING' AND a.c_acctbal >= 0 LEFT JOIN customer b ON o_custkey = b.c_custkey AND b.c_mktsegment = 'MACHINERY' AND b.c_acctbal >= 500")(
    lambda q: q("orders", SEGMENT).select("o_orderkey", ("field", "customer:BUILDING.c_name", "builder"), ("field", "customer:MACHINERY:500.c_name", "rich"))
)
add("join_asof", "SELECT event_id, user_id, prev_id FROM (SELECT event_id, user_id, event_type, max_by(event_id, ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS prev_id FROM events) WHERE event_type = 'click'")(
    lambda q: joins.as_of(q("events").tables("events").where("event_type = 'click'").select("event_id", "user_id", "ts"), q("events").tables("events").where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("prev_id")), ["user_id"], "ts", "ts", ["prev_id"]).select("event_id", "user_id", "prev_id")
)
STAR = {"part": {"type": "star_dimension", "display_field": "p_brand"}, "supplier": {"type": "star_dimension", "display_field": "s_name"}}
add("star_dim", "SELECT p_brand AS brand, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY p_brand")(
    lambda q: q("lineitem", STAR).select(("field", "part.display", "brand"), ("field", ("count", "*"), "n"), ("field", r2(("sum", "l_quantity")), "qty")).filter(("supplier.s_acctbal", (">", 0))).group_by("part.display")
)
add("snowflake", "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda q: q("customer", {"nation": {"type": "snowflake_dimension", "normalization_joins": [{"table": "region", "foreign_key": "n_regionkey", "key": "r_regionkey", "fields": ["r_name"]}]}}).select("c_custkey", ("field", "nation.n_name", "nation"), ("field", "nation.region_r_name", "region"))
)
add("dimension", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")(
    lambda q: q("customer", {"nation": {"type": "dimension", "dimension": "n_name"}}).select("nation.n_name", ("field", ("count", "*"), "n")).group_by("nation.n_name", "nation.n_nationkey")
)

# ---------------------------------------------------------------- tagging, hierarchies

TAGS = {"tags": {"type": "tagging", "schema": "part", "owner_key": "o_orderkey", "related_key": "p_partkey", "join_table": "lineitem", "main_foreign_key": "l_orderkey", "tag_foreign_key": "l_partkey", "tag_field": "p_brand"}}
BRANDS = "(SELECT DISTINCT l_orderkey, l_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)"
add("tag_list", f"SELECT o_orderkey, string_agg(p_brand, ', ' ORDER BY p_brand) AS tags, count(DISTINCT l_partkey) AS n FROM orders LEFT JOIN {BRANDS} ON l_orderkey = o_orderkey GROUP BY o_orderkey")(lambda q: q("orders", TAGS).select("o_orderkey", ("field", "tags.list", "tags"), ("field", "tags.count", "n")))
add("tag_facet_any", f"SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM {BRANDS} WHERE p_brand IN ('Brand#11', 'Brand#22'))")(lambda q: q("orders", TAGS).select("o_orderkey").tag_facet("tags", ["Brand#11", "Brand#22"]))
add("tag_facet_all", f"SELECT l_orderkey AS o_orderkey FROM {BRANDS} WHERE p_brand IN ('Brand#11', 'Brand#22') GROUP BY l_orderkey HAVING count(DISTINCT p_brand) = 2")(lambda q: q("orders", TAGS).select("o_orderkey").tag_facet("tags", ["Brand#11", "Brand#22"], "all"))
add("tag_count_filter", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(DISTINCT l_partkey) <= 2")(lambda q: q("orders", TAGS).select("o_orderkey").tag_count("tags", "<=", 2))
add("hier_path", "SELECT p_partkey, len(string_split(p_name, ' ')) - 1 AS depth, string_split(p_name, ' ')[1] AS head FROM part")(lambda q: materialized_path(q("part").tables("part").select("p_partkey", "p_name"), "p_name", " ").select("p_partkey", F.col("depth").cast("bigint").alias("depth"), F.col("path_array")[0].alias("head")))


TREE = "SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey // 3 END AS parent FROM customer"


def tree(q):
    return q("customer").tables("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") != 0, F.floor(F.col("c_custkey") / 3)).alias("parent"))


add("hier_adjacency", f"WITH RECURSIVE t AS ({TREE}), h AS (SELECT id, 0 AS level, id::VARCHAR AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, h.level + 1, h.path || '/' || t.id FROM t JOIN h ON t.parent = h.id) SELECT * FROM h")(lambda q: adjacency(tree(q), "id", "parent", None).select("id", "level", "path"))


def links(q):
    return adjacency(tree(q), "id", "parent", None).select(F.col("id").alias("d"), F.posexplode(F.reverse("path_array")).alias("depth", "a"))


add("hier_closure", f"WITH RECURSIVE t AS ({TREE}), h AS (SELECT id, [id] AS up, 0 AS level FROM t WHERE parent IS NULL UNION ALL SELECT t.id, list_prepend(t.id, h.up), h.level + 1 FROM t JOIN h ON t.parent = h.id), c AS (SELECT id AS d, unnest(up) AS a, unnest(range(len(up))) AS depth FROM h), n AS (SELECT a, count(*) AS k FROM c GROUP BY a) SELECT d AS id, depth::INT AS depth, k AS descendants FROM c LEFT JOIN n ON n.a = c.d")(
    lambda q: closure(tree(q), "id", links(q), "a", "d", "depth").where("depth IS NOT NULL").select("id", "depth", F.col("descendant_count").alias("descendants"))  # no nodes that no root reaches
)

# ---------------------------------------------------------------- aggregation

add("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")(
    lambda q: q("orders").select(("field", ("count",), "n"), ("field", r2(("sum", "o_totalprice")), "s"), ("field", ("round", ("avg", "o_totalprice"), 4), "a"), ("field", ("min", "o_totalprice"), "lo"), ("field", ("max", "o_totalprice"), "hi"))
)
add("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")(
    lambda q: q("lineitem").select("l_returnflag", "l_linestatus", ("field", ("count", "*"), "n"), ("field", r2(("sum", ("mul", "l_extendedprice", ("sub", 1, "l_discount")))), "revenue")).group_by("l_returnflag", "l_linestatus")
)
add("agg_filter", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (o_totalprice > 1000), 2) AS s FROM orders GROUP BY o_orderpriority")(
    lambda q: q("orders").select("o_orderpriority", ("field", ("count", "*", ("o_orderstatus", "F")), "f"), ("field", r2(("sum", "o_totalprice", ("o_totalprice", (">", 1000)))), "s")).group_by("o_orderpriority")
)
TWO = [("field", ("count", "*"), "n"), ("field", r2(("sum", "o_totalprice")), "s")]
for _k, _s in (("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"), ("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")):
    add(f"agg_{_k}", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY {_s}")(
        lambda q, k=_k: q("orders").select("o_orderstatus", "o_orderpriority", *TWO).group_by(*([("o_orderstatus",), ("o_orderpriority",), ()] if k == "sets" else ["o_orderstatus", "o_orderpriority"]), kind=k).order_by("o_orderstatus", "o_orderpriority")
    )
add("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000")(lambda q: q("orders").select("o_custkey", ("field", ("count", "*"), "n")).group_by("o_custkey").having(("n", (">", 12)), (("max", "o_totalprice"), (">", 1000))))
add("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS a, count(DISTINCT l_suppkey) AS b FROM lineitem GROUP BY l_returnflag")(lambda q: q("lineitem").select("l_returnflag", ("field", ("count_distinct", "l_partkey"), "a"), ("field", ("func", "count", ["DISTINCT", "l_suppkey"]), "b")).group_by("l_returnflag"))
add("agg_stddev", "SELECT o_orderstatus, round(stddev(o_totalprice), 4) AS s, round(variance(o_totalprice / 1000), 4) AS v FROM orders GROUP BY o_orderstatus")(lambda q: q("orders").select("o_orderstatus", ("field", ("round", ("stddev", "o_totalprice"), 4), "s"), ("field", ("round", ("variance", ("div", "o_totalprice", 1000)), 4), "v")).group_by("o_orderstatus"))
add("agg_string", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey")(lambda q: q("nation").select("n_regionkey", ("field", ("string_agg", "n_name", "; "), "s")).group_by("n_regionkey"))
add("agg_array", "SELECT n_regionkey, len(list(nullif(n_nationkey, 3))) AS n, array_to_string(list(n_name ORDER BY n_name), '|') AS s, count(DISTINCT n_name) AS d FROM nation GROUP BY n_regionkey")(
    lambda q: q("nation").select("n_regionkey", ("field", ("array_agg", ("nullif", "n_nationkey", 3)), "x"), ("field", ("array_agg", "n_name"), "y"), ("field", ("array_agg_distinct", "n_name"), "z")).group_by("n_regionkey").df().select("n_regionkey", F.size("x").cast("bigint").alias("n"), F.array_join("y", "|").alias("s"), F.size("z").cast("bigint").alias("d"))
)

# ---------------------------------------------------------------- windows

O = ("o_orderdate", "o_orderkey")  # noqa: E741
W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
WINDOWS = {
    "win_rownum": (("row_number",), {}, f"row_number() {W})"),
    "win_rank": (("rank",), {"over": ("o_orderstatus",), "order": (("o_orderpriority", "desc"),)}, "rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC)"),
    "win_dense": (("dense_rank",), {"over": ("o_orderstatus",), "order": ("o_orderpriority",)}, "dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)"),
    "win_ntile": (("ntile",), {}, f"ntile(4) {W})"),
    "win_lag": (("lag", "o_totalprice"), {}, f"lag(o_totalprice) {W})"),
    "win_lead": (("lead", "o_totalprice", 2), {}, f"lead(o_totalprice, 2) {W})"),
    "win_first": (("first_value", "o_totalprice"), {}, f"first_value(o_totalprice) {W})"),
    "win_last": (("last_value", "o_totalprice"), {}, f"last_value(o_totalprice) {W})"),
    "win_count": (("count",), {}, f"count(*) {W})"),
    "win_moving_max": (("max", "o_totalprice"), {"frame": ("rows", ("preceding", 2), ("following", 1))}, f"max(o_totalprice) {W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"),
    "win_tail_min": (("min", "o_totalprice"), {"frame": ("rows", "current_row", "unbounded_following")}, f"min(o_totalprice) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
}
for _n, (_f, _o, _s) in WINDOWS.items():
    add(_n, f"SELECT o_orderkey, {_s} AS w FROM orders")(lambda q, f=_f, o=_o: q("orders").select("o_orderkey").window(*f, over=o.get("over", ("o_custkey",)), order=o.get("order", O), frame=o.get("frame"), as_="w"))
add("win_pctrank", "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 8) AS w FROM orders")(lambda q: q("orders").select("o_orderkey").window("percent_rank", over=("o_orderstatus",), order=("o_totalprice",), as_="w").df().select("o_orderkey", F.round("w", 8).alias("w")))
add("win_running", f"SELECT o_orderkey, round(sum(o_totalprice) {W}), 2) AS w FROM orders")(lambda q: q("orders").select("o_orderkey").window("sum", "o_totalprice", over=("o_custkey",), order=O, as_="w").df().select("o_orderkey", F.round("w", 2).alias("w")))
add("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS w FROM events")(lambda q: q("events").select("event_id").window("count", over=("user_id",), order=("ts",), frame=("range", ("interval", "1 day"), "current_row"), as_="w"))
add("win_over_agg", "SELECT o_orderpriority, count(*) AS n, lag(count(*)) OVER (ORDER BY o_orderpriority) AS prev FROM orders GROUP BY o_orderpriority")(lambda q: q("orders").select("o_orderpriority", ("field", ("count", "*"), "n")).group_by("o_orderpriority").window("lag", "n", order=("o_orderpriority",), as_="prev"))

# ---------------------------------------------------------------- order, limit, sets

add("order_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS n FROM orders")(
    lambda q: numbered(q("orders").select("o_orderkey", ("field", ("nullif", "o_orderstatus", ("literal", "F")), "s")).order_by(("desc_nulls_last", "s"), "o_orderkey").df())
)
add("order_bare_nulls_first", "SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') NULLS FIRST, o_totalprice DESC, o_orderkey) AS n FROM orders")(
    lambda q: numbered(q("orders").select("o_orderkey").order_by(("nullif", "o_orderstatus", ("literal", "F")), ("desc", "o_totalprice"), ("asc", "o_orderkey")).df())
)
add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda q: q("orders").select("o_orderkey", "o_totalprice").order_by(("o_totalprice", "desc"), "o_orderkey").limit(10))
add("paginate", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")(lambda q: q("customer").select("c_custkey").order_by("c_custkey").page(3, 20))
add("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(lambda q: q("orders").select("o_orderstatus", "o_orderpriority").distinct())
A, B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey FROM supplier WHERE s_acctbal > 0"
a_ = lambda q: q("customer").select(("field", "c_nationkey", "k")).filter(("c_acctbal", (">", 5000)))
b_ = lambda q: q("supplier").select("s_nationkey").filter(("s_acctbal", (">", 0)))
for _n, _m, _s in (("union", "union", "UNION"), ("intersect", "intersect", "INTERSECT"), ("except", "except_", "EXCEPT")):
    add(_n, f"{A} {_s} {B}")(lambda q, m=_m: getattr(a_(q), m)(b_(q)))
    add(f"{_n}_all", f"{A} {_s} ALL {B}")(lambda q, m=_m: getattr(a_(q), m)(b_(q), all=True))
add("setop_chain", f"SELECT * FROM (SELECT * FROM ({A} UNION {B}) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3) ORDER BY k DESC LIMIT 5")(lambda q: a_(q).union(b_(q)).intersect(q("nation").select("n_nationkey").filter(("n_regionkey", ("<", 3)))).order_by(("k", "desc")).limit(5))
add("setop_mapping", "SELECT c_custkey AS id, c_name AS name FROM customer UNION SELECT s_suppkey, s_name FROM supplier")(
    lambda q: q("customer").select(("field", "c_custkey", "id"), ("field", "c_name", "name")).union(q("supplier").select("s_name", "s_suppkey"), mapping={"id": "s_suppkey", "name": "s_name"})
)

# ---------------------------------------------------------------- named frames, recursion, laterals

add("cte_simple", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT c_custkey, round(s, 2) AS s FROM customer JOIN big ON c_custkey = o_custkey WHERE s > 100000")(
    lambda q: q("customer").with_cte("big", q("orders").select("o_custkey", ("field", ("sum", "o_totalprice"), "s")).group_by("o_custkey")).join_frame("big", [("c_custkey", "o_custkey")]).select("c_custkey", ("field", r2("big.s"), "s")).filter(("big.s", (">", 100000)))
)
add("cte_chain", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT c_custkey, a.n, m FROM customer JOIN a ON k = c_custkey JOIN b ON a.n = b.n")(
    lambda q: q("customer").with_ctes({"b": (lambda f: f["a"].groupBy("n").agg(F.count("*").alias("m")), ["a"]), "a": (lambda f: q("orders").select("o_custkey", ("count", "*")).group_by("o_custkey").df().toDF("k", "n"), [])}).join_frame("a", [("c_custkey", "k")]).join_frame("b", [("a.n", "n")]).select("c_custkey", "a.n", "b.m")
)
add("cte_recursive", "WITH RECURSIVE s AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 8) SELECT r_regionkey, n, f FROM region JOIN s ON n > r_regionkey")(
    lambda q: q("region").with_recursive_cte("s", src.values(q("region").spark, [[1, 1]], ["n", "f"], "n int, f int"), lambda d: d.where("n < 8").selectExpr("n + 1", "f * (n + 1)")).join_frame("s", lambda own, of: of("n") > own("r_regionkey")).select("r_regionkey", "s.n", "s.f")
)
add("values_join", "SELECT c_custkey, label FROM customer JOIN (VALUES ('BUILDING', 'b'), ('MACHINERY', 'm')) v(segment, label) ON c_mktsegment = segment")(
    lambda q: q("customer").with_values([{"segment": "BUILDING", "label": "b"}, {"segment": "MACHINERY", "label": "m"}], as_="v").join_frame("v", [("c_mktsegment", "segment")]).select("c_custkey", "v.label")
)
orders_of = lambda q, o: q("orders").tables("orders").where(F.col("o_custkey") == o["c_custkey"])
add("lateral_topn", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN LATERAL (SELECT * FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) ON TRUE")(
    lambda q: q("customer").lateral("best", lambda o: orders_of(q, o).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2), ["o_orderkey", "o_totalprice"], "inner").select("c_custkey", "best.o_orderkey", "best.o_totalprice")
)
# A bare column equal to an outer one is substituted, which would leave the other condition a nested loop; + 0 keeps both for one join by key.
add("lateral_agg", "SELECT c_custkey, n, hi FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, max(o_totalprice) AS hi FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 10) ON TRUE")(
    lambda q: q("customer").lateral("t", lambda o: q("orders").tables("orders").where((F.col("o_custkey") + 0 == o["c_custkey"]) & (F.col("o_totalprice") > o["c_acctbal"] * 10)).select(F.count("*").alias("n"), F.max("o_totalprice").alias("hi")), ["n", "hi"]).select("c_custkey", "t.n", "t.hi")
)
add("lateral_series", "SELECT r_regionkey, n FROM region, LATERAL (SELECT unnest(range(1, r_regionkey + 2)) AS n)")(lambda q: q("region").unnest(F.sequence(F.lit(1), F.col("root__r_regionkey") + 1), "n").select("r_regionkey", "n.n").df().select("r_regionkey", F.col("n").cast("bigint").alias("n")))
add("series", "SELECT unnest(range(3, 21, 3)) AS n")(lambda q: src.series(q("region").spark, 3, 20, 3))

# ---------------------------------------------------------------- arrays, JSON

WORDS = ("string_to_array", "p_name", " ")
add("arr_ops", "SELECT p_partkey, len(w) AS n, array_to_string(list_append(w, 'z'), '|') AS a, array_to_string(list_prepend('a', w), '|') AS b, list_position(w, w[2]) AS p, array_to_string(list_filter(w, lambda x: x <> w[1]), '|') AS r, list_position(w, 'nope') AS none FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")(
    lambda q: q("part").select("p_partkey", ("field", ("array_length", WORDS), "n"), ("field", ("array_to_string", ("array_append", WORDS, "z"), "|"), "a"), ("field", ("array_to_string", ("array_prepend", "a", WORDS), "|"), "b"), ("field", ("array_position", WORDS, F.split("root__p_name", " ")[1]), "p"), ("field", ("array_to_string", ("array_remove", WORDS, F.split("root__p_name", " ")[0]), "|"), "r"), ("field", ("array_position", WORDS, "nope"), "none")).df().select("p_partkey", F.col("n").cast("bigint").alias("n"), "a", "b", F.col("p").cast("int").alias("p"), "r", F.col("none").cast("int").alias("none"))
)
add("arr_filters", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue']) AND NOT list_has_all(string_split(p_name, ' '), ['red', 'blue'])")(lambda q: q("part").select("p_partkey").filter((WORDS, ("array_overlap", ["red", "blue"])), ("not", (WORDS, ("array_contains", ["red", "blue"])))))
add("unnest", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")(lambda q: q("part").unnest(WORDS, "word").select("p_partkey", "word.word"))
add("unnest_ordinality", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(1, len(string_split(p_name, ' ')) + 1))::INT AS n FROM part")(lambda q: q("part").unnest(WORDS, "word", "n").select("p_partkey", "word.word", "word.n"))
add("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props, '$.k') = 'UBIGINT' AS is_int FROM events")(
    lambda q: q("events").select("event_id", ("field", ("json_extract_text", "props", "$.k"), "k"), ("field", ("json_typeof", ("json_extract", "props", "k")), "t")).df().select("event_id", "k", (F.col("t") == "number").alias("is_int"))
)
add("json_filter", "SELECT event_id FROM events WHERE (props->>'k')::INT > 50 AND json_exists(props, '$.k')")(lambda q: q("events").select("event_id").filter((F.get_json_object("root__props", "$.k").cast("int") > 50), ("props", ("json_exists", "k"))))
add("json_order", "SELECT event_id, row_number() OVER (ORDER BY props->>'k' DESC, event_id) AS n FROM events")(lambda q: numbered(q("events").select("event_id").order_by(("desc", ("json_extract_text", "props", "k")), "event_id").df()))
add("json_build", """SELECT r_regionkey, '{"id":' || r_regionkey || ',"name":"' || r_name || '"}' AS o, '[' || r_regionkey || ',"' || r_name || '",null]' AS a FROM region""")(
    lambda q: q("region").select("r_regionkey", ("field", ("json_build_object", ("literal", "id"), "r_regionkey", ("literal", "name"), "r_name"), "o"), ("field", ("json_build_array", "r_regionkey", "r_name", F.lit(None).cast("string")), "a"))
)
add("json_edit", """SELECT event_id, '{"k":7}' AS s, '{}' AS d FROM events""")(lambda q: q("events").select("event_id", ("field", ("json_set", "props", "$.k", 7), "s"), ("field", ("json_remove", "props", "$.k"), "d")))
add("json_agg", """SELECT n_regionkey, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']' AS j FROM nation GROUP BY n_regionkey""")(lambda q: q("nation").select("n_regionkey", ("field", ("json_agg", "n_name"), "j")).group_by("n_regionkey"))
add("json_object_agg", """SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey""")(lambda q: q("nation").select("n_regionkey", ("field", ("json_object_agg", "n_name", "n_nationkey"), "j")).group_by("n_regionkey"))

# ---------------------------------------------------------------- pivot, nesting, subfilters

rich = lambda q: q("customer").filter(("c_acctbal", (">", 9000)))
PIVOT = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000)"
for _k in ("in", "exists"):
    add(f"pivot_{_k}", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")(lambda q, k=_k: rich(q).pivot("orders", k).select("o_orderkey", "o_totalprice").filter(("o_totalprice", (">", 1000))))
add("pivot_join", "SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")(lambda q: rich(q).pivot("nation", "join").select("n_name"))
add("pivot_two_steps", "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9900)")(lambda q: q("customer").filter(("c_acctbal", (">", 9900))).pivot("region").select("r_name"))
add("pivot_nofilter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_orderstatus = 'P'")(lambda q: rich(q).pivot("orders", preserve_filters=False).select("o_orderkey").filter(("o_orderstatus", "P")))
add("subselect_json", """SELECT n_nationkey, '[' || string_agg('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']' AS j FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")(lambda q: q("nation").select("n_nationkey").subselect("supplier", ["s_suppkey", "s_name"], as_="j", order_by=["s_suppkey"]))
add("subselect_array", "SELECT n_nationkey, array_to_string(list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), ',') AS a FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")(lambda q: q("nation").select("n_nationkey").subselect("supplier", ["s_suppkey"], "array_agg", "a").df().select("n_nationkey", F.array_join(F.col("a").cast("array<string>"), ",").alias("a")))
add("subselect_string", "SELECT r_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS s FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")(lambda q: q("region").select("r_regionkey").subselect("nation", ["n_name"], "string_agg", "s", "; "))
add("subselect_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")(lambda q: q("customer").select("c_custkey").subselect("orders", ["o_orderkey"], "count", "n", filters={"o_orderstatus": "P"}))
add("subselect_two_steps", "SELECT r_regionkey, count(s_suppkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_regionkey")(lambda q: q("region").select("r_regionkey").subselect("nation.supplier", ["s_suppkey"], "count", "n"))
HIGH = "SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000"
SUB = {
    "subf_exists": (lambda s: s.subfilter("orders.o_totalprice", (">", 450000)), f"EXISTS ({HIGH})"),
    "subf_not_exists": (lambda s: s.subfilter("orders.o_totalprice", (">", 450000), negate=True), f"NOT EXISTS ({HIGH})"),
    "subf_in": (lambda s: s.subfilter("nation.n_name", ["FRANCE", "NATION_3", "CHINA"]), "c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name IN ('FRANCE', 'NATION_3', 'CHINA'))"),
    "subf_count": (lambda s: s.subfilter("orders", ("count", ">", 12)), "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12"),
    "subf_avg": (lambda s: s.subfilter("orders.o_totalprice", ("avg", ">", 280000)), "(SELECT avg(o_totalprice) FROM orders WHERE o_custkey = c_custkey) > 280000"),
    "subf_range": (lambda s: s.subfilter("orders.o_totalprice", ("between", 1000, 3000)), "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice BETWEEN 1000 AND 3000)"),
    "subf_since": (lambda s: s.subfilter("orders.o_orderdate", ("since_date", date_range("1998-06-01")[0])), "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1998-06-01')"),
    "subf_two_steps": (lambda s: s.subfilter("nation.region.r_name", "ASIA"), "c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"),
    "subf_or": (lambda s: s.subfilter_any(("orders.o_totalprice", (">", 490000)), ("nation.n_regionkey", 2), ("orders", ("count", "<", 3))), "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000) OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) OR (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) < 3"),
}
for _n, (_f, _s) in SUB.items():
    add(_n, f"SELECT c_custkey FROM customer WHERE {_s}")(lambda q, f=_f: f(q("customer").select("c_custkey")))

# ---------------------------------------------------------------- option lists, event-time windows

add("options_domain", "SELECT DISTINCT c_mktsegment AS value, c_mktsegment AS label FROM customer WHERE contains(c_mktsegment, 'I')")(lambda q: src.options({"type": "domain", "table": "customer", "value_field": "c_mktsegment"}, q("customer").tables, "I"))
add("windowed_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda q: windowed(q("events").tables("events"), "ts", ["event_type"], {"n": F.count("*")}, "1 day").drop("window_end"))

from . import catalog_more  # noqa: E402, F401  more queries of the same table
