"""More registered queries: operators by their edge cases (nulls, ties, quotes), each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonops
from ..operators import joins
from ..operators.hierarchy import adjacency
from ..operators.related import Subfilters
from ..sources import sinks
from ..sources import tables as src
from ..sources.forms import form_filter
from ..sources.tables import Tables
from ..streaming.windows import windowed
from .catalog import TREE, add, links, tree
from .domain import Declared
from .query import configure


def inline(q, rows, columns, schema):
    """A query on an inline table."""
    region = q("region")
    return region.derived(src.values(region.spark, rows, columns, schema))


# ---------------------------------------------------------------- aggregates with conditions

GROUPS = [(1, 1, True), (1, None, True), (1, 5, False), (2, None, False), (2, 3, False), (3, 7, True)]
GROUPS_SQL = "(VALUES (1, 1, true), (1, NULL, true), (1, 5, false), (2, NULL, false), (2, 3, false), (3, 7, true)) t(g, x, k)"
groups = lambda q: inline(q, [list(r) for r in GROUPS], ["g", "x", "k"], "g int, x int, k boolean")
add("agg_array_filter", f"SELECT g, list_aggregate(list(coalesce(x::VARCHAR, 'null') ORDER BY x NULLS FIRST) FILTER (k), 'string_agg', ',') AS a FROM {GROUPS_SQL} GROUP BY g")(
    lambda q: groups(q).select("g", ("field", ("array_agg", "x", ("k", True)), "a")).group_by("g").df()
    .select("g", F.array_join(F.transform("a", lambda v: F.coalesce(v.cast("string"), F.lit("null"))), ",").alias("a"))
)
add("agg_json_filter", f"SELECT g, '[' || string_agg(coalesce(x::VARCHAR, 'null'), ',' ORDER BY x NULLS FIRST) FILTER (k) || ']' AS j FROM {GROUPS_SQL} GROUP BY g")(
    lambda q: groups(q).select("g", ("field", ("json_agg", "x", ("k", True)), "j")).group_by("g")
)
add("agg_json_object_repeated", """SELECT '{"a":1,"a":2,"b":null}' AS j, '{"a":2,"b":null}' AS b""")(
    lambda q: inline(q, [["a", 2], ["a", 1], ["b", None]], ["k", "v"], "k string, v int").select(("field", ("json_object_agg", "k", "v"), "j"), ("field", ("jsonb_object_agg", "k", "v"), "b"))
)
add("agg_filter_having", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey HAVING count(*) > 11 AND avg(o_totalprice) > 200000")(
    lambda q: q("orders").select("o_custkey", ("field", ("count", "*"), "n")).filter(("o_totalprice", (">", 1000)), (("count", "*"), (">", 11)), (("avg", "o_totalprice"), (">", 200000))).group_by("o_custkey")
)
add("agg_ordinal", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2")(
    lambda q: q("orders").select(("field", "o_orderstatus", "s"), ("field", "o_orderpriority", "p"), ("field", ("count", "*"), "n")).group_by(("literal_position", 1), ("literal_position", 2)).order_by(("literal_position", 2))
)
add("agg_rollup_order", "SELECT o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY o_orderstatus NULLS FIRST) AS at FROM orders GROUP BY ROLLUP (o_orderstatus)")(
    lambda q: q("orders").select("o_orderstatus", ("field", ("count", "*"), "n")).group_by("o_orderstatus", kind="rollup").window("row_number", order=(("o_orderstatus", "asc_nulls_first"),), as_="at").order_by("o_orderstatus")
)
add("agg_required", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")(
    lambda q: q("customer", required_filters=[("c_acctbal", (">", 0))], required_selected=["c_mktsegment"], required_group_by=["c_mktsegment"], required_order_by=["c_mktsegment"]).select(("field", ("count", "*"), "n"))
)
add("agg_approx", "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_orderstatus")(
    lambda q: q("orders").select("o_orderstatus", ("field", ("approx_count_distinct", "o_orderpriority"), "n")).group_by("o_orderstatus")
)
add("dimension_key", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey")(
    lambda q: q("supplier", {"nation": {"type": "dimension", "dimension": "n_name"}}).select("nation.n_name", ("field", ("count", "*"), "n")).group_by("nation.n_name")
)

# ---------------------------------------------------------------- selectors

add("sel_named_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS o_orderstatus FROM orders")(
    lambda q: q("orders").select("o_orderkey", ("case", "o_orderstatus", {"F": "done", "O": "open", "else": "other"}))
)
add("sel_named_array", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")(
    lambda q: q("nation").select("n_regionkey", ("array", "names", ["n_name"])).group_by("n_regionkey").df().select("n_regionkey", F.array_join("names", "|").alias("names"))
)
add("sel_case_without_conditions", "SELECT r_regionkey, 'any' AS c FROM region")(lambda q: q("region").select("r_regionkey", ("field", ("case", [(("and", []), ("literal", "any"))], ("literal", "none")), "c")))
add("sel_field_forms", "SELECT o_orderkey, c_name AS a, n_name AS b, r_name AS c, n_regionkey AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda q: q("orders", {"customer": {"joins": {"nation": {"joins": {"region": {}}}}}}).select(
        "o_orderkey", ("field", ("qualified_field", "customer.c_name"), "a"), ("field", ("disambiguated_field", "n_name", "nation"), "b"), ("field", "customer[nation][region][r_name]", "c"), ("field", "nation[n_regionkey]", "d")
    )
)
add("sel_functions", "SELECT r_regionkey, ascii(r_name) AS a, true AS now_known, true AS random_known, bit_length(r_name) AS b FROM region")(
    lambda q: q("region").select("r_regionkey", ("field", ("ascii", "r_name"), "a"), ("field", ("now",), "t"), ("field", ("func", "random", []), "r"), ("field", ("bit_length", "r_name"), "b"))
    .df().select("r_regionkey", "a", F.col("t").isNotNull().alias("now_known"), F.col("r").between(0, 1).alias("random_known"), F.col("b").cast("bigint").alias("b"))
)
add("sel_validated", "SELECT 'o_orderkey' AS f, true AS ok UNION ALL SELECT 'customer.c_name', true UNION ALL SELECT 'customer.c_nam', false UNION ALL SELECT 'nope', false")(
    lambda q: src.values(
        q("region").spark,
        [[f, f in (v := q("orders", {"customer": {}}).validate_fields("o_orderkey", "customer.c_name", "customer.c_nam", "nope"))["valid"]] for f in ("o_orderkey", "customer.c_name", "customer.c_nam", "nope")],
        ["f", "ok"], "f string, ok boolean",
    )
)

# ---------------------------------------------------------------- joins

KIND = {"a b": "BUILDING", "a-b": "MACHINERY"}
TWO_PARAMS = {"customer": {"parameters": [{"name": "tag", "type": "string", "required": True}], "condition": lambda own, p: own("c_mktsegment") == KIND[p["tag"]]}}
add("join_param_alike", "SELECT o_orderkey, a.c_name AS x, b.c_name AS y FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey AND a.c_mktsegment = 'BUILDING' LEFT JOIN customer b ON o_custkey = b.c_custkey AND b.c_mktsegment = 'MACHINERY'")(
    lambda q: q("orders", TWO_PARAMS).select("o_orderkey", ("field", "customer:'a b'.c_name", "x"), ("field", "customer:a-b.c_name", "y"))
)
add("join_right", "SELECT c_custkey, s_name FROM customer RIGHT JOIN supplier ON c_custkey = s_suppkey")(
    lambda q: q("customer", {"s": {"type": "right", "schema": "supplier", "owner_key": "c_custkey", "related_key": "s_suppkey"}}).select("c_custkey", "s.s_name")
)
ASOF = ([[1, 1, 10], [2, None, 10], [3, 2, None], [4, 2, 5]], ["id", "k", "t"], "id int, k int, t int")
add("join_asof_nulls", "SELECT * FROM (VALUES (1, 'b'), (2, NULL), (3, NULL), (4, NULL)) t(id, v)")(
    lambda q: joins.as_of(src.values(q("region").spark, *ASOF), src.values(q("region").spark, [[1, 3, "a"], [1, 10, "b"], [None, 1, "c"], [2, 6, "d"]], ["k", "t", "v"], "k int, t int, v string"), ["k"], "t", "t", ["v"]).select("id", "v")
)
add("join_redacted_key", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda q: hidden(q).select("o_orderkey", "customer.c_name"))


def hidden(q):
    """Orders and customers, their keys hidden."""
    cols = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_name"]}
    schema = lambda t, key, hide, **a: {"source_table": t, "primary_key": key, "fields": cols[t], "redact_fields": hide, "associations": a}
    customer = {"customer": {"queryable": "customer", "owner_key": "o_custkey", "related_key": "c_custkey"}}
    d = {"source": schema("orders", "o_orderkey", ["o_custkey"], **customer), "schemas": {"customer": schema("customer", "c_custkey", ["c_custkey"])}, "joins": {"customer": {}}}
    t = q("region").tables
    return configure(t.spark, d, t)


def treed(q, kind, **options):
    """Orders joined to a tree of customers by a declared join."""
    base = q("region").tables
    nodes = tree(q)
    tables = {"orders": base("orders"), "nodes": nodes}
    if kind == "materialized_path":
        tables["ways"] = adjacency(nodes, "id", "parent", None).select("id", F.col("path").alias("way"))
    if kind == "closure_table":
        tables["links"] = links(q)
    target = "ways" if kind == "materialized_path" else "nodes"
    d = {
        "source": {"source_table": "orders", "primary_key": "o_orderkey", "fields": ["o_orderkey", "o_custkey"], "associations": {"node": {"queryable": target, "owner_key": "o_custkey", "related_key": "id"}}},
        "schemas": {"nodes": {"source_table": "nodes", "primary_key": "id", "fields": ["id", "parent"]}, "ways": {"source_table": "ways", "primary_key": "id", "fields": ["id", "way"]}},
        "joins": {"node": {"type": "hierarchical", "hierarchy_type": kind, **options}},
    }
    return configure(base.spark, d, tables)


UP = f"WITH RECURSIVE t AS ({TREE}), h AS (SELECT id, 0 AS level, id::VARCHAR AS path, [id] AS up FROM t WHERE parent IS NULL UNION ALL SELECT t.id, h.level + 1, h.path || '/' || t.id, list_prepend(t.id, h.up) FROM t JOIN h ON t.parent = h.id)"
add("hier_join_adjacency", f"{UP} SELECT o_orderkey, level, path FROM orders LEFT JOIN h ON o_custkey = id")(
    lambda q: treed(q, "adjacency_list", id_field="id", parent_field="parent", depth_limit=None).select("o_orderkey", ("field", "node.level", "level"), ("field", "node.path", "path"))
)
add("hier_join_path", f"{UP} SELECT o_orderkey, level AS depth, path AS way FROM orders LEFT JOIN h ON o_custkey = id")(
    lambda q: treed(q, "materialized_path", path_field="way").select("o_orderkey", ("field", "node.depth", "depth"), ("field", "node.way", "way"))
)
add("hier_join_closure", f"{UP}, c AS (SELECT unnest(up) AS a FROM h) SELECT o_orderkey, (SELECT count(*) FROM c WHERE a = o_custkey) AS descendants, level + 1 AS ancestors FROM orders LEFT JOIN h ON o_custkey = id")(
    lambda q: treed(q, "closure_table", closure_table="links", ancestor_field="a", descendant_field="d", depth_field="depth").select("o_orderkey", ("field", ("max", "node.descendant_count"), "descendants"), ("field", ("count", "node.depth"), "ancestors")).group_by("o_orderkey").df()
    .select("o_orderkey", F.coalesce("descendants", F.lit(0)).alias("descendants"), F.nullif("ancestors", F.lit(0)).alias("ancestors"))
)
add("join_lateral_declared", "SELECT c_custkey, n FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) ON TRUE")(
    lambda q: q("customer", {"t": {"type": "lateral_join", "columns": ["n"], "query": lambda o: q("orders").tables("orders").where(F.col("o_custkey") == o["c_custkey"]).select(F.count("*").alias("n"))}}).select("c_custkey", "t.n")
)

# ---------------------------------------------------------------- subfilters, pivots, nesting

HAS = "(SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey)"
BAL = ("mul", "c_acctbal", 20)
for _n, _test, _sql in (
    ("subf_any", ("any", ">", BAL), f"c_acctbal * 20 > ANY {HAS}"), ("subf_all", ("all", "<", BAL), f"c_acctbal * 20 < ALL {HAS}"),
    ("subf_all_ne", ("all", "!=", BAL), f"c_acctbal * 20 <> ALL {HAS}"), ("subf_any_eq", ("any", "=", "c_nationkey"), "c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_nationkey = c_nationkey)"),
):
    add(_n, f"SELECT c_custkey FROM customer WHERE {_sql}")(lambda q, t=_test, n=_n: q("customer").select("c_custkey").subfilter("nation.n_nationkey" if n == "subf_any_eq" else "orders.o_totalprice", t))
add("subf_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 3))")(
    lambda q: q("supplier").select("s_suppkey").subfilter("nation.n_regionkey", [0, 3], negate=True)
)
add("subf_strategy_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderstatus IS NOT NULL)")(
    lambda q: q("customer").select("c_custkey").subfilter("orders.o_orderstatus", "P", strategy="join")
)
for _k, _v in (("recent", {"years": 200}), ("within_days", 80000), ("within_hours", 2000000)):
    add(f"subf_{_k}", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(lambda q, k=_k, v=_v: q("customer").select("c_custkey").subfilter("orders.o_orderdate", (k, v)))
add("subf_set", "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 8 AND (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))")(
    lambda q: Subfilters().add("many", "orders", ("count", ">", 8)).add("dear", "orders.o_totalprice", (">", 400000)).add("here", "nation.n_regionkey", 2).add("no", "nation.n_regionkey", 4).remove("no")
    .override_strategy("here", "exists").add_compound("or", ["dear", "here"]).apply(q("customer").select("c_custkey"))
)
add("pivot_joins", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")(
    lambda q: q("customer").filter(("c_acctbal", (">", 9000))).pivot("orders").select("o_orderkey", "c_mktsegment", "nation.n_name")
)
add("pivot_reset", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000")(lambda q: q("customer").select("c_custkey").filter(("c_acctbal", (">", 9000))).pivot("orders").reset_pivot())
add("subselect_text", "SELECT n_nationkey, count(s_suppkey) AS x_supplier, string_agg(s_name, ',' ORDER BY s_name) AS y_supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")(
    lambda q: q("nation").select("n_nationkey").subselects(["supplier[s_suppkey, s_name]"], format="count", alias_prefix="x_").subselects(["supplier.s_name"], format="string_agg", alias_prefix="y_")
)

# ---------------------------------------------------------------- JSON

DOCS = ['{"a":"x"}', '{"a":"7"}', '{"a":7,"b":[1,"q",{"c":2}]}', '{"a":null}', "[7]", '{"a":{"b":true}}']
DOCS_SQL = "(VALUES " + ", ".join(f"('{d}')" for d in DOCS) + ") t(j)"
docs = lambda q: inline(q, [[d] for d in DOCS], ["j"], "j string")
add("json_text_or_json", f"""SELECT j, json_extract(j, '$.a')::VARCHAR AS v, json_extract_string(j, '$.a') AS t, CASE json_type(j, '$.a') WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'number' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' END AS k FROM {DOCS_SQL}""")(
    lambda q: docs(q).select("j", ("field", ("json_extract", "j", "a"), "v"), ("field", ("json_extract_path_text", "j", "$.a"), "t"), ("field", ("json_typeof", ("json_extract_path", "j", "a")), "k"))
)
add("json_contains", f"""SELECT j, coalesce(json_type(j, '$.a') = 'UBIGINT' AND (j->>'a') = '7', false) AS n, coalesce(json_type(j, '$.a') = 'VARCHAR' AND (j->>'a') = '7', false) AS s, j LIKE '%"c":2%' AS o, j LIKE '%"a":null%' AS z FROM {DOCS_SQL}""")(
    lambda q: docs(q).df().select("j", *[jsonops.contains(F.col("j"), p).alias(c) for c, p in (("n", {"a": 7}), ("s", {"a": "7"}), ("o", {"b": [{"c": 2}, "q"]}), ("z", {"a": None}))])
)
add("json_contained", f"""SELECT j FROM {DOCS_SQL} WHERE j IN ('{{"a":"7"}}')""")(lambda q: docs(q).select("j").filter(("j", ("json_contained", {"a": "7", "b": 1}))))
add("json_extract_compare", "SELECT event_id FROM events WHERE (props->>'k') = '7'")(lambda q: q("events").select("event_id").filter(("props", ("json_extract_text", "$.k", "7"))))
add("json_edit_values", """SELECT event_id, '{"k":' || (props->>'k') || ',"z":7}' AS s, '{"k":' || (props->>'k') || ',"n":"x"}' AS i, props AS same FROM events""")(
    lambda q: q("events").select("event_id", ("field", ("json_set", "props", "$.z", 7), "s"), ("field", ("json_insert", "props", "$.n", "x"), "i"), "props").df().select("event_id", "s", "i", jsonops.insert_path(F.col("props"), "k", 0).alias("_same"), "props")
    .select("event_id", "s", "i", F.when(F.get_json_object("_same", "$.k") == F.get_json_object("props", "$.k"), F.col("props")).alias("same"))
)
add("json_array_length", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")(
    lambda q: q("nation").select("n_regionkey", ("field", ("json_agg", "n_name"), "j")).group_by("n_regionkey").df().select("n_regionkey", F.json_array_length("j").cast("bigint").alias("n"))
)
add("json_lines", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")(lambda q: sinks.json_lines(q("region").select("r_regionkey", "r_name").df()))

# ---------------------------------------------------------------- arrays

WORDS = ("string_to_array", "p_name", " ")
add("arr_more", "SELECT p_partkey, len(w) AS n, 1 AS d, '[1:' || len(w) || ']' AS dims, array_to_string(list_transform(w, lambda x: CASE WHEN x = w[1] THEN 'first' ELSE x END), '|') AS r, array_to_string(list_concat(w, ['end']), '|') AS c, 'z|z' AS f FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")(
    lambda q: q("part").select("p_partkey", ("field", WORDS, "w"), ("field", ("cardinality", WORDS), "n"), ("field", ("array_ndims", WORDS), "d"), ("field", ("array_dims", WORDS), "dims"), ("field", ("array_to_string", ("array_cat", WORDS, ("array", ("literal", "end"))), "|"), "c"), ("field", ("array_to_string", ("array_fill", "z", 2), "|"), "f"))
    .df().select("p_partkey", "n", F.col("d").cast("int").alias("d"), "dims", F.array_join(F.transform("w", lambda x: F.when(x == F.get("w", F.lit(0)), "first").otherwise(x)), "|").alias("r"), "c", "f")
)
add("arr_sets", "SELECT p_partkey, len(list_distinct(list_concat(w, ['red', 'x']))) AS u, list_contains(w, 'red') AS i, len(list_distinct(list_filter(w, lambda x: x <> 'red'))) AS e FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")(
    lambda q: q("part").select("p_partkey", ("field", ("array_union", WORDS, ("array", ("literal", "red"), ("literal", "x"))), "u"), ("field", ("array_intersect", WORDS, ("array", ("literal", "red"))), "i"), ("field", ("array_except", WORDS, ("array", ("literal", "red"))), "e"))
    .df().select("p_partkey", F.size("u").cast("bigint").alias("u"), (F.size("i") == 1).alias("i"), F.size("e").cast("bigint").alias("e"))
)
add("arr_compare", "SELECT p_partkey FROM part WHERE p_name = 'red blue' OR list_has_all(['red', 'green', 'small'], string_split(p_name, ' '))")(
    lambda q: q("part").select("p_partkey").filter(("or", [(WORDS, ("array_eq", ["red", "blue"])), (WORDS, ("array_contained", ["red", "green", "small"]))]))
)
add("arr_positions", "SELECT * FROM (VALUES (1, '1,3', 'z,b,z'), (2, '', 'c')) t(id, p, r)")(
    lambda q: inline(q, [[1, "a b a"], [2, "c"]], ["id", "s"], "id int, s string").select("id", ("field", ("array_positions", ("string_to_array", "s", " "), "a"), "p"), ("field", ("array_replace", ("string_to_array", "s", " "), "a", "z"), "r"))
    .df().select("id", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("p"), F.array_join("r", ",").alias("r"))
)

# ---------------------------------------------------------------- options, forms, frames, windows, shapes

add("options_enum", "SELECT * FROM (VALUES ('a', 'Alpha'), ('b', 'Beta')) t(value, label)")(lambda q: src.options({"type": "enum", "values": {"b": "Beta", "a": "Alpha"}}, q("region").tables))
add("options_query", "SELECT 'x' || n AS value, n::VARCHAR AS label FROM range(3) t(n)")(lambda q: src.options({"type": "query", "sql": "SELECT concat('x', id) AS v, cast(id AS string) AS l FROM range(3)"}, q("region").tables))
SEGMENTS = {"type": "domain", "table": "customer", "value_field": "c_mktsegment"}
add("form_one", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda q: q("customer").select("c_custkey").filter(form_filter("c_mktsegment", ["BUILDING", ""], SEGMENTS, q("customer").tables)))
add("form_many", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")(lambda q: q("customer").select("c_custkey").filter(form_filter("c_mktsegment", ["BUILDING", "MACHINERY", "BUILDING"], SEGMENTS, q("customer").tables)))
add("cte_columns", "WITH t(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY 1) SELECT c_custkey, n FROM customer JOIN t ON k = c_custkey")(
    lambda q: q("customer").with_cte("t", lambda f: q("orders").select("o_custkey", ("count", "*")).group_by("o_custkey").df(), ["k", "n"]).join_frame("t", [("c_custkey", "k")]).select("c_custkey", "t.n")
)
add("cte_recursive_deep", "WITH RECURSIVE s AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM s WHERE n < 130) SELECT count(*) AS c, max(n) AS m FROM s")(
    lambda q: q("region").derived(q("region").with_recursive_cte("s", src.values(q("region").spark, [[1]], ["n"], "n int"), lambda d: d.where("n < 130").selectExpr("n + 1")).frames[0][1]).select(("field", ("count", "*"), "c"), ("field", ("max", "n"), "m"))
)
add("win_several", "SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) AS r, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer")(
    lambda q: q("customer").select("c_custkey").window("rank", order=("c_nationkey",), as_="r").window("max", "c_acctbal", over=("c_nationkey",), as_="m")
)
add("raw_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT range FROM range(0, 40, 3))")(lambda q: q("customer").select("c_custkey").filter(("c_custkey", ("in", "SELECT id FROM range(0, 40, 3)"))))
add("coerce_auto", "SELECT * FROM (VALUES (1, 1.50, true, DATE '2024-01-02', 'x'), (2, 2.00, false, DATE '2024-02-03', '3')) t(i, d, b, t, s)")(
    lambda q: sinks.coerce(src.values(q("region").spark, [["1", "1.5", "yes", "2024-01-02", "x"], ["2", "2", "f", "2024-02-03", "3"]], ["i", "d", "b", "t", "s"], "i string, d string, b string, t string, s string"), dict.fromkeys("idbts", "auto"))
    .select(F.col("i").cast("int").alias("i"), F.col("d").cast("decimal(3,2)").alias("d"), "b", "t", "s")
)
add("windowed_sliding", "SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * x AS window_start, event_type, count(*) AS n FROM events, range(2) t(x) GROUP BY ALL")(
    lambda q: windowed(q("events").tables("events"), "ts", ["event_type"], {"n": F.count("*")}, "2 days", "1 day").drop("window_end")
)


class Geography(Declared):
    """Nations and regions, checked when this class is made."""

    source = {"source_table": "nation", "primary_key": "n_nationkey", "fields": ["n_nationkey", "n_name", "n_regionkey"], "associations": {"region": {"queryable": "region", "owner_key": "n_regionkey", "related_key": "r_regionkey"}}}
    schemas = {"region": {"source_table": "region", "primary_key": "r_regionkey", "fields": ["r_regionkey", "r_name"]}}
    joins = {"region": {}}


add("declared_domain", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda q: configure(q("region").spark, Geography.domain, Tables(q("region").spark, q("region").tables.where)).select("n_name", "region.r_name"))
