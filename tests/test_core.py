import datetime as dt
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from pyspark.sql import functions as F

from quarry.errors import ConfigurationError, FieldResolutionError, MultipleResults, NoResults, QueryError, TransformationError, ValidationError
from quarry.functions import jsonops
from quarry.functions.dates import date_range
from quarry.operators.hierarchy import adjacency, below
from quarry.plans.domain import Domain
from quarry.plans.query import configure, recursive
from quarry.sources import sinks
from quarry.sources.tables import options, series, values
from quarry.streaming.windows import windowed


@pytest.fixture(scope="module")
def shop(spark):
    t = {
        "people": spark.createDataFrame([(1, "Ann", 1, "x"), (2, "Bob", 2, "y"), (3, "Cy", None, "z"), (4, None, 1, "w")], "id long, name string, city_id long, secret string"),
        "cities": spark.createDataFrame([(1, "Rome"), (2, "Oslo")], "id long, city string"),
        "sales": spark.createDataFrame([(10, 1, 5.0), (11, 1, None), (12, 2, 7.5), (13, 9, 1.0)], "id long, person_id long, amount double"),
    }
    d = {
        "source": {"source_table": "people", "primary_key": "id", "fields": ["id", "name", "city_id", "secret"], "redact_fields": ["secret"], "associations": {"city": {"queryable": "cities", "owner_key": "city_id", "related_key": "id"}, "sales": {"queryable": "sales", "owner_key": "id", "related_key": "person_id"}}},
        "schemas": {"cities": {"source_table": "cities", "primary_key": "id", "fields": ["id", "city"]}, "sales": {"source_table": "sales", "primary_key": "id", "fields": ["id", "person_id", "amount"]}},
        "joins": {"city": {}},
    }
    return configure(spark, d, t)


def got(q):
    return sorted((tuple(r) for r in q.rows()), key=repr)


def test_unused_joins_are_not_made_and_filters_are_pushed(shop, spark):
    plan = lambda q: q.df()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(shop.select("id")) and "Join LeftOuter" in plan(shop.select("city.city"))
    assert "LeftSemi" in plan(shop.select("id").subfilter("sales.amount", (">", 1))) and "LeftAnti" in plan(shop.select("id").subfilter("sales.amount", (">", 1), negate=True))
    assert shop.df().columns == ["id", "name", "city_id"]


def test_nulls(shop):
    assert got(shop.select("id").filter(("name", None))) == [(4,)]
    assert got(shop.select("id", "city.city").filter(("not", ("city_id", 1)))) == [(2, "Oslo")]
    assert got(shop.select("id").filter(("city_id", []))) == []
    assert [r.id for r in shop.select("id").order_by("city_id", "id").rows()] == [3, 1, 4, 2]
    assert [r.id for r in shop.select("id").order_by(("asc", "city_id"), "id").rows()] == [1, 4, 2, 3]
    assert [r.id for r in shop.select("id").order_by(("desc", "city_id"), "id").rows()] == [3, 2, 1, 4]
    assert got(shop.select(("field", ("concat", "name", ("literal", "!")), "x"))) == [("!",), ("Ann!",), ("Bob!",), ("Cy!",)]


def test_nesting_and_subfilters(shop):
    q = shop.select("id").subselect("sales", ["amount"], as_="j", order_by=["id"]).subselect("sales", ["id"], "count", "n")
    assert got(q) == [(1, "[5.0,null]", 2), (2, "[7.5]", 1), (3, None, 0), (4, None, 0)]
    assert got(shop.select("id").subfilter("sales", ("count", "=", 0))) == [(3,), (4,)]
    assert got(shop.select("id").subfilter_any(("sales.amount", (">", 6)), ("city.city", "Rome"))) == [(1,), (2,), (4,)]
    assert got(shop.filter(("id", (">", 1))).pivot("sales").select("id")) == [(12,)]
    assert got(shop.pivot("city", "join").select("city")) == [("Oslo",), ("Rome",), ("Rome",)]


def test_quantified_three_valued(shop, spark):
    some, none = spark.createDataFrame([(1,), (None,)], "v long"), spark.createDataFrame([], "v long")
    ids = lambda *p: [r[0] for r in got(shop.select("id").filter(p))]
    assert ids("id", ">", ("any", some)) == [2, 3, 4] and ids("id", ">", ("all", some)) == []
    assert ids("id", ">", ("any", none)) == [] and ids("id", "=", ("all", none)) == [1, 2, 3, 4]


def test_errors(shop, spark):
    with pytest.raises(FieldResolutionError, match="city.city"):
        shop.select("city").df()
    with pytest.raises(FieldResolutionError):
        shop.select("secret").df()
    with pytest.raises(ConfigurationError):
        Domain.of({"source": {}})
    with pytest.raises(ValidationError):
        shop.select("id", ("count", "*")).group_by("name").df()
    with pytest.raises(ValidationError):
        shop.select("id").union(shop.select("id", "name"))
    with pytest.raises(ValidationError):
        shop.select("id").union(shop.select("name"))
    with pytest.raises(ValidationError):
        shop.with_ctes({"a": (lambda f: None, ["b"]), "b": (lambda f: None, ["a"])})
    with pytest.raises(ValidationError):
        shop.lateral("x", lambda o: None, [], "right")
    with pytest.raises(ValidationError):
        shop.select("id").window("row_number", order=("id",), frame=("rows", ("preceding", 0), "current_row"), as_="w").df()
    with pytest.raises(NoResults):
        shop.filter(("id", 99)).one()
    with pytest.raises(MultipleResults):
        shop.one()
    assert got(shop.select("id").filter(("name", "x'; drop table people; --"))) == []


def test_join_validation():
    s = {"source_table": "t", "primary_key": "id", "fields": ["id"]}
    base = {"source": {**s, "associations": {"a": {"queryable": "x", "owner_key": "id", "related_key": "id"}}}, "schemas": {"x": s}}
    for bad in ({"zz": {}}, {"a": {"type": "odd"}}, {"a": {"type": "dimension"}}, {"a": {"requires_join": "b"}, "b": {"association": "a", "requires_join": "a"}}, {"a": {"requires_join": "gone"}}):
        with pytest.raises(ConfigurationError):
            Domain.of({**base, "joins": bad})
    with pytest.raises(ConfigurationError):
        Domain.of({"source": {**s, "associations": {"a": {"queryable": "no", "owner_key": "id", "related_key": "id"}}}, "schemas": {}})


def test_circles_end(spark):
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "id long, up long")
    assert sorted((r.id, r.level, r.path) for r in adjacency(t, "id", "up", 1).collect()) == [(1, 0, "1"), (2, 1, "1/2")]
    assert adjacency(t, "id", "up", 9).count() == 3


def test_whole_hierarchies_reach_every_node(spark):
    from quarry.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    up = {r.c_custkey: r.c_custkey // 3 for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    want = {}
    for k in up:
        path = [k]
        while path[-1]:
            path.append(up[path[-1]])
        want[k] = path[::-1]
    got = QUERIES["hier_adjacency"](spark, sf).collect()
    assert len(got) == n and {r.id: (r.level, r.path) for r in got} == {k: (len(p) - 1, "/".join(map(str, p))) for k, p in want.items()}
    assert QUERIES["hier_closure"](spark, sf).count() == sum(map(len, want.values()))
    assert QUERIES["setop_mapping"](spark, sf).count() == n + spark.read.parquet(f"{sf}/supplier.parquet").count()
    t = spark.createDataFrame([(1, None), (2, 1), (1, 2)], "id long, up long")
    assert sorted((r.id, r.level) for r in adjacency(t, "id", "up", None).collect()) == [(1, 0), (2, 1)]


def test_recursion_goes_to_the_end(spark):
    start = spark.createDataFrame([(1,)], "n int")
    to = lambda last: lambda d: d.where(F.col("n") < last).selectExpr("n + 1")
    assert sorted(r.n for r in recursive(start, to(140)).collect()) == list(range(1, 141))
    assert recursive(start, to(5), 4).count() == 5
    with pytest.raises(QueryError):
        recursive(start, to(6), 4)


def test_levels_of_a_hierarchy_keep_no_constraints(spark):
    """They multiplied from level to level, and filled the driver's memory."""
    t = spark.createDataFrame([(i, i - 1 if i else None) for i in range(5)], "id long, up long")
    size = lambda df: df._jdf.queryExecution().analyzed().constraints().size()
    seen = []
    step = lambda last: seen.append(size(last)) or below(t, "id", "up", last)
    root = adjacency(t.where("id = 0"), "id", "up", 0)
    assert sorted((r.id, r.path) for r in recursive(root, step).collect()) == [(i, "/".join(map(str, range(i + 1)))) for i in range(5)]
    assert seen == [0] * 5 and spark.conf.get("spark.sql.constraintPropagation.enabled") == "true"


@pytest.fixture(scope="module")
def lost(spark, tmp_path_factory):
    """sf0.001 with a customer that no root reaches, an order of theirs, an order of nobody known and one without a customer."""
    sf, out = Path("/root/testdata/sf0.001"), tmp_path_factory.mktemp("lost")
    for p in sf.iterdir():
        if p.stem not in ("customer", "orders"):
            (out / p.name).symlink_to(p)
    c, o = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    c.union(c.where("c_custkey = 1").withColumn("c_custkey", F.lit(1_000_000).cast("long"))).write.parquet(f"{out}/customer.parquet")
    more = spark.createDataFrame([(-1, 1_000_000), (-2, 999_999), (-3, None)], "o_orderkey long, o_custkey long")
    o.unionByName(more, allowMissingColumns=True).write.parquet(f"{out}/orders.parquet")
    return str(out)


def test_closure_leaves_out_what_no_root_reaches(spark, lost):
    from quarry.plans.catalog import QUERIES

    assert QUERIES["hier_closure"](spark, lost).where("id = 1000000 OR depth IS NULL").count() == 0


@pytest.mark.parametrize("kind, way, none", [("adjacency", ("level", "path"), (None, None)), ("path", ("depth", "way"), (None, None)), ("closure", ("descendants", "ancestors"), (0, None))])
def test_hierarchies_as_joins_build_what_they_need(spark, lost, monkeypatch, kind, way, none):
    from quarry.plans import catalog, query

    ran = []
    monkeypatch.setattr(query, "recursive", lambda *a: ran.append(1) or recursive(*a))
    got = {r.o_orderkey: tuple(r[c] for c in way) for r in catalog.QUERIES[f"hier_join_{kind}"](spark, lost).where("o_orderkey < 10").collect()}
    assert len(ran) == 1 and [got[-k] for k in (1, 2, 3)] == [none] * 3
    assert all(v[0] is not None and v[1] for k, v in got.items() if k >= 0)


def test_whole_orders_number_all_rows(spark):
    from quarry.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/orders.parquet").collect()
    s = lambda r: None if r.o_orderstatus == "F" else r.o_orderstatus
    got = {r.n: (r.o_orderkey, r.s) for r in QUERIES["order_nulls"](spark, sf).collect()}
    want = sorted(rows, key=lambda r: (s(r) is None, -ord(s(r) or "A"), r.o_orderkey))
    assert got == {i: (r.o_orderkey, s(r)) for i, r in enumerate(want, 1)} and any(v is None for _, v in got.values())
    got = {r.n: r.o_orderkey for r in QUERIES["order_bare_nulls_first"](spark, sf).collect()}
    assert got == {i: r.o_orderkey for i, r in enumerate(sorted(rows, key=lambda r: (s(r) is not None, s(r) or "", -r.o_totalprice, r.o_orderkey)), 1)}
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert sorted(r.n for r in QUERIES["json_order"](spark, sf).collect()) == list(range(1, n + 1))


def test_values_options_series(spark, shop):
    v = values(spark, [{"b": 1, "a": None}, {"b": 2.5}])
    assert v.columns == ["a", "b"] and [tuple(r) for r in v.collect()] == [(None, 1.0), (None, 2.5)]
    for bad in ([[1], [1, 2]], [[1], ["x"]]):
        with pytest.raises(ValidationError):
            values(spark, bad)
    assert [r.n for r in series(spark, 3, 1, -1).collect()] == [3, 2, 1]
    assert [tuple(r) for r in options({"type": "static", "values": {"a": "Alpha", "b": "Beta"}}, shop.tables, "Be").collect()] == [("b", "Beta")]


def test_sinks(spark):
    df = spark.createDataFrame([(1, None, dt.date(2024, 1, 2)), (2, 'a,"b', None)], "user_id int, note string, day date").orderBy("user_id")
    assert sinks.dicts(df, "camel", "remove")[0] == {"userId": 1, "day": dt.date(2024, 1, 2)}
    assert sinks.to_csv(df) == 'user_id,note,day\n1,,2024-01-02\n2,"a,""b",\n'
    assert sinks.to_json(df, nulls="omit") == '[{"user_id": 1, "day": "2024-01-02"}, {"user_id": 2, "note": "a,\\"b"}]'
    assert [len(b) for b in sinks.batches(df, 1)] == [1, 1]
    assert sinks.json_lines(df).first()[0] == '{"user_id":1,"note":null,"day":"2024-01-02"}'
    bad = spark.createDataFrame([("7", "yes"), ("x", "maybe")], "n string, b string")
    assert [tuple(r) for r in sinks.coerce(bad, {"n": "integer", "b": "boolean"}).collect()] == [(7, True), (None, None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sinks.coerce(bad, {"n": "integer"}, "strict").collect()


def test_json(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,2]},"c":null,"d":"x"}',), ("[1]",), (None,)], "j string")
    row = lambda c: [r[0] for r in df.select(c).collect()]
    assert row(jsonops.set_path(F.col("j"), "a.b[1]", 9))[0] == '{"a":{"b":[1,9]},"c":null,"d":"x"}'
    assert row(jsonops.insert_path(F.col("j"), "$.d", 1))[0] == '{"a":{"b":[1,2]},"c":null,"d":"x"}'
    assert row(jsonops.remove_path(F.col("j"), "$.a.b[0]"))[0] == '{"a":{"b":[2]},"c":null,"d":"x"}'
    assert row(jsonops.path_exists(F.col("j"), "c")) == [True, False, False]
    assert row(jsonops.contains(F.col("j"), {"a": {"b": [2]}, "d": "x"})) == [True, False, False]
    assert row(jsonops.typeof(F.col("j"))) == ["object", "array", None]


def test_date_ranges():
    day = dt.date(2024, 2, 28)
    span = lambda x: tuple(d.date().isoformat() for d in date_range(x, day))
    assert span("this_month") == ("2024-02-01", "2024-02-29") and span("last_week") == ("2024-02-19", "2024-02-25")
    assert span("2023") == ("2023-01-01", "2023-12-31") and span("tomorrow") == ("2024-02-29", "2024-02-29") and span("last_month")[1] == "2024-01-31"
    with pytest.raises(ValidationError):
        date_range("soon")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), max_size=6))
def test_array_aggregates_keep_nulls(spark, xs):
    from quarry.functions import arrays

    df = spark.createDataFrame([(x,) for x in xs], "x int")
    a, s = df.agg(arrays.agg(F.col("x")), arrays.string_agg(F.col("x"), "-")).first()
    key = sorted(xs, key=lambda v: (v is not None, v or 0))
    assert a == key and s == ("-".join(str(v) for v in key if v is not None) or None)


def test_stream_and_table_agree(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), k) for m, k in ((0, "a"), (3, "a"), (7, "b"), (31, "a"))]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["k"], {"n": F.count("*")}, "5 minutes", late="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed(df, "ts", ["k"], {"n": F.count("*")}, "5 minutes").collect()))


def test_entry_without_the_training_data_operators(monkeypatch):
    import sys

    for m in [m for m in sys.modules if m.startswith("quarry.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "quarry.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    assert entry._llm is None and len(entry.queries()) > 100 and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_distinct_is_ordered_by_what_it_selects(shop):
    assert [r.name for r in shop.select("name").distinct().order_by(("desc_nulls_last", "name")).rows()] == ["Cy", "Bob", "Ann", None]
    with pytest.raises(ValidationError):
        shop.select("name").distinct().order_by("id").df()


def test_subfilters_by_any_all_and_not_in(shop):
    ids = lambda q: [x for (x,) in got(q.select("id"))]
    # person 1 has sales of 5 and null, 2 of 7.5; 3 and 4 none
    assert ids(shop.subfilter("sales.amount", ("any", "<", "id"))) == [1, 2]
    assert ids(shop.subfilter("sales.amount", ("any", "<", ("literal", 6)))) == [2]
    assert ids(shop.subfilter("sales.amount", ("all", "<", ("literal", 6)))) == [2, 3, 4]
    assert ids(shop.subfilter("sales.amount", ("all", ">", ("literal", 6)), negate=True)) == [2]
    assert ids(shop.subfilter("sales.amount", ("any", "=", ("literal", 5.0)))) == [1]
    assert ids(shop.subfilter("sales.amount", ("all", "!=", ("literal", 6.0)))) == [2, 3, 4]
    assert ids(shop.subfilter("city.city", ["Rome"], negate=True)) == [2]  # a null city is unknown
    assert ids(shop.subfilter("city.city", ["Paris"], negate=True)) == [1, 2, 3, 4]
    assert ids(shop.subfilter("city.city", ["Rome"], negate=True, strategy="exists")) == [2, 3]
    avg = ("sales.amount", ("avg", ">", 6), True)
    assert ids(shop.subfilter(*avg)) == ids(shop.subfilter_any(avg)) == [1]  # without sales the average is unknown
    for test, strategy in ((("count", ">", 1), "in"), (["x"], "any"), ("x", "fast")):
        with pytest.raises(ValidationError):
            shop.subfilter("sales.amount", test, strategy=strategy)


def test_subfilter_sets(shop):
    from quarry.operators.related import Subfilters

    s = Subfilters().add("a", "sales.amount", (">", 6)).add("b", "city.city", "Rome").add("c", "sales", ("count", ">", 5)).remove("c").add_compound("or", ["a", "b"])
    assert got(s.apply(shop.select("id"))) == [(1,), (2,), (4,)]
    report = s.add("d", "city.city", "Rome").analyze(shop.domain)
    assert report["subfilters"] == 3 and report["joins"] == 3 and report["level"] == "moderate" and "d repeats b" in report["suggestions"]
    with pytest.raises(ValidationError):
        s.add("a", "city.city", "Oslo")
    with pytest.raises(ValidationError):
        s.remove("zz")


def test_set_queries_and_builders_are_checked(shop):
    both = shop.select("id").union(shop.select("id"))
    for bad in (lambda: both.group_by("id"), lambda: both.pivot("sales"), lambda: both.subselect("sales.id")):
        with pytest.raises(ValidationError):
            bad()
    with pytest.raises(ValidationError):
        shop.with_cte("x", lambda: None)
    with pytest.raises(ValidationError):
        shop.with_recursive_cte("x", shop.select("id").df(), lambda a, b: a)


def test_pivot_keeps_joins_and_can_be_reset(shop):
    p = shop.filter(("city.city", "Rome")).pivot("sales")
    assert p.has_pivot and got(p.select("id", "amount")) == [(10, 5.0), (11, None)]
    assert not p.reset_pivot().has_pivot and got(p.reset_pivot().select("id")) == [(1,), (4,)]
    with pytest.raises(ValidationError):
        shop.pivot("nowhere")


def test_hidden_keys_join(shop, spark):
    t = {"a": spark.createDataFrame([(1, 7)], "id long, k long"), "b": spark.createDataFrame([(7, "x")], "k long, v string")}
    d = {"source": {"source_table": "a", "primary_key": "id", "fields": ["id", "k"], "redact_fields": ["k"], "associations": {"b": {"queryable": "b", "owner_key": "k", "related_key": "k"}}}, "schemas": {"b": {"source_table": "b", "primary_key": "k", "fields": ["k", "v"], "redact_fields": ["k"]}}, "joins": {"b": {}}}
    q = configure(spark, d, t)
    assert got(q.select("id", "b.v")) == [(1, "x")]
    for f in ("k", "b.k"):
        with pytest.raises(FieldResolutionError):
            q.select(f).df()
    assert got(q.select("id").subfilter("b.v", "x")) == [(1,)]


def test_form_filters(shop, spark):
    from quarry.sources.forms import form_filter

    provider = {"type": "static", "values": ["a", "b"]}
    assert form_filter("f", ["", None], provider, shop.tables) is None and form_filter("f", "a") == ("f", "a")
    assert form_filter("f", ["b", "a", "b"], provider, shop.tables) == ("f", ["b", "a"])
    with pytest.raises(ValidationError):
        form_filter("f", ["a", "z"], provider, shop.tables)


def test_coercion_modes(spark):
    df = spark.createDataFrame([("1", "x", "2024-01-02T03:04:05"), (None, "2", "2024-01-02 03:04")], "a string, b string, c string")
    assert sinks.detect(df, ["a", "b", "c"]) == {"a": "integer", "b": "string", "c": "utc_datetime"}
    assert [r.a for r in sinks.coerce(df, {"a": "auto"}).collect()] == [1, None]
    assert [r.b for r in sinks.coerce(df, {"b": "integer"}).collect()] == [None, 2]
    assert [r.b for r in sinks.coerce(df, {"b": "integer"}, "custom", lambda c, kind: F.concat(c, F.lit(kind))).collect()] == ["xinteger", "2integer"]
    assert [r.b for r in sinks.coerce(df, {"b": "integer"}, "custom", F.upper).collect()] == ["X", "2"]
    with pytest.raises(TransformationError):
        sinks.coerce(df, {"b": "integer"}, "odd")


def test_errors_are_wrapped(shop):
    with pytest.raises(QueryError):
        shop.select(("no_such_function", "id")).rows()


def test_field_checks(shop):
    out = shop.validate_fields("id", "city.city", "city.town", "secret")
    assert out["valid"] == ["id", "city.city"] and set(out["errors"]) == {"city.town", "secret"}
    with pytest.raises(ValidationError):
        shop.select("id", ("count", "*")).group_by(("literal_position", 3)).df()


def test_declared_domains_are_checked_when_made():
    from quarry.plans.domain import Declared

    with pytest.raises(ConfigurationError):
        type("Broken", (Declared,), {"source": {"source_table": "t", "primary_key": "id", "fields": ["id"]}, "schemas": {}, "joins": {"nothing": {}}})
