"""Semantics that the standard tables do not show: nulls, empty inputs, ties, wrapping, errors."""

import asyncio
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike import udf, write
from marlspike.context import Context, compile_query
from marlspike.expr import contained, equal, not_, not_equal
from marlspike.functions import convert, dates, numeric, strings
from marlspike.model import Converter, create_table_sql, schema_changes
from marlspike.operators import grouping as g
from marlspike.operators import joins
from marlspike.plans import core, scalars  # noqa: F401
from marlspike.plans.registry import QUERIES
from marlspike.query import MoreThanOne, NoElement
from marlspike.sources.tables import Tables
from marlspike.temporal import History


@pytest.fixture
def ctx(spark):
    tables = Tables(spark)
    tables.add("t", spark.createDataFrame([(1, 10, "b"), (2, None, "a"), (3, 30, None), (4, 10, "B")], "id int, v int, s string"))
    tables.add("u", spark.createDataFrame([(1, 10), (2, None), (3, 50)], "uid int, v int"))
    c = Context(spark, tables)
    c.entity("t", key="id")
    c.entity("u", key="uid")
    return c


def ids(q, column="id"):
    return [r[column] for r in q.to_list()]


def one(spark, column, **values):
    types = {int: "bigint", float: "double", str: "string", bool: "boolean", datetime: "timestamp"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


def test_negation_keeps_unknown_rows(ctx):
    assert sorted(ids(ctx.query("t").where(not_(F.col("v") < 20)))) == [2, 3]
    assert sorted(ids(ctx.query("t").where(equal("v", F.lit(None))))) == [2]
    assert sorted(ids(ctx.query("t").where(not_equal("v", F.lit(10))))) == [2, 3]


def test_contained_matches_null_only_if_listed(ctx):
    assert sorted(ids(ctx.query("t").where(contained("v", [10])))) == [1, 4]
    assert sorted(ids(ctx.query("t").where(contained("v", [10, None])))) == [1, 2, 4]
    assert ids(ctx.query("t").where(contained("v", []))) == []


def test_null_keys_do_not_join_but_group(ctx):
    assert ctx.query("t").join(ctx.query("u"), "v", "v").count() == 2
    assert {(r["v"], r["n"]) for r in ctx.query("t").group_by("v", n=g.count()).df.collect()} == {(10, 2), (None, 1), (30, 1)}
    assert sorted(ids(ctx.query("t").where_none(ctx.query("u"), "v", "v"))) == [2, 3]


@pytest.mark.parametrize("block", [2, 1024])
def test_join_below_is_the_join_of_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(joins, "PAIRS_OF_TASK", 5)
    values = [0.0, -0.0, 1.0, 1.0, 1.0, 5.0, None, float("nan"), float("inf"), float("-inf"), 7.5]
    keys = [(1, "a"), (1, "b"), (2, None), (None, "a")]
    rows = [(n, *k, v) for n, (k, v) in enumerate((k, v) for k in keys for v in values)]
    tables = Tables(spark)
    tables.add("t", spark.createDataFrame(rows, "id int, k int, s string, v double"))
    tables.add("u", spark.createDataFrame([r for r in rows if r[0] % 3] * 2, "id int, k bigint, s string, v float"))
    c = Context(spark, tables)
    t, u = c.query("t"), c.query("u")
    names = [F.col(f"{side}.{n}") for side in "lr" for n in ("id", "k", "s", "v")]
    for left, right, by in ((t, t, ["k", "s"]), (t, u, ["k"]), (u, t, ["s", "k"]), (t, u.where(F.col("id") < 0), ["k"])):
        below = left.join_below(right, by, by, F.col("v") + 1, F.col("v"))
        plain = left.select_many(right, joins.on_keys(by, by)[0] & joins.on_keys(by, by)[-1] & (F.col("l.v") + 1 < F.col("r.v")))
        assert below.columns == plain.columns
        assert sorted(map(str, below.select(*names).collect())) == sorted(map(str, plain.select(*names).collect()))


def test_theta_join_deals_one_nation_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 128, raising=False)
    monkeypatch.setattr(joins, "PAIRS_OF_TASK", 50_000, raising=False)
    rows = spark.range(6000).select(F.col("id").alias("c_custkey"), F.lit(7).alias("c_nationkey"), (F.col("id") * 11 % 6000 * 11.0 / 6 - 1000).alias("c_acctbal"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["theta_join"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    balance = [k * 11 % 6000 * 11.0 / 6 - 1000 for k in range(6000)]
    low, high = [x + 9000 for x in balance if x < 1000], [x for x in balance if x > 8000]
    total = sum(a < b for a in low for b in high)
    assert sum(r["count"] for r in got) == total
    assert max(r["count"] for r in got) < total / 2


def test_group_join_has_empty_lists(ctx):
    rows = {r["id"]: [x["uid"] for x in r["items"]] for r in ctx.query("t").group_join(ctx.query("u"), "v", "v", ["uid"]).to_list()}
    assert rows == {1: [1], 2: [], 3: [], 4: [1]}


def test_nulls_order_first_and_ties_by_key(ctx):
    q = ctx.query("t").order_by("v")
    assert ids(q.take(4)) == [2, 1, 4, 3]
    assert ids(q.reverse()) == [3, 4, 1, 2]
    assert q.take(-3).count() == 0
    assert [q.first()["id"], q.last()["id"], q.element_at(2)["id"]] == [2, 3, 4]
    assert sorted(ids(q.take_last(2))) == [3, 4]
    assert sorted(ids(q.skip_last(3))) == [2]


def test_min_by_counts_null_as_least(ctx):
    assert ctx.query("t").min_by("v")["id"] == 2
    assert ctx.query("t").order_by("id").max_by("v")["id"] == 3


def test_while_clauses_stop_at_unknown(ctx):
    q = ctx.query("t").order_by("id")
    assert ids(q.take_while(F.col("v") < 20)) == [1]
    assert ids(q.skip_while(F.col("v") < 20)) == [2, 3, 4]
    assert ids(q.take_while(F.col("id") > 0)) == [1, 2, 3, 4]
    assert ids(q.skip_while(F.col("id") > 0)) == []
    assert ids(q.skip_while(lambda i: i < 3)) == [4]


def test_single_and_missing_rows(ctx):
    q = ctx.query("t")
    assert q.single(F.col("id") == 3)["v"] == 30
    assert q.single_or_default(F.col("id") == 9) is None
    with pytest.raises(MoreThanOne):
        q.single(F.col("v") == 10)
    with pytest.raises(NoElement):
        q.first(F.col("id") == 9)
    with pytest.raises(NoElement):
        q.where(F.col("id") == 9).average(F.col("v"))
    assert q.where(F.col("id") == 9).sum(F.col("v")) == 0
    assert ctx.find("t", 3)["v"] == 30


def test_order_is_needed(ctx, spark):
    ctx.tables.add("plain", spark.range(3))
    with pytest.raises(ValueError):
        ctx.query("plain").take_last(1)


def test_sets_by_key(ctx):
    t, u = ctx.query("t"), ctx.query("u")
    assert sorted(ids(t.order_by("id", descending=True).distinct_by("v"))) == [2, 3, 4]
    assert sorted(ids(t.order_by("id").except_by(u.select("v"), "v"))) == [3]
    assert sorted(ids(t.order_by("id").intersect_by(u.select("v"), "v"))) == [1, 2]
    assert sorted(r["v"] or 0 for r in t.select("v").union_by(u.select("v"), "v").to_list()) == [0, 10, 30, 50]
    assert t.where(F.col("id") > 9).default_if_empty(id=0).to_list()[0]["id"] == 0
    assert t.default_if_empty(id=0).count() == 4


def test_edges_chunks_and_pairs(ctx):
    q = ctx.query("t").select("id").order_by("id").append(id=0).append(id=-1).prepend(id=99)
    assert ids(q) == [99, 1, 2, 3, 4, 0, -1]
    chunks = {r["chunk"]: [x["id"] for x in r["items"]] for r in ctx.query("t").order_by("id").chunk(3).collect()}
    assert chunks == {0: [1, 2, 3], 1: [4]}
    pairs = ctx.query("t").order_by("id").zip(ctx.query("u").order_by("uid", descending=True)).collect()
    assert sorted((r["first"]["id"], r["second"]["uid"]) for r in pairs) == [(1, 3), (2, 2), (3, 1)]
    assert ctx.query("t").sequence_equal(ctx.query("t"))
    assert not ctx.query("t").sequence_equal(ctx.query("t").order_by("id", descending=True))


def test_windows(ctx):
    q = ctx.query("t").order_by("v")
    assert {r["id"]: r["rank"] for r in q.with_rank().to_list()} == {2: 1, 1: 2, 4: 2, 3: 4}
    assert {r["id"]: r["dense_rank"] for r in q.with_dense_rank().to_list()} == {2: 1, 1: 2, 4: 2, 3: 3}
    lag = ctx.query("t").order_by("id").with_lag(F.col("v"), 1, F.col("id") * 100).to_list()
    assert [r["lag"] for r in lag] == [100, 10, None, 30]
    with pytest.raises(ValueError):
        q.with_lag(F.col("v"), -1)


def test_group_predicates(ctx):
    row = ctx.query("t").aggregate(any=g.any_of(F.col("v") > 20), all=g.all_of(F.col("v") > 5), vacuous=g.all_of(F.col("v") > 20, F.col("id") == 3), text=g.joined_text(F.col("s"), "|")).first()
    assert tuple(row) == (True, False, True, "B|a|b")
    empty = ctx.query("t").where(F.lit(False)).aggregate(any=g.any_of(F.col("v") > 0), all=g.all_of(F.col("v") > 0)).first()
    assert tuple(empty) == (False, True)


def test_filters_hold_at_every_scan(ctx):
    ctx.add_filter("u", lambda df: F.col("uid") < 3)
    assert ctx.query("u").count() == 2
    assert ctx.query("t").join(ctx.query("u"), "id", "uid").count() == 2
    assert ctx.query("u").ignoring_filters().count() == 3
    ctx.entities["t"].tenant, ctx.tenant = "v", 10
    assert sorted(ids(ctx.query("t").ignoring_filters())) == [1, 4]
    ctx.tenant = None
    assert ctx.query("t").count() == 0


def test_converter_and_discriminator(ctx):
    ctx.entity("v10", "t", "id", discriminator=("v", 10), converters={"s": Converter(F.upper, F.lower)})
    assert sorted(r["s"] for r in ctx.query("v10").to_list()) == ["B", "B"]
    assert ctx.derived("t", "v30", "v", 30).count() == 1


def test_strict_context(spark, ctx):
    strict = Context(spark, ctx.tables, strict=True)
    with pytest.raises(PermissionError):
        strict.from_sql("SELECT 1")
    assert ctx.from_sql("SELECT id FROM range(:n)", n=3).count() == 3


def test_cache_returns_the_same_frame_until_changed(ctx):
    a = ctx.query("t").cacheable(60)
    assert ctx.query("t").cacheable(60).df is a.df
    assert a.df.storageLevel.useMemory
    ctx.changed("t")
    assert not a.df.storageLevel.useMemory


def test_results(ctx):
    q = ctx.query("t").order_by("id")
    assert q.to_dictionary("id", "v") == {1: 10, 2: None, 3: 30, 4: 10}
    with pytest.raises(ValueError):
        q.to_dictionary("v")
    assert [r["id"] for r in q] == [1, 2, 3, 4]

    async def fetch():
        return [r["id"] async for r in q]

    assert asyncio.run(fetch()) == [1, 2, 3, 4]
    assert len(q.select("v").to_hash_set()) == 3
    assert "Relation" in q.to_query_string() or "Scan" in q.to_query_string() or "LogicalRDD" in q.to_query_string()
    low = compile_query(lambda c, n: c.query("t").where(F.col("id") <= n))
    assert low(ctx, 2).count() == 2


def test_include_keeps_parents_without_children(ctx):
    ctx.entities["t"].has_many("us", "u", "v", "v")
    rows = {r["id"]: [x["uid"] for x in r["us"]] for r in ctx.query("t").include("us", ["uid"]).to_list()}
    assert rows == {1: [1], 2: [], 3: [], 4: [1]}


def test_as_of_takes_one_moment(ctx):
    with pytest.raises(ValueError):
        ctx.query("t").as_of(datetime(2020, 1, 1)).as_of(datetime(2021, 1, 1))


def test_history(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    h = History.backfill(now, "id", datetime(2020, 1, 1))
    assert h.as_of(datetime(2019, 1, 1)).count() == 0
    assert h.as_of(datetime(2020, 1, 1)).count() == 2  # closed at the start
    later = spark.createDataFrame([(1, "z")], "id int, s string")
    assert [tuple(r) for r in h.restore(later, datetime(2020, 6, 1)).collect()] == [(1, "a")]  # 2 is gone and stays gone
    assert h.prune(datetime(2030, 1, 1)).versions.count() == 2


def test_writes(spark):
    df = spark.createDataFrame([(1, 10, 1), (2, None, 1), (3, 30, 1)], "id int, v int, ver int")
    assert sorted(tuple(r)[:2] for r in write.update(df, F.col("v") > 15, v=F.col("v") + 1).collect()) == [(1, 10), (2, None), (3, 31)]
    assert sorted(r["id"] for r in write.delete(df, F.col("v") < 20).collect()) == [2, 3]
    new = spark.createDataFrame([(3, 99, 1), (4, 44, 1)], "id int, v int, ver int")
    assert sorted(tuple(r)[:2] for r in write.upsert(df, new, ["id"]).collect() if r["v"]) == [(1, 10), (3, 99), (4, 44)]
    assert sorted(r["id"] for r in write.bulk_delete(df, new.select("id"), ["id"]).collect()) == [1, 2]
    assert write.bulk_insert(df, new).count() == 5
    stale = spark.createDataFrame([(1, 11, 1), (3, 33, 7)], "id int, v int, ver int")
    good, conflicts = write.checked_update(df, stale, ["id"], "ver")
    assert {r["id"]: r["v"] for r in good.collect()} == {1: 11, 2: None, 3: 30}
    assert [r["id"] for r in conflicts.collect()] == [3]


def test_schema_text():
    old = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType())])
    new = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("c", T.DateType())])
    assert schema_changes(old, new) == [("drop", "b", None), ("add", "c", "date"), ("alter", "a", "bigint")]
    assert create_table_sql("x", old) == "CREATE TABLE `x` (`a` int NOT NULL, `b` string) USING parquet"


def test_user_functions(spark):
    net = udf.register_sql(spark, "net_price", "price double, rate double", "double", "price * (1 - rate)")
    assert one(spark, net(F.col("a"), F.col("b")), a=200.0, b=0.25) == 150.0
    twice = udf.register_vectorised(spark, "twice", lambda s: s * 2, "double")
    assert one(spark, twice(F.col("a")), a=4.5) == 9.0


@pytest.mark.parametrize(
    ("column", "values", "expected"),
    [
        (lambda: numeric.round_even(F.col("x")), {"x": 2.5}, 2.0),
        (lambda: numeric.round_away(F.col("x")), {"x": 2.5}, 3.0),
        (lambda: numeric.truncate(F.col("x")), {"x": -2.7}, -2),
        (lambda: convert.to_integral(F.col("x")), {"x": 3.5}, 4),
        (lambda: convert.truncating(F.col("x")), {"x": 3.9}, 3),
        (lambda: numeric.ieee_remainder(F.col("x"), F.col("y")), {"x": 5.0, "y": 3.0}, -1.0),
        (lambda: numeric.modulo(F.col("x"), F.col("y")), {"x": -7, "y": 3}, -1),
        (lambda: numeric.copy_sign(F.col("x"), F.col("y")), {"x": 3.0, "y": -2.0}, -3.0),
        (lambda: numeric.is_subnormal(F.col("x")), {"x": 1e-310}, True),
        (lambda: strings.index_of(F.col("s"), "c"), {"s": "abc"}, 2),
        (lambda: strings.index_of(F.col("s"), "z"), {"s": "abc"}, -1),
        (lambda: strings.pad_left(F.col("s"), 2), {"s": "abc"}, "abc"),
        (lambda: strings.insert(F.col("s"), 0, "x"), {"s": "abc"}, "xabc"),
        (lambda: strings.remove(F.col("s"), 1), {"s": "abc"}, "a"),
        (lambda: strings.trim(F.col("s")), {"s": "\t a \n"}, "a"),
        (lambda: strings.format("{0:F1}<{1,3}>", F.col("x"), F.col("s")), {"x": 2.25, "s": "a"}, "2.3<  a>"),
        (lambda: strings.numeric_value(F.col("s")), {"s": "7"}, 7.0),
        (lambda: strings.numeric_value(F.col("s")), {"s": "x"}, -1.0),
        (lambda: dates.day_of_week(F.col("t")), {"t": datetime(2024, 1, 7)}, 0),
        (lambda: dates.add_months(F.col("t"), 1), {"t": datetime(2024, 1, 31)}, datetime(2024, 2, 29)),
        (lambda: dates.ticks(F.col("t")), {"t": datetime(1970, 1, 1)}, 621_355_968_000_000_000),
        (lambda: dates.span_hours(F.col("m")), {"m": -90_000_000_000}, -1),
        (lambda: dates.span_days(F.col("m")), {"m": -90_000_000_000}, -1),
        (lambda: dates.span_text(F.col("m")), {"m": -90_061_500_000}, "-1.01:01:01.5000000"),
        (lambda: dates.time_add(F.col("m"), 7_200_000_000), {"m": 82_800_000_000}, 3_600_000_000),
        (lambda: dates.millisecond(F.col("t")), {"t": datetime(2020, 1, 1, 0, 0, 0, 123456)}, 123),
        (lambda: dates.local_part(dates.with_offset(F.col("t"), 90)), {"t": datetime(2020, 1, 1)}, datetime(2020, 1, 1, 1, 30)),
        (lambda: dates.parse_span(F.col("s")), {"s": "-1.01:01:01.5"}, -90_061_500_000),
        (lambda: dates.parse_span(F.col("s")), {"s": "02:30"}, 9_000_000_000),
        (lambda: dates.parse_time(F.col("s")), {"s": "23:59:59.999999"}, 86_399_999_999),
        (lambda: dates.time_ticks(F.col("m")), {"m": 5}, 50),
        (lambda: dates.time_millisecond(F.col("m")), {"m": 1_234_567}, 234),
        (lambda: F.length(convert.new_guid()), {"m": 1}, 36),
        (lambda: convert.random() < 1, {"m": 1}, True),
        (lambda: convert.parse_bool(F.col("s")), {"s": " TRUE "}, True),
        (lambda: convert.bool_text(F.col("b")), {"b": True}, "True"),
        (lambda: convert.enum_parse(F.col("s"), {"A": 1, "B": 2}, ignore_case=True), {"s": "b"}, 2),
        (lambda: convert.enum_name(F.col("x"), {"A": 1}), {"x": 5}, "5"),
        (lambda: convert.has_flag(F.col("x"), 4), {"x": 6}, True),
        (lambda: convert.json_value(F.col("s"), "$.a.b[1]", "int"), {"s": '{"a": {"b": [1, 2]}}'}, 2),
        (lambda: convert.parse_guid(F.col("s")), {"s": "0A0A0A0A-0000-0000-0000-0000000000FF"}, "0a0a0a0a-0000-0000-0000-0000000000ff"),
    ],
)
def test_scalar(spark, column, values, expected):
    assert one(spark, column(), **values) == expected


def test_bad_text_raises(spark):
    for column in (convert.parse_bool(F.col("s")), convert.parse(F.col("s"), "int"), convert.parse_guid(F.col("s")), dates.parse_time(F.col("s"))):
        with pytest.raises(Exception, match="not a|CAST_INVALID_INPUT"):
            one(spark, column, s="nonsense")
    with pytest.raises(ValueError):
        convert.json_value(F.col("s"), "a.b; drop")


def test_a_time_of_day_is_matched_once(spark):
    texts = spark.createDataFrame([(k, s) for k, s in enumerate(["02:30", None, "-0.00:00", "0.05:00", "23:59:59.9999999", "02:30:01.5\n", "00:00:00.0000019"])], "k int, s string")
    times = texts.select("k", dates.parse_time(F.col("s")).alias("t"), dates.parse_span(F.concat(F.lit("-"), F.ltrim(F.col("s"), F.lit("-")))).alias("u")).orderBy("k")
    expected = [9_000_000_000, None, 0, 18_000_000_000, 86_399_999_999, 9_001_500_000, 1]
    assert [(r["t"], r["u"]) for r in times.collect()] == [(t, t and -t) for t in expected]
    assert texts.select(dates.parse_time(F.col("s")).alias("t"))._jdf.queryExecution().analyzed().toString().count(dates.SPAN) == 2
    for bad in ("24:00", "-02:30", "1.00:00", "02:30:", "$1:$2", "::::::", ""):
        with pytest.raises(Exception, match="not a"):
            one(spark, dates.parse_time(F.col("s")), s=bad)


def test_date_diff_all_reads_every_order(spark, tmp_path):
    sold, sent = datetime(2020, 1, 1, 12), datetime(2020, 1, 3)
    spark.createDataFrame([(1, sold), (2000, sold), (9_000_000, sold)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.createDataFrame([(k, 1, 1, 1, 1.0, 1.0, sent) for k in (1, 2000, 9_000_000)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["date_diff_all"](spark, str(tmp_path)).collect()
    assert sorted((r["o_orderkey"], r["hours"], r["days"]) for r in got) == [(k, 36.0, 1) for k in (1, 2000, 9_000_000)]


def test_cross_join_all_has_every_pair(spark):
    got = {(r["r_name"], r["n_name"]) for r in QUERIES["cross_join_all"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 125


def test_queries_read_whole_tables(spark):
    assert QUERIES["cross_join"](spark, "/root/testdata/sf0.001").count() == 125


def test_a_statement_has_one_point_in_time(spark, ctx):
    past, later = datetime(2020, 1, 1), datetime(2021, 1, 1)
    for name, key in (("t", "id"), ("u", "uid")):
        ctx.add_history(name, History.backfill(ctx.scan(name), key, past))
    ctx.add_history("t", History.backfill(ctx.scan("t"), "id", past))
    a = ctx.query("t", as_of=past)
    with pytest.raises(ValueError, match="one point in time"):
        a.as_of(later)
    assert a.join(ctx.query("u", as_of=past), "id", "uid").count() == 3
    for other in (ctx.query("u", as_of=later), ctx.query("u")):
        with pytest.raises(ValueError):
            a.join(other, "id", "uid")
        with pytest.raises(ValueError):
            a.where_any(other, "id", "uid")
    ctx.tables.add("plain", spark.range(3).toDF("uid"))
    assert a.join(ctx.query("plain"), "id", "uid").count() == 2  # without history there is only the present
    with pytest.raises(LookupError):
        ctx.query("plain", as_of=past)


def test_cached_results_end_with_any_of_their_tables(ctx):
    q = ctx.query("t").where_any(ctx.query("u"), "id", "uid").cacheable(60)
    assert ctx.query("t").where_any(ctx.query("u"), "id", "uid").cacheable(60).df is q.df
    ctx.changed("u")
    assert not q.df.storageLevel.useMemory


def test_added_rows_leave_no_trace(ctx):
    q = ctx.query("t").select("id").order_by("id").append(id=9)
    assert q.df.columns == ["id"] and q.frame().columns == ["id"]
    assert {tuple(r) for r in q.to_hash_set()} == {(1,), (2,), (3,), (4,), (9,)}
    assert sorted(r["id"] for r in q.concat(q).to_list()) == [1, 1, 2, 2, 3, 3, 4, 4, 9, 9]
    assert ids(q.take_last(2)) == [4, 9] or sorted(ids(q.take_last(2))) == [4, 9]
    assert [x["id"] for r in sorted(q.chunk(9).collect()) for x in r["items"]] == [1, 2, 3, 4, 9]
    assert q.where(F.col("id") > 3).distinct().df.columns == ["id"]
    assert [r.asDict() for r in q.chunk(9).select(F.col("items")[0].alias("x")).select("x.*").collect()] == [{"id": 1}]


def test_numbering_and_paging_keep_rows_apart(spark, ctx):
    many = spark.range(0, 5000, 1, 7).select(F.col("id").alias("k"), (F.col("id") % 10).alias("v"))
    ctx.tables.add("many", many)
    ctx.entity("many", key="k")
    q = ctx.query("many").order_by("v")
    plans = [q.with_row_number().df, q.with_rank().df, q.with_dense_rank().df, q.with_lag(F.col("k"), 3).df, q.skip(20_000).df, q.skip_last(12_000).df, q.skip(7).df]
    assert {r["k"]: r["rank"] for r in plans[1].collect() if r["k"] < 12} == {k: k % 10 * 500 + 1 for k in range(12)}
    assert sorted({r["dense_rank"] for r in plans[2].collect()}) == list(range(1, 11))
    assert plans[4].count() == 0 and plans[6].count() == 4993
    assert [r["k"] for r in q.skip(498).take(4).to_list()] == [4980, 4990, 1, 11]
    assert sorted(r["k"] for r in ctx.query("many").select("v", "k").order_by("v", "k").skip_last(4998).to_list()) == [0, 10]


def test_source_keys_must_not_repeat(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "id int, v int")
    twice = spark.createDataFrame([(1, 11), (1, 12), (None, 5), (None, 6)], "id int, v int")
    for out in (write.bulk_update(df, twice, ["id"]), write.upsert(df, twice, ["id"])):
        with pytest.raises(Exception, match="several rows for the key"):
            out.collect()
    once = twice.filter("v <> 12")
    assert sorted(tuple(r) for r in write.bulk_update(df, once, ["id"]).collect()) == [(1, 11), (2, 20)]
    assert sorted(r["v"] for r in write.upsert(df, once, ["id"]).collect()) == [5, 6, 11, 20]


def test_only_row_of_a_group(ctx):
    with pytest.raises(Exception, match="more than one row"):
        ctx.query("t").group_by("v", x=g.only(F.col("id"))).to_list()
    assert {r["id"]: r["x"] for r in ctx.query("t").group_by("id", x=g.only(F.col("v"))).to_list()} == {1: 10, 2: None, 3: 30, 4: 10}


def test_client_projections_follow_the_policy(ctx):
    q = ctx.query("t").select("id")
    with pytest.raises(PermissionError):
        q.map_batches(lambda b: b, "id long")
    ctx.client_evaluation = "warn"
    with pytest.warns(UserWarning):
        assert q.map_batches(lambda b: b + 1, "id long").agg(F.sum("id")).first()[0] == 14


def test_compiled_queries_are_analysed_once(ctx):
    made = []
    low = compile_query(lambda c, n: made.append(n) or c.query("t").where(F.col("id") <= n), size=2)
    assert [low(ctx, n).count() for n in (2, 3, 2, 1, 3)] == [2, 3, 2, 1, 3]
    assert made == [2, 3, 1, 3]


def test_labels_do_not_stay(ctx, spark):
    before = spark.sparkContext.getLocalProperty("spark.job.description")
    ctx.query("t").tag_with("mine").to_list()
    assert spark.sparkContext.getLocalProperty("spark.job.description") == before


def test_instants_with_offsets_are_one_key(spark, ctx):
    at = datetime(2020, 1, 1)
    z = spark.createDataFrame([(1, at, 0), (2, at, 90), (3, datetime(2021, 1, 1), 0)], "id int, t timestamp, o int").select("id", dates.with_offset(F.col("t"), F.col("o")).alias("z"))
    ctx.tables.add("z", z)
    ctx.entity("z", key="id")
    assert sorted(r["n"] for r in ctx.query("z").group_by("z", n=g.count()).to_list()) == [1, 2]
    assert sorted(ids(ctx.query("z").order_by("id").distinct_by("z"))) == [1, 3]
    with pytest.raises(Exception, match="not a time of day"):
        spark.range(1).select(dates.time_from_span(F.lit(dates.MICROS_OF_DAY))).collect()


def test_strict_contexts_keep_to_the_engine(spark, ctx):
    strict = Context(spark, ctx.tables, strict=True, client_evaluation="allow")
    for refused in (lambda: strict.functions.add("f", F.abs), lambda: strict.query("t").map_batches(lambda b: b, "id long"), lambda: strict.execute_sql("SELECT 1")):
        with pytest.raises(PermissionError):
            refused()
    with pytest.raises(LookupError):
        ctx.functions.call("nothing", F.lit(1))


def test_statements_end_what_was_cached(ctx, spark):
    a = ctx.query("t").cacheable(60)
    ctx.execute_sql("CREATE OR REPLACE TEMPORARY VIEW three AS SELECT * FROM range(3)")
    assert not a.df.storageLevel.useMemory
    assert ctx.sql("SELECT count(*) AS n FROM three").first()["n"] == 3


def test_cast_type_raises_on_others(ctx):
    assert ctx.query("t").where(F.col("v") == 10).cast_type("v", 10).count() == 2
    with pytest.raises(Exception, match="not of type 10"):
        ctx.query("t").cast_type("v", 10).to_list()
