"""Modifiers, related rows, points in time, and writes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import write
from ..operators.ordering import Key
from ..temporal import FROM, OPEN_END, OPERATION, TO, VERSION, History
from .registry import dbl, money, query


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus <> 'P'""")
def global_filter(ctx):
    ctx.add_filter("customer", lambda df: F.col("c_acctbal") > 0)
    ctx.add_filter("orders", lambda df: F.col("o_orderstatus") != "P")
    return ctx.query("customer").join(ctx.query("orders"), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey = 4""")
def ignore_filters(ctx):
    ctx.add_filter("customer", lambda df: F.col("c_acctbal") > 0)
    ctx.entities["customer"].tenant, ctx.tenant = "c_nationkey", 4
    return ctx.query("customer").ignoring_filters().select("c_custkey").df


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_nationkey = 5""")
def tenant_filter(ctx):
    ctx.entities["customer"].tenant, ctx.entities["supplier"].tenant, ctx.tenant = "c_nationkey", "s_nationkey", 5
    return ctx.query("customer").join(ctx.query("supplier"), "c_nationkey", "s_nationkey").select("c_custkey", "s_suppkey")


@query("""SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 50""")
def of_type(ctx):
    ctx.entity("purchase", "events", "event_id", discriminator=("event_type", "purchase"))
    return ctx.query("purchase").where(F.col("value") > 50).select("event_id", "value").df


@query("""SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 AND p_retailprice > 1000 GROUP BY p_brand""")
def raw_sql_compose(ctx):
    ctx.scan("part").createOrReplaceTempView("marlspike_part")
    ctx.add_filter("part", lambda df: F.col("p_retailprice") > 1000)
    return ctx.from_sql("SELECT * FROM marlspike_part WHERE p_size > :size", size=10, entity="part").group_by("p_brand", n=F.count(F.lit(1))).df


@query("""SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def cacheable(ctx):
    return ctx.query("orders").group_by("o_orderstatus", n=F.count(F.lit(1))).cacheable(30).df


@query("""SELECT n_nationkey, coalesce(list(s_suppkey ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL), []) AS keys FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def include_children(ctx):
    q = ctx.query("nation").include("suppliers", ["s_suppkey"])
    return q.select("n_nationkey", keys=F.transform("suppliers", lambda x: x["s_suppkey"])).df


@query("""SELECT c_custkey, coalesce(list(o_orderkey ORDER BY rn) FILTER (WHERE o_orderkey IS NOT NULL), []) AS top FROM customer LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') o ON o_custkey = c_custkey AND rn <= 3 GROUP BY 1""")
def include_filtered_topn(ctx):
    q = ctx.query("customer").include("orders", ["o_orderkey"], where=F.col("o_orderstatus") == "O", order=(Key("o_totalprice", True), Key("o_orderkey")), take=3)
    return q.select("c_custkey", top=F.transform("orders", lambda x: x["o_orderkey"])).df


@query("""WITH n AS (SELECT n_regionkey, n_name, coalesce(list(s_name ORDER BY s_name) FILTER (WHERE s_name IS NOT NULL), []) AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT r_regionkey, list(n_name || ':' || array_to_string(s, ',') ORDER BY n_name) AS tree FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY 1""")
def then_include(ctx):
    q = ctx.query("region").include("nations", ["n_name", "suppliers"], then=lambda n: n.include("suppliers", ["s_name"]))
    tree = F.transform("nations", lambda n: F.concat(n["n_name"], F.lit(":"), F.array_join(F.transform(n["suppliers"], lambda s: s["s_name"]), ",")))
    return q.select("r_regionkey", tree=tree).df


@query("""SELECT p_partkey, coalesce(list(s_suppkey ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL), []) AS supplied FROM part
    LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def many_to_many(ctx):
    q = ctx.query("part").include("suppliers", ["s_suppkey"])
    return q.select("p_partkey", supplied=F.transform("suppliers", lambda x: x["s_suppkey"])).df


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def include_reference(ctx):
    return ctx.query("orders").include("customer", ["c_name"]).select("o_orderkey", c_name=F.col("customer.c_name")).df


@query("""SELECT o_orderkey, coalesce(list(round(l_quantity * 2, 2) ORDER BY l_quantity, l_partkey) FILTER (WHERE l_quantity IS NOT NULL), []) AS doubled FROM
    orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 30) ON l_orderkey = o_orderkey GROUP BY 1""")
def shaped_collection(ctx):
    q = ctx.query("orders").include("lines", ["l_quantity", "l_partkey"], where=F.col("l_quantity") > 30)
    return q.select("o_orderkey", doubled=F.transform("lines", lambda x: F.round(x["l_quantity"] * 2, 2))).df


# history of orders by a rule: a version at the order's date, another 30 days later, and for every seventh a deletion after 60 days

def order_history(ctx) -> History:
    day = F.expr("interval 1 day")
    o = ctx.scan("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    seventh = F.col("o_orderkey") % 7 == 0
    later, gone, end = F.col("o_orderdate") + day * 30, F.col("o_orderdate") + day * 60, F.lit(OPEN_END).cast("timestamp_ntz")
    version = lambda status, price, start, stop, op, n: o.select("o_orderkey", status.alias("o_orderstatus"), price.alias("o_totalprice"), start.alias(FROM), stop.alias(TO), F.lit(op).alias(OPERATION), (F.col("o_orderkey") * 4 + n).alias(VERSION))
    first = version(F.lit("N"), F.col("o_totalprice"), F.col("o_orderdate"), later, "I", 1)
    second = version(F.col("o_orderstatus"), F.col("o_totalprice") + 1, later, F.when(seventh, gone).otherwise(end), "U", 2)
    third = version(F.col("o_orderstatus"), F.col("o_totalprice") + 1, gone, end, "D", 3).filter(seventh)
    return History(first.union(second).union(third), "o_orderkey")


_HISTORY = """WITH h AS (
    SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice, o_orderdate AS f, o_orderdate + INTERVAL 30 DAY AS t, 'I' AS op, o_orderkey * 4 + 1 AS v FROM orders
    UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice + 1, o_orderdate + INTERVAL 30 DAY, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 60 DAY ELSE TIMESTAMP '9999-12-31' END, 'U', o_orderkey * 4 + 2 FROM orders
    UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice + 1, o_orderdate + INTERVAL 60 DAY, TIMESTAMP '9999-12-31', 'D', o_orderkey * 4 + 3 FROM orders WHERE o_orderkey % 7 = 0)
"""
_AT, _AT_SQL = datetime(1996, 6, 1), "TIMESTAMP '1996-06-01'"


@query(_HISTORY + f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM h WHERE f <= {_AT_SQL} AND {_AT_SQL} < t AND op <> 'D'")
def as_of(ctx):
    ctx.add_history("orders", order_history(ctx))
    ctx.tag("mid", _AT)
    return ctx.query("orders").as_of("mid").select("o_orderkey", "o_orderstatus", "o_totalprice").df


@query(_HISTORY + f"SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'N') AS fresh FROM h JOIN lineitem ON l_orderkey = o_orderkey WHERE f <= {_AT_SQL} AND {_AT_SQL} < t AND op <> 'D' GROUP BY 1")
def as_of_join(ctx):
    ctx.add_history("orders", order_history(ctx))
    joined = ctx.query("orders", as_of=_AT).join(ctx.query("lineitem"), "o_orderkey", "l_orderkey")
    return joined.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "N").alias("fresh"))


@query(_HISTORY + "SELECT o_orderkey, v AS version, op, strftime(f, '%Y-%m-%d') AS since FROM h WHERE o_orderkey = 14")
def history(ctx):
    return order_history(ctx).of(14).select("o_orderkey", F.col(VERSION).alias("version"), F.col(OPERATION).alias("op"), F.date_format(FROM, "yyyy-MM-dd").alias("since"))


@query(_HISTORY + """, p AS (SELECT *, lag(o_orderstatus) OVER w AS was, lag(o_totalprice) OVER w AS before, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY o_orderkey ORDER BY f, v))
    SELECT o_orderkey, strftime(f, '%Y-%m-%d') AS day, 'o_orderstatus' AS col FROM p WHERE n > 1 AND o_orderstatus IS DISTINCT FROM was
    UNION ALL SELECT o_orderkey, strftime(f, '%Y-%m-%d'), 'o_totalprice' FROM p WHERE n > 1 AND o_totalprice IS DISTINCT FROM before""")
def diff(ctx):
    return order_history(ctx).diff().select("o_orderkey", F.date_format("changed_at", "yyyy-MM-dd").alias("day"), F.col("column").alias("col"))


@query(_HISTORY + f""", c AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM h WHERE t = TIMESTAMP '9999-12-31' AND op <> 'D'),
    a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM h WHERE f <= {_AT_SQL} AND {_AT_SQL} < t AND op <> 'D')
    SELECT c.o_orderkey, coalesce(a.o_orderstatus, c.o_orderstatus) AS o_orderstatus, coalesce(a.o_totalprice, c.o_totalprice) AS o_totalprice FROM c LEFT JOIN a USING (o_orderkey)""")
def restore(ctx):
    h = order_history(ctx)
    return h.restore(h.current(), _AT)


@query(_HISTORY + f"SELECT op, count(*) AS n FROM h WHERE t >= {_AT_SQL} GROUP BY 1")
def prune(ctx):
    return order_history(ctx).prune(_AT).versions.groupBy(F.col(OPERATION).alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders""")
def execute_update(ctx):
    out = write.update(ctx.scan("orders"), F.col("o_totalprice") > 200000, o_orderstatus=F.lit("X"), o_totalprice=F.col("o_totalprice") + 10)
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT c_custkey, CAST(CAST(coalesce(spent, c_acctbal) AS DECIMAL(18,2)) AS DOUBLE) AS c_acctbal FROM customer LEFT JOIN
    (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def execute_update_join(ctx):
    spent = ctx.query("orders").where(F.col("o_orderstatus") == "P").group_by(F.col("o_custkey").alias("c_custkey"), spent=dbl(F.sum(money("o_totalprice")))).df
    return write.update_from(ctx.scan("customer"), spent, ["c_custkey"], c_acctbal=F.col("s.spent")).select("c_custkey", dbl(money("c_acctbal")).alias("c_acctbal"))


@query("""SELECT o_orderkey FROM orders WHERE (o_totalprice < 150000 AND o_orderstatus = 'O') IS NOT TRUE""")
def execute_delete(ctx):
    return write.delete(ctx.scan("orders"), (F.col("o_totalprice") < 150000) & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN rn <= 100 THEN 'T' ELSE o_orderstatus END AS o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)""")
def update_paged(ctx):
    top = ctx.query("orders").order_by("o_totalprice", descending=True).take(100)
    return write.update_window(ctx.scan("orders"), top.df, ["o_orderkey"], o_orderstatus=F.lit("T")).select("o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_nationkey = 3""")
def bulk_upsert(ctx):
    c = ctx.scan("customer").select("c_custkey", "c_name", "c_nationkey")
    changed = c.filter("c_nationkey = 3").withColumn("c_name", F.upper("c_name"))
    added = c.filter("c_nationkey = 3").withColumn("c_custkey", F.col("c_custkey") + 10_000_000).withColumn("c_name", F.lit("new"))
    return write.upsert(c, changed.union(added), ["c_custkey"]).select("c_custkey", "c_name")


@query("""SELECT (SELECT count(*) FROM customer WHERE c_nationkey <> 3) AS customers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS orders,
    (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))) AS lines""")
def cascade_delete(ctx):
    tables = {n: ctx.scan(n) for n in ("customer", "orders", "lineitem")}
    links = [("customer", "orders", ["c_custkey"], ["o_custkey"]), ("orders", "lineitem", ["o_orderkey"], ["l_orderkey"])]
    left = write.cascade_delete(tables, "customer", F.col("c_nationkey") == 3, links)
    counts = [left[t].agg(F.count(F.lit(1)).alias(n)) for t, n in (("customer", "customers"), ("orders", "orders"), ("lineitem", "lines"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
