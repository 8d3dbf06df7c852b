"""Filters, projections, paging and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..expr import choose, contained, not_, value_or
from .registry import dbl, money, net_price, query


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_totalprice > 100000 AND (o_orderstatus = 'O' OR o_orderpriority LIKE '1%') AND NOT o_orderstatus = 'P'""")
def where_predicates(ctx):
    q = ctx.query("orders").where(F.col("o_totalprice") > 100000, (F.col("o_orderstatus") == "O") | F.col("o_orderpriority").like("1%"), not_(F.col("o_orderstatus") == "P"))
    return q.select("o_orderkey", "o_custkey", "o_totalprice").df


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality < 1) IS NOT TRUE""")
def negated_null_pred(ctx):
    joined = ctx.query("documents").left_join(ctx.query("labels"), "doc_id", "doc_id")
    return joined.filter(not_(F.col("quality") < 1)).select("l.doc_id")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)""")
def local_contains(ctx):
    q = ctx.query("customer").where(contained("c_mktsegment", ["BUILDING", "MACHINERY", None]), ~contained("c_nationkey", {1, 2, 3}))
    return q.select("c_custkey", "c_mktsegment").df


@query("""SELECT p_partkey, p_name || ' / ' || p_brand AS label, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS twice, p_size + 1 AS next_size FROM part""")
def select_computed(ctx):
    return ctx.query("part").select("p_partkey", label=F.concat("p_name", F.lit(" / "), "p_brand"), twice=dbl(money("p_retailprice") * 2), next_size=F.col("p_size") + 1).df


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'medium' ELSE 'small' END AS size_class FROM orders""")
def conditional(ctx):
    price = F.col("o_totalprice")
    return ctx.query("orders").select("o_orderkey", size_class=choose(price >= 200000, F.lit("large"), choose(price >= 50000, F.lit("medium"), F.lit("small")))).df


@query("""SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def coalesce_default(ctx):
    joined = ctx.query("documents").left_join(ctx.query("labels"), "doc_id", "doc_id")
    return joined.select("l.doc_id", value_or("quality", -1).alias("quality"), value_or("toxic", -1).alias("toxic"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25""")
def order_take(ctx):
    return ctx.query("orders").order_by("o_totalprice", descending=True).then_by("o_orderkey").take(25).select("o_orderkey", "o_totalprice").df


@query("""SELECT o_orderkey FROM orders ORDER BY o_custkey NULLS FIRST, o_orderkey LIMIT 20 OFFSET 40""")
def skip_take(ctx):
    return ctx.query("orders").order_by("o_custkey").skip(40).take(20).select("o_orderkey").df


@query("""SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 60) ORDER BY o_orderkey LIMIT 60 OFFSET 35""")
def take_skip(ctx):
    return ctx.query("orders").order_by("o_orderkey").take(60).skip(35).select("o_orderkey").df


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) WHERE o_orderstatus = 'F'""")
def filter_after_take(ctx):
    return ctx.query("orders").order_by("o_orderkey").take(500).where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice").df


@query("""SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def inner_join(ctx):
    return ctx.query("orders").join(ctx.query("customer").where(F.col("c_mktsegment") == "BUILDING"), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("""WITH pairs AS (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_quantity >= 45)
    SELECT l_orderkey, l_linenumber, pk, sk, l_quantity FROM lineitem JOIN pairs ON l_partkey = pk AND l_suppkey = sk""")
def composite_key_join(ctx):
    pairs = ctx.query("lineitem").where(F.col("l_quantity") >= 45).select(pk=F.col("l_partkey"), sk=F.col("l_suppkey")).distinct()
    return ctx.query("lineitem").join(pairs, ["l_partkey", "l_suppkey"], ["pk", "sk"]).select("l_orderkey", "l_linenumber", "pk", "sk", "l_quantity")


@query("""SELECT n_name, c_name, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS spent FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_name HAVING count(*) > 12""")
def chained_join(ctx):
    first = ctx.query("orders").join(ctx.query("customer"), "o_custkey", "c_custkey")
    joined = first.join(ctx.scan("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    grouped = joined.groupBy("n_name", "c_name").agg(dbl(F.sum(money("o_totalprice"))).alias("spent"), F.count(F.lit(1)).alias("n"))
    return grouped.filter("n > 12").select("n_name", "c_name", "spent")


@query("""SELECT o_orderkey, coalesce(l_quantity, 0) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1""")
def left_join_coalesce(ctx):
    firsts = ctx.query("lineitem").where(F.col("l_linenumber") == 1)
    return ctx.query("orders").left_join(firsts, "o_orderkey", "l_orderkey").select("o_orderkey", F.coalesce("l_quantity", F.lit(0.0)).alias("quantity"))


@query("""SELECT r_name, n_name FROM region, nation""")
def cross_join(ctx):
    return ctx.query("region").cross(ctx.query("nation")).select("r_name", "n_name")


@query("""SELECT r_name, n_name FROM region, nation""")
def cross_join_all(ctx):
    return ctx.query("region").cross(ctx.query("nation")).select("r_name", "n_name")


@query("""SELECT a.c_custkey AS low, b.c_custkey AS high FROM customer a JOIN customer b
    ON a.c_nationkey = b.c_nationkey AND a.c_acctbal + 9000 < b.c_acctbal""")
def theta_join(ctx):
    c = ctx.query("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    pairs = c.join_below(c, "c_nationkey", "c_nationkey", F.col("c_acctbal") + 9000, F.col("c_acctbal"))
    return pairs.select(F.col("l.c_custkey").alias("low"), F.col("r.c_custkey").alias("high"))


@query("""SELECT n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000""")
def select_many_default(ctx):
    rich = ctx.query("supplier").where(F.col("s_acctbal") > 5000)
    return ctx.query("nation").select_many(rich, F.col("l.n_nationkey") == F.col("r.s_nationkey"), default_if_empty=True).select("n_name", "s_name")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)""")
def semi_any(ctx):
    return ctx.query("orders").where_any(ctx.query("lineitem").where(F.col("l_quantity") > 49), "o_orderkey", "l_orderkey").select("o_orderkey").df


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def anti_none(ctx):
    return ctx.query("orders").where_none(ctx.query("lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey").df


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_discount < 0.05) IS NOT TRUE)""")
def anti_all(ctx):
    return ctx.query("orders").where_all(ctx.query("lineitem"), "o_orderkey", "l_orderkey", F.col("l_discount") < 0.05).select("o_orderkey").df


@query("""SELECT n_nationkey, coalesce(list(s_name ORDER BY s_name) FILTER (WHERE s_name IS NOT NULL), []) AS names
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def group_join_list(ctx):
    joined = ctx.query("nation").group_join(ctx.query("supplier"), "n_nationkey", "s_nationkey", ["s_name"])
    return joined.select("n_nationkey", names=F.transform("items", lambda x: x["s_name"])).df


@query("""SELECT x.c_custkey, o_orderkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) x JOIN orders ON o_custkey = x.c_custkey""")
def join_over_window(ctx):
    top = ctx.query("customer").order_by("c_acctbal", descending=True).take(50)
    return top.join(ctx.query("orders"), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@query("""SELECT n_name, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))), 4) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def revenue_by_nation(ctx):
    lines = ctx.query("lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).df
    joined = lines.join(ctx.scan("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(ctx.scan("customer"), F.col("o_custkey") == F.col("c_custkey")).join(ctx.scan("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = dbl(F.sum(net_price()) / 10_000)
    return joined.groupBy("n_name").agg(revenue.alias("revenue")).orderBy(F.desc("revenue"), "n_name").limit(10)
