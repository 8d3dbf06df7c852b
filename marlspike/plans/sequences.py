"""Windows, positional operators, set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.include import first_per_parent
from ..operators.ordering import Key
from .registry import query


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) AS INTEGER) AS rn FROM orders""")
def row_number(ctx):
    return ctx.query("orders").order_by("o_totalprice").with_row_number("rn").select("o_orderkey", rn=F.col("rn").cast("int")).df


@query("""SELECT event_id, CAST(rank() OVER (ORDER BY user_id NULLS FIRST) AS INTEGER) AS rk FROM events""")
def rank(ctx):
    return ctx.query("events").order_by("user_id").with_rank("rk").select("event_id", rk=F.col("rk").cast("int")).df


@query("""SELECT event_id, CAST(dense_rank() OVER (ORDER BY user_id DESC) AS INTEGER) AS rk FROM events""")
def dense_rank(ctx):
    return ctx.query("events").order_by("user_id", descending=True).with_dense_rank("rk").select("event_id", rk=F.col("rk").cast("int")).df


@query("""SELECT o_orderkey, lag(o_totalprice, 2, -1.0) OVER (ORDER BY o_orderkey) AS prev FROM orders""")
def lag_default(ctx):
    return ctx.query("orders").order_by("o_orderkey").with_lag(F.col("o_totalprice"), 2, F.lit(-1.0), "prev").select("o_orderkey", "prev").df


@query("""SELECT o_orderkey, coalesce(lead(o_custkey, 1) OVER (ORDER BY o_orderkey), o_custkey) AS next FROM orders""")
def lead_default(ctx):
    return ctx.query("orders").order_by("o_orderkey").with_lead(F.col("o_custkey"), 1, F.col("o_custkey"), "next").select("o_orderkey", "next").df


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE (o_totalprice < 300000) IS NOT TRUE), 1e18)""")
def take_while(ctx):
    return ctx.query("orders").order_by("o_orderkey").take_while(F.col("o_totalprice") < 300000).select("o_orderkey").df


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE (o_totalprice < 300000) IS NOT TRUE)""")
def skip_while(ctx):
    return ctx.query("orders").order_by("o_orderkey").skip_while(F.col("o_totalprice") < 300000).select("o_orderkey").df


@query("""WITH n AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
    SELECT c_custkey FROM n WHERE i < coalesce((SELECT min(i) FROM n WHERE (c_acctbal > -900 OR i < 20) IS NOT TRUE), 1e18)""")
def take_while_indexed(ctx):
    balance = F.col("c_acctbal")
    return ctx.query("customer").order_by("c_custkey").take_while(lambda i: (balance > -900) | (i < 20)).select("c_custkey").df


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 2 AND 3""")
def top_n_per_parent(ctx):
    return first_per_parent(ctx.scan("orders"), ["o_custkey"], (Key("o_totalprice", True), Key("o_orderkey")), 2, skip=1).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def first(ctx):
    return ctx.query("orders").order_by("o_orderdate").first_rows(F.col("o_orderstatus") == "P").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def last(ctx):
    return ctx.query("orders").order_by("o_orderdate").reverse().take(1).select("o_orderkey", "o_custkey").df


@query("""SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 37""")
def element_at(ctx):
    return ctx.query("orders").order_by("o_totalprice").element(37).select("o_orderkey")


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 1""")
def min_by(ctx):
    return ctx.query("customer").order_by("c_acctbal").take(1).select("c_custkey", "c_acctbal").df


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 1""")
def max_by(ctx):
    return ctx.query("customer").order_by("c_acctbal", descending=True).take(1).select("c_custkey", "c_acctbal").df


@query("""SELECT c_custkey FROM customer WHERE c_nationkey = 3""")
def find_by_column(ctx):
    return ctx.query("customer").where(F.col("c_nationkey") == 3).select("c_custkey").df


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 12""")
def take_last(ctx):
    return ctx.query("orders").order_by("o_totalprice").take_last(12).select("o_orderkey").df


@query("""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) AS rn FROM customer) WHERE rn > 30""")
def skip_last(ctx):
    return ctx.query("customer").order_by("c_acctbal").skip_last(30).select("c_custkey").df


@query("""SELECT n_name, CAST(row_number() OVER (ORDER BY n_name DESC) AS INTEGER) AS rn FROM nation""")
def reverse(ctx):
    return ctx.query("nation").order_by("n_name").reverse().with_row_number("rn").select("n_name", rn=F.col("rn").cast("int")).df


@query("""SELECT true AS same, false AS shifted""")
def sequence_equal(ctx):
    q = ctx.query("nation").select("n_nationkey", "n_name").order_by("n_nationkey")
    same = q.sequence_equal(ctx.query("nation").select("n_nationkey", "n_name").order_by("n_nationkey"))
    shifted = q.sequence_equal(q.skip(1))
    return ctx.spark.range(1).select(F.lit(same).alias("same"), F.lit(shifted).alias("shifted"))


@query("""SELECT any_value(a) AS some_debt, any_value(b) AS all_named, any_value(c) AS has_key FROM
    (SELECT (SELECT bool_or(c_acctbal < 0) FROM customer) AS a, (SELECT bool_and(c_name LIKE 'Customer%') FROM customer) AS b, (SELECT count(*) > 0 FROM customer WHERE c_custkey = 7) AS c)""")
def any_all_contains(ctx):
    q = ctx.query("customer")
    values = {"some_debt": q.any(F.col("c_acctbal") < 0), "all_named": q.all(F.col("c_name").like("Customer%")), "has_key": q.contains(c_custkey=7)}
    return ctx.spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])


@query("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def union(ctx):
    return ctx.query("customer").select(k=F.col("c_nationkey")).union(ctx.query("supplier").select(k=F.col("s_nationkey"))).df


@query("""SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier""")
def concat(ctx):
    return ctx.query("customer").select(k=F.col("c_nationkey")).concat(ctx.query("supplier").select(k=F.col("s_nationkey"))).df


@query("""SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier""")
def intersect(ctx):
    return ctx.query("customer").where(F.col("c_acctbal") > 9000).select(k=F.col("c_nationkey")).intersect(ctx.query("supplier").select(k=F.col("s_nationkey"))).df


@query("""SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""")
def except_(ctx):
    return ctx.query("nation").select(k=F.col("n_nationkey")).except_(ctx.query("supplier").where(F.col("s_acctbal") > 5000).select(k=F.col("s_nationkey"))).df


@query("""SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""")
def distinct(ctx):
    return ctx.query("orders").select("o_orderstatus", "o_orderpriority").distinct().df


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1""")
def distinct_by(ctx):
    return ctx.query("customer").order_by("c_acctbal", descending=True).distinct_by("c_nationkey").select("c_nationkey", "c_custkey").df


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer
    WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)) WHERE rn = 1""")
def except_by(ctx):
    other = ctx.query("supplier").where(F.col("s_acctbal") > 5000).select("s_nationkey")
    return ctx.query("customer").order_by("c_custkey").except_by(other, "c_nationkey").select("c_nationkey", "c_custkey").df


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer
    WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)) WHERE rn = 1""")
def intersect_by(ctx):
    other = ctx.query("supplier").where(F.col("s_acctbal") > 5000).select("s_nationkey")
    return ctx.query("customer").order_by("c_custkey").intersect_by(other, "c_nationkey").select("c_nationkey", "c_custkey").df


@query("""SELECT k, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY side, name) AS rn FROM
    (SELECT s_nationkey AS k, s_name AS name, 0 AS side FROM supplier UNION ALL SELECT c_nationkey, c_name, 1 FROM customer)) WHERE rn = 1""")
def union_by(ctx):
    a = ctx.query("supplier").select(k=F.col("s_nationkey"), name=F.col("s_name")).order_by("name")
    return a.union_by(ctx.query("customer").select(k=F.col("c_nationkey"), name=F.col("c_name")), "k").df


@query("""SELECT n, CAST(row_number() OVER (ORDER BY side, n) AS INTEGER) AS rn FROM
    (SELECT n_name AS n, 0 AS side FROM nation UNION ALL SELECT 'ZZZ', -1 UNION ALL SELECT 'AAA', 1)""")
def append_prepend(ctx):
    q = ctx.query("nation").select(n=F.col("n_name")).order_by("n").append(n="AAA").prepend(n="ZZZ")
    return q.with_row_number("rn").select("n", rn=F.col("rn").cast("int")).df


@query("""SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region) USING (i)""")
def zip(ctx):  # noqa: A001
    pairs = ctx.query("nation").order_by("n_name").zip(ctx.query("region").order_by("r_name"))
    return pairs.select(F.col("first.n_name"), F.col("second.r_name"))


@query("""SELECT (i - 1) // 7 AS chunk, list(n_name ORDER BY i) AS names FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) GROUP BY 1""")
def chunk(ctx):
    return ctx.query("nation").order_by("n_name").chunk(7).select("chunk", F.transform("items", lambda x: x["n_name"]).alias("names"))


@query("""SELECT -1::BIGINT AS o_orderkey, 'none' AS o_orderstatus""")
def default_if_empty(ctx):
    return ctx.query("orders").where(F.col("o_orderkey") < -1).select("o_orderkey", "o_orderstatus").default_if_empty(o_orderkey=-1, o_orderstatus="none").df


@query("""SELECT vec_id, embedding[1] AS head, len(embedding) AS dims FROM embeddings""")
def array_column(ctx):
    return ctx.query("embeddings").select("vec_id", head=F.get("embedding", F.lit(0)), dims=F.size("embedding")).df
