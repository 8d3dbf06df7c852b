"""Scalar and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping as g
from .registry import cents, dbl, money, net_price, query


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
    min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(CAST(o_custkey AS DOUBLE)), 6) AS mean_key FROM orders""")
def scalar_aggs(ctx):
    return ctx.query("orders").aggregate(n=g.count(), finished=g.count(F.col("o_orderstatus") == "F"), total=dbl(g.total(money("o_totalprice"))), low=g.least(F.col("o_totalprice")), high=g.greatest(F.col("o_totalprice")), mean_key=F.round(g.average(F.col("o_custkey").cast("double")), 6))


@query("""SELECT 0::BIGINT AS total, NULL::DOUBLE AS mean, NULL::DOUBLE AS low, 0::BIGINT AS n""")
def empty_aggs(ctx):
    return ctx.query("orders").where(F.col("o_orderkey") < -1).aggregate(total=g.total(F.col("o_custkey")), mean=g.average(F.col("o_totalprice")), low=g.least(F.col("o_totalprice")), n=g.count())


@query("""SELECT count(DISTINCT o_custkey) AS customers, sum(DISTINCT o_custkey)::BIGINT AS keys FROM orders""")
def distinct_aggs(ctx):
    return ctx.query("orders").aggregate(customers=g.distinct_count(F.col("o_custkey")), keys=g.distinct_total(F.col("o_custkey")))


@query("""SELECT count(*) AS n, max(k) AS high FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def aggregate_over_union(ctx):
    u = ctx.query("customer").select(k=F.col("c_nationkey")).union(ctx.query("supplier").select(k=F.col("s_nationkey")))
    return u.aggregate(n=g.count(), high=g.greatest(F.col("k")))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS sum_disc, count(*) AS n
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def group_by_multi(ctx):
    return ctx.query("lineitem").group_by("l_returnflag", "l_linestatus", sum_qty=dbl(g.total(cents("l_quantity")) / 100), sum_disc=dbl(F.sum(net_price()) / 10_000), n=g.count()).df


@query("""SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2""")
def group_by_computed_key(ctx):
    return ctx.query("orders").group_by(F.year("o_orderdate").alias("y"), "o_orderpriority", n=g.count()).df


@query("""SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality""")
def group_null_key(ctx):
    return ctx.query("documents").left_join(ctx.query("labels"), "doc_id", "doc_id").groupBy("quality").agg(g.count().alias("n"))


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15""")
def group_having(ctx):
    return ctx.query("orders").group_by("o_custkey", n=g.count()).where(F.col("n") >= 15).df


@query("""SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) AS n FROM events GROUP BY event_type""")
def group_count_if(ctx):
    return ctx.query("events").group_by("event_type", high=g.count(F.col("value") > 50), n=g.count()).df


@query("""SELECT user_id, bool_or(value > 99) AS any_high, bool_and(value > 1) AS all_low, bool_and(event_type <> 'click' OR value > 5) AS clicks_ok FROM events GROUP BY user_id""")
def group_any_all(ctx):
    v = F.col("value")
    return ctx.query("events").group_by("user_id", any_high=g.any_of(v > 99), all_low=g.all_of(v > 1), clicks_ok=g.all_of(v > 5, where=F.col("event_type") == "click")).df


@query("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS done FROM orders GROUP BY o_orderpriority""")
def group_distinct_count(ctx):
    return ctx.query("orders").group_by("o_orderpriority", customers=g.distinct_count(F.col("o_custkey")), done=g.distinct_count(F.col("o_custkey"), F.col("o_orderstatus") == "F")).df


@query("""SELECT l_returnflag, CAST(coalesce(sum(CASE WHEN l_quantity > 25 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS big,
    min(CASE WHEN l_quantity > 25 THEN l_discount END) AS low, max(CASE WHEN l_quantity > 1000 THEN l_discount END) AS none FROM lineitem GROUP BY l_returnflag""")
def group_filtered_sum(ctx):
    big = F.col("l_quantity") > 25
    return ctx.query("lineitem").group_by("l_returnflag", big=dbl(g.total(money("l_extendedprice"), big)), low=g.least(F.col("l_discount"), big), none=g.greatest(F.col("l_discount"), F.col("l_quantity") > 1000)).df


@query("""SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey""")
def string_agg_ordered(ctx):
    return ctx.query("nation").group_by("n_regionkey", names=g.joined_text(F.col("n_name"), ", ")).df


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def group_ordered_first(ctx):
    q = ctx.query("orders").order_by("o_totalprice", descending=True).nth_of_group(["o_custkey"])
    return q.select("o_custkey", "o_orderkey", "o_totalprice").df


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 3""")
def group_element_at(ctx):
    return ctx.query("orders").order_by("o_orderkey").nth_of_group(["o_custkey"], 3).select("o_custkey", "o_orderkey").df


@query("""SELECT o_orderkey, count(l_orderkey) AS n_lines, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS quantity,
    coalesce(bool_or(l_returnflag = 'R'), false) AS returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def nav_aggregates(ctx):
    q = ctx.query("orders").with_children(ctx.query("lineitem"), "o_orderkey", "l_orderkey", n_lines=g.count(), quantity=g.total(money("l_quantity")), returned=g.any_of(F.col("l_returnflag") == "R"))
    return q.select("o_orderkey", n_lines=F.coalesce("n_lines", F.lit(0)), quantity=dbl(F.coalesce("quantity", F.lit(0))), returned=F.coalesce("returned", F.lit(False))).df


@query("""SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS in_debt FROM nation""")
def correlated_scalar(ctx):
    q = ctx.query("nation").with_children(ctx.query("customer"), "n_nationkey", "c_nationkey", in_debt=g.count(F.col("c_acctbal") < 0))
    return q.select("n_name", in_debt=F.coalesce("in_debt", F.lit(0))).df


@query("""SELECT c_custkey, o_orderkey AS last_order FROM customer LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1""")
def correlated_last(ctx):
    newest = ctx.query("orders").order_by("o_orderdate", "o_orderkey", descending=True).nth_of_group(["o_custkey"])
    return ctx.query("customer").left_join(newest, "c_custkey", "o_custkey").select("c_custkey", F.col("o_orderkey").alias("last_order"))


@query("""SELECT r_name, count(DISTINCT c_mktsegment) AS segments, count(c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
    LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def two_hop_aggregates(ctx):
    customers = ctx.query("nation").join(ctx.query("customer"), "n_nationkey", "c_nationkey")
    q = ctx.query("region").left_join(ctx.query("region")._with(customers.select("n_regionkey", "c_mktsegment", "c_custkey")), "r_regionkey", "n_regionkey")
    return q.groupBy("r_name").agg(g.distinct_count(F.col("c_mktsegment")).alias("segments"), F.count("c_custkey").alias("customers"))


@query("""SELECT n_name, coalesce(n_rich, 0) AS n_rich, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS n_rich FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def group_by_correlated_key(ctx):
    nations = ctx.query("nation").with_children(ctx.query("supplier").where(F.col("s_acctbal") > 5000), "n_nationkey", "s_nationkey", n_rich=g.count())
    joined = ctx.query("customer").join(nations, "c_nationkey", "n_nationkey")
    return joined.groupBy("n_name", F.coalesce("n_rich", F.lit(0)).alias("n_rich")).agg(g.count().alias("n"))


@query("""SELECT 1000 + sum(o_custkey)::BIGINT AS folded FROM orders""")
def fold_sum(ctx):
    return ctx.query("orders").aggregate(folded=g.fold_sum(F.col("o_custkey"), 1000))


@query("""SELECT greatest(max(o_totalprice), 1.0) AS high, least(min(o_totalprice), 1000000.0) AS low FROM orders""")
def fold_minmax(ctx):
    return ctx.query("orders").aggregate(high=g.fold_max(F.col("o_totalprice"), 1.0), low=g.fold_min(F.col("o_totalprice"), 1000000.0))


@query("""SELECT 'names: ' || string_agg(n_name, '' ORDER BY n_nationkey) AS text FROM nation""")
def fold_concat(ctx):
    return ctx.query("nation").aggregate(text=g.fold_concat(F.col("n_name"), F.col("n_nationkey"), seed="names: "))


@query("""SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey""")
def raw_grouping(ctx):
    return ctx.query("nation").groups("n_regionkey", fields=["n_nationkey"]).select("n_regionkey", F.transform("items", lambda x: x["n_nationkey"]).alias("keys"))


@query("""SELECT count(DISTINCT c_mktsegment) AS n_groups FROM customer""")
def count_of_groups(ctx):
    return ctx.query("customer").select("c_mktsegment").distinct().aggregate(n_groups=g.count())


@query("""SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000) GROUP BY 1""")
def group_after_take(ctx):
    return ctx.query("orders").order_by("o_orderkey").take(1000).group_by("o_orderstatus", n=g.count()).df
