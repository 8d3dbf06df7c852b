"""Members and methods of scalar types, and the operators around one row, one moment and one batch, each over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import udf, write
from ..context import compile_query
from ..expr import equal, not_equal
from ..functions import convert, dates, numeric, strings
from ..operators import grouping as g
from ..temporal import History
from .registry import dbl, query


@query("""WITH x AS (SELECT c_custkey, c_acctbal, c_acctbal / 10000.0::DOUBLE AS x FROM customer)
    SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down, round(exp(x), 8) AS e, round(log2(1 + abs(x)), 8) AS l2, round(tan(x), 8) AS t,
    round(asin(x), 8) AS asn, round(acos(x), 8) AS acs, round(atan(x), 8) AS atn, round(sinh(x), 8) AS sh, round(cosh(x), 8) AS ch, round(tanh(x), 8) AS th,
    round(asinh(x), 8) AS ash, round(acosh(1 + abs(x)), 8) AS ach, round(atanh(x * 0.99), 8) AS ath FROM x""")
def math_plain(ctx):
    m, balance = numeric.PLAIN, F.col("c_acctbal")
    x = balance / F.lit(10000.0)
    far = F.lit(1.0) + F.abs(x)
    rounded = {"e": m["exp"](x), "l2": m["log2"](far), "t": m["tan"](x), "asn": m["asin"](x), "acs": m["acos"](x), "atn": m["atan"](x), "sh": m["sinh"](x), "ch": m["cosh"](x), "th": m["tanh"](x), "ash": m["asinh"](x), "ach": m["acosh"](far), "ath": m["atanh"](x * 0.99)}
    return ctx.query("customer").select("c_custkey", a=m["abs"](balance), up=m["ceiling"](balance), down=m["floor"](balance), **{k: F.round(v, 8) for k, v in rounded.items()}).df


@query("""WITH x AS (SELECT c_custkey, c_acctbal AS a, CAST(c_nationkey - 12 AS DOUBLE) * 300 AS b, c_nationkey + 1 AS k FROM customer)
    SELECT c_custkey, CASE WHEN abs(a) >= abs(b) THEN a ELSE b END AS hi, CASE WHEN abs(a) <= abs(b) THEN a ELSE b END AS lo, a * pow(2, k % 5) AS scaled, abs(a) * sign(b) AS signed,
    c_custkey * 3000000000 AS big, round(a - k * round_even(a / k, 0), 6) AS rest FROM x""")
def math_magnitude(ctx):
    a, b, k = F.col("c_acctbal"), (F.col("c_nationkey") - 12).cast("double") * 300, F.col("c_nationkey") + 1
    return ctx.query("customer").select("c_custkey", hi=numeric.max_magnitude(a, b), lo=numeric.min_magnitude(a, b), scaled=numeric.scale_b(a, k % 5), signed=numeric.copy_sign(a, b), big=numeric.big_mul(F.col("c_custkey"), F.lit(3_000_000_000)), rest=F.round(numeric.ieee_remainder(a, k), 6)).df


@query("""WITH x AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,2)) - 1000 AS d, CAST(p_size AS DECIMAL(12,2)) + 0.25 AS e FROM part)
    SELECT p_partkey, CAST(floor(d) AS DOUBLE) AS down, CAST(ceil(d) AS DOUBLE) AS up, CAST(abs(d) AS DOUBLE) AS size, CAST(trunc(d) AS DOUBLE) AS cut, CAST(d + e AS DOUBLE) AS total, CAST(d - e AS DOUBLE) AS less,
    CAST(d * e AS DOUBLE) AS times, round(CAST(d AS DOUBLE) / CAST(e AS DOUBLE), 4) AS parts, CAST(d % e AS DOUBLE) AS rest, CAST(-d AS DOUBLE) AS minus, CASE WHEN d < e THEN -1 WHEN d > e THEN 1 ELSE 0 END AS cmp FROM x""")
def decimal_ops(ctx):
    d, e = F.col("p_retailprice").cast("decimal(12,2)") - F.lit(1000).cast("decimal(4,0)"), F.col("p_size").cast("decimal(12,2)") + F.lit("0.25").cast("decimal(3,2)")
    m = numeric.PLAIN
    made = {"down": m["floor"](d), "up": m["ceiling"](d), "size": m["abs"](d), "cut": numeric.truncate(d), "total": d + e, "less": d - e, "times": d * e, "rest": numeric.modulo(d, e), "minus": -d}
    return ctx.query("part").select("p_partkey", **{k: dbl(v) for k, v in made.items()}, parts=F.round(dbl(d / e), 4), cmp=numeric.compare(d, e)).df


@query("""WITH x AS (SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:30:45') AS s FROM events), y AS (SELECT event_id, s, abs(s) AS n FROM x)
    SELECT event_id, s // 86400000000 AS d, (s // 3600000000) % 24 AS h, (s // 60000000) % 60 AS m, (s // 1000000) % 60 AS sec, s / 86400000000.0::DOUBLE AS td, s / 60000000.0::DOUBLE AS tm, s / 1000000.0::DOUBLE AS ts, s / 1000.0::DOUBLE AS tms,
    CASE WHEN s < 0 THEN '-' ELSE '' END || CASE WHEN n >= 86400000000 THEN (n // 86400000000) || '.' ELSE '' END || printf('%02d:%02d:%02d', (n // 3600000000) % 24, (n // 60000000) % 60, (n // 1000000) % 60)
    || CASE WHEN n % 1000000 > 0 THEN '.' || printf('%06d', n % 1000000) || '0' ELSE '' END AS t, CASE WHEN s < 0 THEN -1 WHEN s > 0 THEN 1 ELSE 0 END AS cmp FROM y""")
def span_members(ctx):
    s = dates.span(F.col("ts"), F.lit("2024-01-15 12:30:45").cast("timestamp_ntz"))
    return ctx.query("events").select("event_id", d=dates.span_days(s), h=dates.span_hours(s), m=dates.span_minutes(s), sec=dates.span_seconds(s), td=dates.total_days(s), tm=dates.total_minutes(s), ts=dates.total_seconds(s), tms=dates.total_milliseconds(s), t=dates.span_text(s), cmp=numeric.compare(s, F.lit(0))).df


@query("""WITH x AS (SELECT event_id, epoch_us(ts) % 86400000000 AS t FROM events)
    SELECT event_id, t // 3600000000 AS h, (t // 60000000) % 60 AS m, (t // 1000000) % 60 AS s, (t // 1000) % 1000 AS ms, t % 1000 AS us, 0 AS ns, t * 10 AS ticks, t // 2 AS half, CASE WHEN t < 43200000000 THEN -1 WHEN t > 43200000000 THEN 1 ELSE 0 END AS cmp FROM x""")
def time_members(ctx):
    t = dates.time_of_day(F.col("ts"))
    half = dates.time_from_span(F.floor(t / 2).cast("long"))
    return ctx.query("events").select("event_id", h=dates.time_hour(t), m=dates.time_minute(t), s=dates.time_second(t), ms=dates.time_millisecond(t), us=dates.time_microsecond(t), ns=dates.nanosecond(t), ticks=dates.time_ticks(t), half=half, cmp=numeric.compare(t, F.lit(43_200_000_000))).df


_FORM = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("""SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS h, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS m, strftime(ts - INTERVAL 45 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS s,
    strftime(ts + INTERVAL 1500 MILLISECOND, '%Y-%m-%d %H:%M:%S.%f') AS ms, strftime(ts + INTERVAL 1234567 MICROSECOND, '%Y-%m-%d %H:%M:%S.%f') AS ticks, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day,
    minute(ts) AS mi, second(ts) AS se, millisecond(ts) % 1000 AS mil, epoch_us(ts) % 1000 AS mic, 0 AS nan FROM events""")
def date_add_small(ctx):
    t = F.col("ts")
    text = lambda x: F.date_format(x, _FORM)
    return ctx.query("events").select(
        "event_id", h=text(dates.add_hours(t, 5)), m=text(dates.add_minutes(t, 90)), s=text(dates.add_seconds(t, -45)), ms=text(dates.add_milliseconds(t, 1500)), ticks=text(dates.add_ticks(t, 12_345_678)),
        day=F.date_format(dates.date_of(t), _FORM[:19]), mi=F.minute(t), se=F.second(t), mil=dates.millisecond(t), mic=dates.microsecond(t), nan=dates.nanosecond(t),
    ).df


@query("""SELECT o_orderkey, month(CAST(o_orderdate AS DATE)) AS m, dayofyear(CAST(o_orderdate AS DATE)) AS doy, strftime(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY, '%Y-%m-%d') AS later, strftime(CAST(o_orderdate AS DATE) - INTERVAL 2 MONTH, '%Y-%m-%d') AS before,
    strftime(DATE '0001-01-01' + CAST(700000 + o_orderkey % 1000 AS INTEGER), '%Y-%m-%d') AS numbered, strftime(CAST(o_orderdate AS DATE) + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS at,
    CASE WHEN CAST(o_orderdate AS DATE) < DATE '1995-06-17' THEN -1 WHEN CAST(o_orderdate AS DATE) > DATE '1995-06-17' THEN 1 ELSE 0 END AS cmp FROM orders""")
def date_only(ctx):
    d = F.to_date("o_orderdate")
    text = lambda x, n=10: F.date_format(x, _FORM[:n])
    return ctx.query("orders").select(
        "o_orderkey", m=F.month(d), doy=F.dayofyear(d), later=text(dates.add_days(d, 10)), before=text(dates.add_months(d, -2)), numbered=text(dates.from_day_number((F.col("o_orderkey") % 1000 + 700_000).cast("int"))),
        at=text(dates.to_instant(d, F.lit(90 * 60_000_000)), 16), cmp=numeric.compare(d, F.lit("1995-06-17").cast("date")),
    ).df


def _zoned():
    return dates.with_offset(F.col("o_orderdate").cast("timestamp"), (F.col("o_orderkey") % 5 * 60 - 120).cast("int"))


@query("""SELECT o_orderkey, strftime(o_orderdate + to_minutes(CAST(o_orderkey % 5 * 60 - 120 AS INTEGER)), '%Y-%m-%d %H:%M') AS local, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS utc, (o_orderkey % 5 * 60 - 120) * 60000000 AS shift,
    o_orderkey % 5 = 2 AS same_told, true AS same FROM orders""")
def offset_parts(ctx):
    z, plain = _zoned(), dates.with_offset(F.col("o_orderdate").cast("timestamp"), 0)
    text = lambda x: F.date_format(x, _FORM[:16])
    return ctx.query("orders").select("o_orderkey", local=text(dates.local_part(z)), utc=text(dates.utc_part(z)), shift=dates.offset_span(z), same_told=z == plain, same=dates.same_instant(z, plain)).df


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY o_orderdate""")
def offset_group(ctx):
    grouped = ctx.query("orders").select("o_orderkey", z=_zoned()).group_by("z", n=g.count())
    return grouped.select("n", day=F.date_format(F.col("z.instant"), _FORM[:10])).df


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def offset_distinct_by(ctx):
    return ctx.query("orders").select("o_orderkey", z=_zoned()).order_by("o_orderkey").distinct_by("z").select("o_orderkey").df


@query("""WITH c AS (SELECT doc_id, substr(text, 1, 1) AS a, substr(text, 6, 1) AS b FROM documents)
    SELECT doc_id, a BETWEEN 'a' AND 'z' AS low, regexp_matches(b, '^[\\x00-\\x1F\\x7F]$') AS control, regexp_matches(b, '^[A-Za-z0-9]$') AS either, CASE WHEN regexp_matches(b, '^[0-9]$') THEN CAST(b AS DOUBLE) ELSE -1 END AS number FROM c""")
def char_rest(ctx):
    a, b = strings.char_at(F.col("text"), 0), strings.char_at(F.col("text"), 5)
    return ctx.query("documents").select("doc_id", low=strings.is_lower(a), control=strings.is_control(b), either=strings.is_letter_or_digit(b), number=strings.numeric_value(b)).df


@query("""SELECT d.doc_id, ltrim('..' || source, '.') AS head, coalesce(lang, '') = '' AS none, quality IS NOT DISTINCT FROM toxic AS same, quality IS DISTINCT FROM toxic AS other FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def null_safe_equality(ctx):
    joined = ctx.query("documents").left_join(ctx.query("labels"), "doc_id", "doc_id")
    head = strings.trim_start(F.concat(F.lit(".."), F.col("source")), ".")
    return joined.select("l.doc_id", head.alias("head"), strings.is_null_or_empty(F.col("lang")).alias("none"), equal("quality", "toxic").alias("same"), not_equal("quality", "toxic").alias("other"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value END AS v FROM events)
    SELECT event_id, event_id % 4 = 1 AS plus, event_id % 4 = 2 AS minus FROM x""")
def infinities(ctx):
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return ctx.query("events").select("event_id", plus=numeric.is_positive_infinity(v), minus=numeric.is_negative_infinity(v)).df


@query("""SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS d, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS dec, o_orderkey % 2 = 0 AS b, strftime(o_orderdate, '%Y/%m/%d') AS t,
    (o_orderkey % 24) * 3600000000 + 1500000 AS span, (o_orderkey % 24) * 3600000000 + 60000000 AS time, printf('%08x', o_orderkey) || '-0000-0000-0000-0123456789ab' AS guid, o_orderkey <> 0 AS flag, CAST(o_orderkey % 128 AS TINYINT) AS small FROM orders""")
def parse_all(ctx):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    hour = F.lpad((key % 24).cast("string"), 2, "0")
    guid = F.concat(F.lpad(F.upper(F.hex(key)), 8, "0"), F.lit("-0000-0000-0000-0123456789AB"))
    return ctx.query("orders").select(
        "o_orderkey", d=convert.parse(F.concat(F.lit(" "), price.cast("string")), "double"), dec=dbl(convert.parse(price.cast("decimal(18,2)").cast("string"), "decimal(18,2)")),
        b=convert.parse_bool(convert.bool_text(key % 2 == 0)), t=F.date_format(convert.parse_exact(F.date_format("o_orderdate", "yyyy/MM/dd"), "yyyy/MM/dd"), "yyyy/MM/dd"),
        span=dates.parse_span(F.concat(hour, F.lit(":00:01.5"))), time=dates.parse_time(F.concat(hour, F.lit(":01"))), guid=convert.parse_guid(guid), flag=key.cast("boolean"), small=convert.to_integral(key % 128, "tinyint"),
    ).df


@query("""SELECT o_orderkey, CASE WHEN o_custkey < 500 THEN -1 WHEN o_custkey > 500 THEN 1 ELSE 0 END AS i, CASE WHEN o_totalprice < 150000 THEN -1 WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS d,
    CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN -1 WHEN o_orderdate > TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END AS t, CASE WHEN o_orderpriority < '3' THEN -1 WHEN o_orderpriority > '3' THEN 1 ELSE 0 END AS s FROM orders""")
def compare_all(ctx):
    c = numeric.compare
    return ctx.query("orders").select("o_orderkey", i=c(F.col("o_custkey"), F.lit(500)), d=c(F.col("o_totalprice"), F.lit(150_000.0)), t=c(F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp_ntz")), s=strings.compare(F.col("o_orderpriority"), F.lit("3"))).df


# one row, by methods of the query

@query("""(SELECT 'least' AS which, c_custkey FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 1) UNION ALL (SELECT 'most', c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 1) UNION ALL SELECT 'found', c_custkey FROM customer WHERE c_custkey = 42""")
def extremes_and_find(ctx):
    q = ctx.query("customer")
    row = lambda df, which: df.select(F.lit(which).alias("which"), "c_custkey")
    return row(q.least_by("c_acctbal"), "least").union(row(q.most_by("c_acctbal"), "most")).union(row(ctx.found("customer", 42), "found"))


@query("""SELECT n_nationkey, any_value(n_name) AS name FROM nation GROUP BY n_nationkey""")
def group_only(ctx):
    return ctx.query("nation").group_by("n_nationkey", name=g.only(F.col("n_name"))).df


# relations

@query("""SELECT c_mktsegment, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2)::DOUBLE AS spent FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def group_by_navigation(ctx):
    q = ctx.query("orders").with_parent("customer", "c_mktsegment")
    return q.group_by("c_mktsegment", n=g.count(), spent=dbl(F.sum(F.col("o_totalprice").cast("decimal(18,2)")))).df


@query("""WITH s AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS u FROM lineitem) SELECT p, u, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM s JOIN lineitem ON l_partkey = p AND l_suppkey = u GROUP BY p, u""")
def include_composite_key(ctx):
    ctx.tables.add("supplies", lambda: ctx.tables.read("lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("u")).distinct())
    ctx.entity("supplies", key=("p", "u")).has_many("lines", "lineitem", ("p", "u"), ("l_partkey", "l_suppkey"))
    q = ctx.query("supplies").include("lines", ["l_orderkey", "l_linenumber", "l_quantity"])
    total = F.aggregate("lines", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["l_quantity"].cast("decimal(18,2)")).cast("decimal(28,2)"))
    return q.select("p", "u", n=F.size("lines"), q=dbl(total)).df


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)""")
def delete_correlated(ctx):
    gone = (F.col("t.o_custkey") == F.col("s.c_custkey")) & (F.col("s.c_acctbal") < 0)
    return write.delete_where_any(ctx.query("orders").df, ctx.query("customer").df, gone).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50)""")
def delete_paged(ctx):
    q = ctx.query("orders")
    return write.delete_window(q.df, q.order_by("o_totalprice", descending=True).take(50).df, ["o_orderkey"]).select("o_orderkey")


# beyond the engine, and queries made once

@query("""SELECT c_custkey, upper(reverse(c_name)) AS back FROM customer""")
def client_projection(ctx):
    ctx.client_evaluation = "allow"
    back = lambda b: b[["c_custkey"]].assign(back=b["c_name"].str[::-1].str.upper())
    return ctx.query("customer").select("c_custkey", "c_name").map_batches(back, "c_custkey long, back string")


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'""")
def compiled(ctx):
    made = compile_query(lambda c, price, status: c.query("orders").where(F.col("o_totalprice") > price, F.col("o_orderstatus") == status).tag_with("dear orders"))
    made(ctx, 200_000, "F")
    return made(ctx, 200_000, "F").select("o_orderkey").df


# sequences over tables of many partitions

@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) AS i FROM orders), c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal NULLS FIRST, c_custkey) AS i FROM customer)
    SELECT o_orderkey, c_custkey FROM o JOIN c USING (i)""")
def zip_orders(ctx):
    pairs = ctx.query("orders").order_by("o_totalprice").zip(ctx.query("customer").order_by("c_acctbal"))
    return pairs.select("first.o_orderkey", "second.c_custkey")


@query("""SELECT (i - 1) // 100 AS chunk, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) AS i FROM orders) GROUP BY 1""")
def chunk_orders(ctx):
    keys = F.transform("items", lambda x: x["o_orderkey"])
    return ctx.query("orders").order_by("o_totalprice").chunk(100).select("chunk", F.size("items").cast("long").alias("n"), F.array_min(keys).alias("low"), F.array_max(keys).alias("high"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders""")
def reverse_orders(ctx):
    return ctx.query("orders").order_by("o_totalprice").reverse().with_row_number("rn").select("o_orderkey", "rn").df


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY side, o_totalprice NULLS FIRST, o_orderkey) AS rn FROM
    (SELECT o_orderkey, o_totalprice, 0 AS side FROM orders UNION ALL SELECT -1, NULL, -1 UNION ALL SELECT -2, NULL, 1)""")
def append_prepend_orders(ctx):
    q = ctx.query("orders").select("o_orderkey", "o_totalprice").order_by("o_totalprice").prepend(o_orderkey=-1).append(o_orderkey=-2)
    return q.with_row_number("rn").select("o_orderkey", "rn").df


@query("""WITH a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), b AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) - 1 AS i FROM orders)
    SELECT i AS place FROM a JOIN b USING (i) WHERE a.k <> b.k""")
def sequence_differences(ctx):
    q = ctx.query("orders").select("o_orderkey", "o_totalprice")
    return q.order_by("o_orderkey").differences(q.order_by("o_totalprice")).select(F.col("__position").alias("place"))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey) AS i FROM orders) WHERE i > 120""")
def skip_orders(ctx):
    return ctx.query("orders").order_by("o_totalprice").skip(120).select("o_orderkey").df


@query("""SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT -1, 0.5""")
def default_if_some(ctx):
    q = ctx.query("customer").select("c_custkey", "c_acctbal")
    none = q.where(F.lit(False)).default_if_empty(c_custkey=-1, c_acctbal=0.5)
    return q.default_if_empty(c_custkey=-9).concat(none).df


@query("""SELECT p_partkey, contains(lower(p_type), 'an') AS c, starts_with(lower(p_type), 'eco') AS s, lower(p_brand) = 'brand#13' AS e, instr(lower(p_type), 'o') - 1 AS at, p_brand = 'BRAND#13' AS exact,
    CASE WHEN lower(p_name) < lower(p_type) THEN -1 WHEN lower(p_name) > lower(p_type) THEN 1 ELSE 0 END AS cmp FROM part""")
def str_modes(ctx):
    kind, brand = F.col("p_type"), F.col("p_brand")
    return ctx.query("part").select(
        "p_partkey", c=strings.contains(kind, "AN", ignore_case=True), s=strings.starts_with(kind, "eco", ignore_case=True), e=strings.equals(brand, "BRAND#13", ignore_case=True),
        at=strings.index_of(kind, "O", ignore_case=True), exact=strings.equals(brand, "BRAND#13"), cmp=strings.compare_ignore_case(F.col("p_name"), kind),
    ).df


@query("""SELECT event_id, '{' || strftime(ts, '%Y-%m-%d') || '} at ' || strftime(ts, '%H:%M:%S') || ' ' || lpad(event_type, 9, ' ') AS t, CASE WHEN value > 50 THEN 'True' ELSE 'False' END AS b, strftime(ts, '%Y-%m-%d %H:%M:%S') AS plain, CAST(event_id AS VARCHAR) AS i FROM events WHERE value IS NOT NULL""")
def text_of_values(ctx):
    ts = F.col("ts")
    text = strings.format("{{{0:yyyy-MM-dd}}} at {0:HH:mm:ss} {1,9}", ts, F.col("event_type"))
    return ctx.query("events").where(F.col("value").isNotNull()).select("event_id", t=text, b=convert.to_text(F.col("value") > 50, "boolean"), plain=convert.to_text(ts, "timestamp_ntz"), i=convert.to_text(F.col("event_id"), "bigint")).df


@query("""SELECT n_name, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey""")
def flatten_navigation(ctx):
    return ctx.query("nation").flatten("customers", "c_custkey", default_if_empty=True).select("n_name", "c_custkey").df


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def cast_type(ctx):
    return ctx.query("orders").of_type("o_orderstatus", "F").cast_type("o_orderstatus", "F").select("o_orderkey").df


@query("""SELECT p_partkey, p_retailprice * 0.75 AS net, p_size + 1 AS more, p_brand || '!' AS loud FROM part""")
def mapped_functions(ctx):
    net = udf.register_sql(ctx.spark, "marlspike_net", "price double, rate double", "double", "price * (1 - rate)")
    ctx.functions.add("Net", net)
    ctx.functions.add("Next", lambda x: x + 1, "int")
    ctx.functions.add("Next", lambda x: F.concat(x, F.lit("!")), "string")
    call = ctx.functions.call
    return ctx.query("part").select("p_partkey", net=call("Net", F.col("p_retailprice"), F.lit(0.25)), more=call("Next", F.col("p_size"), kind="int"), loud=call("Next", F.col("p_brand"), kind="string")).df


@query("""SELECT count(*) AS n, sum(c_custkey) AS keys FROM customer""")
def by_name(ctx):
    del ctx.entities["customer"]
    return ctx.query("customer").aggregate(n=g.count(), keys=F.sum("c_custkey"))


@query("""SELECT o_orderkey, true AS same, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS utc FROM orders""")
def offset_from_parts(ctx):
    t, minutes = F.col("o_orderdate"), (F.col("o_orderkey") % 5 * 60 - 120).cast("int")
    shown = dates.local_part(_zoned())
    made = dates.offset_from_parts(F.year(shown), F.month(shown), F.dayofmonth(shown), F.hour(shown), F.minute(shown), F.second(shown), minutes)
    return ctx.query("orders").select("o_orderkey", same=dates.same_instant(made, dates.with_offset(t.cast("timestamp"), 0)), utc=F.date_format(dates.utc_part(made), _FORM[:16])).df


@query("""SELECT event_id, CAST(now() AS TIMESTAMP) > ts AS past, current_date >= CAST(ts AS DATE) AS by_today, true AS same, 36 AS guid, true AS unit FROM events""")
def clocks_and_chance(ctx):
    ts = F.col("ts")
    same = F.abs(F.unix_micros(dates.utc_now()) - dates.micros(dates.now())) <= 86_400_000_000
    chance = convert.random()
    return ctx.query("events").select("event_id", past=dates.utc_now() > ts, by_today=dates.today() >= F.to_date(ts), same=same, guid=F.length(convert.new_guid()), unit=(chance >= 0) & (chance < 1)).df


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def modifiers(ctx):
    q = ctx.query("orders").as_no_tracking().as_split_query().as_tracking().tag_with("open ones").where(F.col("o_orderstatus") == "P")
    assert q.to_query_string().startswith("-- open ones")
    return q.select("o_orderkey").df


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderkey % 10 = 0 AS conflict FROM orders""")
def checked_update(ctx):
    token = F.col("o_orderkey") % 7
    stored = ctx.query("orders").select("o_orderkey", "o_totalprice", token=token).df
    # one row in ten was read before its token changed
    read = ctx.query("orders").select("o_orderkey", o_totalprice=F.lit(0.0), token=F.when(F.col("o_orderkey") % 10 == 0, -1).otherwise(token)).df
    done, conflicts = write.checked_update(stored, read, ["o_orderkey"], "token")
    marks = conflicts.select("o_orderkey", F.lit(True).alias("conflict"))
    return done.join(marks, "o_orderkey", "left").select("o_orderkey", "o_totalprice", F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query("""SELECT 'before' AS at, 0 AS n UNION ALL SELECT 'after', count(*) FROM customer""")
def backfilled_history(ctx):
    since = datetime(2020, 1, 1)
    ctx.add_history("customer", History.backfill(ctx.scan("customer"), "c_custkey", since))
    count = lambda at, moment: ctx.query("customer", as_of=moment).aggregate(n=g.count()).select(F.lit(at).alias("at"), "n")
    return count("before", datetime(2019, 1, 1)).union(count("after", since))


@query("""SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT -1) WHERE c_custkey % 2 <> 0 ORDER BY c_custkey = -1, c_custkey DESC NULLS LAST LIMIT 3""")
def after_reshape(ctx):
    q = ctx.query("customer").where(F.col("c_acctbal") > 0).select("c_custkey").order_by("c_custkey", descending=True)
    return q.append(c_custkey=-1).where(F.col("c_custkey") % 2 != 0).take(3).select("c_custkey").df
