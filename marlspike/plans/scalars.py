"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert, dates, numeric, strings
from .registry import query


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS mid, rtrim('xx' || p_brand || 'xx', 'x') AS tail, length(p_name) AS n FROM part""")
def str_case_trim(ctx):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return ctx.query("part").select("p_partkey", up=strings.upper(name), low=strings.lower(brand), mid=strings.trim(F.concat(F.lit("  "), kind, F.lit(" "))), tail=strings.trim_end(F.concat(F.lit("xx"), brand, F.lit("xx")), "x"), n=strings.length(name)).df


@query("""SELECT p_partkey, substr(p_name, 3, 4) AS mid, substr(p_name, 3) AS rest, substr(p_name, 1, 1) AS c FROM part""")
def str_slice(ctx):
    name = F.col("p_name")
    return ctx.query("part").select("p_partkey", mid=strings.substring(name, 2, 4), rest=strings.substring(name, 2), c=strings.char_at(name, 0)).df


@query("""SELECT p_partkey, instr(p_type, 'A') - 1 AS at, replace(p_type, 'A', '_') AS swapped, substr(p_brand, 1, 2) || '<>' || substr(p_brand, 3) AS inserted, substr(p_brand, 1, 1) || substr(p_brand, 4) AS removed FROM part""")
def str_index_replace(ctx):
    kind, brand = F.col("p_type"), F.col("p_brand")
    return ctx.query("part").select("p_partkey", at=strings.index_of(kind, "A"), swapped=strings.replace(kind, "A", "_"), inserted=strings.insert(brand, 2, "<>"), removed=strings.remove(brand, 1, 2)).df


@query("""SELECT p_partkey, CASE WHEN length(p_brand) >= 12 THEN p_brand ELSE lpad(p_brand, 12, '.') END AS l, CASE WHEN length(p_brand) >= 3 THEN p_brand ELSE rpad(p_brand, 3, ' ') END AS r FROM part""")
def str_pad(ctx):
    return ctx.query("part").select("p_partkey", l=strings.pad_left(F.col("p_brand"), 12, "."), r=strings.pad_right(F.col("p_brand"), 3)).df


@query("""SELECT p_partkey, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS cmp, starts_with(p_type, 'S') AS s, ends_with(lower(p_type), 'l') AS e, contains(p_name, 'a') AS c FROM part""")
def str_compare(ctx):
    name, kind = F.col("p_name"), F.col("p_type")
    return ctx.query("part").select("p_partkey", cmp=strings.compare(name, kind), s=strings.starts_with(kind, "S"), e=strings.ends_with(kind, "L", ignore_case=True), c=strings.contains(name, "a")).df


@query("""SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'none' ELSE 'q' || quality END AS t, coalesce(lang, '') || '-' || coalesce(CAST(toxic AS VARCHAR), '') AS joined, source IS NULL OR trim(source) = '' AS blank
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def str_null_rules(ctx):
    joined = ctx.query("documents").left_join(ctx.query("labels"), "doc_id", "doc_id")
    return joined.select("l.doc_id", F.when(F.col("quality").isNull(), "none").otherwise(strings.concat(F.lit("q"), F.col("quality"))).alias("t"), strings.join("-", F.col("lang"), F.col("toxic")).alias("joined"), strings.is_null_or_white_space(F.col("source")).alias("blank"))


@query("""SELECT p_partkey, '#' || p_partkey || ' ' || lpad(CAST(p_size AS VARCHAR), 4, ' ') || '|' || rpad(p_brand, 10, ' ') || '|' || printf('%.2f', p_retailprice) AS t FROM part""")
def str_format(ctx):
    return ctx.query("part").select("p_partkey", t=strings.format("#{0} {1,4}|{2,-10}|{3:F2}", F.col("p_partkey"), F.col("p_size"), F.col("p_brand"), F.col("p_retailprice"))).df


@query("""SELECT p_partkey FROM part WHERE p_type LIKE '%E%L' AND p_name ILIKE '%A%'""")
def like_ilike(ctx):
    return ctx.query("part").where(strings.like(F.col("p_type"), "%E%L"), strings.ilike(F.col("p_name"), "%A%")).select("p_partkey").df


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Z]{4,}!!')""")
def regex_match(ctx):
    return ctx.query("documents").where(strings.is_match(F.col("text"), "[A-Z]{4,}!!")).select("doc_id").df


@query("""SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS shape FROM pages""")
def regex_replace(ctx):
    return ctx.query("pages").select("page_id", shape=strings.regex_replace(F.col("url"), "[0-9]+", "#")).df


@query("""WITH c AS (SELECT doc_id, substr(text, 1, 1) AS a, substr(text, 6, 1) AS b FROM documents)
    SELECT doc_id, regexp_matches(a, '^[A-Za-z]$') AS letter, regexp_matches(b, '^[0-9]$') AS digit, b IN (' ', chr(9), chr(10), chr(13)) AS space, a BETWEEN 'A' AND 'Z' AS up,
    regexp_matches(b, '^[!-#%-*,-/:;?@\\[-\\]_{}]$') AS punct, regexp_matches(b, '^[$+<=>^`|~]$') AS symbol FROM c""".replace("\\\\", "\\"))
def char_classes(ctx):
    a, b = strings.char_at(F.col("text"), 0), strings.char_at(F.col("text"), 5)
    return ctx.query("documents").select("doc_id", letter=strings.is_letter(a), digit=strings.is_digit(b), space=strings.is_white_space(b), up=strings.is_upper(a), punct=strings.is_punctuation(b), symbol=strings.is_symbol(b)).df


@query("""SELECT o_orderkey, round_even(o_orderkey / 2.0, 0)::DOUBLE AS half, round(o_orderkey / 2.0, 0)::DOUBLE AS away, trunc(o_totalprice / -7)::BIGINT AS cut FROM orders""")
def math_round_even(ctx):
    half = F.col("o_orderkey") / F.lit(2.0)
    return ctx.query("orders").select("o_orderkey", half=numeric.round_even(half).cast("double"), away=numeric.round_away(half).cast("double"), cut=numeric.truncate(F.col("o_totalprice") / -7)).df


@query("""SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(atan2(p_size, 3), 9) AS a, round(ln(p_size) / ln(3.0::DOUBLE), 9) AS l3, round(sqrt(p_size), 9) AS r, round(cbrt(p_size), 9) AS r3, round(pow(p_size, 1.5), 6) AS p, round(log10(p_size), 9) AS l10 FROM part""")
def math_trig(ctx):
    x, m = F.col("p_size").cast("double"), numeric.PLAIN
    return ctx.query("part").select("p_partkey", s=F.round(m["sin"](x), 9), c=F.round(m["cos"](x), 9), a=F.round(m["atan2"](x, F.lit(3.0)), 9), l3=F.round(numeric.log(x, 3), 9), r=F.round(m["sqrt"](x), 9), r3=F.round(m["cbrt"](x), 9), p=F.round(m["pow"](x, F.lit(1.5)), 6), l10=F.round(m["log10"](x), 9)).df


@query("""SELECT d.doc_id, CASE WHEN quality IS NULL THEN NULL ELSE least(quality, toxic) END AS lo, CASE WHEN quality IS NULL THEN NULL ELSE greatest(quality, toxic) END AS hi, least(greatest(n_chars, 500), 2000) AS c, sign(n_chars - 1000)::INTEGER AS s
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def math_minmax_clamp(ctx):
    joined = ctx.query("documents").left_join(ctx.query("labels"), "doc_id", "doc_id")
    return joined.select("l.doc_id", numeric.least(F.col("quality"), F.col("toxic")).alias("lo"), numeric.greatest(F.col("quality"), F.col("toxic")).alias("hi"), numeric.clamp(F.col("n_chars"), 500, 2000).alias("c"), numeric.sign(F.col("n_chars") - 1000).alias("s"))


@query("""SELECT o_orderkey, (o_orderkey - 500) // 7 AS q, (o_orderkey - 500) % 7 AS r FROM orders""")
def integer_division(ctx):
    return ctx.query("orders").select("o_orderkey", q=numeric.int_div("o_orderkey - 500", "7"), r=numeric.modulo(F.col("o_orderkey") - 500, F.lit(7))).df


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, dayofyear(o_orderdate) AS doy, dayofweek(o_orderdate) AS dow,
    day(last_day(o_orderdate)) AS dim, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap FROM orders""")
def date_parts(ctx):
    t = F.col("o_orderdate")
    y, m = F.year(t), F.month(t)
    return ctx.query("orders").select("o_orderkey", y=y, m=m, d=F.dayofmonth(t), h=F.hour(t), doy=F.dayofyear(t), dow=dates.day_of_week(t), dim=dates.days_in_month(y, m), leap=dates.is_leap_year(y)).df


@query("""SELECT event_id, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts + INTERVAL 1 MONTH, '%Y-%m-%d') AS b, strftime(ts - INTERVAL 1 YEAR, '%Y-%m-%d') AS c FROM events""")
def date_add(ctx):
    t, form = F.col("ts"), "yyyy-MM-dd HH:mm:ss"
    return ctx.query("events").select("event_id", a=F.date_format(dates.add_days(t, 1.5), form), b=F.date_format(dates.add_months(t, 1), form[:10]), c=F.date_format(dates.add_years(t, -1), form[:10])).df


def _date_diff(ctx, orders):
    joined = orders.join(ctx.query("lineitem"), "o_orderkey", "l_orderkey")
    s = dates.span(F.col("l_shipdate"), F.col("o_orderdate"))
    return joined.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", dates.total_hours(s).alias("hours"), dates.span_days(s).alias("days"))


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0::DOUBLE AS hours,
    trunc((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE)::BIGINT AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def date_diff(ctx):
    return _date_diff(ctx, ctx.query("orders"))


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0::DOUBLE AS hours,
    trunc((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE)::BIGINT AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def date_diff_all(ctx):
    return _date_diff(ctx, ctx.query("orders"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS t, epoch_us(o_orderdate) * 10 + 621355968000000000 AS ticks, date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) AS day_number FROM orders""")
def date_format(ctx):
    t = F.col("o_orderdate")
    return ctx.query("orders").select("o_orderkey", t=F.date_format(t, "dd/MM/yyyy"), ticks=dates.ticks(t), day_number=dates.day_number(F.to_date(t))).df


@query("""SELECT event_id, hour(ts) AS h, (epoch_us(ts) % 86400000000 + 7200000000) % 86400000000 AS later,
    CASE WHEN 79200000000 <= 21600000000 THEN false ELSE (epoch_us(ts) % 86400000000 >= 79200000000 OR epoch_us(ts) % 86400000000 < 21600000000) END AS night FROM events""")
def time_of_day(ctx):
    t = dates.time_of_day(F.col("ts"))
    return ctx.query("events").select("event_id", h=dates.time_hour(t), later=dates.time_add(t, 7_200_000_000), night=dates.time_between(t, F.lit(79_200_000_000), F.lit(21_600_000_000))).df


@query("""SELECT p_partkey, CAST(round_even(p_retailprice, 0) AS INTEGER) AS near, CAST(trunc(p_retailprice) AS INTEGER) AS cut, CAST(p_size AS VARCHAR) AS t, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS tail FROM part""")
def convert_cast(ctx):
    price = F.col("p_retailprice")
    return ctx.query("part").select("p_partkey", near=convert.to_integral(price), cut=convert.truncating(price), t=F.col("p_size").cast("string"), tail=convert.try_parse(strings.substring(F.col("p_brand"), 6), "int")).df


STATUS = {"Finished": 1, "Open": 2, "Partial": 4}


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END AS number, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Partial' END AS name,
    (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END & 4) = 4 AS flag FROM orders""")
def enum_names(ctx):
    long_name = F.when(F.col("o_orderstatus") == "F", "Finished").when(F.col("o_orderstatus") == "O", "Open").otherwise("Partial")
    number = convert.enum_parse(long_name, STATUS)
    return ctx.query("orders").select("o_orderkey", number=number, name=convert.enum_name(number, STATUS), flag=convert.has_flag(number, 4)).df


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_value(ctx):
    return ctx.query("events").select("event_id", k=convert.json_value(F.col("props"), "$.k", "int")).df


@query("""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 1e-310 ELSE value END AS v FROM events)
    SELECT event_id, isnan(v) AS nan, isinf(v) AS inf, isfinite(v) AS fin, isfinite(v) AND abs(v) >= 2.2250738585072014e-308 AS normal, abs(v) > 0 AND abs(v) < 2.2250738585072014e-308 AS sub FROM x""")
def ieee_predicates(ctx):
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(1e-310)).otherwise(F.col("value"))
    return ctx.query("events").select("event_id", v=v).select("event_id", nan=numeric.is_nan(F.col("v")), inf=numeric.is_infinity(F.col("v")), fin=numeric.is_finite(F.col("v")), normal=numeric.is_normal(F.col("v")), sub=numeric.is_subnormal(F.col("v"))).df
