"""Instants, dates, times of day (microseconds as long) and spans of time (microseconds as long)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_OF_DAY = 86_400_000_000
#: Ticks of 100 ns from year 1 to 1970.
EPOCH_TICKS = 621_355_968_000_000_000
FIRST_DAY = "0001-01-01"


def micros(t: Column) -> Column:
    """Microseconds since 1970; a timestamp without zone counts as the session's."""
    return F.unix_micros(t.cast("timestamp"))


def ticks(t: Column) -> Column:
    return micros(t) * 10 + EPOCH_TICKS


def add_micros(t: Column, n: Column) -> Column:
    return F.timestamp_micros(micros(t) + n.cast("long"))


def _add(unit: int):
    def add(t: Column, n) -> Column:
        n = n if isinstance(n, Column) else F.lit(n)
        return add_micros(t, F.bround(n * F.lit(unit).cast("long")).cast("long"))

    return add


add_days = _add(MICROS_OF_DAY)
add_hours = _add(3_600_000_000)
add_minutes = _add(60_000_000)
add_seconds = _add(1_000_000)
add_milliseconds = _add(1000)


def add_ticks(t: Column, n) -> Column:
    """A tick is a tenth of a microsecond; what is below one is cut off."""
    n = n if isinstance(n, Column) else F.lit(n)
    return add_micros(t, truncated(n, 10))


def add_months(t: Column, n) -> Column:
    """Clamps to the end of the month."""
    return t + F.make_ym_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def add_years(t: Column, n) -> Column:
    return t + F.make_ym_interval(n if isinstance(n, Column) else F.lit(n), F.lit(0))


def day_of_week(t: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(t) - 1


def millisecond(t: Column) -> Column:
    return F.pmod(F.floor(micros(t) / 1000), F.lit(1000)).cast("int")


def microsecond(t: Column) -> Column:
    return F.pmod(micros(t), F.lit(1000)).cast("int")


def date_of(t: Column) -> Column:
    return F.date_trunc("DAY", t)


def time_of_day(t: Column) -> Column:
    return F.pmod(micros(t), F.lit(MICROS_OF_DAY))


def is_leap_year(y: Column) -> Column:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def days_in_month(y: Column, m: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))


def day_number(d: Column) -> Column:
    return F.datediff(d, F.lit(FIRST_DAY).cast("date"))


def from_day_number(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n)


def to_instant(d: Column, time: Column) -> Column:
    return F.timestamp_micros(micros(d.cast("timestamp")) + time)


def truncated(n: Column, unit: int) -> Column:
    """Whole units in ``n``, toward zero."""
    return F.when(n < 0, -F.floor(-n / unit)).otherwise(F.floor(n / unit)).cast("long")


def span(a: Column, b: Column) -> Column:
    """``a - b``."""
    return micros(a) - micros(b)


def span_days(s: Column) -> Column:
    return truncated(s, MICROS_OF_DAY)


def _member(unit: int, modulus: int):
    """A member of a span keeps the span's sign."""
    return lambda s: (truncated(s, unit) % modulus).cast("int")


span_hours = _member(3_600_000_000, 24)
span_minutes = _member(60_000_000, 60)
span_seconds = _member(1_000_000, 60)


def total(unit: float):
    return lambda s: s / F.lit(float(unit))


total_days, total_hours, total_minutes = total(MICROS_OF_DAY), total(3_600_000_000), total(60_000_000)
total_seconds, total_milliseconds = total(1_000_000), total(1000)


def span_text(s: Column) -> Column:
    """``[-][d.]hh:mm:ss[.fffffff]``."""
    n = F.abs(s)
    days = F.floor(n / MICROS_OF_DAY)
    part = lambda unit, mod: F.format_string("%02d", (F.floor(n / unit) % mod).cast("long"))
    fraction = n % 1_000_000
    return F.concat(
        F.when(s < 0, "-").otherwise(""),
        F.when(days > 0, F.format_string("%d.", days)).otherwise(""),
        part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60),
        F.when(fraction > 0, F.format_string(".%06d0", fraction)).otherwise(""),
    )


# times of day

def time_add(t: Column, span_micros) -> Column:
    """Wraps at midnight."""
    span_micros = span_micros if isinstance(span_micros, Column) else F.lit(span_micros)
    return F.pmod(t + span_micros, F.lit(MICROS_OF_DAY))


def time_between(t: Column, a: Column, b: Column) -> Column:
    """From ``a`` up to ``b``; over midnight where ``b`` is earlier."""
    return F.when(a <= b, (t >= a) & (t < b)).otherwise((t >= a) | (t < b))


def time_hour(t: Column) -> Column:
    return F.floor(t / 3_600_000_000).cast("int")


def time_minute(t: Column) -> Column:
    return (F.floor(t / 60_000_000) % 60).cast("int")


def time_second(t: Column) -> Column:
    return (F.floor(t / 1_000_000) % 60).cast("int")


# instants with an offset: struct(instant, offset_minutes)

def with_offset(instant: Column, minutes) -> Column:
    """An instant and the offset it is told in. As a key it is compared by its instant: see ``same_instant`` and ``by_instant``."""
    return F.struct(instant.alias("instant"), (minutes if isinstance(minutes, Column) else F.lit(minutes)).cast("int").alias("offset_minutes"))


def offset_from_parts(year, month, day, hour, minute, second, minutes: Column) -> Column:
    """The instant that a clock at an offset of ``minutes`` shows these parts at."""
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (year, month, day, hour, minute, second)]
    return with_offset(add_minutes(F.make_timestamp(*parts), -minutes), minutes)


def same_instant(a: Column, b: Column) -> Column:
    return a["instant"] == b["instant"]


def by_instant(df: DataFrame, key) -> Column | str:
    """What to group rows by: of an instant with an offset (the name of a column of ``df``), the instant told without offset."""
    if isinstance(key, str) and key in df.columns and isinstance(kind := df.schema[key].dataType, T.StructType) and kind.names == ["instant", "offset_minutes"]:
        c = F.col(f"`{key}`")
        return F.when(c.isNotNull(), with_offset(c["instant"], 0)).alias(key)
    return key


def utc_part(z: Column) -> Column:
    return z["instant"]


def offset_span(z: Column) -> Column:
    """The offset as a span of time."""
    return z["offset_minutes"].cast("long") * 60_000_000


def nanosecond(t: Column) -> Column:
    """Nanoseconds beyond the microsecond: timestamps have none."""
    return F.when(t.isNotNull(), F.lit(0))


def local_part(z: Column) -> Column:
    return add_minutes(z["instant"], z["offset_minutes"])


def in_zone(instant: Column, zone: str) -> Column:
    return F.from_utc_timestamp(instant, zone)


def time_millisecond(t: Column) -> Column:
    return (F.floor(t / 1000) % 1000).cast("int")


def time_microsecond(t: Column) -> Column:
    return (t % 1000).cast("int")


def time_ticks(t: Column) -> Column:
    return t * 10


SPAN = r"^(-?)(?:(\d+)\.)?(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,7}))?)?$"


def _held(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` names it: a column named twice is evaluated twice within a condition."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def parse_span(s: Column) -> Column:
    """``[-][d.]hh:mm[:ss[.fffffff]]`` as microseconds; raises on other text. Tenths of a microsecond are cut off."""
    def value(part: Column) -> Column:
        number = lambda k: F.concat(F.lit("0"), part[k - 1]).cast("long")
        fraction = F.substring(F.rpad(part[5], 7, "0"), 1, 6).cast("long")
        total_micros = ((number(2) * 24 + number(3)) * 3600 + number(4) * 60 + number(5)) * 1_000_000 + fraction
        return F.when(part[0] == "-", F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long")) * total_micros

    parts = F.split(F.regexp_replace(s, SPAN, "$1:$2:$3:$4:$5:$6:"), ":")
    wrong = F.raise_error(F.concat(F.lit("not a span of time: "), s)).cast("long")
    return F.when(s.isNull(), F.lit(None)).when(s.rlike(SPAN), _held(parts, value)).otherwise(wrong)


def parse_time(s: Column) -> Column:
    """A time of day as microseconds; raises on text that is none."""
    wrong = F.raise_error(F.concat(F.lit("not a time of day: "), s)).cast("long")
    return F.when(s.isNull(), F.lit(None)).otherwise(_held(parse_span(s), lambda v: F.when((v >= 0) & (v < MICROS_OF_DAY), v).otherwise(wrong)))


def utc_now() -> Column:
    """Fixed for the whole query."""
    return F.current_timestamp()


def now() -> Column:
    """The session's local time, fixed for the whole query."""
    return F.localtimestamp()


def today() -> Column:
    return F.current_date()


def time_from_span(s: Column) -> Column:
    """A span of at least nothing and less than a day as a time of day; raises on others."""
    wrong = F.raise_error(F.concat(F.lit("not a time of day: "), s.cast("string"))).cast("long")
    return F.when(s.isNull(), F.lit(None)).when((s >= 0) & (s < MICROS_OF_DAY), s).otherwise(wrong)
