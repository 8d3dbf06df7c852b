"""Strings: positions count from 0, comparison is ordinal, null concatenates as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\r\v\f\u0085 "


def length(s: Column) -> Column:
    return F.length(s)


def char_at(s: Column, i) -> Column:
    return F.substring(s, F.lit(i) + 1, F.lit(1))


def substring(s: Column, start, n=None) -> Column:
    start = start if isinstance(start, Column) else F.lit(start)
    n = F.greatest(F.length(s) - start, F.lit(0)) if n is None else (n if isinstance(n, Column) else F.lit(n))
    return F.substring(s, start + 1, n)


def equals(a: Column, b, ignore_case: bool = False) -> Column:
    """Null equals null alone."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.lower(a).eqNullSafe(F.lower(b)) if ignore_case else a.eqNullSafe(b)


def index_of(s: Column, part, ignore_case: bool = False) -> Column:
    """The place of the first ``part``, or -1."""
    if ignore_case:
        return F.instr(F.lower(s), F.lower(part if isinstance(part, Column) else F.lit(part))) - 1
    return F.locate(part, s) - 1 if isinstance(part, str) else F.instr(s, part) - 1


def contains(s: Column, part, ignore_case: bool = False) -> Column:
    part = part if isinstance(part, Column) else F.lit(part)
    return F.contains(F.lower(s), F.lower(part)) if ignore_case else F.contains(s, part)


def starts_with(s: Column, part, ignore_case: bool = False) -> Column:
    part = part if isinstance(part, Column) else F.lit(part)
    return F.startswith(F.lower(s), F.lower(part)) if ignore_case else F.startswith(s, part)


def ends_with(s: Column, part, ignore_case: bool = False) -> Column:
    part = part if isinstance(part, Column) else F.lit(part)
    return F.endswith(F.lower(s), F.lower(part)) if ignore_case else F.endswith(s, part)


def like(s: Column, pattern: str) -> Column:
    return s.like(pattern)


def ilike(s: Column, pattern: str) -> Column:
    return s.ilike(pattern)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def insert(s: Column, at: int, part: str) -> Column:
    return F.concat(F.substring(s, 1, at), F.lit(part), substring(s, at))


def remove(s: Column, at: int, n: int | None = None) -> Column:
    head = F.substring(s, 1, at)
    return head if n is None else F.concat(head, substring(s, at + n))


def pad_left(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def pad_right(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, fill))


def trim(s: Column, chars: str = WHITE_SPACE) -> Column:
    return F.btrim(s, F.lit(chars))


def trim_start(s: Column, chars: str = WHITE_SPACE) -> Column:
    return F.ltrim(s, F.lit(chars))


def trim_end(s: Column, chars: str = WHITE_SPACE) -> Column:
    return F.rtrim(s, F.lit(chars))


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def concat(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def join(separator: str, *parts: Column) -> Column:
    """Null parts join as empty strings."""
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def is_null_or_empty(s: Column) -> Column:
    return s.isNull() | (s == "")


def is_null_or_white_space(s: Column) -> Column:
    return s.isNull() | (trim(s) == "")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null comes before all."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def compare_ignore_case(a: Column, b: Column) -> Column:
    return compare(F.lower(a), F.lower(b))


def format(template: str, *args: Column) -> Column:
    """``{0}`` is an argument as text; ``{0,8}`` pads to the left and ``{0,-8}`` to the right; ``{0:F2}`` fixes decimals.

    ``{0:yyyy-MM-dd HH:mm:ss.fff}`` tells a date or time by the tokens in it. ``{{`` and ``}}`` are braces.
    """
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\d+)(?:,(-?\d+))?(?::(?:F(\d+)|([yMdHmsf][^{}]*)))?\}", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        if m[1] is None:
            parts.append(F.lit(m[0][0]))
            at = m.end()
            continue
        value = args[int(m[1])]
        if m[4]:
            text = F.date_format(value, m[4].replace("f", "S"))
        else:
            text = F.format_string(f"%.{m[3]}f", value.cast("double")) if m[3] else value.cast("string")
        text = F.coalesce(text, F.lit(""))
        if m[2]:
            width = int(m[2])
            text = pad_left(text, width) if width > 0 else pad_right(text, -width)
        parts.append(text)
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def is_match(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def regex_replace(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, pattern, new)


# single characters: ASCII classes

def is_digit(c: Column) -> Column:
    return c.rlike(r"^[0-9]$")


def is_letter(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]$")


def is_letter_or_digit(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9]$")


def is_white_space(c: Column) -> Column:
    return c.isin(" ", "\t", "\n", "\r")


def is_upper(c: Column) -> Column:
    return c.between("A", "Z")


def is_lower(c: Column) -> Column:
    return c.between("a", "z")


def is_punctuation(c: Column) -> Column:
    return c.rlike(r"^[!-#%-*,-/:;?@\[-\]_{}]$")


def is_symbol(c: Column) -> Column:
    return c.rlike(r"^[$+<=>^`|~]$")


def is_control(c: Column) -> Column:
    return c.rlike("^[\\x00-\\x1F\\x7F]$")


def numeric_value(c: Column) -> Column:
    return F.when(is_digit(c), F.try_to_number(c, F.lit("9")).cast("double")).otherwise(F.lit(-1.0))
