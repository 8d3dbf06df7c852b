"""Conversion between types, enumerations, and values in JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_integral(x: Column, kind: str = "int") -> Column:
    """Rounds halves to even; raises where the value does not fit."""
    return F.bround(x).cast(kind)


def truncating(x: Column, kind: str = "int") -> Column:
    return x.cast(kind)


def parse(s: Column, kind: str) -> Column:
    """Raises on text that is no such value."""
    return F.btrim(s).cast(kind)


def try_parse(s: Column, kind: str) -> Column:
    return F.btrim(s).try_cast(kind)


def parse_bool(s: Column) -> Column:
    text = F.lower(F.btrim(s))
    wrong = F.raise_error(F.concat(F.lit("not a boolean: "), s)).cast("boolean")
    return F.when(s.isNull(), F.lit(None)).when(text == "true", True).when(text == "false", False).otherwise(wrong)


def bool_text(b: Column) -> Column:
    return F.when(b, "True").when(~b, "False")


def to_text(x: Column, kind: str) -> Column:
    """A value as text by its type (as in ``dtypes``): booleans as True and False, times to the second, the rest as Spark does."""
    if kind == "boolean":
        return bool_text(x)
    if kind.startswith("timestamp"):
        return F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return x.cast("string")


def parse_guid(s: Column) -> Column:
    text = F.lower(F.btrim(s))
    ok = text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return F.when(s.isNull() | ok, text).otherwise(F.raise_error(F.concat(F.lit("not a GUID: "), s)).cast("string"))


DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy")


def parse_exact(s: Column, form: str) -> Column:
    if form not in DATE_FORMATS:
        raise ValueError(f"not one of {DATE_FORMATS}: {form}")
    return F.to_timestamp(s, form)


# enumerations: a dict of names to numbers

def enum_name(x: Column, members: dict[str, int]) -> Column:
    """The member's name, or the number as text."""
    out = None
    for name, number in members.items():
        out = F.when(x == number, name) if out is None else out.when(x == number, name)
    return out.otherwise(x.cast("string")) if out is not None else x.cast("string")


def enum_parse(s: Column, members: dict[str, int], ignore_case: bool = False) -> Column:
    """The member's number, or null."""
    text = F.lower(s) if ignore_case else s
    out = F.lit(None).cast("int")
    for name, number in members.items():
        out = F.when(text == (name.lower() if ignore_case else name), number).otherwise(out)
    return out


def enum_defined(x: Column, members: dict[str, int]) -> Column:
    return x.isin(list(members.values()))


def has_flag(x: Column, flag: int) -> Column:
    return x.bitwiseAND(F.lit(flag)) == flag


_PATH = re.compile(r"\$(\.[A-Za-z_]\w*|\[\d+\])+")


def json_value(text: Column, path: str, kind: str = "string") -> Column:
    """The value at a constant path such as ``$.a.b[0]``."""
    if not _PATH.fullmatch(path):
        raise ValueError(f"not a path: {path}")
    return F.get_json_object(text, path).cast(kind)


def new_guid() -> Column:
    return F.uuid()


def random() -> Column:
    """Uniform in [0, 1), different for each row."""
    return F.rand()
