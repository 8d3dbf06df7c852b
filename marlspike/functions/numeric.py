"""Numbers: rounding to even, null-propagating extremes, IEEE predicates, decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORMAL = 2.2250738585072014e-308
INF = float("inf")


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def round_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def round_away(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def least(a: Column, b: Column) -> Column:
    """The smaller; null if either is null."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.greatest(a, b))


def clamp(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, _lit(low)), _lit(high)))


def max_magnitude(a: Column, b: Column) -> Column:
    return F.when(F.abs(a) >= F.abs(b), a).otherwise(b)


def min_magnitude(a: Column, b: Column) -> Column:
    return F.when(F.abs(a) <= F.abs(b), a).otherwise(b)


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def copy_sign(a: Column, b: Column) -> Column:
    """Zero where ``b`` is zero."""
    return F.abs(a) * F.signum(b)


def scale_b(a: Column, b: Column) -> Column:
    return a * F.pow(F.lit(2.0), b)


def big_mul(a: Column, b: Column) -> Column:
    return a.cast("long") * b.cast("long")


def ieee_remainder(a: Column, b: Column) -> Column:
    return a - b * F.rint(a / b)


def int_div(a: str, b: str) -> Column:
    """Integer division toward zero, null where the divisor is 0."""
    return F.expr(f"({a}) div nullif({b}, 0)")


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign, null where the divisor is 0."""
    return a % F.nullif(b, F.lit(0))


def log(x: Column, base: float | None = None) -> Column:
    return F.ln(x) if base is None else F.ln(x) / F.ln(F.lit(float(base)))


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def is_infinity(x: Column) -> Column:
    return F.abs(x) == INF


def is_positive_infinity(x: Column) -> Column:
    return x == INF


def is_negative_infinity(x: Column) -> Column:
    return x == -INF


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def is_normal(x: Column) -> Column:
    return is_finite(x) & (F.abs(x) >= LEAST_NORMAL)


def is_subnormal(x: Column) -> Column:
    return (F.abs(x) > 0) & (F.abs(x) < LEAST_NORMAL)


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


#: Functions that Spark has under the same meaning.
PLAIN = {
    "abs": F.abs, "ceiling": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "exp": F.exp, "log10": F.log10, "log2": F.log2, "cbrt": F.cbrt,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh,
    "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "pow": F.pow, "atan2": F.atan2,
}
