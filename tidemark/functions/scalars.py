"""Scalar functions with IEEE results.

Inside the engine NULL means that nothing was emitted, so no function makes a
NULL of a number: where Spark would give NULL or raise, these give an infinity
or NaN, as arithmetic on doubles does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def number(x: Column) -> Column:
    return x.cast("double")


def divide(a: Column, b: Column) -> Column:
    """a / b; x/0 is a signed infinity, 0/0 and NaN/0 are NaN."""
    a, b = number(a), number(b)
    # 1/-0.0 cannot be told from 1/0.0 by comparison; its text can
    sign = F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    zero = F.when((a == 0) | F.isnan(a), NAN).otherwise(F.signum(a) * sign * INF)
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def remainder(a: Column, b: Column) -> Column:
    a, b = number(a), number(b)
    return F.when(b == 0, NAN).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def log(x: Column) -> Column:
        x = number(x)
        return F.when(F.isnan(x), NAN).when(x > 0, f(F.when(x > 0, x).otherwise(1.0))).when(x == 0, -INF).when(x < 0, NAN)

    return log


ln, log10, log2 = _log(F.ln), _log(F.log10), _log(F.log2)


def sqrt(x: Column) -> Column:
    x = number(x)
    return F.when(x < 0, NAN).otherwise(F.sqrt(x))


def sign(x: Column) -> Column:
    """-1, 0 or 1; 0 for NaN."""
    x = number(x)
    return F.when(F.isnan(x), 0.0).otherwise(F.signum(x))


def whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """floor and ceil as doubles, also beyond the range of integers."""

    def of(x: Column) -> Column:
        x = number(x)
        fits = F.abs(x) < 2.0**53
        return F.when(fits, f(F.when(fits, x).otherwise(0.0)).cast("double")).otherwise(x)

    return of


def round_half_away(x: Column) -> Column:
    x = number(x)
    fits = F.abs(x) < 2.0**53
    return F.when(fits, F.round(F.when(fits, x).otherwise(0.0))).otherwise(x)


def power(x: Column, y: Column) -> Column:
    return F.pow(number(x), number(y))


#: One-argument functions by name.
UNARY: dict[str, Callable[[Column], Column]] = {
    "ABS": lambda x: F.abs(number(x)),
    "FLOOR": whole(F.floor),
    "CEIL": whole(F.ceil),
    "CEILING": whole(F.ceil),
    "ROUND": round_half_away,
    "LN": ln,
    "LOG": ln,
    "LOG10": log10,
    "LOG2": log2,
    "SQRT": sqrt,
    "EXP": lambda x: F.exp(number(x)),
    "SIN": lambda x: F.sin(number(x)),
    "COS": lambda x: F.cos(number(x)),
    "TAN": lambda x: F.tan(number(x)),
    "SIGN": sign,
}


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparison of numbers in which NaN is unlike everything, itself too."""
    plain = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    nan = F.isnan(number(a)) | F.isnan(number(b))
    return (plain | nan) if op == "<>" else (plain & ~nan)
