"""Integer arithmetic that wraps at 64 bits, division that fails on zero, and stores that wrap at 32 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = (-(1 << 31), (1 << 31) - 1)
BIGINT = (-(1 << 63), (1 << 63) - 1)


def _wrapped(exact: Column) -> Column:
    """An exact decimal as the 64-bit integer that it wraps to."""
    half, whole = (F.lit(str(1 << b)).cast("decimal(20,0)") for b in (63, 64))
    return (F.pmod(exact + half, whole) - half).cast("bigint")


def exact(op: str, a: Column, b: Column, fits: bool) -> Column:
    """a op b over bigints, for + - *; fits: the result is known to need no wrapping."""
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    direct = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op]
    a, b = a.cast("bigint"), b.cast("bigint")
    if fits:
        return direct(a, b)
    return F.coalesce(plain(a, b), _wrapped(direct(a.cast("decimal(19,0)"), b.cast("decimal(19,0)"))))


def interval(op: str, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """Bounds of a op b before any wrapping."""
    every = [{"+": x + y, "-": x - y, "*": x * y}[op] for x in a for y in b]
    return min(every), max(every)


def divide(a: Column, b: Column) -> Column:
    """Always a double; an error if b is zero and neither is null."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(F.try_divide(x, y))


def to_int(x: Column) -> Column:
    """A bigint stored as a 32-bit integer, wrapped."""
    return F.shiftright(F.shiftleft(x.cast("bigint"), 32), 32).cast("int")


def sum_bigint(x: Column) -> Column:
    """The wrapped sum of bigints: sums of three parts, none of which can overflow below 2**41 rows."""
    x = x.cast("bigint")
    mask = (1 << 21) - 1
    high, middle, low = F.sum(F.shiftright(x, 42)), F.sum(F.shiftright(x, 21).bitwiseAND(mask)), F.sum(x.bitwiseAND(mask))
    return exact("+", exact("+", F.shiftleft(high, 42), F.shiftleft(middle, 21), False), low, False)


def sum_distinct_bigint(x: Column) -> Column:
    return _wrapped(F.sum_distinct(x.cast("bigint").cast("decimal(19,0)")))
