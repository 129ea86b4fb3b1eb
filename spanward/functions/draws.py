"""Draws that depend on the row's key alone, so results survive any repartitioning."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(n, *keys) -> Column:
    """Integer in [0, n) from the given keys."""
    size = n if isinstance(n, Column) else F.lit(n)
    parts = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.pmod(F.xxhash64(*parts), size.cast("long")).cast("int")


def pick(options, *keys) -> Column:
    """One of the options (a string gives one of its characters)."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), draw(len(options), *keys) + 1)


def pick_char(chars: str, *keys) -> Column:
    return F.substring(F.lit(chars), draw(len(chars), *keys) + 1, F.lit(1))
