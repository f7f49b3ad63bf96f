"""Small column helpers shared by the extraction functions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(c: Column) -> Column:
    """Trim all white space on both sides (plain ``btrim`` trims blanks only)."""
    return F.btrim(c, F.lit(P.SPACES))


def rstrip(c: Column) -> Column:
    # Trimming by a set of characters looks at all of a text; most texts end in none of the set.
    return F.when(F.contains(F.lit(P.SPACES), F.substring(c, -1, 1)), F.rtrim(c, F.lit(P.SPACES))).otherwise(c)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def extract_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def none_if_empty(arr: Column) -> Column:
    return F.get(F.filter(F.array(arr), lambda a: F.size(a) > 0), F.lit(0))


def none_if_blank(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def to_bigints(arr: Column) -> Column:
    """Digit strings to BIGINT; digit runs too long for BIGINT are left out."""
    return F.array_compact(F.transform(arr, lambda x: x.try_cast("bigint")))


def sorted_set(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))
