"""Saturating token arithmetic.

Token counts are non-negative 64-bit integers.  Sums clamp at the largest
BIGINT instead of raising: ``try_add``/``try_sum`` give NULL only on overflow
here, because every addend is made non-NULL first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COUNT = 9223372036854775807


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_or_zero(x: str | Column) -> Column:
    return F.coalesce(_c(x), F.lit(0).cast("bigint"))


def saturating_add(*cols: str | Column) -> Column:
    """Row-wise sum clamped at :data:`MAX_COUNT`."""
    total = reduce(F.try_add, [count_or_zero(c) for c in cols])
    return F.coalesce(total, F.lit(MAX_COUNT))


def saturating_sum(x: str | Column) -> Column:
    """Aggregate sum of non-negative counts clamped at :data:`MAX_COUNT`."""
    return F.coalesce(F.try_sum(count_or_zero(x)), F.lit(MAX_COUNT))


def saturating_sub(a: str | Column, b: str | Column) -> Column:
    """``max(0, a - b)`` for non-negative counts."""
    return F.greatest(F.lit(0).cast("bigint"), count_or_zero(a) - count_or_zero(b))


def as_count(text: str | Column) -> Column:
    """A non-negative integer from text; larger than BIGINT clamps, else NULL."""
    wide = _c(text).try_cast("decimal(20,0)")
    exact = _c(text).rlike(r"^\+?\d{1,20}$")
    return F.when(exact, F.least(wide, F.lit(MAX_COUNT).cast("decimal(20,0)")).cast("bigint"))


def div_ceil(x: str | Column, by: int) -> Column:
    """Ceiling division of a non-negative count."""
    return F.ceil(_c(x) / F.lit(by)).cast("bigint")


def chars_to_tokens(chars: str | Column) -> Column:
    """The four-characters-per-token estimate."""
    return div_ceil(chars, 4)
