"""Sequence helpers: 1-based items with 0 as left padding on the way out, 0-based on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_with(seq, constant, fn) -> Column:
    """``fn(element, constant)`` for each element. A lambda evaluates what it captures once per
    element; handed over this way, a costly constant is evaluated once per row."""
    s = _col(seq)
    return F.zip_with(s, F.array_repeat(constant, F.size(s)), fn)


def last_n(seq, n: int) -> Column:
    s = _col(seq)
    return F.slice(s, F.greatest(F.size(s) - F.lit(n) + 1, F.lit(1)), F.lit(n))


def pad_left(seq, n: int, shift: int = 1) -> Column:
    s = _col(seq)
    body = F.transform(s, lambda x: x + F.lit(shift).cast("long")) if shift else s
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(n) - F.size(s)), body)


def drop_padding(seq) -> Column:
    return F.transform(F.filter(_col(seq), lambda x: x != 0), lambda x: x - 1)


def ordered(entries, field: str) -> Column:
    """Sort an array of structs and keep one field."""
    return F.transform(F.array_sort(_col(entries)), lambda e: e[field])


def joined(arr, sep: str = ",") -> Column:
    """Array as text, used where two engines must compare arrays."""
    return F.array_join(F.transform(_col(arr), lambda x: x.cast("string")), sep)
