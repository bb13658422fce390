"""Seeded draws that any engine with md5 can repeat.

A draw is a function of the row's own key and the seed, so it does not depend on partitioning, on
task retries or on the order rows arrive in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = 13  # 52 bits: exact in a double, wide enough for sampling keys on very large tables


def digest(*keys, seed: int) -> Column:
    """md5 of ``key|key|...|seed``."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def draw(*keys, seed: int) -> Column:
    """A 52-bit non-negative integer."""
    return F.conv(F.substring(digest(*keys, seed=seed), 1, _HEX), 16, 10).cast("long")


def draw_below(n, *keys, seed: int) -> Column:
    """A uniform integer in ``[0, n)``; ``n`` is a number or a column."""
    return F.pmod(draw(*keys, seed=seed), n if isinstance(n, Column) else F.lit(n).cast("long"))


def draw01(*keys, seed: int) -> Column:
    """A uniform double in ``[0, 1)``."""
    return draw(*keys, seed=seed) / F.lit(float(16**_HEX))


def normal(*keys, seed: int) -> Column:
    """A standard gaussian number, from two uniform draws."""
    size = (draw(*keys, F.lit(0), seed=seed) + 1) / F.lit(float(16**_HEX))
    return F.sqrt(-2.0 * F.log(size)) * F.cos(2.0 * math.pi * draw01(*keys, F.lit(1), seed=seed))
