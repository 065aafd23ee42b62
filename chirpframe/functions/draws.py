"""Seeded random draws that depend only on (seed, id).

A draw is 52 bits of ``md5(seed-id)``, so it is the same on every engine, in
every task attempt and for every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: str, key: Column) -> Column:
    """Uniform double in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def uniform(seed: str, key: Column, low: Column | float, high: Column | float) -> Column:
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return lo + draw(seed, key) * (hi - lo)


def integer(seed: str, key: Column, low: Column | int, high: Column | int) -> Column:
    """Integer in [low, high); ``low`` itself when the range is empty."""
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return (lo + F.floor(draw(seed, key) * F.greatest(hi - lo, F.lit(1)))).cast("int")
