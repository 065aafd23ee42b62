"""Tiling of one axis with copied borders, so that windows stay local and short."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = "_tile"
CORE = "_core"


def with_halo(df: DataFrame, axis: str, width: float, reach: float) -> DataFrame:
    """One row per tile that can see it; ``_core`` marks the tile that owns it."""
    w = F.lit(width)
    tiles = F.sequence(
        F.floor((F.col(axis) - F.lit(reach)) / w), F.floor((F.col(axis) + F.lit(reach)) / w)
    )
    return df.withColumn(TILE, F.explode(tiles)).withColumn(
        CORE, F.col(TILE) == F.floor(F.col(axis) / w)
    )


def core_only(df: DataFrame) -> DataFrame:
    return df.where(CORE).drop(TILE, CORE)


def spread(df: DataFrame, name: str, low, high) -> DataFrame:
    """One row per integer in [low, high]; none when the range is empty."""
    return df.where(low <= high).withColumn(name, F.explode(F.sequence(low, high)))


def dense_grid(df: DataFrame, keys: Sequence[str], sizes: dict[str, str]) -> DataFrame:
    """All cells of each group's grid. ``sizes`` maps axis name → size column of ``df``."""
    out = df.select(*keys, *[c for c in dict.fromkeys(sizes.values())])
    for axis, size in sizes.items():
        out = spread(out, axis, F.lit(0).cast("bigint"), F.col(size).cast("bigint") - 1)
    return out
