"""Group statistics next to the rows, without sending whole groups to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut_lineage

#: Rows up to which a table of one short row per group is broadcast (some 20 MB).
SMALL_ROWS = 300_000


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Aggregate per key (partial sums first), then join the small result back.

    A window over ``keys`` would sort a hot group in a single task; here it is
    reduced map-side, and AQE may broadcast or split the join.
    """
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(sums, list(keys))


def counted(stats: DataFrame) -> DataFrame:
    """A table of one short row per key, checkpointed, and broadcast in joins if it has at most ``SMALL_ROWS`` rows."""
    known = cut_lineage(stats)
    return F.broadcast(known) if known.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else known


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join wide rows with a table of one short row per key, without moving the wide rows if that can be.

    The table is checkpointed and counted; up to ``SMALL_ROWS`` rows it is
    broadcast, beyond that Spark chooses the join.
    """
    return df.join(counted(stats), list(keys), how)


def global_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """Attach one-row global aggregates to every row."""
    one = df.agg(*[c.alias(n) for n, c in stats.items()])
    return df.crossJoin(F.broadcast(one))  # always exactly one row
