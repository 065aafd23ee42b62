"""Cumulative work over a long order, spread over many tasks.

A window without a partition key, or with one hot key, sorts everything in one
task. Instead the rows are range-partitioned on (keys, value, tie); the id of
the range becomes a column and the result is checkpointed, so ranges stay fixed
when tasks are rerun. Per-range totals are tiny; their running totals give each
range its offset, and the rest is a window inside (keys, range).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut_lineage

RANGE = "_range"


@dataclass(frozen=True)
class Ordered:
    """Rows cut into ordered ranges. ``order`` sorts inside and across ranges."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[tuple[str, bool], ...]  # (column, descending)

    def sort(self, reverse: bool = False) -> list[Column]:
        return [
            F.col(name).desc() if desc != reverse else F.col(name).asc() for name, desc in self.order
        ]

    def local(self, reverse: bool = False):
        return (
            Window.partitionBy(*self.keys, RANGE)
            .orderBy(*self.sort(reverse))
            .rowsBetween(Window.unboundedPreceding, 0)
        )

    def across(self, reverse: bool = False, frame=(Window.unboundedPreceding, -1)):
        last = F.col(RANGE).desc() if reverse else F.col(RANGE).asc()
        base = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
        return base.orderBy(last).rowsBetween(*frame)

    def with_rows(self, rows: DataFrame) -> Ordered:
        return Ordered(rows, self.keys, self.order)

    def clean(self) -> DataFrame:
        return self.rows.drop(RANGE)


def order_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], ranges: int | None = None
) -> Ordered:
    """Cut ``df`` into ranges of the order (keys, order...)."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(k).asc() for k in keys]
    sort += [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    ranged = df.repartitionByRange(n, *sort).withColumn(RANGE, F.spark_partition_id())
    return Ordered(cut_lineage(ranged), tuple(keys), tuple(order))


def running(
    ordered: Ordered,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    reverse: bool = False,
) -> Ordered:
    """Add running sums and running maxima (from the far end with ``reverse``)."""
    sums, maxima = dict(sums or {}), dict(maxima or {})
    keys = [*ordered.keys, RANGE]
    totals = ordered.rows.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()],
    )
    across = ordered.across(reverse)
    offsets = totals.select(
        *keys,
        *[F.sum(f"_t_{n}").over(across).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(across).alias(f"_o_{n}") for n in maxima],
    )
    local = ordered.local(reverse)
    rows = (
        ordered.rows.withColumns(
            {n: F.sum(c).over(local) for n, c in sums.items()}
            | {n: F.max(c).over(local) for n, c in maxima.items()}
        )
        .join(offsets, keys)
        .withColumns(
            {n: F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in sums}
            | {n: F.greatest(F.col(n), F.col(f"_o_{n}")) for n in maxima}
        )
        .drop(*[f"_o_{n}" for n in [*sums, *maxima]])
    )
    return ordered.with_rows(rows)


def with_rank(ordered: Ordered, name: str = "rank") -> Ordered:
    """1-based position of each row in its key's order."""
    return running(ordered, sums={name: F.lit(1).cast("bigint")})


def with_previous(ordered: Ordered, name: str, value: str) -> Ordered:
    """``value`` of the previous row in the order, across range borders."""
    keys = [*ordered.keys, RANGE]
    sort = Window.partitionBy(*keys).orderBy(*ordered.sort())
    last = (
        ordered.rows.withColumn("_tail", F.row_number().over(
            Window.partitionBy(*keys).orderBy(*ordered.sort(reverse=True))))
        .where(F.col("_tail") == 1)
        .select(*keys, F.col(value).alias("_last"))
    )
    before = ordered.across(frame=(-1, -1))
    carried = last.select(*keys, F.last("_last").over(before).alias("_carried"))
    rows = (
        ordered.rows.withColumn("_first", F.row_number().over(sort) == 1)
        .withColumn(name, F.lag(value).over(sort))
        .join(carried, keys)
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name)))
        .drop("_first", "_carried")
    )
    return ordered.with_rows(rows)


def hashed_rank(
    df: DataFrame, keys: Sequence[str], draw: str, tie: str, name: str = "rank", buckets: int | None = None
) -> DataFrame:
    """Rank by a uniform draw in [0, 1) inside each key.

    The draw is uniform, so equal-width buckets are balanced by construction
    and neither sampling nor a checkpoint is needed.
    """
    n = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = df.withColumn("_bucket", F.floor(F.col(draw) * n).cast("int"))
    group = [*keys, "_bucket"]
    counts = cut.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    across = (
        (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
        .orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(*group, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*group).orderBy(draw, tie)
    return (
        cut.withColumn(name, F.row_number().over(local))
        .join(offsets, group)
        .withColumn(name, (F.col(name) + F.col("_before")).cast("bigint"))
        .drop("_bucket", "_before")
    )

