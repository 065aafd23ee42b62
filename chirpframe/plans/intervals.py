"""Range joins as equi-joins on (keys, slots)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[Column, Column]


@dataclass(frozen=True)
class Axis:
    """One axis of a range join: the spans of both sides and the slot width."""

    left: Span
    right: Span
    width: float


def _slotted(df: DataFrame, spans: Sequence[Span], widths: Sequence[float], side: str) -> DataFrame:
    for n, ((start, end), width) in enumerate(zip(spans, widths)):
        low, high, first = f"_{side}s{n}", f"_{side}e{n}", f"_{side}f{n}"
        w = F.lit(float(width))
        df = (
            df.withColumns({low: start, high: end})
            .where(F.col(low) <= F.col(high))
            .withColumn(first, F.floor(F.col(low) / w))
            .withColumn(f"_slot{n}", F.explode(F.sequence(F.col(first), F.floor(F.col(high) / w))))
        )
    return df


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], axes: Sequence[Axis]) -> DataFrame:
    """Pairs of the same key whose spans touch on every axis, each exactly once.

    Both sides are copied into every slot they touch; a pair is kept only in
    the first slot both share. A hot key is split by its slots. Span columns
    refer to their own side; the sides share no column names but ``keys``.
    """
    widths = [a.width for a in axes]
    lhs = _slotted(left, [a.left for a in axes], widths, "l")
    rhs = _slotted(right, [a.right for a in axes], widths, "r")
    numbers = range(len(axes))
    out = lhs.join(rhs, [*keys, *[f"_slot{n}" for n in numbers]])
    for n in numbers:
        out = out.where(F.col(f"_slot{n}") == F.greatest(f"_lf{n}", f"_rf{n}")).where(
            (F.col(f"_ls{n}") <= F.col(f"_re{n}")) & (F.col(f"_rs{n}") <= F.col(f"_le{n}"))
        )
    return out.drop(*[f"_{c}{n}" for n in numbers for c in ("slot", "ls", "le", "lf", "rs", "re", "rf")])


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: Span, right_span: Span, width: float
) -> DataFrame:
    """Range join on time alone."""
    return range_join(left, right, keys, [Axis(left_span, right_span, width)])
