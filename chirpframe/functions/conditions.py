"""Conditions on annotated rows, compiled to one boolean column.

A condition is a small frozen dataclass with ``column(row)``. ``row`` maps a
field name to a column: ``F.col`` for flat tables, ``lambda n: e[n]`` inside
``F.filter(events, ...)``. Every column is null-safe (never null), so ``Not``
is a plain negation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

Row = Callable[[str], Column]
Tag = tuple[str, str]

COMPARISONS = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
}
TIME_ONLY = ("TimeInterval", "TimeStamp")


class Condition(Protocol):
    def column(self, row: Row = F.col) -> Column: ...


def tag_struct(key: str, value: str) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))


def is_true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def compare(name: str, left: Column, right: float) -> Column:
    if name not in COMPARISONS:
        raise ValueError(f"Invalid operator {name}")
    return COMPARISONS[name](left, F.lit(float(right)))


@dataclass(frozen=True)
class HasTag:
    key: str
    value: str

    def column(self, row: Row = F.col) -> Column:
        return is_true(
            F.exists(row("tags"), lambda t: (t["key"] == self.key) & (t["value"] == self.value))
        )


@dataclass(frozen=True)
class HasAllTags:
    tags: Sequence[Tag]

    def __post_init__(self) -> None:
        if not self.tags:
            raise ValueError("the list of tags is empty")

    def column(self, row: Row = F.col) -> Column:
        return AllOf([HasTag(k, v) for k, v in self.tags]).column(row)


@dataclass(frozen=True)
class HasAnyTag:
    tags: Sequence[Tag]

    def __post_init__(self) -> None:
        if not self.tags:
            raise ValueError("the list of tags is empty")

    def column(self, row: Row = F.col) -> Column:
        wanted = F.array(*[tag_struct(k, v) for k, v in self.tags])
        own = F.transform(
            row("tags"), lambda t: F.struct(t["key"].alias("key"), t["value"].alias("value"))
        )
        return is_true(F.arrays_overlap(own, wanted))


@dataclass(frozen=True)
class Duration:
    operator: str
    seconds: float

    def column(self, row: Row = F.col) -> Column:
        return is_true(compare(self.operator, row("end_time") - row("start_time"), self.seconds))


@dataclass(frozen=True)
class Frequency:
    operator: str
    boundary: str
    hertz: float

    def column(self, row: Row = F.col) -> Column:
        bound = row("low_freq") if self.boundary == "low" else row("high_freq")
        has_band = ~row("geom_type").isin(*TIME_ONLY)
        return is_true(has_band & compare(self.operator, bound, self.hertz))


@dataclass(frozen=True)
class Flag:
    """A boolean column computed earlier, e.g. by ``operators.filters.flag_in_list``."""

    name: str

    def column(self, row: Row = F.col) -> Column:
        return is_true(row(self.name))


@dataclass(frozen=True)
class Not:
    condition: Condition

    def column(self, row: Row = F.col) -> Column:
        return ~self.condition.column(row)


@dataclass(frozen=True)
class AllOf:
    conditions: Sequence[Condition]

    def column(self, row: Row = F.col) -> Column:
        return reduce(lambda a, b: a & b, [c.column(row) for c in self.conditions], F.lit(True))


@dataclass(frozen=True)
class AnyOf:
    conditions: Sequence[Condition]

    def column(self, row: Row = F.col) -> Column:
        return reduce(lambda a, b: a | b, [c.column(row) for c in self.conditions], F.lit(False))


@dataclass(frozen=True)
class RecordingSatisfies:
    """Apply a recording condition to a clip row that carries ``recording`` as a struct."""

    condition: Condition

    def column(self, row: Row = F.col) -> Column:
        recording = row("recording")
        return self.condition.column(lambda name: recording[name])
