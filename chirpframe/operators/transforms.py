"""Event and detection transforms.

An event transform maps field names to columns (``dict``) given a row accessor,
so the same object works on flat rows and inside ``F.transform`` over nested
events, and steps compose before Spark sees them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Condition, Row, Tag, tag_struct
from ..plans.stats import global_stats

EVENT_FIELDS = ("start_time", "end_time", "low_freq", "high_freq", "geom_type", "tags")
Fields = dict[str, Column]


class EventTransform:
    def fields(self, row: Row) -> Fields:
        """Changed fields only."""
        raise NotImplementedError


def overlay(row: Row, changed: Mapping[str, Column]) -> Row:
    return lambda name: changed[name] if name in changed else row(name)


@dataclass(frozen=True)
class SetFrequencyBound(EventTransform):
    hertz: float
    boundary: str = "low"

    def fields(self, row: Row) -> Fields:
        bound = F.lit(float(self.hertz))
        is_box = row("geom_type") == "BoundingBox"
        if self.boundary == "low":
            new = {"low_freq": bound, "high_freq": F.greatest(row("high_freq"), bound)}
        else:
            new = {"high_freq": bound, "low_freq": F.least(row("low_freq"), bound)}
        return {n: F.when(is_box, c).otherwise(row(n)) for n, c in new.items()}


@dataclass(frozen=True)
class ReplaceTag(EventTransform):
    original: Tag
    replacement: Tag

    def fields(self, row: Row) -> Fields:
        old, new = self.original, tag_struct(*self.replacement)
        return {
            "tags": F.transform(
                row("tags"),
                lambda t: F.when((t["key"] == old[0]) & (t["value"] == old[1]), new).otherwise(t),
            )
        }


@dataclass(frozen=True)
class MapTagValue(EventTransform):
    tag_key: str
    value_mapping: Mapping[str, str]
    target_key: str | None = None

    def fields(self, row: Row) -> Fields:
        if not self.value_mapping:
            return {}
        pairs = [F.lit(x) for kv in self.value_mapping.items() for x in kv]
        lookup = F.create_map(*pairs)
        target = self.target_key or self.tag_key

        def one(tag: Column) -> Column:
            mapped = F.element_at(lookup, tag["value"])
            hit = (tag["key"] == self.tag_key) & mapped.isNotNull()
            return F.when(
                hit, F.struct(F.lit(target).alias("key"), mapped.alias("value"))
            ).otherwise(tag)

        return {"tags": F.transform(row("tags"), one)}


@dataclass(frozen=True)
class ApplyIf(EventTransform):
    condition: Condition
    transform: EventTransform

    def fields(self, row: Row) -> Fields:
        chosen = self.condition.column(row)
        return {
            n: F.when(chosen, c).otherwise(row(n)) for n, c in self.transform.fields(row).items()
        }


@dataclass(frozen=True)
class ApplyAll(EventTransform):
    steps: Sequence[EventTransform]

    def fields(self, row: Row) -> Fields:
        changed: Fields = {}
        for step in self.steps:
            changed = {**changed, **step.fields(overlay(row, changed))}
        return changed


def transform_events(events: DataFrame, transform: EventTransform) -> DataFrame:
    """Apply to flat event rows."""
    return events.withColumns(transform.fields(F.col))


def transform_nested(clips: DataFrame, transform: EventTransform, events: str = "events", fields: Sequence[str] = ()) -> DataFrame:
    """Apply to the nested events of each clip; ``fields`` lists all event fields in order."""

    def one(event: Column) -> Column:
        changed = transform.fields(lambda n: event[n])
        return F.struct(*[changed.get(n, event[n]).alias(n) for n in fields])

    return clips.withColumn(events, F.transform(events, one))


# --- detections ------------------------------------------------------------

def shift_to_clip_start(dets: DataFrame, clips: DataFrame | None = None, key: str = "clip_id") -> DataFrame:
    """Clip-relative times become recording times; joins ``clip_start`` unless present."""
    rows = dets if clips is None else dets.join(clips.select(key, "clip_start"), key)
    out = rows.withColumns(
        {n: F.col(n) + F.col("clip_start") for n in ("start_time", "end_time")}
    )
    return out if clips is None else out.drop("clip_start")


DetectionStep = Callable[[DataFrame], DataFrame]


def output_steps(
    dets: DataFrame,
    clips: DataFrame,
    detection_steps: Sequence[DetectionStep] = (),
    clip_steps: Sequence[DetectionStep] = (),
) -> DataFrame:
    """Shift, then per-detection steps, then clip steps, in that order."""
    out = shift_to_clip_start(dets, clips)
    for step in (*detection_steps, *clip_steps):
        out = out.transform(step)
    return out


def standardize_low_freq(events: DataFrame, class_name: str, column: str = "class_name") -> DataFrame:
    """Set a class's low frequency to its mean; a high frequency below it becomes the mean high."""
    chosen = F.col(column) == class_name
    rows = global_stats(
        events,
        _low=F.avg(F.when(chosen, F.col("low_freq"))),
        _high=F.avg(F.when(chosen, F.col("high_freq"))),
    )
    low, high = F.col("_low"), F.col("_high")
    return rows.withColumns(
        {
            "high_freq": F.when(chosen & (F.col("high_freq") < low), high).otherwise(F.col("high_freq")),
            "low_freq": F.when(chosen, low).otherwise(F.col("low_freq")),
        }
    ).drop("_low", "_high")


def genus_rollup(dets: DataFrame, class_names: Sequence[str], scores: str = "class_scores") -> DataFrame:
    """Sum class scores per genus (first word); sums may exceed 1. Genera are sorted."""
    genera = sorted({c.split(" ")[0] for c in class_names})
    members = [[i for i, c in enumerate(class_names) if c.split(" ")[0] == g] for g in genera]
    sums = []
    for group in members:
        total = F.get(F.col(scores), group[0])
        for index in group[1:]:
            total = total + F.get(F.col(scores), index)
        sums.append(total)
    return dets.withColumn(scores, F.array(*sums))


def genus_of_class_id(index: Column, class_names: Sequence[str]) -> Column:
    """Ground-truth class id → genus id; -1 (unknown) stays."""
    genera = sorted({c.split(" ")[0] for c in class_names})
    mapping = F.array(*[F.lit(genera.index(c.split(" ")[0])) for c in class_names])
    return F.when(index < 0, index).otherwise(F.get(mapping, index))
