"""Target definition: which events count, which class they get, how boxes are encoded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords, geometry
from ..functions.conditions import AllOf, Condition, HasAllTags, HasAnyTag, HasTag, Not, Row, Tag
from ..plans.tiles import spread

# Tag keys and the default detection target.
CALL_TYPE = "soundevent:call_type"
GENERIC_CLASS = "soundevent:class"
DETECTION_CLASS = "bat"
EXCLUDED_TAGS = (
    (CALL_TYPE, "Feeding"), (CALL_TYPE, "Social"), (CALL_TYPE, "Unknown"),
    (GENERIC_CLASS, "Unknown"), (GENERIC_CLASS, "Not Bat"), (CALL_TYPE, "Not Bat"),
)


@dataclass(frozen=True)
class TargetClass:
    """A class rule: either ``tags`` (all required) or ``match_if``."""

    name: str
    tags: Sequence[Tag] | None = None
    match_if: Condition | None = None
    assign_tags: Sequence[Tag] = ()

    def __post_init__(self) -> None:
        if self.tags and self.match_if is not None:
            raise ValueError("a class rule is given by tags or by match_if, not both")
        if self.match_if is None and self.tags is None:
            raise ValueError(f"class {self.name!r} must have tags or match_if")

    @property
    def rule(self) -> Condition:
        return self.match_if if self.match_if is not None else HasAllTags(self.tags)

    @property
    def decoded(self) -> list[Tag]:
        return list(self.assign_tags or (self.tags if self.match_if is None else ()) or ())


def default_detection_target() -> TargetClass:
    rule = AllOf([HasTag(CALL_TYPE, "Echolocation"), Not(HasAnyTag(EXCLUDED_TAGS))])
    tags = [(CALL_TYPE, "Echolocation"), ("order", "Chiroptera")]
    return TargetClass(DETECTION_CLASS, match_if=rule, assign_tags=tags)


@dataclass(frozen=True)
class Targets:
    classes: Sequence[TargetClass]
    detection: TargetClass = field(default_factory=default_detection_target)

    def __post_init__(self) -> None:
        names = [c.name for c in self.classes]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"class names have to be unique; named twice: {', '.join(twice)}")

    @property
    def class_names(self) -> list[str]:
        return [c.name for c in self.classes]

    @property
    def decoding(self) -> dict[str, list[Tag]]:
        return {c.name: c.decoded for c in self.classes}

    def is_target(self, row: Row = F.col) -> Column:
        return self.detection.rule.column(row)

    def class_of(self, row: Row = F.col) -> Column:
        """First class in order whose rule matches, else null (a generic event)."""
        return F.coalesce(*[F.when(c.rule.column(row), F.lit(c.name)) for c in self.classes], F.lit(None).cast("string"))

    def check_model(self, model_classes: Sequence[str]) -> None:
        """The model may only know classes that the targets define."""
        extra = [c for c in model_classes if c not in self.class_names]
        if extra:
            raise ValueError(f"classes of the model missing in the targets: {', '.join(extra)}")


def targets_from_names(names: Sequence[str]) -> Targets:
    return Targets([TargetClass(n, tags=[("class", n)]) for n in names])


def encode_events(events: DataFrame, targets: Targets) -> DataFrame:
    """Add ``is_target`` and ``class_name``."""
    return events.withColumns({"is_target": targets.is_target(), "class_name": targets.class_of()})


def event_table(
    events: DataFrame, targets: Targets, exclude_non_target: bool = True, exclude_generic: bool = True
) -> DataFrame:
    """Sound-event table: rows with a shape; generic events are dropped or named after the detection class."""
    rows = encode_events(events, targets).where(F.col("start_time").isNotNull())
    if exclude_non_target:
        rows = rows.where("is_target")
    if exclude_generic:
        return rows.where(F.col("class_name").isNotNull())
    return rows.withColumn("class_name", F.coalesce("class_name", F.lit(targets.detection.name)))


# --- box encoding ----------------------------------------------------------

@dataclass(frozen=True)
class AnchorBox:
    anchor: str = "bottom-left"
    time_scale: float = geometry.TIME_SCALE
    frequency_scale: float = geometry.FREQUENCY_SCALE
    dimensions = ("width", "height")

    def encode(self, row: Row = F.col) -> dict[str, Column]:
        return geometry.encode_anchor(row, self.anchor, self.time_scale, self.frequency_scale)

    def decode(self, row: Row = F.col) -> dict[str, Column]:
        return geometry.decode_anchor(row, self.anchor, self.time_scale, self.frequency_scale)


@dataclass(frozen=True)
class PeakBox:
    """Needs ``peak_time`` and ``peak_freq`` on the rows, see :func:`with_peaks`."""

    time_scale: float = geometry.TIME_SCALE
    frequency_scale: float = geometry.FREQUENCY_SCALE
    dimensions = ("left", "bottom", "right", "top")

    def encode(self, row: Row = F.col) -> dict[str, Column]:
        return geometry.encode_peak(row, self.time_scale, self.frequency_scale)

    def decode(self, row: Row = F.col) -> dict[str, Column]:
        return geometry.decode_peak(row, self.time_scale, self.frequency_scale)


@dataclass(frozen=True)
class BoxMapping:
    """Default mapper plus overrides per class; all share their size dimensions."""

    default: AnchorBox | PeakBox = field(default_factory=AnchorBox)
    overrides: Mapping[str, AnchorBox | PeakBox] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, mapper in self.overrides.items():
            if mapper.dimensions != self.default.dimensions:
                raise ValueError(
                    f"the box mapping of {name!r} has dimension order {list(mapper.dimensions)}, "
                    f"the default one {list(self.default.dimensions)}"
                )

    def _switch(self, method: str, row: Row, class_name: Column) -> dict[str, Column]:
        out = getattr(self.default, method)(row)
        for name, mapper in self.overrides.items():
            other = getattr(mapper, method)(row)
            out = {k: F.when(class_name == name, other[k]).otherwise(out[k]) for k in out}
        return out

    def encode(self, row: Row = F.col, class_name: Column | None = None) -> dict[str, Column]:
        return self._switch("encode", row, F.col("class_name") if class_name is None else class_name)

    def decode(self, row: Row = F.col, class_name: Column | None = None) -> dict[str, Column]:
        return self._switch("decode", row, F.col("class_name") if class_name is None else class_name)


def encode_boxes(events: DataFrame, mapping: BoxMapping | AnchorBox | PeakBox) -> DataFrame:
    return events.withColumns(mapping.encode())


def decode_boxes(rows: DataFrame, mapping: BoxMapping | AnchorBox | PeakBox) -> DataFrame:
    return rows.withColumns(mapping.decode())


def encoded_targets(events: DataFrame, targets: Targets, mapping: BoxMapping) -> DataFrame:
    """Target events with a shape, their class and their encoded position and size."""
    rows = encode_events(events, targets).where(F.col("is_target") & F.col("start_time").isNotNull())
    return encode_boxes(rows, mapping)


#: Columns of a grid whose cells are joined as one list.
BLOCK = 16


def with_peaks(
    events: DataFrame,
    cells: DataFrame,
    grid: DataFrame,
    event_key: str = "ann_id",
    clip_key: str = "clip_id",
) -> DataFrame:
    """Loudest cell inside each event box, as ``peak_time`` and ``peak_freq``.

    ``grid`` has one row per clip: clip_start, clip_end, n_time, min_freq,
    max_freq, n_freq. The cells of ``BLOCK`` columns are one list, and each event is copied to
    the blocks it reaches, so the range join is an equi-join on (clip, block) that makes one row
    per event and block, not one per cell. Ties go to the earliest column, then the lowest row.
    """
    step = (F.col("clip_end") - F.col("clip_start")) / F.col("n_time")
    spans = events.select(event_key, clip_key, "start_time", "end_time", "low_freq", "high_freq").join(
        grid, clip_key
    ).select(
        event_key, clip_key, "start_time", "end_time",
        F.greatest("low_freq", "min_freq").alias("_low"), F.least("high_freq", "max_freq").alias("_high"),
        F.greatest(F.floor((F.col("start_time") - F.col("clip_start")) / step), F.lit(0)).alias("_first"),
        F.least(F.ceil((F.col("end_time") - F.col("clip_start")) / step), F.col("n_time").cast("bigint") - 1).alias("_last"),
    ).where("_first <= _last")
    reached = spread(spans, "_block", F.floor(F.col("_first") / BLOCK), F.floor(F.col("_last") / BLOCK))
    lists = cells.groupBy(clip_key, F.floor(F.col("t") / BLOCK).alias("_block")).agg(
        F.collect_list(F.struct("t", "f", "value")).alias("_all")).join(grid, clip_key)

    def column(t: Column) -> Column:
        time = coords.axis_value(t, F.col("clip_start"), F.col("clip_end"), F.col("n_time"))
        mine = F.transform(F.filter("_all", lambda c: c["t"] == t), lambda c: F.struct(
            (-c["value"]).alias("cost"), t.alias("t"), c["f"].alias("f"), time.alias("peak_time"),
            coords.axis_value(c["f"], F.col("min_freq"), F.col("max_freq"), F.col("n_freq")).alias("peak_freq")))
        return F.struct(t.alias("t"), time.alias("time"), mine.alias("cells"))

    blocks = lists.select(clip_key, "_block", F.transform(F.array_distinct("_all.t"), column).alias("_columns"))
    beside = F.filter("_columns", lambda c: (c["time"] >= F.col("start_time")) & (c["time"] <= F.col("end_time"))
                      & (c["t"] >= F.col("_first")) & (c["t"] <= F.col("_last")))
    inside = F.transform(beside, lambda c: F.array_min(F.filter(
        c["cells"], lambda x: (x["peak_freq"] >= F.col("_low")) & (x["peak_freq"] <= F.col("_high")))))
    found = reached.join(blocks, [clip_key, "_block"]).select(event_key, F.array_min(inside).alias("_p"))
    best = found.groupBy(event_key).agg(F.min("_p").alias("_p")).select(event_key, "_p.peak_time", "_p.peak_freq")
    return events.join(best, event_key, "left")
