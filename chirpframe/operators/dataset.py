"""Dataset assembly: sources, source tags, clip filter, event filter, transforms – in that order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.conditions import Condition
from .filters import filter_events, source_selected
from .projections import add_source_tag
from .reports import union_all
from .transforms import ApplyAll, EventTransform, transform_nested

Loader = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Source:
    """A named scan. ``load`` gives nested clips: clip columns, ``tags`` and ``events``."""

    name: str
    load: Loader


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    sources: Sequence[Source]
    clip_filter: Condition | None = None
    event_filter: Condition | None = None
    event_transforms: Sequence[EventTransform] = ()
    event_fields: Sequence[str] = ("ann_id", "start_time", "end_time", "low_freq", "high_freq", "geom_type", "tags")
    description: str = ""


def load_dataset(
    spark: SparkSession, config: DatasetConfig, add_source_tags: bool = True,
    include_sources: Sequence[str] | None = None, exclude_sources: Sequence[str] | None = None,
    apply_transforms: bool = True, apply_filters: bool = True,
) -> DataFrame:
    """Union of the chosen sources. A source that is not chosen is never scanned."""
    frames = []
    for source in config.sources:
        if not source_selected(source.name, include_sources, exclude_sources):
            continue
        clips = source.load(spark)
        if add_source_tags:
            clips = add_source_tag(clips, source.name)
        if apply_filters and config.clip_filter is not None:
            clips = clips.where(config.clip_filter.column())
        if apply_filters and config.event_filter is not None:
            clips = filter_events(clips, config.event_filter)
        if apply_transforms and config.event_transforms:
            clips = transform_nested(clips, ApplyAll(config.event_transforms), fields=config.event_fields)
        frames.append(clips)
    if not frames:
        raise ValueError("No source is selected.")
    return union_all(frames)
