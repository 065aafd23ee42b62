"""Clip generation, sub-clips and event selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.draws import draw
from ..plans.tiles import spread


def tile_recordings(
    recordings: DataFrame, duration: float, overlap: float = 0.0, max_empty: float = 0.0,
    discard_empty: bool = True, with_ids: bool = True,
) -> DataFrame:
    """Clips of fixed length. ``overlap`` is a fraction of the clip length.

    A last clip that overhangs by more than ``max_empty`` is dropped unless
    ``discard_empty`` is off. Ids need a uuid ``recording_id``.
    """
    hop = duration * (1 - overlap)
    last = F.ceil(F.col("duration") / F.lit(hop)) - 1
    tiles = spread(recordings, "clip_index", F.lit(0).cast("bigint"), last.cast("bigint"))
    out = tiles.withColumn("clip_start", F.col("clip_index") * F.lit(hop)).withColumn(
        "clip_end", F.col("clip_start") + F.lit(float(duration))
    )
    if discard_empty:
        out = out.where(F.col("clip_end") - F.col("duration") <= F.lit(float(max_empty))).where(
            F.col("clip_end") - F.col("clip_start") > F.lit(float(max_empty))
        )
    if with_ids:
        out = out.withColumn(
            "clip_id",
            ids.tile_clip_id(F.col("recording_id"), F.col("clip_start"), F.col("clip_end")),
        )
    return out


def random_subclips(
    clips: DataFrame, duration: float = 0.5, max_empty: float = 0.2, random: bool = True,
    seed: str = "subclip", key: str = "clip_id",
) -> DataFrame:
    """Random window per clip; the start may run up to ``max_empty`` past what fits.

    Clips that are too short keep their start, as do all clips when not random.
    """
    length = F.col("clip_end") - F.col("clip_start")
    room = F.col("clip_end") + F.lit(float(max_empty)) - F.lit(float(duration)) - F.col("clip_start")
    start = F.col("clip_start") + draw(seed, F.col(key)) * room
    if random:
        start = F.when(F.lit(float(duration)) > length + F.lit(float(max_empty)), F.col("clip_start")).otherwise(start)
    else:
        start = F.col("clip_start")
    return clips.withColumn("clip_start", start).withColumn(
        "clip_end", F.col("clip_start") + F.lit(float(duration))
    )


def padded_clips(clips: DataFrame, chunk_size: float = 0.256) -> DataFrame:
    chunk = F.lit(float(chunk_size))
    whole = chunk * F.ceil((F.col("clip_end") - F.col("clip_start")) / chunk)
    return clips.withColumn("clip_end", F.col("clip_start") + whole)


def fixed_clips(clips: DataFrame, duration: float = 0.256) -> DataFrame:
    return clips.withColumn("clip_end", F.col("clip_start") + F.lit(float(duration)))


def select_events(events: DataFrame, clips: DataFrame, min_overlap: float = 0.0, key: str = "clip_id") -> DataFrame:
    """Events that overlap their clip's window by more than 0 (at least ``min_overlap`` when set).

    One window per key: an equi-join and a row filter. Use
    :func:`events_in_clips` when a recording has many clips.
    """
    window = clips.select(key, F.col("clip_start"), F.col("clip_end"))
    shared = F.least("end_time", "clip_end") - F.greatest("start_time", "clip_start")
    enough = shared >= F.lit(float(min_overlap)) if min_overlap > 0 else shared > 0
    return events.join(window, key).where(enough)


def events_in_clips(
    events: DataFrame, clips: DataFrame, min_overlap: float = 0.0, key: str = "recording_id", slot: float = 1.0,
) -> DataFrame:
    """Interval join of a recording's events with its clips, each overlapping pair once.

    Clips of recordings without events are left out before they are copied into slots.
    """
    from ..plans.intervals import overlap_join
    from ..plans.stats import attach

    near = attach(clips, events.select(key).distinct(), [key])
    pairs = overlap_join(
        events, near, [key], (F.col("start_time"), F.col("end_time")),
        (F.col("clip_start"), F.col("clip_end")), slot,
    )
    shared = F.least("end_time", "clip_end") - F.greatest("start_time", "clip_start")
    return pairs.where(shared >= F.lit(float(min_overlap)) if min_overlap > 0 else shared > 0)


def fixed_clip_events(clips: DataFrame, events: DataFrame, duration: float = 0.256, key: str = "clip_id") -> DataFrame:
    return select_events(events, fixed_clips(clips, duration), 0.0, key)


def chunk_recordings(recordings: DataFrame, chunk_size: float = 3.0, key: str = "recording_id") -> DataFrame:
    """Fixed-size sample chunks; needs ``n_samples`` and ``samplerate``."""
    length = F.floor(F.col("samplerate") * F.lit(float(chunk_size))).cast("bigint")
    count = F.ceil(F.col("n_samples") / F.col("samplerate") / F.lit(float(chunk_size)))
    rows = spread(recordings, "chunk_idx", F.lit(0).cast("bigint"), count.cast("bigint") - 1)
    return rows.select(
        key, "chunk_idx",
        (F.col("chunk_idx") * F.lit(float(chunk_size))).alias("chunk_start"),
        (F.col("chunk_idx") * length).alias("start_sample"),
        F.least((F.col("chunk_idx") + 1) * length, F.col("n_samples").cast("bigint")).alias("end_sample"),
    )


def offset_chunk_times(dets: DataFrame, chunk_size: float = 3.0) -> DataFrame:
    shift = F.col("chunk_idx") * F.lit(float(chunk_size))
    return dets.withColumns({n: F.col(n) + shift for n in ("start_time", "end_time")})


def pair_predictions(clip_annotations: DataFrame, dets: DataFrame, key: str = "clip_id") -> DataFrame:
    """Every annotated clip with its predictions, joined on the clip id (never by position)."""
    return clip_annotations.join(dets, key, "left")
