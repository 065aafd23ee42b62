"""Seeded dataset augmentation. Every random choice is a column, so runs repeat exactly."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw, integer, uniform
from ..plans.ordered import hashed_rank
from ..plans.session import cut_lineage
from ..plans.stats import with_group_stats
from ..plans.tiles import spread
from .signal import resize_axis

CLIP = "clip_id"


# --- annotations -----------------------------------------------------------

def partners(clips: DataFrame, seed: str = "partner", key: str = CLIP) -> DataFrame:
    """A partner clip for every clip: the next one in a seeded random order (the last takes the first)."""
    ranked = hashed_rank(clips.select(key).withColumn("_u", draw(seed, F.col(key))), [], "_u", key, "_r").drop("_u")
    size = ranked.agg(F.count(F.lit(1)).alias("_n"))
    turned = ranked.crossJoin(F.broadcast(size)).withColumn("_next", F.col("_r") % F.col("_n") + 1)  # one row
    other = ranked.select(F.col("_r").alias("_next"), F.col(key).alias("partner_id"))
    return turned.join(other, "_next").select(key, "partner_id")


def combine_annotations(events: DataFrame, clips: DataFrame, pairs: DataFrame, key: str = CLIP) -> DataFrame:
    """Own events plus the partner's, shifted to the clip's start."""
    start = clips.select(key, "clip_start")
    own = pairs.join(start, key)
    theirs = start.select(F.col(key).alias("partner_id"), F.col("clip_start").alias("_theirs"))
    shift = own.join(theirs, "partner_id").select(
        F.col("partner_id"), F.col(key).alias("_own"), (F.col("clip_start") - F.col("_theirs")).alias("_shift")
    )
    borrowed = events.withColumnRenamed(key, "partner_id").join(shift, "partner_id").withColumns(
        {n: F.col(n) + F.col("_shift") for n in ("start_time", "end_time")}
    ).drop("_shift", "partner_id").withColumnRenamed("_own", key)
    kept = events.join(pairs.select(key), key, "left_semi")
    return kept.withColumn("mixed", F.lit(False)).unionByName(
        borrowed.select(*events.columns).withColumn("mixed", F.lit(True))
    )


def warp_annotations(events: DataFrame, clips: DataFrame, key: str = CLIP) -> DataFrame:
    """Times scaled by 1/``factor`` about the clip start; ``clips`` carries the factor."""
    rows = events.join(clips.select(key, "clip_start", "factor"), key)
    return rows.withColumns(
        {
            n: F.col("clip_start") + (F.col(n) - F.col("clip_start")) * (F.lit(1.0) / F.col("factor"))
            for n in ("start_time", "end_time")
        }
    ).drop("clip_start", "factor")


# --- waveforms (the arithmetic is ``waves.mix`` and ``waves.echo``) ----------

def mix_weights(pairs: DataFrame, low: float = 0.3, high: float = 0.7, seed: str = "mix", key: str = CLIP) -> DataFrame:
    return pairs.withColumn("weight", uniform(seed, F.col(key), low, high))


def echo_settings(clips: DataFrame, samplerate: int, max_delay: float = 0.005, low: float = 0.0, high: float = 1.0, seed: str = "echo", key: str = CLIP) -> DataFrame:
    return clips.select(
        key, integer(f"{seed}-delay", F.col(key), 0, int(max_delay * samplerate)).alias("delay"),
        uniform(f"{seed}-weight", F.col(key), low, high).alias("weight"),
    )


# --- grids -----------------------------------------------------------------

def scale_volume(cells: DataFrame, low: float = 0.0, high: float = 2.0, seed: str = "volume", key: str = CLIP) -> DataFrame:
    return cells.withColumn("value", F.col("value") * uniform(seed, F.col(key), low, high))


def warp_factors(clips: DataFrame, delta: float = 0.04, seed: str = "warp", key: str = CLIP) -> DataFrame:
    return clips.withColumn("factor", uniform(seed, F.col(key), 1 - delta, 1 + delta))


def warp_cells(cells: DataFrame, factors: DataFrame, key: str = CLIP) -> DataFrame:
    """Stretch time: cut or zero-pad to int(width × factor), then resample to the old width."""
    sized = with_group_stats(cells, [key], _w=F.max("t") + 1).join(factors.select(key, "factor"), key).withColumn(
        "_n", F.floor(F.col("_w") * F.col("factor")).cast("bigint")
    )
    inside = sized.where(F.col("t") < F.col("_n"))
    last = sized.where(F.col("t") == F.col("_w") - 1)
    pad = spread(last, "_t", F.col("_w"), F.col("_n") - 1).drop("t").withColumnRenamed("_t", "t").withColumn(
        "value", F.lit(0.0)
    )
    whole = inside.unionByName(pad)
    return resize_axis(whole, "t", F.col("_n"), F.col("_w"), [key, "f"]).select(key, "f", "t", "value")


def draw_masks(
    clips: DataFrame, size: Column | int, max_share: float, max_masks: int = 3, seed: str = "mask", key: str = CLIP
) -> DataFrame:
    """One to ``max_masks`` half-open bands per clip: (clip, masks array<struct<start, stop>>)."""
    n = size if isinstance(size, Column) else F.lit(size)
    bands = []
    for i in range(max_masks):
        width = integer(f"{seed}-size{i}", F.col(key), 0, F.floor(n * F.lit(max_share)).cast("int"))
        start = integer(f"{seed}-start{i}", F.col(key), 0, n - width)
        bands.append(F.struct(start.alias("start"), (start + width).alias("stop")))
    count = integer(f"{seed}-count", F.col(key), 1, max_masks + 1)
    return clips.select(key, F.slice(F.array(*bands), F.lit(1), count).alias("masks"))


def apply_masks(cells: DataFrame, masks: DataFrame, axis: str, value: float = 0.0, key: str = CLIP) -> DataFrame:
    """Overwrite the cells of every band on ``axis`` (t or f)."""
    rows = cells.join(masks.select(key, "masks"), key, "left")
    hit = F.coalesce(
        F.exists("masks", lambda m: (F.col(axis) >= m["start"]) & (F.col(axis) < m["stop"])), F.lit(False)
    )
    return rows.withColumn("value", F.when(hit, F.lit(float(value))).otherwise(F.col("value"))).drop("masks")


# --- sequence --------------------------------------------------------------

Step = Callable[[DataFrame], DataFrame]


def maybe_apply(
    df: DataFrame, step: Step, probability: float = 0.2, seed: str = "maybe", key: str = CLIP, same_rows: bool = True
) -> DataFrame:
    """Apply ``step`` to the clips whose draw is at most ``probability``; the rest pass through.

    A step that keeps the rows and passes other columns on runs once over all rows, and each row
    then takes its new or its old values, so the input is read once. For a step
    that adds or removes rows (``same_rows=False``) the input is stored first and split in two.
    """
    chosen = draw(seed, F.col(key)) <= F.lit(float(probability))
    if not same_rows:
        whole = cut_lineage(df)
        return step(whole.where(chosen)).unionByName(whole.where(~chosen), allowMissingColumns=True)
    values = [c for c in df.columns if c != key]
    done = step(df.withColumns({f"_old_{c}": F.col(c) for c in values}))
    return done.withColumns({
        c: F.when(chosen, F.col(c)).otherwise(F.col(f"_old_{c}")) if c in values else F.when(chosen, F.col(c))
        for c in done.columns if c != key and not c.startswith("_old_")
    }).drop(*[f"_old_{c}" for c in values])


def augment(df: DataFrame, steps: Sequence[tuple], seed: str = "augment", key: str = CLIP) -> DataFrame:
    """Steps (step, probability[, same_rows]) in order, each with its own draw per clip."""
    out = df
    for number, (step, probability, *same_rows) in enumerate(steps):
        out = maybe_apply(out, step, probability, f"{seed}-{number}", key, *same_rows)
    return out
