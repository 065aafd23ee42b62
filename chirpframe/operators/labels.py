"""Training heatmaps from annotated events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coords
from ..functions.geometry import FREQUENCY_SCALE, TIME_SCALE, encode_anchor
from ..plans.tiles import spread

# exp(-d²/2σ²) is 0 in single precision beyond this many sigmas.
REACH_SIGMAS = 14.43
DETECTION = "__detection__"
#: Cells of the grids that are worked on at a time.
GRID_CELLS = 1_000_000


def event_cells(
    events: DataFrame, clips: DataFrame, height: int, width: int,
    min_freq: float = coords.MIN_FREQ, max_freq: float = coords.MAX_FREQ,
    key: str = "clip_id", time_scale: float = TIME_SCALE, frequency_scale: float = FREQUENCY_SCALE,
) -> DataFrame:
    """Grid cell and size of each event; events outside the grid are left out.

    ``events`` are encoded targets (``time``, ``frequency``, size columns) or
    plain boxes, which are encoded by their bottom-left corner.
    """
    if "time" not in events.columns:
        events = events.withColumns(encode_anchor(F.col, "bottom-left", time_scale, frequency_scale))
    rows = events.join(clips.select(key, "clip_start", "clip_end"), key)
    return (
        rows.withColumn("t0", coords.to_pixel(F.col("time"), width, F.col("clip_start"), F.col("clip_end")))
        .withColumn("f0", coords.to_pixel(F.col("frequency"), height, min_freq, max_freq))
        .where((F.col("t0") < width) & (F.col("f0") < height))
        .drop("clip_start", "clip_end")
    )


def lower_envelope(squares: np.ndarray) -> np.ndarray:
    """min over i of ``squares[i] + (row - i)^2`` for every row and every column, in place of the rows.

    The lower envelope of parabolas, for all columns at once: one pass over the
    rows builds it, one reads it.
    """
    count, width = squares.shape
    every = np.arange(width)
    owner = np.zeros((count, width), np.int64)  # parabolas of the envelope, from the left
    begin = np.full((count + 1, width), np.inf)  # where each of them starts to be the lowest
    begin[0] = -np.inf
    top = np.zeros(width, np.int64)
    for i in range(1, count):
        columns, cross = every, np.empty(width)
        while len(columns):
            last = owner[top[columns], columns]
            meet = (squares[i, columns] + i * i - squares[last, columns] - last * last) / (2.0 * (i - last))
            cross[columns] = meet
            columns = columns[meet <= begin[top[columns], columns]]  # hidden by the new one
            top[columns] -= 1
        top += 1
        owner[top, every], begin[top, every], begin[top + 1, every] = i, cross, np.inf
    out = np.empty((count, width))
    here = np.zeros(width, np.int64)
    for row in range(count):
        columns = every
        while len(columns):
            columns = columns[begin[here[columns] + 1, columns] < row]
            here[columns] += 1
        lowest = owner[here, every]
        out[row] = squares[lowest, every] + (row - lowest) ** 2
    return out


def nearest_along(marks: np.ndarray) -> np.ndarray:
    """Distance of every entry to the nearest true entry along the last axis (a large number if there is none)."""
    width = marks.shape[-1]
    far = 4 * width + 4
    place = np.arange(width)
    before = np.maximum.accumulate(np.where(marks, place, -far), axis=-1)
    after = np.minimum.accumulate(np.where(marks, place, width + far)[..., ::-1], axis=-1)[..., ::-1]
    return np.minimum(place - before, after - place)


def heatmaps(
    cells: DataFrame, height: int, width: int, sigma: float = 2.0, key: str = "clip_id", tile: int = 256
) -> DataFrame:
    """Non-zero cells (clip, layer, f, t, value) of the detection and class heatmaps.

    The maximum of Gaussians is the Gaussian of the nearest event: an exact distance
    transform on time tiles, to which the events within reach are copied. Along
    time, every row has its distance to the nearest event; along frequency the lower
    envelope of parabolas takes O(height) steps a column, many grids at a time. Cells whose
    value is 0 in single precision are not emitted; all others are exact.
    """
    reach = int(math.ceil(REACH_SIGMAS * sigma))
    layers = F.array_compact(F.array(F.lit(DETECTION), F.col("class_name")))
    spots = cells.select(key, F.explode(layers).alias("layer"), F.col("f0").cast("long"), F.col("t0").cast("long")).distinct()
    seen = spread(spots, "_tile", F.floor(F.greatest(F.col("t0") - reach, F.lit(0)) / tile),
                  F.floor(F.least(F.col("t0") + reach, F.lit(width - 1)) / tile))
    far = float(reach + 1)  # beyond reach all distances are alike: none is emitted
    span = min(tile, width)

    def paint(keys: list, events: np.ndarray, type_: pa.DataType) -> pa.RecordBatch:
        """Columns of squared distances of grids (clip, layer, tile); ``events`` is (number of the grid, f0, t0 in the tile)."""
        marks = np.zeros((height, len(keys), span + 2 * reach), bool)
        marks[events[:, 1], events[:, 0], events[:, 2]] = True
        along = np.minimum(nearest_along(marks)[..., reach:reach + span], far)
        squares = lower_envelope((along * along).reshape(height, -1)).astype(np.int32)
        grid, t = np.divmod(np.arange(squares.shape[1]), span)
        t = t + np.array([k[2] for k in keys])[grid] * tile
        used = np.flatnonzero((squares.min(axis=0) <= reach * reach) & (t < width))
        owner = pa.array(grid[used])
        offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * height)
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], type_).take(owner), pa.array([k[1] for k in keys], pa.string()).take(owner),
            pa.array(t[used]), pa.ListArray.from_arrays(offsets, pa.array(squares[:, used].T.ravel())),
        ], names=[key, "layer", "t", "squares"])

    most = max(1, GRID_CELLS // (height * (span + 2 * reach)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        held: list = []
        for batch in batches:
            type_ = batch.schema.field(0).type
            for clip, layer, number, f0, t0 in zip(*(column.to_pylist() for column in batch.columns)):
                if not keys or keys[-1] != (clip, layer, number):
                    if len(keys) == most:
                        yield paint(keys, np.array(held), type_)
                        keys, held = [], []
                    keys.append((clip, layer, number))
                held.append((len(keys) - 1, f0, t0 - number * tile + reach))
        if keys:
            yield paint(keys, np.array(held), type_)

    kind = cells.schema[key].dataType.simpleString()
    grids = seen.select(key, "layer", "_tile", "f0", "t0").repartition(key, "layer", "_tile").sortWithinPartitions(
        key, "layer", "_tile")
    columns = grids.mapInArrow(run, f"`{key}` {kind}, layer string, t long, squares array<int>")
    found = columns.select(key, "layer", F.posexplode("squares").alias("f", "d"), F.col("t").cast("int").alias("t"))
    return found.where(F.col("d") <= reach * reach).select(
        key, "layer", "f", "t", F.exp(-F.col("d") / F.lit(2.0 * sigma * sigma)).alias("value"))


def size_maps(cells: DataFrame, key: str = "clip_id", order: str = "ann_id", dimensions=("width", "height")) -> DataFrame:
    """Size at each event cell; the last event in id order wins a shared cell."""
    return cells.groupBy(key, F.col("f0").alias("f"), F.col("t0").alias("t")).agg(
        F.max_by(F.struct(*dimensions), F.col(order)).alias("_s")
    ).select(key, "f", "t", *[F.col(f"_s.{d}").alias(d) for d in dimensions])
