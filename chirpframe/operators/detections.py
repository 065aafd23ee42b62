"""From score grids to detections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coords
from ..functions import scores as class_scores
from ..plans.tiles import core_only, spread, with_halo
from .targets import BoxMapping

CLIP = "clip_id"


def suppress(cells: DataFrame, kernel: int | tuple[int, int] = 9, tile: int = 512, key: str = CLIP) -> DataFrame:
    """Non-maximum suppression of a dense grid: cells below their neighbourhood maximum become 0.

    The k×k maximum is two 1-D window maxima. Time is tiled with copied
    borders; one shuffle on (clip, tile) serves both windows, and a long clip
    is split over many tasks.
    """
    k_f, k_t = (kernel, kernel) if isinstance(kernel, int) else kernel
    r_f, r_t = (k_f - 1) // 2, (k_t - 1) // 2
    tiled = with_halo(cells, "t", tile, r_t).repartition(key, "_tile")
    rows = Window.partitionBy(key, "_tile", "f").orderBy("t").rangeBetween(-r_t, r_t)
    columns = Window.partitionBy(key, "_tile", "t").orderBy("f").rangeBetween(-r_f, r_f)
    marked = tiled.withColumn("_m", F.max("value").over(rows)).where("_core")
    top = marked.withColumn("_m", F.max("_m").over(columns))
    return core_only(top).withColumn(
        "value", F.when(F.col("_m") == F.col("value"), F.col("value")).otherwise(F.lit(0.0))
    ).drop("_m")


def suppress_sparse(cells: DataFrame, kernel: int = 9, key: str = CLIP) -> DataFrame:
    """Suppression for grids without their low cells: drops every cell with a greater neighbour.

    Cells are compared through coarse blocks; a cell is copied to the blocks
    its neighbourhood touches (at most four), and a block holds at most
    kernel² cells plus border.
    """
    r = (kernel - 1) // 2
    near = lambda c: F.sequence(F.floor((F.col(c) - r) / kernel), F.floor((F.col(c) + r) / kernel))
    own = cells.withColumns({"_bf": F.floor(F.col("f") / kernel), "_bt": F.floor(F.col("t") / kernel)})
    other = (
        cells.withColumn("_bf", F.explode(near("f"))).withColumn("_bt", F.explode(near("t")))
        .select(F.col(key), "_bf", "_bt", F.col("f").alias("_f"), F.col("t").alias("_t"), F.col("value").alias("_v"))
    )
    same = [own[c] == other[c] for c in (key, "_bf", "_bt")]
    greater = (
        (F.abs(own["f"] - F.col("_f")) <= r) & (F.abs(own["t"] - F.col("_t")) <= r) & (F.col("_v") > own["value"])
    )
    return own.join(other, [*same, greater], "left_anti").drop("_bf", "_bt")


def peaks(cells: DataFrame, limit: Column | int, threshold: float | None = 0.01, strict: bool = False, key: str = CLIP) -> DataFrame:
    """The ``limit`` highest cells per clip, then the score threshold (inclusive; above it when strict).

    The rank filter lets Spark cut each task's rows to the top before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("value").desc(), "f", "t"))
    top = cells.withColumn("rank", rank).where(F.col("rank") <= limit)
    if threshold is None:
        return top
    bar = F.lit(float(threshold))
    return top.where(F.col("value") > bar if strict else F.col("value") >= bar)


def attach_at_peaks(found: DataFrame, *maps: DataFrame, key: str = CLIP) -> DataFrame:
    """Size, feature and class columns of the peak cells."""
    out = found
    for table in maps:
        out = out.join(table, [key, "f", "t"], "left")
    return out


def peak_detections(
    cells: DataFrame, *maps: DataFrame, height: int, width: int, duration: float,
    min_freq: float = coords.MIN_FREQ, max_freq: float = coords.MAX_FREQ, per_second: int = 100,
    threshold: float = 0.01, kernel: int = 9, key: str = CLIP,
) -> DataFrame:
    """Suppression, top-k, threshold, lookup, and mapping to seconds and Hz."""
    found = peaks(suppress(cells, kernel, key=key), int(per_second * duration), threshold, key=key)
    return to_seconds_hz(normalised(attach_at_peaks(found, *maps, key=key), height, width), 0.0, duration, min_freq, max_freq)


def normalised(found: DataFrame, height: int, width: int) -> DataFrame:
    return found.withColumns(
        {"time": F.col("t") / F.lit(float(width)), "frequency": F.col("f") / F.lit(float(height))}
    )


def to_seconds_hz(found: DataFrame, start: float, end: float, min_freq: float, max_freq: float) -> DataFrame:
    return found.withColumns(
        {
            "time": F.col("time") * F.lit(float(end - start)) + F.lit(float(start)),
            "frequency": F.col("frequency") * F.lit(float(max_freq - min_freq)) + F.lit(float(min_freq)),
        }
    )


def decode_detections(found: DataFrame, mapping: BoxMapping, class_names: Sequence[str], scores: str = "class_scores") -> DataFrame:
    """Boxes from positions and sizes; the best class chooses the mapper."""
    best = class_scores.class_at(class_names, class_scores.top_index(F.col(scores)))
    return found.withColumns(mapping.decode(F.col, best))


def legacy_boxes(
    found: DataFrame, height: int, samplerate: int = coords.SAMPLERATE, resize: float = coords.RESIZE,
    min_freq: float = coords.MIN_FREQ, max_freq: float = coords.MAX_FREQ,
) -> DataFrame:
    """Older decoding: rows count from the top, size in cells gives end time and high frequency."""
    step = (max_freq - min_freq) / height
    low = (F.lit(float(height)) - F.col("f")) * F.lit(step) + F.lit(float(min_freq))
    at = lambda x: coords.column_to_time(x / F.lit(resize), samplerate)
    return found.withColumns(
        {
            "start_time": at(F.col("t").cast("double")),
            "end_time": at(F.col("t") + F.col("bb_width")),
            "low_freq": low,
            "high_freq": low + F.col("bb_height") * F.lit(step),
        }
    )


def legacy_peak_limit(width: int, samplerate: int = coords.SAMPLERATE, per_second: int = 200) -> int:
    n_fft = int(coords.WINDOW_S * samplerate)
    n_overlap = int(coords.OVERLAP * n_fft)
    return int((width * (n_fft - n_overlap) + n_overlap) / samplerate * per_second)


def best_class_rows(dets: DataFrame, class_names: Sequence[str], scores: str = "class_scores") -> DataFrame:
    """Rounded box, best class and its score, as result documents show them."""
    index = class_scores.top_index(F.col(scores))
    return dets.withColumns(
        {
            "start_time": F.round("start_time", 4),
            "end_time": F.round("end_time", 4),
            "low_freq": F.col("low_freq").cast("int"),
            "high_freq": F.col("high_freq").cast("int"),
            "class": class_scores.class_at(class_names, index),
            "class_prob": F.round(class_scores.top_score(F.col(scores)), 3),
            "det_prob": F.round("detection_score", 3),
        }
    )


def class_score_rows(
    dets: DataFrame, class_names: Sequence[str], include_top_class: bool = True,
    sort: bool = True, scores: str = "class_scores", key: str = "det_id",
) -> DataFrame:
    """(det_id, position, class_name, score), highest first; the top class optional."""
    ranked = class_scores.ranked_scores(F.col(scores), class_names, sort)
    if not include_top_class:
        top = class_scores.class_at(class_names, class_scores.top_index(F.col(scores)))
        rows = dets.withColumn("_top", top)
        ranked = F.filter(ranked, lambda x: x["class_name"] != F.col("_top"))
    else:
        rows = dets
    return rows.select(key, F.posexplode(ranked).alias("position", "_x")).select(
        key, "position", "_x.class_name", "_x.score"
    )


# --- model hook ------------------------------------------------------------

Scorer = Callable[[list], list]


def score_clips(
    clips: DataFrame, scorer: Scorer, schema: str, grid: str = "spec", batch_size: int = 8,
    keep: Sequence[str] = (CLIP,), partitions: int | None = None,
) -> DataFrame:
    """Run a caller-supplied model over clips in batches, one output list per clip.

    ``spec`` holds a clip's grid as ``array<array<double>>`` (rows × columns).
    Narrow grids of a batch are zero-padded to the widest. ``scorer`` maps a
    numpy batch (n, rows, columns) to one list of result tuples per clip, laid
    out as ``schema``. The model must not depend on padding for the result to
    be independent of ``batch_size``.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fieldNames()
    kept = clips.select(*keep, grid)
    if partitions:
        kept = kept.repartition(partitions)

    def run(batches):
        for frame in batches:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                grids = [np.stack([np.asarray(r, dtype=float) for r in g]) for g in part[grid]]
                widest = max(g.shape[1] for g in grids)
                block = np.stack([np.pad(g, ((0, 0), (0, widest - g.shape[1]))) for g in grids])
                rows = [
                    (*head, *result)
                    for head, results in zip(part[list(keep)].itertuples(index=False), scorer(block), strict=True)
                    for result in results
                ]
                yield pd.DataFrame(rows, columns=[*keep, *fields])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keep).schema.fields)
    return kept.mapInPandas(run, f"{head}, {schema}")


def pack_grids(
    cells: DataFrame, n_f: int, key: str = CLIP, columns: int | None = None, border: int = 0
) -> DataFrame:
    """Model input per clip: rows × columns arrays, of any width.

    With ``columns`` a long clip is cut into tiles of so many columns, each with
    ``border`` columns of its neighbours on both sides: one row per (clip, tile), where ``first``
    is the column of the clip that the tile's array starts with.
    """
    group = [key]
    if columns is not None:
        home = F.floor(F.col("t") / columns)
        near = F.sequence(F.floor((F.col("t") - border) / columns), F.floor((F.col("t") + border) / columns))
        last = F.max(home).over(Window.partitionBy(key))
        cells = cells.withColumn("_last", last).withColumn("tile", F.explode(near)).where(
            (F.col("tile") >= 0) & (F.col("tile") <= F.col("_last"))
        ).drop("_last")
        group = [key, "tile"]
    column = cells.groupBy(*group, "t").agg(
        F.array_sort(F.collect_list(F.struct("f", "value"))).alias("_c")
    ).withColumn("_c", F.transform("_c", lambda x: x["value"]))
    packed = column.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("t", "_c"))).alias("_g"))
    rows = F.transform(
        F.sequence(F.lit(0), F.lit(n_f - 1)), lambda i: F.transform("_g", lambda g: F.get(g["_c"], i))
    )
    first = [F.array_min(F.transform("_g", lambda g: g["t"])).alias("first")] if columns is not None else []
    return packed.select(*group, *first, rows.alias("spec"))


__all__ = [
    "attach_at_peaks", "best_class_rows", "class_score_rows", "decode_detections", "legacy_boxes",
    "legacy_peak_limit", "normalised", "pack_grids", "peak_detections", "peaks", "score_clips",
    "spread", "suppress", "suppress_sparse", "to_seconds_hz",
]
