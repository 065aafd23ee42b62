"""Acoustic features of detections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords
from ..plans.ordered import order_rows, with_previous
from ..plans.scan import affine_prefix
from ..plans.session import cut_lineage
from ..plans.stats import with_group_stats
from ..plans.tiles import spread

CLIP = "clip_id"
#: Columns of a grid that one task sums up.
TILE = 1024


def box_features() -> dict[str, Column]:
    return {
        "duration": F.round(F.col("end_time") - F.col("start_time"), 5),
        "low_freq_bb": F.col("low_freq").cast("int"),
        "high_freq_bb": F.col("high_freq").cast("int"),
        "bandwidth": (F.col("high_freq") - F.col("low_freq")).cast("int"),
    }


def _spans(dets: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Detections with grid size and half-open column and row spans (rows from the top)."""
    grid = cells.groupBy(key).agg((F.max("f") + 1).alias("_h"), (F.max("t") + 1).alias("_w"))
    rows = dets.join(grid, key)
    return rows.withColumns(
        {
            "_x0": F.greatest(F.col("x_pos"), F.lit(0)),
            "_x1": F.least(F.col("_w") - 1, F.col("x_pos") + F.col("bb_width")),
            "_y1": F.least(F.col("_h") - 1, F.col("y_pos")),
            "_y0": F.greatest(F.col("y_pos") - F.col("bb_height"), F.lit(0)),
        }
    )


def column_sums(cells: DataFrame, wanted: DataFrame, height: str, key: str = CLIP, tile: int = TILE) -> DataFrame:
    """Running sums per row over all columns before a place: ``wanted`` (clip, t, ..., ``height``) plus ``sums``.

    A summed-area table along time that is never written out. A tile of columns meets the
    places asked for in it, and only they get its running sums; what all tiles before it hold
    is a prefix scan of the tiles' totals. The work for a place is one array of
    ``height`` sums, whatever lies before it.
    """
    place = F.floor(F.col("t") / tile).alias("_tile")
    grid = cells.select(key, F.col("f").cast("long").alias("f"), "t", "value", place)
    asked = wanted.withColumn("_tile", place)
    names = asked.columns

    def answer(some: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if not len(here):
            return pd.DataFrame({c: [] for c in [*names, "_inside"]})
        first = int(here["_tile"].iloc[0]) * tile
        dense = np.zeros((tile + 1, int(here[height].iloc[0])))
        np.add.at(dense, (some["t"].to_numpy() - first + 1, some["f"].to_numpy()), some["value"].to_numpy())
        before = np.cumsum(dense, axis=0)
        return here.assign(_inside=list(before[here["t"].to_numpy() - first]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    inside = grid.groupBy(key, "_tile").cogroup(asked.groupBy(key, "_tile")).applyInPandas(
        answer, f"{fields}, _inside array<double>")
    totals = grid.groupBy(key, "f", "_tile").agg(F.sum("value").alias("term")).withColumn("factor", F.lit(1.0))
    # a tile may lack a row that others have, so its predecessor's sum is carried by a dense set of rows
    rows = totals.groupBy(key).agg(F.collect_set("f").alias("_rows"))
    tiles = asked.select(key, "_tile").distinct().join(rows, key).select(key, F.explode("_rows").alias("f"), "_tile")
    dense = cut_lineage(tiles.join(totals, [key, "f", "_tile"], "full").fillna({"term": 0.0, "factor": 1.0}))
    carried = affine_prefix(dense, [key, "f"], "_tile")
    entry = F.struct("f", "carry")
    before = carried.groupBy(key, "_tile").agg(F.map_from_entries(F.collect_list(entry)).alias("_carry"))
    return inside.join(before, [key, "_tile"], "left").withColumn("sums", F.transform("_inside", lambda v, f: (
        v + F.coalesce(F.element_at("_carry", f.cast("long")), F.lit(0.0))))).drop("_inside", "_carry", "_tile")


def max_power(
    dets: DataFrame, cells: DataFrame, min_freq: int = coords.MIN_FREQ, max_freq: int = coords.MAX_FREQ,
    key: str = CLIP, det_key: str = "det_id", tile: int = TILE,
) -> DataFrame:
    """Loudest row in Hz: inside the box, over the call, over its first and second half.

    Every span is the difference of two running sums, so a call looks up three
    columns (start, middle, end) whatever its width. The topmost row wins ties and empty
    spans; a box without rows gives null.
    """
    spans = _spans(dets.select(key, det_key, "x_pos", "y_pos", "bb_width", "bb_height"), cells, key)
    width = F.greatest(F.col("_x1") - F.col("_x0"), F.lit(0))
    spans = cut_lineage(spans.withColumn("_half", F.col("_x0") + F.floor(width / 2)).withColumn("_end", F.col("_x0") + width))
    columns = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("long").alias("t"))
                                  for k, c in enumerate(("_x0", "_half", "_end"))]))
    wanted = spans.select(key, det_key, "_h", columns.alias("_w")).select(
        key, det_key, F.col("_h").cast("long").alias("_h"), F.col("_w.k").alias("k"), F.col("_w.t").alias("t"))
    sums = column_sums(cells, wanted, "_h", key, tile).groupBy(det_key).agg(
        *[F.first(F.when(F.col("k") == k, F.col("sums")), ignorenulls=True).alias(f"_s{k}") for k in range(3)])

    def part(low: int, high: int) -> Column:
        return F.zip_with(f"_s{high}", f"_s{low}", lambda b, a: b - a)

    def loudest(values: Column) -> Column:
        return F.array_position(values, F.array_max(values)) - 1  # the first of equals

    def hertz(row: Column) -> Column:
        share = (F.col("_h") - row) / F.col("_h")
        return F.round(share * F.lit(float(max_freq - min_freq)) + F.lit(float(min_freq)), 2).cast("int")

    found = spans.join(sums, det_key, "left").withColumns({"_all": part(0, 2), "_first": part(0, 1), "_second": part(1, 2)})
    tall = F.col("_y1") > F.col("_y0")
    box = F.slice("_all", F.when(tall, F.col("_y0") + 1).otherwise(F.lit(1)).cast("int"),
                  F.when(tall, F.col("_y1") - F.col("_y0")).otherwise(F.lit(0)).cast("int"))
    return found.withColumn("_box", box).select(
        det_key,
        F.when(tall, hertz(F.col("_y0") + loudest(F.col("_box")))).alias("max_power_bb"),
        hertz(loudest(F.col("_all"))).alias("max_power"),
        hertz(loudest(F.col("_first"))).alias("max_power_first"),
        hertz(loudest(F.col("_second"))).alias("max_power_second"),
    )


def call_interval(
    dets: DataFrame, keys: Sequence[str] = ("recording_id",), order: Sequence[str] = ("start_time", "det_id")
) -> DataFrame:
    """Gap to the end of the previous call of the same recording and chunk; null for the first.

    The order runs over ranges, so one busy recording does not sort in one task.
    """
    slim = dets.select(*dict.fromkeys([*keys, *order, "end_time", "start_time"]))
    rows = with_previous(order_rows(slim, keys, [(c, False) for c in order]), "_prev", "end_time").clean()
    return rows.withColumn("call_interval", F.round(F.col("start_time") - F.col("_prev"), 5)).drop("_prev")


def call_slices(dets: DataFrame, cells: DataFrame, key: str = CLIP, det_key: str = "det_id", padding: float = 0.2) -> DataFrame:
    """Cells of each call with padding on both sides: (det_id, f, t, offset, value)."""
    widths = cells.groupBy(key).agg((F.max("t") + 1).alias("_w"))
    pad = F.col("bb_width") * F.lit(padding)
    left = F.col("x_pos") - pad
    spans = dets.select(key, det_key, "x_pos", "bb_width").join(widths, key).withColumns(
        {
            "_x0": F.greatest(left, F.lit(0.0)).cast("bigint"),
            "_x1": F.least(F.col("_w") - 1, F.rint(left + F.col("bb_width") + 2 * pad)).cast("bigint"),
        }
    )
    columns = spread(spans, "t", F.col("_x0"), F.col("_x1") - 1)
    return columns.join(cells.select(key, "t", "f", "value"), [key, "t"]).select(
        det_key, "f", "t", (F.col("t") - F.col("_x0")).alias("offset"), "value"
    )


__all__ = ["box_features", "call_interval", "call_slices", "max_power", "with_group_stats"]
