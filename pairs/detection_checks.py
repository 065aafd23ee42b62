"""Score grids to detections, acoustic features, label heatmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpframe.functions import coords
from chirpframe.operators import detections, features, forest, labels, targets
from chirpframe.sources import predictions

from .base import CLASSES, pair, scored

NMS = """mx as (select clip_id, f, t, value, max(rm) over (partition by clip_id, t order by f range between 4 preceding and 4 following) as m
      from (select *, max(value) over (partition by clip_id, f order by t range between 4 preceding and 4 following) as rm from cells)),
    nms as (select clip_id, f, t, case when value = m then value else 0 end as value from mx)"""


@pair("det01_suppress", f"with {NMS} select clip_id, f, t, round(value, 6) as value from nms", "cells")
def _(i):
    out = detections.suppress(i.cells, tile=16)
    return out.select("clip_id", "f", "t", F.round("value", 6).alias("value"))


@pair(
    "det01_suppress_sparse",
    f"with {NMS} select clip_id, f, t, round(value, 6) as value from nms where value >= 0.5",
    "cells",
)
def _(i):
    out = detections.suppress_sparse(i.cells.where("value >= 0.5"))
    return out.select("clip_id", "f", "t", F.round("value", 6).alias("value"))


SIZES = "((f*7 + t*3)%11) as width, ((f*5 + t)%13) as height"
PEAKS = f"""{NMS}, pk as (select *, row_number() over (partition by clip_id order by value desc, f, t) as rank from nms)"""


def _maps(i):
    size = i.cells.select(
        "clip_id", "f", "t", ((F.col("f") * 7 + F.col("t") * 3) % 11).cast("double").alias("width"),
        ((F.col("f") * 5 + F.col("t")) % 13).cast("double").alias("height"),
    )
    part = lambda k: ((F.col("f") * k + F.col("t")) % 17).cast("double") / 17
    classes = i.cells.select("clip_id", "f", "t", F.array(part(3), part(5), part(7)).alias("class_scores"))
    return size, classes


@pair(
    "det02_peaks",
    f"""with {PEAKS} select clip_id, cast(rank as integer) as rank, f, t, round(value, 6) as value, cast((f*7 + t*3)%11 as double) as width,
    round(t / cast(50 as double), 6) as time, round(f / cast(20 as double), 6) as frequency from pk where rank <= 12 and value >= 0.93""",
    "cells",
)
def _(i):
    found = detections.peaks(detections.suppress(i.cells, tile=16), 12, 0.93)
    found = detections.attach_at_peaks(found, _maps(i)[0])
    out = detections.normalised(found, 20, 50)
    return out.select("clip_id", "rank", "f", "t", F.round("value", 6).alias("value"), "width", F.round("time", 6).alias("time"), F.round("frequency", 6).alias("frequency"))


@pair(
    "det03_seconds_hz",
    """select clip_id, f, t, round(t / cast(50 as double) * 2.5, 6) as time, round(f / cast(20 as double) * 110000 + 10000, 6) as frequency from cells""",
    "cells",
)
def _(i):
    out = detections.to_seconds_hz(detections.normalised(i.cells, 20, 50), 0.0, 2.5, coords.MIN_FREQ, coords.MAX_FREQ)
    return out.select("clip_id", "f", "t", F.round("time", 6).alias("time"), F.round("frequency", 6).alias("frequency"))


@pair(
    "det04_decode_detections",
    f"""with {PEAKS}, g as (select *, t / cast(50 as double) * 2.5 as time, f / cast(20 as double) * 110000 + 10000 as freq, {SIZES},
      (f*3 + t)%17 as a, (f*5 + t)%17 as b, (f*7 + t)%17 as c from pk where rank <= 100 and value >= 0.5)
    select clip_id, f, t, case when a >= b and a >= c then 'click' when b >= c then 'purchase' else 'signup' end as top_class,
    round(greatest(0, case when a >= b and a >= c then time - width / cast(1000 as double) / 2 else time end), 6) as start_time,
    round(greatest(0, case when a >= b and a >= c then freq - height * cast(859.375 as double) / 2 else freq end) + height * cast(859.375 as double), 6) as high_freq from g""",
    "cells",
)
def _(i):
    from chirpframe.functions import scores

    mapping = targets.BoxMapping(overrides={"click": targets.AnchorBox("center")})
    found = detections.peak_detections(i.cells, *_maps(i), height=20, width=50, duration=2.5, per_second=40, threshold=0.5)
    out = detections.decode_detections(found, mapping, CLASSES)
    best = scores.class_at(CLASSES, scores.top_index(F.col("class_scores")))
    return out.select(
        "clip_id", "f", "t", best.alias("top_class"), F.round("start_time", 6).alias("start_time"), F.round("high_freq", 6).alias("high_freq")
    )


@pair(
    "det05_legacy_boxes",
    f"""with {PEAKS}, g as (select *, 1 + (f*7 + t*3)%11 as bw, (f*5 + t)%13 as bh from pk where rank <= 12 and value > 0.9)
    select clip_id, f, t, round((t / cast(0.5 as double) * 128 + 384) / 256000, 6) as start_time, round(((t + bw) / cast(0.5 as double) * 128 + 384) / 256000, 6) as end_time,
    round((20 - f) * cast(5500 as double) + 10000, 6) as low_freq, round((20 - f) * cast(5500 as double) + 10000 + bh * 5500, 6) as high_freq from g""",
    "cells",
)
def _(i):
    found = detections.peaks(detections.suppress(i.cells), 12, 0.9, strict=True)
    sizes = found.withColumns({
        "bb_width": (1 + (F.col("f") * 7 + F.col("t") * 3) % 11).cast("double"),
        "bb_height": ((F.col("f") * 5 + F.col("t")) % 13).cast("double"),
    })
    out = detections.legacy_boxes(sizes, 20)
    return out.select("clip_id", "f", "t", *[F.round(n, 6).alias(n) for n in ("start_time", "end_time", "low_freq", "high_freq")])


@pair(
    "det11_score_clips",
    """select clip_id, cast(f as bigint) as f, round(sum(value), 6) as energy from cells group by clip_id, f""",
    "cells",
)
def _(i):
    def energy(block):
        return [[(int(row), float(total)) for row, total in enumerate(grid.sum(axis=1))] for grid in block]

    packed = detections.pack_grids(i.cells, 20)
    out = detections.score_clips(packed, energy, "f bigint, energy double", batch_size=3)
    return out.withColumn("energy", F.round("energy", 6))


# --- features --------------------------------------------------------------

@pair(
    "fea01_box_features",
    """select det_id, round(end_time - start_time, 5) as duration, cast(low_freq as integer) as low_freq_bb, cast(high_freq as integer) as high_freq_bb,
    cast(high_freq - low_freq as integer) as bandwidth from det""",
    "det",
)
def _(i):
    return i.det.select("det_id", *[c.alias(n) for n, c in features.box_features().items()])


SPAN = """sp as (select *, greatest(0, x_pos) as x0, least(49, x_pos + bb_width) as x1, least(19, y_pos) as y1, greatest(0, y_pos - bb_height) as y0 from grid_det),
    sh as (select *, x0 + cast(floor(greatest(x1 - x0, 0) / 2) as bigint) as half from sp),
    sm as (select det_id, f, sum(value) as al, sum(value) filter (where f >= y0 and f < y1) as bx, coalesce(sum(value) filter (where t < half), 0) as h1, coalesce(sum(value) filter (where t >= half), 0) as h2
      from sh join whole_cells c on c.clip_id = sh.clip_id and c.t >= x0 and c.t < x1 group by det_id, f),
    b as (select det_id, arg_min(f, (-al, f)) as fa, arg_min(f, (-bx, f)) filter (where bx is not null) as fb, arg_min(f, (-h1, f)) as f1, arg_min(f, (-h2, f)) as f2 from sm group by 1)"""


def hertz(row: str) -> str:
    return f"cast(floor(round((20 - {row}) / cast(20 as double) * 110000 + 10000, 2)) as integer)"


@pair(
    "fea02_max_power",
    f"""with {SPAN} select det_id, case when y1 > y0 then {hertz('coalesce(fb, y0)')} end as max_power_bb, {hertz('coalesce(fa, 0)')} as max_power,
    {hertz('coalesce(f1, 0)')} as max_power_first, {hertz('coalesce(f2, 0)')} as max_power_second from sh left join b using (det_id)""",
    "whole_cells grid_det",
)
def _(i):
    return features.max_power(i.grid_det, i.whole_cells)


@pair(
    "fea03_call_interval",
    """select det_id, round(start_time - lag(end_time) over (partition by clip_id order by start_time, det_id), 5) as call_interval from det""",
    "det",
)
def _(i):
    return features.call_interval(i.det, ["clip_id"]).select("det_id", "call_interval")


@pair(
    "fea04_call_slices",
    """with s as (select *, cast(floor(greatest(0, x_pos - bb_width * cast(0.2 as double))) as bigint) as x0,
      cast(least(49, round_even(x_pos - bb_width * cast(0.2 as double) + bb_width + 2 * (bb_width * cast(0.2 as double)), 0)) as bigint) as x1 from grid_det)
    select det_id, f, t, t - x0 as "offset", round(value, 6) as value from s join cells c on c.clip_id = s.clip_id and t >= x0 and t < x1""",
    "cells grid_det",
)
def _(i):
    return features.call_slices(i.grid_det, i.cells).withColumn("value", F.round("value", 6))


# --- labels ----------------------------------------------------------------

EVENT_CELLS = """ec as (select ann_id, clip_id, class_name, start_time, end_time, low_freq, high_freq, cast(floor(greatest(0, least(1, start_time / 10)) * 50) as integer) as t0,
      cast(floor(greatest(0, least(1, (low_freq - 10000) / 110000)) * 20) as integer) as f0 from ann where is_target)"""


def _event_cells(i):
    return labels.event_cells(i.ann.where("is_target"), i.clips, 20, 50)


@pair(
    "lbl01_heatmaps",
    f"""with {EVENT_CELLS}, ly as (select clip_id, '__detection__' as layer, f0, t0 from ec where t0 < 50 and f0 < 20
      union select clip_id, class_name, f0, t0 from ec where t0 < 50 and f0 < 20 and class_name is not null),
    gr as (select x.f, y.t from (select unnest(range(0, 20)) as f) x, (select unnest(range(0, 50)) as t) y),
    hv as (select clip_id, layer, cast(f as integer) as f, cast(t as integer) as t, max(exp(-((t - t0)*(t - t0) + (f - f0)*(f - f0)) / cast(0.5 as double))) as value from ly, gr group by all)
    select clip_id, layer, f, t, round(value, 6) as value from hv where round(value, 6) > 0""",
    "ann",
)
def _(i):
    out = labels.heatmaps(_event_cells(i), 20, 50, sigma=0.5)
    return out.withColumn("value", F.round("value", 6)).where("value > 0")


@pair(
    "lbl01_size_maps",
    f"""with {EVENT_CELLS}, r as (select *, row_number() over (partition by clip_id, f0, t0 order by ann_id desc) as r from ec)
    select clip_id, f0 as f, t0 as t, round((end_time - start_time)*1000, 6) as width, round((high_freq - low_freq)/859.375, 6) as height from r where r = 1""",
    "ann",
)
def _(i):
    out = labels.size_maps(_event_cells(i))
    return out.withColumns({n: F.round(n, 6) for n in ("width", "height")})


# --- forest, feature table -------------------------------------------------

@pair(
    "mlm01_random_forest",
    """select vec_id, cast(9 as bigint) as classes, cast(1 as double) as total, true as rest_is_noise, true as in_range from embeddings""",
)
def _(i):
    calls = i.embeddings.select("vec_id", F.col("embedding").alias("features"), (F.col("label") - 1).alias("class_id"))
    model = forest.train_forest(calls, 9, trees=20, depth=6)
    out = forest.score_forest(calls, model, 9)
    probs = F.col("class_probs")
    rest = F.abs(F.col("det_prob") - (F.lit(1.0) - F.element_at(probs, -1))) < 1e-9
    return out.select(
        "vec_id", F.size(probs).cast("bigint").alias("classes"),
        F.round(F.aggregate(probs, F.lit(0.0), lambda a, b: a + b), 6).alias("total"), rest.alias("rest_is_noise"),
        F.forall(probs, lambda p: (p >= 0) & (p <= 1)).alias("in_range"),
    )


@pair(
    "snk05_feature_rows",
    """select vec_id, printf('%.5f', cast(embedding[1] as double)) as "0", printf('%.5f', cast(embedding[2] as double)) as "1", printf('%.5f', cast(embedding[3] as double)) as "2" from embeddings""",
)
def _(i):
    rows = i.embeddings.select(F.col("vec_id").alias("det_id"), F.col("embedding").alias("features"))
    return predictions.feature_rows(rows, 3).select(F.col("det_id").alias("vec_id"), "0", "1", "2")


__all__ = ["scored"]
