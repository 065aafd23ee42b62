"""Targets, box encoding and class-score decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpframe.functions import conditions as c
from chirpframe.functions import scores
from chirpframe.operators import targets

from .base import CLASSES, pair, scored, tagged
from .filter_checks import _targets

DECODING = {"click": [("class", "Click"), ("order", "A")], "purchase": [("class", "Purchase")], "signup": []}


@pair(
    "tgt01_is_target",
    """select ann_id, is_target and ann_id%10 <> 3 as default_target from ann""",
    "ann",
)
def _(i):
    call, generic = targets.CALL_TYPE, targets.GENERIC_CLASS
    tags = F.array(
        c.tag_struct(call, "Echolocation"),
        F.when(F.col("ann_id") % 10 == 3, c.tag_struct(generic, "Unknown")).otherwise(c.tag_struct(generic, "x")),
        F.when(F.col("is_target"), c.tag_struct("other", "x")).otherwise(c.tag_struct(call, "Social")),
    )
    rule = targets.default_detection_target().rule
    return i.ann.withColumn("tags", tags).select("ann_id", rule.column().alias("default_target"))


@pair(
    "tgt02_class_of",
    """select ann_id, case when low_freq >= 50000 and class_name = 'click' then 'high_click'
    when class_name = 'click' then 'click' when class_name = 'purchase' then 'purchase' end as encoded from ann""",
    "ann",
)
def _(i):
    high = c.AllOf([c.Frequency("gte", "low", 50000), c.HasTag("class", "click")])
    t = targets.Targets([
        targets.TargetClass("high_click", match_if=high),
        targets.TargetClass("click", tags=[("class", "click")]),
        targets.TargetClass("purchase", tags=[("class", "purchase")]),
    ])
    return tagged(i.ann).select("ann_id", t.class_of().alias("encoded"))


@pair(
    "tgt03_decode_class",
    """select ann_id, 'class' as key, case class_name when 'click' then 'Click' else 'Purchase' end as value from ann where class_name in ('click','purchase')
    union all select ann_id, 'order', 'A' from ann where class_name = 'click'""",
    "ann",
)
def _(i):
    tag = F.explode(scores.decode_class(F.col("class_name"), DECODING)).alias("t")
    return i.ann.select("ann_id", tag).select("ann_id", "t.key", "t.value")


ENCODED = ("time", "frequency", "width", "height")


@pair(
    "tgt05_encode_anchor",
    """select ann_id, anchor, round(case when anchor like '%-left' then start_time when anchor like '%-right' then end_time else (start_time+end_time)/2 end, 6) as time,
    round(case when anchor like 'bottom-%' then low_freq when anchor like 'top-%' then high_freq else (low_freq+high_freq)/2 end, 6) as frequency,
    round((end_time-start_time)*1000, 6) as width, round((high_freq-low_freq)/859.375, 6) as height
    from ann, (select unnest(['bottom-left','top-right','center','center-left','top-center']) as anchor) x""",
    "ann",
)
def _(i):
    parts = []
    for anchor in ("bottom-left", "top-right", "center", "center-left", "top-center"):
        cols = targets.AnchorBox(anchor).encode()
        parts.append(F.struct(F.lit(anchor).alias("anchor"), *[F.round(cols[n], 6).alias(n) for n in ENCODED]))
    return i.ann.select("ann_id", F.explode(F.array(*parts)).alias("e")).select("ann_id", "e.*")


@pair(
    "tgt06_decode_anchor",
    """with p as (select ann_id, start_time - 0.5 as time, low_freq as frequency, (end_time-start_time)*1000 - 4 as width, (high_freq-low_freq)/859.375 as height from ann),
    s as (select *, greatest(0, width/1000) as span, greatest(0, height*859.375) as band from p)
    select ann_id, round(greatest(0, time - span), 6) as start_time, round(greatest(0, frequency - band/2), 6) as low_freq,
    round(greatest(0, time - span + span), 6) as end_time, round(greatest(0, frequency - band/2 + band), 6) as high_freq from s""",
    "ann",
)
def _(i):
    box = targets.AnchorBox("bottom-left").encode()
    rows = i.ann.select(
        "ann_id", (box["time"] - 0.5).alias("time"), box["frequency"].alias("frequency"),
        (box["width"] - 4).alias("width"), box["height"].alias("height"),
    )
    out = targets.decode_boxes(rows, targets.AnchorBox("center-right"))
    return out.select("ann_id", *[F.round(n, 6).alias(n) for n in ("start_time", "low_freq", "end_time", "high_freq")])


# grid annotations: boxes on the 20 x 50 cell grid, 5 s per clip, 10–120 kHz
GRID_ANN = """with ga as (select det_id as ann_id, clip_id, cast(x_pos as double)*0.1 - 0.03 as start_time,
    cast(x_pos + bb_width as double)*0.1 + 0.03 as end_time,
    10000 + cast(y_pos as double)*5500 - 100 as low_freq, 10000 + cast(y_pos + bb_height as double)*5500 + 100 as high_freq from grid_det),
    axes as (select clip_id, f, t, value, 0 + t*(cast(5 as double)/50) as ct, 10000 + f*(cast(110000 as double)/20) as cf from cells),
    hits as (select ann_id, ct, cf, row_number() over (partition by ann_id order by value desc, t, f) as r from ga join axes using (clip_id)
      where ct between start_time and end_time and cf between greatest(low_freq, 10000) and least(high_freq, 120000)),
    pk as (select ga.*, ct as peak_time, cf as peak_freq from ga left join hits on hits.ann_id = ga.ann_id and r = 1) """


def _grid_events(i):
    d = i.grid_det
    return d.select(
        F.col("det_id").alias("ann_id"), "clip_id",
        (F.col("x_pos").cast("double") * 0.1 - 0.03).alias("start_time"),
        ((F.col("x_pos") + F.col("bb_width")).cast("double") * 0.1 + 0.03).alias("end_time"),
        (F.lit(10000) + F.col("y_pos").cast("double") * 5500 - 100).alias("low_freq"),
        (F.lit(10000) + (F.col("y_pos") + F.col("bb_height")).cast("double") * 5500 + 100).alias("high_freq"),
    )


def _peaks(i):
    grid = i.cells.select("clip_id").distinct().select(
        "clip_id", F.lit(0.0).alias("clip_start"), F.lit(5.0).alias("clip_end"), F.lit(50).alias("n_time"),
        F.lit(10000.0).alias("min_freq"), F.lit(120000.0).alias("max_freq"), F.lit(20).alias("n_freq"),
    )
    return targets.with_peaks(_grid_events(i), i.cells, grid)


@pair(
    "tgt07_encode_peak",
    GRID_ANN + """select ann_id, round(peak_time, 6) as time, round(peak_freq, 6) as frequency,
    round((peak_time - start_time)*1000, 6) as "left", round((peak_freq - low_freq)/859.375, 6) as bottom,
    round((end_time - peak_time)*1000, 6) as "right", round((high_freq - peak_freq)/859.375, 6) as top from pk""",
    "cells grid_det",
)
def _(i):
    cols = targets.PeakBox().encode()
    return _peaks(i).select("ann_id", *[F.round(col, 6).alias(n) for n, col in cols.items()])


@pair(
    "tgt08_decode_peak",
    """select ann_id, round(start_time + 0.1 - greatest(0, 100 - ann_id%300)/1000, 6) as start_time,
    round(low_freq - greatest(0, 5)*859.375, 6) as low_freq,
    round(start_time + 0.1 + greatest(0, ann_id%50)/1000, 6) as end_time, round(low_freq, 6) as high_freq from ann""",
    "ann",
)
def _(i):
    rows = i.ann.select(
        "ann_id", (F.col("start_time") + 0.1).alias("time"), F.col("low_freq").alias("frequency"),
        (F.lit(100.0) - F.col("ann_id") % 300).alias("left"), F.lit(5.0).alias("bottom"),
        (F.col("ann_id") % 50).cast("double").alias("right"), F.lit(-3.0).alias("top"),
    )
    out = targets.decode_boxes(rows, targets.PeakBox())
    return out.select("ann_id", *[F.round(n, 6).alias(n) for n in ("start_time", "low_freq", "end_time", "high_freq")])


@pair(
    "tgt09_class_mapping",
    """select ann_id, round(case when class_name='click' then (start_time+end_time)/2 when class_name='signup' then end_time else start_time end, 6) as time,
    round(case when class_name='click' then (low_freq+high_freq)/2 when class_name='signup' then high_freq else low_freq end, 6) as frequency from ann""",
    "ann",
)
def _(i):
    mapping = targets.BoxMapping(overrides={"click": targets.AnchorBox("center"), "signup": targets.AnchorBox("top-right")})
    rows = targets.encode_boxes(i.ann, mapping)
    return rows.select("ann_id", F.round("time", 6).alias("time"), F.round("frequency", 6).alias("frequency"))


@pair(
    "tgt10_encoded_targets",
    """select ann_id, class_name, round(start_time, 6) as time, round(low_freq, 6) as frequency,
    round((end_time-start_time)*1000, 6) as width, round((high_freq-low_freq)/859.375, 6) as height from ann where is_target""",
    "ann",
)
def _(i):
    rows = targets.encoded_targets(tagged(i.ann), _targets(), targets.BoxMapping())
    return rows.select("ann_id", "class_name", *[F.round(n, 6).alias(n) for n in ENCODED])


# --- class scores ----------------------------------------------------------

LONG = """lng as (select det_id, detection_score, 0 as idx, 'click' as class_name, s_click as score from det
    union all select det_id, detection_score, 1, 'purchase', s_purchase from det
    union all select det_id, detection_score, 2, 'signup', s_signup from det),
    rnk as (select *, row_number() over (partition by det_id order by score desc, idx) as r from lng)"""
DECODED = """dec as (select 'click' as class_name, 'class' as key, 'Click' as value union all select 'click','order','A' union all select 'purchase','class','Purchase')"""


@pair("det06_drop_background", "select det_id, round(s_click, 6) as a, round(s_purchase, 6) as b, cast(2 as integer) as n from det", "det")
def _(i):
    cut = scores.first_scores(F.col("class_scores"), 2)
    return scored(i.det).select(
        "det_id", F.round(F.get(cut, F.lit(0)), 6).alias("a"), F.round(F.get(cut, F.lit(1)), 6).alias("b"), F.size(cut).alias("n")
    )


@pair(
    "det07_best_class",
    f"""with {LONG} select d.det_id, round(start_time, 4) as start_time, cast(low_freq as integer) as low_freq,
    r.class_name as class, round(r.score, 3) as class_prob, round(d.detection_score, 3) as det_prob
    from det d join rnk r on r.det_id = d.det_id and r.r = 1""",
    "det",
)
def _(i):
    from chirpframe.operators.detections import best_class_rows

    return best_class_rows(scored(i.det), CLASSES).select("det_id", "start_time", "low_freq", "class", "class_prob", "det_prob")


@pair(
    "det08_class_scores",
    f"""with {LONG} select det_id, true as whole, cast(r - 1 as integer) as position, class_name, round(score, 6) as score from rnk
    union all select det_id, false, cast(r - 2 as integer), class_name, round(score, 6) from rnk where r > 1""",
    "det",
)
def _(i):
    from chirpframe.operators.detections import class_score_rows

    whole = class_score_rows(scored(i.det), CLASSES).withColumn("whole", F.lit(True))
    rest = class_score_rows(scored(i.det), CLASSES, include_top_class=False).withColumn("whole", F.lit(False))
    return whole.unionByName(rest).withColumn("score", F.round("score", 6))


def _tag_rows(frame):
    return frame.select("det_id", F.posexplode("tags").alias("position", "t")).select(
        "det_id", "t.key", "t.value", F.round("t.score", 6).alias("score")
    )


@pair(
    "det09_class_tags",
    f"""with {LONG}, {DECODED} select det_id, key, value, round(score, 6) as score from rnk join dec using (class_name) where score >= 0.4""",
    "det",
)
def _(i):
    tags = scores.class_tags(F.col("class_scores"), CLASSES, DECODING, threshold=0.4)
    return _tag_rows(scored(i.det).withColumn("tags", tags))


@pair(
    "det10_named_features",
    """select det_id, 'f0' as name, round(s_click, 6) as value from det union all select det_id, 'f1', round(s_purchase, 6) from det
    union all select det_id, 'f2', round(s_signup, 6) from det""",
    "det",
)
def _(i):
    rows = scored(i.det).select("det_id", F.explode(scores.named_features(F.col("class_scores"))).alias("x"))
    return rows.select("det_id", "x.name", F.round("x.value", 6).alias("value"))


@pair(
    "snk06_prediction_tags",
    f"""with {LONG}, {DECODED} select det_id, 'event' as key, 'Echolocation' as value, round(detection_score, 6) as score from det
    union all select det_id, key, value, round(score, 6) from rnk join dec using (class_name) where r <= 2 and score >= 0.3""",
    "det",
)
def _(i):
    from chirpframe.sources.predictions import prediction_tags

    return _tag_rows(prediction_tags(scored(i.det), CLASSES, DECODING, [("event", "Echolocation")], top_k=2, min_score=0.3))


@pair(
    "snk07_wide_rows",
    f"""with {LONG} select d.det_id, r.class_name as top_class, round(r.score, 6) as top_class_score,
    round(case when r.class_name='click' then r.score else 0 end, 6) as click, round(case when r.class_name='purchase' then r.score else 0 end, 6) as purchase,
    round(case when r.class_name='signup' then r.score else 0 end, 6) as signup from det d join rnk r on r.det_id = d.det_id and r.r = 1""",
    "det",
)
def _(i):
    from chirpframe.sources.predictions import read_wide, wide_rows

    rows = read_wide(wide_rows(scored(i.det), CLASSES, include_class_scores=False), CLASSES)
    return rows.select(
        "det_id", "top_class", F.round("top_class_score", 6).alias("top_class_score"),
        *[F.round(F.get("class_scores", F.lit(k)), 6).alias(n) for k, n in enumerate(CLASSES)],
    )


@pair(
    "snk08_relative_path",
    """select recording_id, path as path from recordings""",
    "recordings",
)
def _(i):
    from chirpframe.sources.predictions import relative_path

    full = F.when(F.col("recording_id") % 2 == 0, F.concat(F.lit("/data/audio/"), "path")).otherwise(F.col("path"))
    return i.recordings.select("recording_id", relative_path(full, "/data/audio").alias("path"))


BEST = """best as (select recording_id, class_name as recording_class from (select clip_id as recording_id, class_name,
    row_number() over (partition by clip_id order by sum(score * l.detection_score) desc, class_name) as r
    from lng l join det d using (det_id) group by clip_id, class_name) where r = 1)"""


@pair(
    "snk03_result_documents",
    f"""with {LONG}, {BEST}, doc as (select d.clip_id as recording_id, d.start_time, d.end_time, cast(d.low_freq as integer) as low_freq, cast(d.high_freq as integer) as high_freq,
      round(r.score, 3) as class_prob, round(d.detection_score, 3) as det_prob, r.class_name as cls,
      row_number() over (partition by d.clip_id order by d.detection_score desc, d.start_time desc, d.low_freq desc, d.end_time desc, d.high_freq desc) - 1 as pos
      from det d join rnk r on r.det_id = d.det_id and r.r = 1)
    select recordings.recording_id, 'rec' || cast(recordings.recording_id as varchar(20)) || '.wav' as id, recording_class as class_name, round(duration, 4) as duration,
    cast(pos as integer) as pos, round(start_time, 4) as start_time, round(end_time, 4) as end_time, low_freq, high_freq, class_prob, det_prob, cls as class
    from recordings join doc using (recording_id) join best using (recording_id)""",
    "det recordings",
)
def _(i):
    from chirpframe.sources.predictions import result_documents

    dets = scored(i.det).withColumnRenamed("clip_id", "recording_id")
    docs = result_documents(dets, i.recordings, CLASSES)
    event = "struct<start_time:double,end_time:double,low_freq:int,high_freq:int,class_prob:double,det_prob:double,class:string>"
    parsed = docs.select(
        "recording_id", F.from_json("document", f"struct<id:string,class_name:string,duration:double,annotation:array<{event}>>").alias("d")
    )
    return parsed.select(
        "recording_id", "d.id", "d.class_name", "d.duration", F.posexplode("d.annotation").alias("pos", "e")
    ).select("recording_id", "id", "class_name", "duration", "pos", "e.*")
