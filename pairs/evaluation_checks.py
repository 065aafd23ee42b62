"""Affinities, matching, curves and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpframe.functions import geometry as g
from chirpframe.functions import scores
from chirpframe.operators import curves, filters, legacy, matching, reports

from chirpframe.plans.session import cut_lineage

from .base import CLASSES, pair, scored
from .dataset_checks import duck_draw

AFFINITY = g.TimeAffinity(max_distance=0.05)


# --- inputs ----------------------------------------------------------------

def targets_in_bounds(i):
    return filters.in_bounds(i.ann.where("is_target"), i.clips)


def detections_in_bounds(i):
    return filters.in_bounds(scored(i.det), i.clips)


BASE = """a as (select * from ann where is_target and start_time between 0.01 and 9.99),
    d as (select * from det where start_time between 0.01 and 9.99)"""
DETECTED = "dx as (select *, detection_score as score from d), ax as (select * from a)"
TOP = """dx as (select *, greatest(s_click, s_purchase, s_signup) as score,
      case when s_click >= s_purchase and s_click >= s_signup then 'click' when s_purchase >= s_signup then 'purchase' else 'signup' end as pred_class from d),
    ax as (select * from a)"""
PER_CLASS = """dx as (select *, 'click' as task_class, s_click as score from d union all select *, 'purchase', s_purchase from d union all select *, 'signup', s_signup from d),
    ax as (select a.*, t.task_class from a, (select unnest(['click','purchase','signup']) as task_class) t where a.class_name = t.task_class or a.class_name is null)"""


def match_ctes(inputs: str, keys: str = "clip_id", order: str = "abs(dx.start_time - ax.start_time), ax.ann_id",
               test: str = "1 - abs(dx.start_time - ax.start_time)/cast(0.05 as double) > 0", extra: str = "") -> str:
    k = keys.split(",")
    first = ", ".join(f"dx.{c}" for c in k)
    det_extra = ", dx.pred_class" if "pred_class" in extra else ""
    miss_extra = ", null" if "pred_class" in extra else ""
    return f"""{BASE}, {inputs},
    pr as (select {first}, dx.det_id, ax.ann_id, dx.score, row_number() over (partition by {first}, dx.det_id order by {order}) as r
      from dx join ax using ({keys}) where {test}),
    wn as (select *, row_number() over (partition by {keys}, ann_id order by score desc, det_id) as w from pr where r = 1),
    mt as (select {keys}, det_id, ann_id from wn where w = 1),
    mr as (select {first}, dx.det_id, mt.ann_id, dx.score{det_extra}, ax.class_name as true_class from dx left join mt using ({keys}, det_id)
        left join ax on {' and '.join(f'ax.{c} = dx.{c}' for c in k)} and ax.ann_id = mt.ann_id
      union all select {', '.join(f'ax.{c}' for c in k)}, null, ax.ann_id, 0{miss_extra}, ax.class_name from ax left join mt using ({keys}, ann_id) where mt.det_id is null)"""


DET_MATCH = match_ctes(DETECTED)
TOP_MATCH = match_ctes(TOP, extra="pred_class")
CLASS_MATCH = match_ctes(PER_CLASS, "task_class,clip_id")
DET_OBS = """obs as (select 'all' as k, coalesce(det_id, ann_id) as row_id, score, ann_id is not null as is_true from mr where det_id is not null),
    pos as (select 'all' as k, count(ann_id) as n_pos from mr)"""
TOP_OBS = """obs as (select 'all' as k, det_id as row_id, score, pred_class is not distinct from true_class as is_true from mr
      where det_id is not null and not (ann_id is not null and true_class is null)),
    pos as (select 'all' as k, count(ann_id) as n_pos from mr where not (ann_id is not null and true_class is null))"""
CLASS_OBS = """obs as (select task_class as k, det_id as row_id, score, coalesce(true_class = task_class, false) as is_true from mr
      where det_id is not null and not (ann_id is not null and true_class is null)),
    pos as (select task_class as k, count(*) as n_pos from mr where true_class = task_class group by 1)"""
CURVE = """cu as (select obs.*, row_number() over w as rank, sum(cast(is_true as bigint)) over w as tp from obs window w as (partition by k order by score desc, row_id)),
    pr2 as (select cu.*, tp / cast(rank as double) as prec, tp / cast(n_pos as double) as rec from cu join pos using (k)),
    env as (select *, max(prec) over (partition by k order by rank desc rows unbounded preceding) as e from pr2),
    ap as (select pos.k, coalesce(sum(e) filter (where is_true), 0) / max(n_pos) as ap from pos left join env using (k) group by 1)"""
AUC = """sc as (select k, score, sum(cast(is_true as bigint)) as p, sum(cast(not is_true as bigint)) as n from obs group by all),
    sb as (select *, sum(n) over (partition by k order by score rows unbounded preceding) - n as below from sc),
    au as (select k, sum(p * (below + n / 2)) / (cast(sum(p) as double) * sum(n)) as auc from sb group by 1)"""


# --- affinities ------------------------------------------------------------

AFF = """p as (select det_id, d.start_time as ds, d.end_time as de, d.low_freq as dl, d.high_freq as dh,
    a.start_time as gs, a.end_time as ge, a.low_freq as gl, a.high_freq as gh from det d join ann a on a.ann_id = d.det_id)"""


def _pairs(i):
    right = i.ann.select(F.col("ann_id").alias("det_id"), *[F.col(n).alias(f"g_{n}") for n in ("start_time", "end_time", "low_freq", "high_freq")])
    return i.det.join(right, "det_id")


def gt_row(name):
    return F.col(f"g_{name}")


@pair(
    "aff01_time_affinity",
    f"""with {AFF} select det_id, round(greatest(0, 1 - abs(ds - gs)/0.05), 6) as at_start, round(greatest(0, 1 - abs(de - ge)/0.05), 6) as at_end,
    round(greatest(0, 1 - abs(ds + 0.5*(de-ds) - (gs + 0.5*(ge-gs)))/0.05), 6) as at_centre,
    round(greatest(0, 1 - abs(ds + 0.25*(de-ds) - (gs + 0.25*(ge-gs)))/0.05), 6) as at_quarter from p""",
    "ann det",
)
def _(i):
    kinds = {"at_start": "start", "at_end": "end", "at_centre": "center", "at_quarter": 0.25}
    return _pairs(i).select("det_id", *[F.round(g.TimeAffinity(0.05, at).column(F.col, gt_row), 6).alias(n) for n, at in kinds.items()])


@pair(
    "aff02_interval_iou",
    f"""with {AFF}, o as (select *, greatest(least(de, ge) - greatest(ds, gs), 0) as i, greatest(ds - 0.01, 0) as bs, greatest(gs - 0.01, 0) as hs from p),
    o2 as (select *, greatest(least(de, ge) + 0.01 - greatest(bs, hs), 0) as j from o)
    select det_id, round(i / ((de-ds) + (ge-gs) - i), 6) as plain, round(j / ((de + 0.01 - bs) + (ge + 0.01 - hs) - j), 6) as buffered from o2""",
    "ann det",
)
def _(i):
    return _pairs(i).select(
        "det_id", F.round(g.IntervalIOU().column(F.col, gt_row), 6).alias("plain"),
        F.round(g.IntervalIOU(0.01).column(F.col, gt_row), 6).alias("buffered"),
    )


BOX_AREA = """greatest(least(de, ge) - greatest(ds, gs), 0) * greatest(least(dh, gh) - greatest(dl, gl), 0)"""


@pair(
    "aff03_box_iou",
    f"""with {AFF}, o as (select *, {BOX_AREA} as i,
      greatest(least(de, ge) + 0.01 - greatest(greatest(ds - 0.01, 0), greatest(gs - 0.01, 0)), 0) * greatest(least(dh, gh) + 2000 - greatest(dl - 2000, gl - 2000), 0) as j from p)
    select det_id, round(i / ((de-ds)*(dh-dl) + (ge-gs)*(gh-gl) - i), 6) as plain,
    round(j / ((de + 0.01 - greatest(ds - 0.01, 0))*(dh - dl + 4000) + (ge + 0.01 - greatest(gs - 0.01, 0))*(gh - gl + 4000) - j), 6) as buffered from o""",
    "ann det",
)
def _(i):
    return _pairs(i).select(
        "det_id", F.round(g.BBoxIOU().column(F.col, gt_row), 6).alias("plain"),
        F.round(g.BBoxIOU(0.01, 2000.0).column(F.col, gt_row), 6).alias("buffered"),
    )


@pair(
    "aff04_geometric_iou",
    f"""with {AFF}, o as (select *, {BOX_AREA} as i, greatest(least(de, ge) - greatest(ds, gs), 0) as t from p)
    select det_id, round(case when det_id%5 = 1 then t / ((de-ds) + (ge-gs) - t) else i / ((de-ds)*(dh-dl) + (ge-gs)*(gh-gl) - i) end, 6) as iou from o""",
    "ann det",
)
def _(i):
    number = F.col("det_id") % 5
    corners = lambda p: [[p("start_time"), p("low_freq")], [p("end_time"), p("low_freq")], [p("end_time"), p("high_freq")], [p("start_time"), p("high_freq")]]
    ring = lambda p: F.array(F.array(*[F.array(*xy) for xy in corners(p)]))
    box = lambda p: F.array(p("start_time"), p("low_freq"), p("end_time"), p("high_freq"))

    def shape(kind, coordinates):
        return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))

    kind = F.when(number == 1, "TimeInterval").when(number == 2, "Polygon").otherwise("BoundingBox")
    rows = _pairs(i).withColumns(
        {
            "geom_type": kind, "g_geom_type": F.lit("BoundingBox"),
            "geometry": F.when(number == 2, shape("Polygon", ring(F.col))).otherwise(shape("BoundingBox", box(F.col))),
            "g_geometry": shape("BoundingBox", box(gt_row)),
        }
    )
    return rows.select("det_id", F.round(g.GeometricIOU(shapes=True).column(F.col, gt_row), 6).alias("iou"))


@pair(
    "aff05_nearest_start",
    """with near as (select d.det_id, a.ann_id, abs(d.start_time - a.start_time) as gap, row_number() over (partition by d.det_id order by abs(d.start_time - a.start_time), a.ann_id) as r
      from det d join ann a using (clip_id))
    select clip_id, start_time, min(ann_id) as ann_id, round(min(gap), 6) as gap from near join det using (det_id) where r = 1 and gap <= 0.1 group by clip_id, start_time""",
    "ann det",
)
def _(i):
    near = matching.nearest_pairs(i.det.withColumn("score", F.col("detection_score")), i.ann, reach=0.1)
    rows = near.where("distance <= 0.1").join(i.det.select("det_id", "start_time"), "det_id")
    return rows.select("clip_id", "start_time", "ann_id", F.round("distance", 6).alias("gap"))


@pair(
    "aff06_scaled_box_iou",
    f"""with {AFF}, o as (select *, {BOX_AREA} as i from p)
    select det_id, round(case when i = 0 then 0 else i / ((de-ds)*(dh-dl) + (ge-gs)*(gh-gl) - i) end, 6) as iou from o""",
    "ann det",
)
def _(i):
    return _pairs(i).select("det_id", F.round(g.scaled_box_iou(F.col, gt_row), 6).alias("iou"))


# --- matching --------------------------------------------------------------

@pair(
    "mat01_detection_matches",
    f"""with {DET_MATCH} select clip_id, det_id, ann_id, round(score, 6) as score from mr""",
    "ann det",
)
def _(i):
    rows = matching.detection_matches(detections_in_bounds(i), targets_in_bounds(i), AFFINITY)
    return rows.select("clip_id", "det_id", "ann_id", F.round("score", 6).alias("score"))


IOU = """(greatest(least(dx.end_time, ax.end_time) - greatest(dx.start_time, ax.start_time), 0)
    * greatest(least(dx.high_freq, ax.high_freq) - greatest(dx.low_freq, ax.low_freq), 0))"""
IOU_SHARE = f"{IOU} / ((dx.end_time-dx.start_time)*(dx.high_freq-dx.low_freq) + (ax.end_time-ax.start_time)*(ax.high_freq-ax.low_freq) - {IOU})"


@pair(
    "mat01_box_matches",
    f"""with {match_ctes(DETECTED, order=f'{IOU_SHARE} desc, ax.ann_id', test=f'{IOU_SHARE} > 0.1')} select clip_id, det_id, ann_id, round(score, 6) as score from mr""",
    "ann det",
)
def _(i):
    rows = matching.detection_matches(detections_in_bounds(i), targets_in_bounds(i), g.BBoxIOU(), threshold=0.1)
    return rows.select("clip_id", "det_id", "ann_id", F.round("score", 6).alias("score"))


def serial_ctes(chooser: str, chosen: str, rank: str, candidates: str) -> str:
    """Sequential choice inside each clip, one chooser per step, over table ``cand``."""
    return f"""ch as (select clip_id, {chooser} as who, row_number() over (partition by clip_id order by {rank}) as n,
        list({chosen} order by {candidates}) as wish from cand group by clip_id, {rank.replace(' desc', '')}{'' if chooser in rank else ', ' + chooser}),
    st as (select distinct clip_id, cast(0 as bigint) as n, cast([] as bigint[]) as taken, cast(null as bigint) as who, cast(null as bigint) as pick from ch
      union all select clip_id, n, case when pick is null then taken else list_append(taken, pick) end, who, pick from (
        select ch.clip_id, ch.n, st.taken, ch.who, list_filter(ch.wish, lambda x: not list_contains(st.taken, x))[1] as pick
        from st join ch on ch.clip_id = st.clip_id and ch.n = st.n + 1) q),
    won as (select clip_id, who, pick from st where pick is not null)"""


@pair(
    "mat02_free_choice",
    f"""with recursive {BASE}, {DETECTED}, cand as (select dx.clip_id, dx.det_id, dx.score, ax.ann_id, abs(dx.start_time - ax.start_time) as gap
      from dx join ax using (clip_id) where 1 - abs(dx.start_time - ax.start_time)/cast(0.05 as double) > 0),
    {serial_ctes('det_id', 'ann_id', 'score desc, det_id', 'gap, ann_id')}
    select dx.clip_id, det_id, pick as ann_id, round(score, 6) as score from dx left join won on who = det_id
    union all select ax.clip_id, null, ann_id, 0 from ax left join won on pick = ann_id where who is null""",
    "ann det",
)
def _(i):
    rows = matching.detection_matches(detections_in_bounds(i), targets_in_bounds(i), AFFINITY, strict=False)
    return rows.select("clip_id", "det_id", "ann_id", F.round("score", 6).alias("score"))


@pair(
    "mat03_per_class_matches",
    f"""with {CLASS_MATCH} select task_class, clip_id, det_id, ann_id, true_class, round(score, 6) as score, ann_id is not null and true_class is null as is_generic from mr""",
    "ann det",
)
def _(i):
    rows = matching.per_class_matches(detections_in_bounds(i), targets_in_bounds(i), CLASSES, AFFINITY)
    return rows.select("task_class", "clip_id", "det_id", "ann_id", "true_class", F.round("score", 6).alias("score"), "is_generic")


def _top(i, keep: bool = True):
    """Match table of the top-class task; several metrics read it, so it is written once."""
    rows = matching.top_class_matches(detections_in_bounds(i), targets_in_bounds(i), CLASSES, AFFINITY)
    return cut_lineage(rows) if keep else rows


@pair(
    "mat04_top_class_matches",
    f"""with {TOP_MATCH} select clip_id, det_id, ann_id, pred_class, true_class, round(score, 6) as score from mr""",
    "ann det",
)
def _(i):
    return _top(i, keep=False).select("clip_id", "det_id", "ann_id", "pred_class", "true_class", F.round("score", 6).alias("score"))


@pair(
    "mat05_assign_classes",
    f"""with recursive dx as (select * from det), ax as (select * from ann), cand as (select dx.clip_id, dx.det_id, ax.ann_id, {IOU_SHARE} as iou
      from dx join ax using (clip_id) where {IOU_SHARE} > 0.01),
    {serial_ctes('ann_id', 'det_id', 'ann_id', 'iou desc, det_id')}
    select det.clip_id, det_id, case when who is null then 'Not Bat' else coalesce(class_name, 'Not Bat') end as class_name
    from det left join won on pick = det_id left join ann on ann_id = who""",
    "ann det",
)
def _(i):
    dets = i.det.withColumn("class_name", F.lit("Not Bat"))
    return matching.assign_truth_classes(i.ann, dets, 0.01).select("clip_id", "det_id", "class_name")


@pair(
    "mat06_outcomes",
    f"""with {TOP_MATCH}, o as (select *, case when score < 0.6 and true_class is not null then 'false_negative' when score < 0.6 then null
      when true_class is null then 'false_positive' when true_class = pred_class then 'true_positive' else 'cross_trigger' end as outcome from mr)
    select outcome, case when outcome in ('false_negative','true_positive') then true_class else pred_class end as group_class, count(*) as n
    from o where outcome is not null group by all""",
    "ann det",
)
def _(i):
    return matching.grouped_outcomes(_top(i, keep=False), 0.6).groupBy("outcome", "group_class").agg(F.count(F.lit(1)).alias("n"))


@pair(
    "mat07_binned_sample",
    f"""with {TOP_MATCH}, rows as (select pred_class, det_id, score from mr where det_id is not null),
    e as (select pred_class, quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1]) as q from rows group by 1),
    b as (select r.*, greatest(len(list_filter(list_distinct(q), lambda x: x < score)), 1) as bin from rows r join e using (pred_class)),
    c as (select *, row_number() over (partition by pred_class, bin order by {duck_draw('sample', 'det_id')}, det_id) as r from b)
    select pred_class, cast(bin as integer) as bin, det_id from c where r = 1""",
    "ann det",
)
def _(i):
    rows = _top(i).where("is_prediction").select("pred_class", F.col("det_id").alias("row_id"), "score")
    return curves.binned_sample(rows, ["pred_class"], 5).select("pred_class", "bin", F.col("row_id").alias("det_id"))


# --- curves ----------------------------------------------------------------

def _detection(i):
    return cut_lineage(matching.detection_matches(detections_in_bounds(i), targets_in_bounds(i), AFFINITY))


def _classification(i):
    return cut_lineage(matching.per_class_matches(detections_in_bounds(i), targets_in_bounds(i), CLASSES, AFFINITY))


@pair(
    "met01_pr_curve",
    f"""with {DET_MATCH}, {DET_OBS}, {CURVE} select row_id, cast(rank as bigint) as rank, cast(tp as bigint) as tp, round(prec, 6) as precision, round(rec, 6) as recall from pr2""",
    "ann det",
)
def _(i):
    obs, positives = reports.detection_observations(_detection(i))
    out = curves.pr_curve(obs, (), positives)
    return out.select("row_id", "rank", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@pair(
    "met02_average_precision",
    f"""with {DET_MATCH}, {DET_OBS}, {CURVE} select round(ap, 6) as average_precision from ap""",
    "ann det",
)
def _(i):
    obs, positives = reports.detection_observations(_detection(i))
    return curves.average_precision(obs, (), positives).select(F.round("average_precision", 6).alias("average_precision"))


def at_threshold(right: str, cut: str = "0.5", truth: str = "ann_id is not null") -> str:
    return f"""select 'recall' as metric, count(*) filter (where score >= {cut} and {right}) / cast(count(*) filter (where {truth}) as double) as value from mr
    union all select 'precision', count(*) filter (where score >= {cut} and {right}) / cast(count(*) filter (where score >= {cut}) as double) from mr"""


NO_CLASS = "cast(null as varchar) as class_name"


@pair(
    "met03_detection_metrics",
    f"""with {DET_MATCH}, {DET_OBS}, {CURVE}, {AUC}, th as ({at_threshold('ann_id is not null')})
    select 'average_precision' as metric, {NO_CLASS}, round(ap, 6) as value from ap union all select 'roc_auc', null, round(auc, 6) from au
    union all select metric, null, round(value, 6) from th""",
    "ann det",
)
def _(i):
    return _rounded(reports.detection_metrics(_detection(i)))


def _rounded(frame):
    return frame.withColumn("value", F.round("value", 6))


@pair(
    "met04_classification_metrics",
    f"""with {CLASS_MATCH}, {CLASS_OBS}, {CURVE}, {AUC}
    select 'average_precision' as metric, k as class_name, round(ap, 6) as value from ap where k <> 'click' union all select 'mean_average_precision', null, round(avg(ap), 6) from ap
    union all select 'roc_auc', k, round(auc, 6) from au where k <> 'click' union all select 'mean_roc_auc', null, round(avg(auc), 6) from au""",
    "ann det",
)
def _(i):
    return _rounded(reports.classification_metrics(_classification(i), CLASSES, exclude=["click"]))


@pair(
    "met05_top_class_metrics",
    f"""with {TOP_MATCH}, {TOP_OBS}, {CURVE}, {AUC}, th as ({at_threshold('pred_class is not distinct from true_class')})
    select 'average_precision' as metric, {NO_CLASS}, round(ap, 6) as value from ap union all select 'roc_auc', null, round(auc, 6) from au
    union all select metric, null, round(value, 6) from th""",
    "ann det",
)
def _(i):
    return _rounded(reports.top_class_metrics(_top(i)))


@pair(
    "met06_balanced_accuracy",
    f"""with {TOP_MATCH}, l as (select coalesce(true_class, 'noise') as t, coalesce(pred_class, 'noise') as p from mr where not (ann_id is not null and true_class is null)),
    r as (select t, avg(cast(t = p as integer)) as rec from l group by 1) select round(avg(rec), 6) as balanced_accuracy from r""",
    "ann det",
)
def _(i):
    return reports.balanced_accuracy(_top(i, keep=False)).select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@pair(
    "met07_confusion_matrix",
    f"""with {TOP_MATCH}, r1 as (select true_class as t, pred_class as p from mr where det_id is not null and ann_id is not null and score >= 0.6 and true_class is not null),
    lab as (select unnest(['click','purchase','signup']) as l), n1 as (select a.l as t, b.l as p, (select count(*) from r1 where r1.t = a.l and r1.p = b.l) as n from lab a, lab b),
    r2 as (select case when ann_id is not null and true_class is null then 'bat' else coalesce(true_class, 'noise') end as t, case when score < 0.6 then 'noise' else coalesce(pred_class, 'noise') end as p from mr),
    lab2 as (select unnest(['click','purchase','signup','bat','noise']) as l), n2 as (select a.l as t, b.l as p, (select count(*) from r2 where r2.t = a.l and r2.p = b.l) as n from lab2 a, lab2 b)
    select 'strict' as kind, t as true_label, p as pred_label, round(n / cast(sum(n) over (partition by t) as double), 6) as value from n1
    union all select 'all', t, p, round(n / cast(sum(n) over () as double), 6) from n2""",
    "ann det",
)
def _(i):
    top = _top(i)
    strict = reports.confusion_matrix(top, CLASSES, 0.6)
    whole = reports.confusion_matrix(
        top, CLASSES, 0.6, "all", exclude_generic=False, exclude_false_positives=False, exclude_false_negatives=False
    )
    return _rounded(strict.withColumn("kind", F.lit("strict")).unionByName(whole.withColumn("kind", F.lit("all"))))


@pair(
    "met08_roc_auc",
    f"""with {TOP_MATCH}, {TOP_OBS}, {AUC} select round(auc, 6) as roc_auc from au""",
    "ann det",
)
def _(i):
    obs, _ = reports.top_class_observations(_top(i))
    return curves.roc_auc(obs).select(F.round("roc_auc", 6).alias("roc_auc"))


@pair(
    "met08_roc_curve",
    f"""with {DET_MATCH}, {DET_OBS}, {AUC}, t as (select sum(p) as np, sum(n) as nn from sc)
    select round(score, 6) as threshold, round(sum(n) over w / cast(nn as double), 6) as fpr, round(sum(p) over w / cast(np as double), 6) as tpr from sc, t window w as (order by score desc)
    union all select cast('inf' as double), 0, 0""",
    "ann det",
)
def _(i):
    obs, _ = reports.detection_observations(_detection(i))
    return curves.roc_curve(obs).select(*[F.round(n, 6).alias(n) for n in ("threshold", "fpr", "tpr")])


# clips of one second: clip_id * 10 + second, so that some have no event of a class
PART = "clip_id*10 + cast(floor(start_time) as bigint) as part"
CLIP_SCORE = f"""dp as (select *, {PART} from d), apt as (select *, {PART} from a),
    cp as (select clip_id*10 + s as part from clips, (select unnest(range(10)) as s) r),
    cs as (select cp.part as row_id, coalesce(max(q.detection_score), 0) as score, cp.part in (select part from apt where class_name = 'purchase') as is_true
      from cp left join (select * from dp where detection_score < 0.9 - (part%5)*0.01) q on q.part = cp.part group by cp.part)"""


def by_second(frame):
    return frame.withColumn("clip_id", F.col("clip_id") * 10 + F.floor("start_time"))


def _clip_scored(i):
    """Which seconds hold a purchase; the score is the best detection below a bar."""
    bar = F.lit(0.9) - (F.col("clip_id") % 5) * F.lit(0.01)
    seconds = i.clips.select(F.explode(F.sequence(F.col("clip_id") * 10, F.col("clip_id") * 10 + 9)).alias("clip_id"))
    truth = by_second(targets_in_bounds(i)).where("class_name = 'purchase'")
    return reports.clip_detection_scores(seconds, truth, by_second(detections_in_bounds(i)).where(F.col("detection_score") < bar))


@pair(
    "agg05_clip_scores",
    f"with {BASE}, {CLIP_SCORE} select row_id as clip_id, round(score, 6) as score, is_true from cs",
    "ann det clips",
)
def _(i):
    return _clip_scored(i).withColumn("score", F.round("score", 6))


CLIP_CLASS = f"""dp as (select *, {PART} from d), apt as (select *, {PART} from a),
    cc as (select part as clip_id, 'click' as class_name, max(s_click) as score from dp group by 1 union all select part, 'purchase', max(s_purchase) from dp group by 1
      union all select part, 'signup', max(s_signup) from dp group by 1),
    ct as (select distinct part as clip_id, class_name from apt where class_name is not null),
    cb as (select cc.*, ct.clip_id is not null as is_true from cc left join ct on ct.clip_id = cc.clip_id and ct.class_name = cc.class_name)"""


def _clip_classes(i):
    return reports.clip_class_scores(by_second(targets_in_bounds(i)), by_second(detections_in_bounds(i)), CLASSES)


@pair(
    "agg06_clip_classes",
    f"with {BASE}, {CLIP_CLASS} select clip_id, class_name, round(score, 6) as score, is_true from cb",
    "ann det",
)
def _(i):
    return _clip_classes(i).withColumn("score", F.round("score", 6))


@pair(
    "met09_clip_detection_metrics",
    f"""with {BASE}, {CLIP_SCORE}, obs as (select 'all' as k, * from cs), pos as (select 'all' as k, count(*) filter (where is_true) as n_pos from cs), {CURVE}, {AUC},
    mr as (select * from cs), th as ({at_threshold('is_true', '0.87', 'is_true')})
    select 'average_precision' as metric, {NO_CLASS}, round(ap, 6) as value from ap union all select 'roc_auc', null, round(auc, 6) from au
    union all select metric, null, round(value, 6) from th""",
    "ann det clips",
)
def _(i):
    return _rounded(reports.clip_detection_metrics(_clip_scored(i), 0.87))


@pair(
    "met10_clip_classification_metrics",
    f"""with {BASE}, {CLIP_CLASS}, obs as (select class_name as k, clip_id as row_id, score, is_true from cb), pos as (select class_name as k, count(*) filter (where is_true) as n_pos from cb group by 1), {CURVE}, {AUC}
    select 'average_precision' as metric, k as class_name, round(ap, 6) as value from ap union all select 'mean_average_precision', null, round(avg(ap), 6) from ap
    union all select 'roc_auc', k, round(auc, 6) from au union all select 'mean_roc_auc', null, round(avg(auc), 6) from au""",
    "ann det",
)
def _(i):
    return _rounded(reports.clip_classification_metrics(_clip_classes(i)))


@pair(
    "met11_threshold_curves",
    f"""with {CLASS_MATCH}, {CLASS_OBS}, {CURVE} select k as task_class, row_id, round(score, 6) as threshold, round(prec, 6) as precision, round(rec, 6) as recall from pr2""",
    "ann det",
)
def _(i):
    obs, positives = reports.classification_observations(_classification(i), CLASSES)
    out = curves.pr_curve(obs, ["task_class"], positives)
    return out.select(
        "task_class", "row_id", F.round("score", 6).alias("threshold"), F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"),
    )


@pair(
    "met12_score_distribution",
    f"""with {DET_MATCH}, {DET_OBS}, b as (select is_true, cast(least(floor(score / cast(0.025 as double)), 39) as integer) as bin, count(*) as n from obs group by all)
    select is_true, bin, n, round(n / cast(sum(n) over (partition by is_true) as double), 6) as probability from b""",
    "ann det",
)
def _(i):
    obs, _ = reports.detection_observations(_detection(i))
    return curves.score_distribution(obs).withColumn("probability", F.round("probability", 6))


@pair(
    "met13_top_class_curve",
    f"""with {TOP_MATCH}, {TOP_OBS}, {CURVE} select row_id, cast(rank as bigint) as rank, round(prec, 6) as precision, round(rec, 6) as recall from pr2""",
    "ann det",
)
def _(i):
    obs, positives = reports.top_class_observations(_top(i))
    out = curves.pr_curve(obs, (), positives)
    return out.select("row_id", "rank", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@pair(
    "met13_clip_detection_curve",
    f"""with {BASE}, {CLIP_SCORE}, obs as (select 'all' as k, * from cs), pos as (select 'all' as k, count(*) filter (where is_true) as n_pos from cs), {CURVE}
    select row_id as clip_id, cast(rank as bigint) as rank, round(prec, 6) as precision, round(rec, 6) as recall from pr2""",
    "ann det clips",
)
def _(i):
    obs = _clip_scored(i).withColumnRenamed("clip_id", "row_id")
    out = curves.pr_curve(obs)
    return out.select(F.col("row_id").alias("clip_id"), "rank", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@pair(
    "met13_clip_class_curve",
    f"""with {BASE}, {CLIP_CLASS}, obs as (select q.k, c_custkey as row_id, coalesce(cb.score, 0) as score, c_custkey in (select clip_id from ct where class_name = q.k) as is_true
      from customer cross join (select unnest(['click','purchase','signup']) as k) q left join cb on cb.clip_id = c_custkey and cb.class_name = q.k),
    pos as (select k, count(*) filter (where is_true) as n_pos from obs group by 1), {CURVE}
    select k as task_class, row_id as clip_id, cast(rank as bigint) as rank, round(prec, 6) as precision, round(rec, 6) as recall from pr2""",
    "ann det",
)
def _(i):
    clips = i.customer.select(F.col("c_custkey").alias("clip_id"))
    obs = reports.clip_class_observations(clips, _clip_classes(i), by_second(targets_in_bounds(i)), CLASSES)
    out = curves.pr_curve(obs, ["task_class"])
    return out.select(
        "task_class", F.col("row_id").alias("clip_id"), "rank", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")
    )


@pair(
    "mat07_random_clips",
    f"select c_custkey as clip_id from customer order by {duck_draw('examples', 'c_custkey')}, c_custkey limit 5",
)
def _(i):
    return curves.random_rows(i.customer.select(F.col("c_custkey").alias("clip_id")), 5, "clip_id")


# --- older evaluation ------------------------------------------------------

def _legacy(i):
    index = scores.class_index(CLASSES, F.col("class_name"))
    gts = i.ann.select(F.col("clip_id").alias("file_id"), F.col("ann_id").alias("gt_id"), "start_time", index.alias("class_id"))
    dets = scored(i.det).select(
        F.col("clip_id").alias("file_id"), "det_id", "start_time", F.col("detection_score").alias("det_prob"),
        F.col("class_scores").alias("class_probs"),
    )
    files = i.clips.select(F.col("clip_id").alias("file_id"), F.col("clip_end").alias("duration"))
    return gts, dets, files


def legacy_ctes(mode: str) -> str:
    own = {
        "detection": "lx as (select 0 as k, clip_id, det_id, start_time, detection_score as score, -2 as pred from det where start_time between 0.01 and 9.99)",
        "top_class": "lx as (select 0 as k, clip_id, det_id, start_time, greatest(s_click, s_purchase, s_signup) as score, case when s_click >= s_purchase and s_click >= s_signup then 0 when s_purchase >= s_signup then 1 else 2 end as pred from det where start_time between 0.01 and 9.99)",
        "per_class": """lx as (select 0 as k, clip_id, det_id, start_time, s_click as score, -2 as pred from det where start_time between 0.01 and 9.99
            union all select 1, clip_id, det_id, start_time, s_purchase, -2 from det where start_time between 0.01 and 9.99
            union all select 2, clip_id, det_id, start_time, s_signup, -2 from det where start_time between 0.01 and 9.99)""",
    }[mode]
    classes = "case class_name when 'click' then 0 when 'purchase' then 1 when 'signup' then 2 else -1 end"
    truth = {
        "per_class": f"lg as (select t.k, clip_id, ann_id, start_time, {classes} as cls from ann, (select unnest([0,1,2]) as k) t where start_time between 0.01 and 9.99 and {classes} in (t.k, -1))",
    }.get(mode, f"lg as (select 0 as k, clip_id, ann_id, start_time, {classes} as cls from ann where start_time between 0.01 and 9.99)")
    count = {"detection": "count(*)", "top_class": "count(*) filter (where cls > -1)", "per_class": "count(*) filter (where cls > -1)"}[mode]
    right = "won.cls is not null and won.cls = lx.pred" if mode == "top_class" else "won.cls is not null"
    drop = "" if mode == "detection" else "where won.cls is null or won.cls <> -1"
    return f"""{own}, {truth},
    lp as (select lx.k, lx.det_id, lg.ann_id, lg.cls, lx.score, abs(lx.start_time - lg.start_time) as gap,
        row_number() over (partition by lx.k, lx.det_id order by abs(lx.start_time - lg.start_time), lg.ann_id) as r
      from lx join lg on lg.k = lx.k and lg.clip_id = lx.clip_id),
    won as (select * from (select *, row_number() over (partition by k, ann_id order by score desc, det_id) as w from lp where r = 1 and gap <= 0.0105) where w = 1),
    obs as (select lx.k, lx.det_id as row_id, lx.score, coalesce({right}, false) as is_true from lx left join won on won.k = lx.k and won.det_id = lx.det_id {drop}),
    pos as (select k, {count} as n_pos from lg group by 1), {CURVE},
    rx as (select k, coalesce(max_by(rec, rank) filter (where prec > 0.95), 0) as rec from pr2 group by 1)"""


def legacy_sql(mode: str) -> str:
    key = "cast(k as integer) as class_of_interest, " if mode == "per_class" else ""
    return f"""with {legacy_ctes(mode)} select {key} n_pos as num_gt, round(ap, 5) as avg_prec, round(rec, 5) as rec_at_x from pos join ap using (k) join rx using (k)"""


REACH = dict(threshold=0.0105)


@pair("met14_legacy_detection", legacy_sql("detection"), "ann det")
def _(i):
    return legacy.precision_recall(*_legacy(i), "detection", 3, **REACH)


@pair("met14_legacy_top_class", legacy_sql("top_class"), "ann det")
def _(i):
    return legacy.precision_recall(*_legacy(i), "top_class", 3, **REACH)


@pair("met14_legacy_per_class", legacy_sql("per_class"), "ann det")
def _(i):
    return legacy.precision_recall(*_legacy(i), "per_class", 3, **REACH)


@pair(
    "met15_recall_at_precision",
    f"""with {CLASS_MATCH}, {CLASS_OBS}, {CURVE} select k as task_class, round(coalesce(max_by(rec, rank) filter (where prec > 0.4), 0), 6) as recall_at_x from pr2 group by 1""",
    "ann det",
)
def _(i):
    obs, positives = reports.classification_observations(_classification(i), CLASSES)
    out = curves.recall_at_precision(curves.pr_curve(obs, ["task_class"], positives), ["task_class"], 0.4)
    return out.withColumn("recall_at_x", F.round("recall_at_x", 6))


# files of the accuracy checks: one per user, ground truth of one class unless the user id is divisible by 4
FILE_GT = """fg as (select user_id as file_id, case when user_id%4 = 0 then event_id%3 else user_id%3 end as class_id from events),
    sf as (select file_id, min(class_id) as true_class from fg group by 1 having count(distinct class_id) = 1),
    fp as (select clip_id as file_id, 0 as c, s_click as p from det union all select clip_id, 1, s_purchase from det union all select clip_id, 2, s_signup from det)"""


def _file_inputs(i):
    gts = i.events.select(
        F.col("user_id").alias("file_id"),
        F.when(F.col("user_id") % 4 == 0, F.col("event_id") % 3).otherwise(F.col("user_id") % 3).cast("int").alias("class_id"),
    )
    dets = scored(i.det).select(F.col("clip_id").alias("file_id"), "det_id", F.col("class_scores").alias("class_probs"))
    return gts, dets


@pair(
    "met16_file_accuracy_simple",
    f"""with {FILE_GT}, m as (select file_id, c, avg(p) as v from fp group by all), b as (select file_id, c, row_number() over (partition by file_id order by v desc, c) as r from m)
    select file_id, cast(true_class as integer) as true_class, cast(coalesce(c, 0) as integer) as pred_class from sf left join b using (file_id) where coalesce(r, 1) = 1""",
    "det",
)
def _(i):
    """Means of an addition in the order of events, as one thread of the SQL adds them."""
    return legacy.file_accuracy_simple(*_file_inputs(i), 3, order="det_id")


FILE_BEST = f"""{FILE_GT}, bd as (select min(p) as lo, max(p) as hi from fp), th as (select s, lo + s*((hi - lo)/10) as cut from bd, (select unnest(range(0, 10)) as s) q),
    sm as (select s, file_id, c, sum(case when p >= cut then p else 0 end) as v from fp, th group by all),
    b as (select s, file_id, c, row_number() over (partition by s, file_id order by v desc, c) as r from sm),
    cl as (select th.s, sf.file_id, true_class, coalesce(c, 0) as pred_class from sf cross join th left join b on b.s = th.s and b.file_id = sf.file_id where coalesce(r, 1) = 1),
    acc as (select s, avg(cast(true_class = pred_class as integer)) as a from cl group by 1), ch as (select s from acc order by a desc, s limit 1),
    fa as (select cl.* from cl join ch using (s))"""


@pair(
    "met17_file_accuracy",
    f"""with {FILE_BEST} select count(*) as num_valid_files, round(avg(cast(true_class = pred_class as integer)), 5) as file_acc from fa""",
    "det",
)
def _(i):
    return legacy.accuracy_of(legacy.file_accuracy(*_file_inputs(i), 3))


@pair(
    "met18_classification_error",
    f"""with obs as (select 'all' as k, d.det_id as row_id, detection_score as score, is_target as is_true from det d join ann on ann_id = det_id), {AUC}
    select round((select avg(cast((score > 0.4) = is_true as integer)) * 100 from obs), 6) as class_acc, round(auc, 6) as roc_auc from au""",
    "ann det",
)
def _(i):
    truth = i.ann.select(F.col("ann_id").alias("row_id"), F.col("is_target").alias("is_true"))
    rows = i.det.select(F.col("det_id").alias("row_id"), F.col("detection_score").alias("score")).join(truth, "row_id")
    return legacy.classification_error(rows, 0.4).select(F.round("class_acc", 6).alias("class_acc"), F.round("roc_auc", 6).alias("roc_auc"))


def renamed(ctes: str, mark: str, names: str) -> str:
    """The CTE text with its names marked, so that several tasks fit in one statement."""
    import re

    for n in names.split():
        ctes = re.sub(rf"\b{n}\b(?!')", f"{n}_{mark}", ctes)
    return ctes


TASK_NAMES = "dx ax pr wn mt mr obs pos cu pr2 env ap sc sb au"


def _task_ctes(match: str, observe: str, mark: str) -> str:
    text = f"{match}, {observe}, {CURVE}, {AUC}"
    text = text.replace(BASE + ", ", "")
    return renamed(text.replace(" / max(n_pos) as ap from", " / max(n_pos) as value from").replace("as auc from", "as value from"), mark, TASK_NAMES)


@pair(
    "met19_evaluation_report",
    f"""with {BASE}, {_task_ctes(DET_MATCH, DET_OBS, 'd')}, {_task_ctes(TOP_MATCH, TOP_OBS, 't')}, {_task_ctes(CLASS_MATCH, CLASS_OBS, 'c')},
    thd as ({at_threshold('ann_id is not null').replace('from mr', 'from mr_d')}), tht as ({at_threshold('pred_class is not distinct from true_class').replace('from mr', 'from mr_t')})
    select 'detection/average_precision' as name, round(value, 6) as value from ap_d union all select 'detection/roc_auc', round(value, 6) from au_d
    union all select 'detection/' || metric, round(value, 6) from thd
    union all select 'top_class/average_precision', round(value, 6) from ap_t union all select 'top_class/roc_auc', round(value, 6) from au_t
    union all select 'top_class/' || metric, round(value, 6) from tht
    union all select 'classification/average_precision/' || k, round(value, 6) from ap_c union all select 'classification/mean_average_precision', round(avg(value), 6) from ap_c
    union all select 'classification/roc_auc/' || k, round(value, 6) from au_c union all select 'classification/mean_roc_auc', round(avg(value), 6) from au_c""",
    "ann det",
)
def _(i):
    return _rounded(reports.evaluation_report({
        "detection": reports.detection_metrics(_detection(i)),
        "top_class": reports.top_class_metrics(_top(i)),
        "classification": reports.classification_metrics(_classification(i), CLASSES),
    }))


LEGACY_NAMES = "lx lg lp won obs pos cu pr2 env ap rx"


def _legacy_task(mode: str, mark: str) -> str:
    text = legacy_ctes(mode).replace(" / max(n_pos) as ap from", " / max(n_pos) as value from")
    return renamed(text, mark, LEGACY_NAMES)


@pair(
    "met19_legacy_report",
    f"""with {_legacy_task('detection', 'd')}, {_legacy_task('top_class', 't')}, {_legacy_task('per_class', 'c')},
    one as (select clip_id, min(coalesce(class_name, '-')) as c from ann group by 1 having count(distinct coalesce(class_name, '-')) = 1 and c <> '-')
    select 'avg_prec' as name, round(value, 5) as value from ap_d union all select 'top_class', round(value, 5) from ap_t
    union all select 'avg_prec_class', round(avg(round(value, 5)), 5) from ap_c
    union all select 'class_pr/' || case k when 0 then 'click' when 1 then 'purchase' else 'signup' end, round(value, 5) from ap_c
    union all select 'file_acc', case when count(*) > 0 then cast('nan' as double) end from one""",
    "ann det",
)
def _(i):
    return legacy.report(*_legacy(i), CLASSES, **REACH)


@pair(
    "met20_operating_points",
    f"""with {DET_MATCH}, {DET_OBS}, {CURVE}, t as (select cast(unnest([0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) as double) as threshold),
    n as (select threshold, count(*) filter (where score >= threshold) as above, count(*) as total from t, obs group by 1)
    select threshold, cast(rank as bigint) as rank, round(score, 6) as score, round(prec, 6) as precision, round(rec, 6) as recall from n join pr2 on rank = least(above, total - 1) + 1""",
    "ann det",
)
def _(i):
    obs, positives = reports.detection_observations(_detection(i))
    out = curves.curve_points(curves.pr_curve(obs, (), positives), [i / 10 for i in range(11)])
    return out.select("threshold", "rank", *[F.round(n, 6).alias(n) for n in ("score", "precision", "recall")])


@pair(
    "met20_legacy_points",
    f"""with {legacy_ctes('per_class')}, t as (select cast(unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as double) as threshold),
    n as (select k, threshold, count(*) filter (where score > threshold) as above, count(*) as total from t, obs group by 1, 2)
    select cast(n.k as integer) as class_of_interest, threshold, cast(rank as bigint) as rank, round(prec, 6) as precision, round(pr2.rec, 6) as recall
    from n join pr2 on pr2.k = n.k and rank = case when above = 0 or above = total then total else above + 1 end""",
    "ann det",
)
def _(i):
    out = legacy.operating_points(*_legacy(i), "per_class", 3, **REACH)
    return out.select("class_of_interest", "threshold", "rank", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@pair(
    "met21_class_file_accuracy",
    f"""with {FILE_BEST} select cast(true_class as integer) as true_class, round(avg(cast(true_class = pred_class as integer)), 6) as accuracy from fa group by 1""",
    "det",
)
def _(i):
    files = legacy.file_accuracy(*_file_inputs(i), 3)
    return legacy.class_file_accuracy(files, 3).withColumn("accuracy", F.round("accuracy", 6))
