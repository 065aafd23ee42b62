"""Aggregates, splits, clips, joins and dataset assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpframe.functions import conditions as c
from chirpframe.operators import aggregates, clips, dataset, splits, transforms
from chirpframe.sources import tables

from .base import CLASSES, pair, scored


def duck_draw(seed: str, key: str) -> str:
    text = f"md5('{seed}-' || cast({key} as varchar))"
    return f"(cast(cast('0x' || substr({text}, 1, 13) as bigint) as double) / 4503599627370496)"


LONG = """lng as (select clip_id as recording_id, det_id, detection_score, 0 as class_idx, 'click' as class_name, s_click as score from det
    union all select clip_id, det_id, detection_score, 1, 'purchase', s_purchase from det
    union all select clip_id, det_id, detection_score, 2, 'signup', s_signup from det),
    wsum as (select recording_id, class_idx, class_name, sum(score * detection_score) as w from lng group by all),
    shr as (select *, w / sum(w) over (partition by recording_id) as share from wsum),
    rnk as (select *, row_number() over (partition by recording_id order by share desc, class_idx) as r from shr)"""


@pair(
    "agg01_class_summary",
    """with per as (select distinct class_name, recording_id from rec_ann),
    d as (select class_name, count(*) as num_recordings, sum(duration) as duration from per left join recordings using (recording_id) group by 1),
    n as (select class_name, count(*) as num_calls from rec_ann group by 1)
    select class_name, num_calls, num_recordings, round(duration, 6) as duration, round(num_calls / duration, 6) as call_rate from n join d using (class_name)""",
    "rec_ann recordings",
)
def _(i):
    out = aggregates.class_summary(i.rec_ann, i.recordings, "recording_id")
    return out.withColumns({n: F.round(n, 6) for n in ("duration", "call_rate")})


@pair(
    "agg02_class_weights",
    """with n as (select event_type as class_name, count(*) as n from events where event_type <> 'error' group by 1)
    select event_id, event_type as class_name, round((select avg(n) from n) / n, 6) as weight from events join n on event_type = class_name""",
)
def _(i):
    rows = i.events.select("event_id", F.col("event_type").alias("class_name"))
    return aggregates.sample_weights(rows, ["error"]).select("event_id", "class_name", F.round("weight", 6).alias("weight"))


def _rec_det(i):
    return scored(i.det).withColumnRenamed("clip_id", "recording_id")


@pair(
    "agg03_recording_class",
    f"""with {LONG} select recording_id, class_name as recording_class from rnk where r = 1""",
    "det",
)
def _(i):
    return aggregates.recording_class(_rec_det(i), CLASSES)


@pair(
    "agg04_top_classes",
    f"""with {LONG} select recording_id, cast(r as integer) as rank, class_name, round(share, 6) as share from rnk where r <= 2""",
    "det",
)
def _(i):
    out = aggregates.top_classes(_rec_det(i), CLASSES, 2)
    return out.select("recording_id", "rank", "class_name", F.round("share", 6).alias("share"))


@pair(
    "agg07_merge_detections",
    """select det_id, o_custkey as recording_id, detection_score from det join orders on o_orderkey = clip_id""",
    "det",
)
def _(i):
    clip_table = i.orders.select(F.col("o_orderkey").alias("clip_id"), F.col("o_custkey").alias("recording_id"))
    merged = aggregates.merge_detections(i.det, clip_table)
    return merged.select("det_id", "recording_id", "detection_score")


# --- splits ----------------------------------------------------------------

MAJORITY = """cnt as (select o_custkey, o_orderpriority, count(*) as n from orders group by all),
    maj as (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by n desc, o_orderpriority) as r from cnt)"""


@pair(
    "spl01_split_by_recordings",
    f"""with {MAJORITY}, s as (select c_custkey, o_orderpriority, coalesce(o_orderpriority, '') as k from customer left join maj on o_custkey = c_custkey and r = 1),
    q as (select *, row_number() over (partition by k order by {duck_draw('split', 'c_custkey')}, c_custkey) as rank, count(*) over (partition by k) as size from s)
    select c_custkey as recording_id, o_orderpriority as class_name, case when rank <= floor(size * 0.75 + 0.5) then 'train' else 'test' end as split from q""",
)
def _(i):
    events = i.orders.select(F.col("o_custkey").alias("recording_id"), F.col("o_orderpriority").alias("class_name"))
    return splits.split_by_recordings(i.customer.select(F.col("c_custkey").alias("recording_id")), events)


@pair(
    "spl02_group_folds",
    f"""with {MAJORITY}, q as (select *, row_number() over (partition by o_orderpriority order by {duck_draw('7', 'o_custkey')}, o_custkey) as rank from maj where r = 1)
    select o_custkey as file_id, o_orderpriority as class_name, cast((rank + floor({duck_draw('7-shift', 'o_orderpriority')} * 5)) % 5 as integer) as fold,
    case when (rank + floor({duck_draw('7-shift', 'o_orderpriority')} * 5)) % 5 = 0 then 'test' else 'train' end as split from q""",
)
def _(i):
    events = i.orders.select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("class_name"))
    return splits.first_fold(splits.group_folds(events, 5, "7"))


@pair(
    "spl03_named_split",
    """select distinct source as dataset_name, lang as split_name, source in ('src1','src2') as is_test, source in ('src2','src3') as is_binary
    from documents where lang = 'en' and (source in ('src1','src2') or source not in ('src2','src3'))""",
)
def _(i):
    registry = i.documents.select(
        F.col("source").alias("dataset_name"), F.col("lang").alias("split_name"),
        F.col("source").isin("src1", "src2").alias("is_test"), F.col("source").isin("src2", "src3").alias("is_binary"),
    ).distinct()
    return splits.named_split(registry, "en", load_extra=False)


# --- clips -----------------------------------------------------------------

TILES = """tl as (select recording_id, duration, cast(k as bigint) as clip_index, cast(k as double) * 0.375 as clip_start from recordings, (select unnest(range(0, 200)) as k) r
    where k <= ceil(duration / (0.5 * (1 - 0.25))) - 1)"""


@pair(
    "clp01_tile_recordings",
    f"""with {TILES} select recording_id, clip_index, round(clip_start, 6) as clip_start, round(clip_start + cast(0.5 as double), 6) as clip_end from tl
    where clip_start + 0.5 - duration <= 0.2""",
    "recordings",
)
def _(i):
    out = clips.tile_recordings(i.recordings, 0.5, 0.25, 0.2, with_ids=False)
    return out.select("recording_id", "clip_index", F.round("clip_start", 6).alias("clip_start"), F.round("clip_end", 6).alias("clip_end"))


def _whole_clips(i):
    return i.recordings.select(
        F.col("recording_id").alias("clip_id"), F.lit(0.5).alias("clip_start"), (F.col("duration") + 0.5).alias("clip_end")
    )


def _rounded(frame):
    return frame.select("clip_id", F.round("clip_start", 6).alias("clip_start"), F.round("clip_end", 6).alias("clip_end"))


@pair(
    "clp02_random_subclips",
    f"""with s as (select recording_id, case when 12 > duration + 0.2 then cast(0.5 as double)
      else 0.5 + {duck_draw('subclip', 'recording_id')} * (duration + 0.5 + 0.2 - 12 - 0.5) end as st from recordings)
    select recording_id as clip_id, round(st, 6) as clip_start, round(st + 12, 6) as clip_end from s""",
    "recordings",
)
def _(i):
    return _rounded(clips.random_subclips(_whole_clips(i), 12.0, 0.2))


@pair(
    "clp03_padded_clips",
    """select recording_id as clip_id, cast(0.5 as double) as clip_start,
    round(0.5 + cast(0.256 as double) * ceil((duration + 0.5 - 0.5) / cast(0.256 as double)), 6) as clip_end from recordings""",
    "recordings",
)
def _(i):
    return _rounded(clips.padded_clips(_whole_clips(i)))


@pair(
    "clp04_fixed_clip_events",
    """select ann_id, clip_id, cast(0 as double) as clip_start, cast(4.25 as double) as clip_end from ann
    where least(end_time, 4.25) - greatest(start_time, 0) > 0""",
    "ann",
)
def _(i):
    out = clips.fixed_clip_events(i.clips, i.ann, 4.25)
    return out.select("ann_id", "clip_id", "clip_start", "clip_end")


@pair(
    "clp05_chunks",
    """with s as (select recording_id, samplerate, cast(floor(duration * samplerate) as bigint) as n, cast(samplerate * 3 as bigint) as len from recordings)
    select recording_id, cast(k as bigint) as chunk_idx, cast(k * 3 as double) as chunk_start, k * len as start_sample, least((k + 1) * len, n) as end_sample
    from s, (select unnest(range(0, 60)) as k) r where k <= ceil(n / cast(samplerate as double) / 3) - 1""",
    "recordings",
)
def _(i):
    rec = i.recordings.withColumn("n_samples", F.floor(F.col("duration") * F.col("samplerate")))
    return clips.chunk_recordings(rec, 3.0)


@pair(
    "clp05_chunk_offset",
    "select det_id, round(start_time + (det_id%7)*3, 6) as start_time, round(end_time + (det_id%7)*3, 6) as end_time from det",
    "det",
)
def _(i):
    rows = clips.offset_chunk_times(i.det.withColumn("chunk_idx", F.col("det_id") % 7), 3.0)
    return rows.select("det_id", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@pair(
    "jon01_events_in_clips",
    f"""with {TILES} select ann_id, r.recording_id, clip_index from rec_ann r join tl using (recording_id)
    where clip_start + 0.5 - duration <= 0 and least(end_time, clip_start + 0.5) - greatest(start_time, clip_start) >= 0.05""",
    "rec_ann recordings",
)
def _(i):
    tiles = clips.tile_recordings(i.recordings, 0.5, 0.25, with_ids=False)
    pairs = clips.events_in_clips(i.rec_ann, tiles.select("recording_id", "clip_index", "clip_start", "clip_end"), 0.05)
    return pairs.select("ann_id", "recording_id", "clip_index")


@pair(
    "jon02_pair_predictions",
    """select c_custkey as clip_id, det_id, detection_score from customer left join det on clip_id = c_custkey""",
    "det",
)
def _(i):
    ann_clips = i.customer.select(F.col("c_custkey").alias("clip_id"))
    return clips.pair_predictions(ann_clips, i.det).select("clip_id", "det_id", "detection_score")


def _nested(parity: int):
    """Loader of a source: one clip per event row of the given parity, two events each."""

    def load_from(i):
        def event(k, shift):
            return F.struct(
                (F.col("event_id") * 2 + k).alias("ann_id"), F.lit(0.1 + shift).alias("start_time"),
                F.lit(0.2 + shift).alias("end_time"), (F.lit(20000.0) + F.col("event_id") % 9 * 1000 + shift).alias("low_freq"),
                F.lit(60000.0).alias("high_freq"), F.lit("BoundingBox").alias("geom_type"),
                F.array(c.tag_struct("event", "Echolocation"), F.struct(F.lit("class").alias("key"), F.col("event_type").alias("value"))).alias("tags"),
            )

        tags = F.array(F.struct(F.lit("user").alias("key"), F.col("user_id").cast("string").alias("value")))
        return i.events.where(F.col("event_id") % 2 == parity).select(
            F.col("event_id").alias("clip_id"), tags.alias("tags"), F.array(event(0, 0.0), event(1, 1.0)).alias("events")
        )

    return load_from


@pair(
    "jon03_load_dataset",
    """with ev as (select event_id, 0 as k, event_type, user_id, 20000 + event_id%9*1000 as low_freq, event_id%2 as src from events
      union all select event_id, 1, event_type, user_id, 20000 + event_id%9*1000 + 1, event_id%2 from events),
    kept as (select * from ev where low_freq >= 24001 and src in (0, 1))
    select c.event_id as clip_id, case c.event_id%2 when 0 then 'even' else 'odd' end as source, k.event_id * 2 + k.k as ann_id,
      case when low_freq is not null then greatest(cast(low_freq as double), 26000) end as low_freq, case when k.event_type = 'click' then 'tap' else k.event_type end as class_name
    from events c left join kept k on k.event_id = c.event_id where c.user_id <> 5""",
)
def _(i):
    sources = [
        dataset.Source("even", lambda spark: _nested(0)(i)), dataset.Source("odd", lambda spark: _nested(1)(i)),
        dataset.Source("skipped", lambda spark: _nested(1)(i)),
    ]
    config = dataset.DatasetConfig(
        "check", sources, clip_filter=c.Not(c.HasTag("user", "5")), event_filter=c.Frequency("gte", "low", 24001),
        event_transforms=[
            transforms.ApplyIf(c.Frequency("lt", "low", 26000), transforms.SetFrequencyBound(26000)),
            transforms.MapTagValue("class", {"click": "tap"}),
        ],
    )
    out = dataset.load_dataset(i.spark, config, exclude_sources=["skipped"])
    source = F.get(F.filter("tags", lambda t: t["key"] == "dcterms:source"), F.lit(0))["value"]
    flat = out.select("clip_id", source.alias("source"), F.explode_outer("events").alias("e"))
    name = F.get(F.filter("e.tags", lambda t: t["key"] == "class"), F.lit(0))["value"]
    return flat.select("clip_id", "source", "e.ann_id", "e.low_freq", name.alias("class_name"))


# --- third-party call tables -----------------------------------------------

FIRST = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
SECOND = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]


@pair(
    "src06_calls_with_species",
    """with f as (select p_partkey, case when p_partkey%4=0 then 'x' else substr(split_part(p_name,' ',1),1,3) || substr(split_part(p_name,' ',2),1,3) end as accepted,
      case when p_partkey%4=0 then p_name else p_name end as name from part)
    select l_orderkey, l_linenumber, cast(l_partkey as varchar) as recording, name as class, round(case when l_partkey%4=0 then cast(0.5 as double) when l_partkey%8=1 then 0 else cast(0.75 as double) end, 6) as class_prob,
    round(l_quantity / 1000, 5) as start_time, round(round(l_quantity / 1000, 5) + l_linenumber / cast(1000 as double), 5) as end_time,
    round(l_tax * 1000, 2) as low_freq, round(l_discount * 1000, 3) as det_prob
    from lineitem join f on l_partkey = p_partkey""",
)
def _(i):
    word = lambda k: F.substring(F.get(F.split("p_name", " "), F.lit(k)), 1, 3)
    code = F.concat(word(0), word(1))
    key = F.col("p_partkey")
    files = i.part.select(
        key.cast("string").alias("Filename"), F.when(key % 4 == 0, "x").otherwise(code).alias("accepted"),
        F.when(key % 8 == 1, "x").otherwise("0.75").alias("accepted_prob"), code.alias("guess"), F.lit("0.5").alias("guess_prob"),
    )
    names = [f"{a} {b}" for a in FIRST for b in SECOND]
    species = tables.file_species(files, names, only_accepted=False)
    calls = i.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("Filename"), F.col("l_quantity").alias("TimeInFile"),
        F.col("l_linenumber").alias("CallDuration"), F.col("l_tax").alias("LowFreq"), F.col("l_tax").alias("HiFreq"),
        (F.col("l_discount") * 1000).alias("Quality"),
    )
    out = tables.calls_with_species(calls, species)
    return out.select(
        "l_orderkey", "l_linenumber", "recording", "class", "class_prob", "start_time", "end_time", "low_freq", "det_prob"
    )
