"""Filters, projections and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpframe.functions import conditions as c
from chirpframe.functions import ids
from chirpframe.operators import filters, projections, targets, transforms

from .base import CLASSES, pair, tagged

HAS = "exists (select 1 from tags t where t.ann_id = a.ann_id and t.key = '{}' and t.value = '{}')"


def has(key: str, value: str) -> str:
    return HAS.format(key, value)


# --- conditions ------------------------------------------------------------

@pair("flt01_has_tag", f"select ann_id from ann a where {has('class', 'click')}", "ann tags")
def _(i):
    return filters.keep(tagged(i.ann), c.HasTag("class", "click")).select("ann_id")


@pair(
    "flt02_has_all_tags",
    f"select ann_id from ann a where {has('class', 'signup')} and {has('event', 'Echolocation')}",
    "ann tags",
)
def _(i):
    rule = c.HasAllTags([("class", "signup"), ("event", "Echolocation")])
    return filters.keep(tagged(i.ann), rule).select("ann_id")


@pair(
    "flt03_has_any_tag",
    f"select ann_id from ann a where {has('class', 'purchase')} or {has('event', 'Social')}",
    "ann tags",
)
def _(i):
    rule = c.HasAnyTag([("class", "purchase"), ("event", "Social")])
    return filters.keep(tagged(i.ann), rule).select("ann_id")


@pair(
    "flt04_id_in_list",
    """select ann_id, true as listed from ann where ann_id in (select doc_id from labels)
    union all select ann_id, false as listed from ann where ann_id not in (select doc_id from labels)""",
    "ann",
)
def _(i):
    listed = filters.id_in_list(i.ann, i.labels.select("doc_id"), "ann_id")
    rest = filters.id_in_list(i.ann, i.labels.select("doc_id"), "ann_id", negate=True)
    return listed.select("ann_id", F.lit(True).alias("listed")).unionByName(
        rest.select("ann_id", F.lit(False).alias("listed"))
    )


@pair(
    "flt05_path_in_list",
    """with rec as (select recording_id, case when recording_id%5=0 then '/other/' || path
       when recording_id%5=1 then path else '/data/' || path end as path from recordings),
    wanted as (select path from recordings where recording_id%3=0)
    select recording_id from rec where path like '/other/%'
      or (path like '/data/%' and substr(path, 7) in (select path from wanted))
      or (path not like '/%' and path in (select path from wanted))""",
    "recordings",
)
def _(i):
    n = F.col("recording_id") % 5
    rec = i.recordings.withColumn(
        "path",
        F.when(n == 0, F.concat(F.lit("/other/"), "path")).when(n == 1, F.col("path"))
        .otherwise(F.concat(F.lit("/data/"), "path")),
    )
    wanted = i.recordings.where(F.col("recording_id") % 3 == 0).select("path")
    return filters.path_in_list(rec, wanted, base_dir="/data").select("recording_id")


@pair(
    "flt06_duration",
    """select ann_id, end_time - start_time > 0.006 as gt, end_time - start_time >= 0.006 as gte,
    end_time - start_time < 0.004 as lt, end_time - start_time <= 0.004 as lte,
    end_time - start_time = 0.005 as eq from ann""",
    "ann",
)
def _(i):
    cut = {"gt": 0.006, "gte": 0.006, "lt": 0.004, "lte": 0.004, "eq": 0.005}
    return i.ann.select("ann_id", *[c.Duration(op, s).column().alias(op) for op, s in cut.items()])


@pair(
    "flt07_frequency",
    """select ann_id from ann where ann_id%11 <> 0 and low_freq >= 40000 and high_freq < 70000""",
    "ann",
)
def _(i):
    shape = F.when(F.col("ann_id") % 11 == 0, "TimeInterval").otherwise("BoundingBox")
    rule = c.AllOf([c.Frequency("gte", "low", 40000), c.Frequency("lt", "high", 70000)])
    return filters.keep(i.ann.withColumn("geom_type", shape), rule).select("ann_id")


@pair(
    "flt08_combinators",
    f"""select ann_id,
    not ({has('class', 'click')} or {has('class', 'signup')}) as none_of,
    {has('event', 'Echolocation')} and end_time - start_time > 0.005 as both_of,
    true as all_of_nothing, false as any_of_nothing,
    ann_id in (select doc_id from labels) or low_freq > 50000 as listed_or_high
    from ann a""",
    "ann tags",
)
def _(i):
    rows = filters.flag_in_list(tagged(i.ann), i.labels.select("doc_id"), "ann_id", "_listed")
    rules = {
        "none_of": c.Not(c.AnyOf([c.HasTag("class", "click"), c.HasTag("class", "signup")])),
        "both_of": c.AllOf([c.HasTag("event", "Echolocation"), c.Duration("gt", 0.005)]),
        "all_of_nothing": c.AllOf([]),
        "any_of_nothing": c.AnyOf([]),
        "listed_or_high": c.AnyOf([c.Flag("_listed"), c.Frequency("gt", "low", 50000)]),
    }
    return rows.select("ann_id", *[r.column().alias(n) for n, r in rules.items()])


@pair(
    "flt09_recording_satisfies",
    """select o_orderkey as clip_id from orders join customer on o_custkey = c_custkey
    where c_nationkey = 3 and not c_mktsegment = 'BUILDING'""",
)
def _(i):
    def tag(key, value):
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    tags = F.array(tag("nation", F.col("c_nationkey")), tag("segment", F.col("c_mktsegment")))
    recordings = i.customer.select("c_custkey", F.struct(tags.alias("tags")).alias("recording"))
    clips = i.orders.join(recordings, F.col("o_custkey") == F.col("c_custkey"))
    inner = c.AllOf([c.HasTag("nation", "3"), c.Not(c.HasTag("segment", "BUILDING"))])
    return filters.keep(clips, c.RecordingSatisfies(inner)).select(F.col("o_orderkey").alias("clip_id"))


@pair(
    "flt10_filter_clip_events",
    """select c.clip_id, a.ann_id, a.low_freq from clips c left join
    (select * from ann where low_freq >= 58000 and class_name = 'click') a on a.clip_id = c.clip_id""",
    "clips ann",
)
def _(i):
    rule = c.AllOf([c.Frequency("gte", "low", 58000), c.HasTag("class", "click")])
    return filters.filter_flat_events(i.clips, tagged(i.ann), rule).select("clip_id", "ann_id", "low_freq")


def _tasks(i):
    badge = lambda s: F.struct(F.lit(s).alias("state"))
    badges = (
        F.when(F.col("o_orderstatus") == "F", F.array(badge("completed")))
        .when(F.col("o_orderstatus") == "O", F.array(badge("completed"), badge("verified"), badge("rejected")))
        .otherwise(F.array(badge("verified")))
    )
    return i.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("clip_id"), badges.alias("badges"))


@pair(
    "flt11_select_tasks",
    """select o_orderkey as task_id, o_orderstatus = 'F' as by_default,
    o_orderstatus = 'O' as verified_with_issues, o_orderstatus in ('F','P') as no_issues from orders""",
)
def _(i):
    badges = F.col("badges")
    return _tasks(i).select(
        "task_id",
        filters.task_is_ready(badges).alias("by_default"),
        filters.task_is_ready(badges, only_verified=True, exclude_issues=False).alias("verified_with_issues"),
        filters.task_is_ready(badges, only_completed=False).alias("no_issues"),
    )


@pair(
    "flt12_ready_clips",
    "select c_custkey as clip_id from customer where c_custkey in (select o_custkey from orders where o_orderstatus='F')",
)
def _(i):
    return filters.ready_clips(i.customer.select(F.col("c_custkey").alias("clip_id")), _tasks(i))


def _files(i):
    return i.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("annotated"),
        (F.col("o_orderpriority") == "1-URGENT").alias("issues"),
    )


@pair(
    "flt13_annotated_files",
    "select o_orderkey as id from orders where o_orderstatus <> 'P' and o_orderpriority <> '1-URGENT'",
)
def _(i):
    return filters.annotated_files(_files(i)).select("id")


@pair(
    "flt14_sources",
    "select doc_id, source from documents where source in ('src1','src2','src3') and source not in ('src2')",
)
def _(i):
    return filters.by_source(i.documents, ["src1", "src2", "src3"], ["src2"]).select("doc_id", "source")


@pair(
    "flt15_by_frequency",
    """select 'both' as mode, det_id from det where low_freq >= 50000 or high_freq <= 40000
    union all select 'low' as mode, det_id from det where low_freq between 30000 and 40000
    union all select 'high' as mode, det_id from det where high_freq between 30000 and 40000""",
    "det",
)
def _(i):
    def part(mode, frame):
        return frame.select(F.lit(mode).alias("mode"), "det_id")

    return (
        part("both", filters.by_frequency(i.det, 50000, 40000))
        .unionByName(part("low", filters.by_frequency(i.det, 30000, 40000, "low_freq")))
        .unionByName(part("high", filters.by_frequency(i.det, 30000, 40000, "high_freq")))
    )


@pair("flt16_by_duration", "select det_id from det where end_time - start_time between 0.0035 and 0.0075", "det")
def _(i):
    return filters.by_duration(i.det, 0.0035, 0.0075).select("det_id")


def _rec_det(i):
    return i.det.withColumnRenamed("clip_id", "recording_id")


@pair(
    "flt17_below_nyquist",
    """select det_id from det join recordings on recording_id = clip_id
    where high_freq < cast(samplerate as double)/2 - 50000""",
    "det recordings",
)
def _(i):
    return filters.below_nyquist(_rec_det(i), i.recordings, buffer=50000).select("det_id")


@pair(
    "flt18_away_from_edges",
    """select det_id,
    start_time between clip_start + 0.1 and clip_end - 0.1 as by_start,
    end_time between clip_start + 0.1 and clip_end - 0.1 as by_end
    from det join clips using (clip_id)
    where start_time >= clip_start + 0.1 and end_time <= clip_end - 0.1""",
    "det clips",
)
def _(i):
    kept = filters.away_from_edges(i.det, i.clips, 0.1)
    for mode in ("start_time", "end_time"):
        flag = filters.away_from_edges(i.det, i.clips, 0.1, mode).select("det_id", F.lit(True).alias(f"by_{mode[:-5]}"))
        kept = kept.join(flag, "det_id", "left")
    return kept.select("det_id", *[F.coalesce(f, F.lit(False)).alias(f) for f in ("by_start", "by_end")])


@pair(
    "flt19_at_or_below_nyquist",
    """select det_id from det join recordings on recording_id = clip_id
    where cast(floor(high_freq) as integer) <= samplerate * cast(0.5 as double) / 2""",
    "det recordings",
)
def _(i):
    rec = i.recordings.withColumn("time_expansion", F.lit(0.5))
    return filters.at_or_below_nyquist(_rec_det(i), rec).select("det_id")


@pair(
    "flt20_in_bounds",
    """select ann_id from ann join clips using (clip_id)
    where is_target and start_time between clip_start + 0.01 and clip_end - 0.01""",
    "ann clips",
)
def _(i):
    return filters.in_bounds(i.ann.where("is_target"), i.clips, 0.01).select("ann_id")


@pair(
    "flt21_without_test_items",
    "select doc_id from documents where doc_id not in (select doc_id from labels)",
)
def _(i):
    return filters.without_test_items(i.documents, i.labels, "doc_id").select("doc_id")


# --- projections -----------------------------------------------------------

FILES = """files as (
 select event_id as id, case when event_type='view' then '' else event_type end as cls,
  case when event_type='error' then '' else 'Echolocation' end as event,
  cast(event_id%10000 as double)/1000 as t0, cast(event_id%4 as varchar(5)) as ind from events)"""


def _documents(i):
    def event(shift, individual):
        start = (F.col("event_id") % 10000).cast("double") / 1000 + F.lit(shift)
        return F.struct(
            F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("class"),
            F.when(F.col("event_type") == "error", "").otherwise("Echolocation").alias("event"),
            individual.alias("individual"), start.alias("start_time"), (start + 0.5).alias("end_time"),
            F.lit(20000.0).alias("low_freq"), F.lit(30000.0).alias("high_freq"),
            F.lit(0.25).alias("class_prob"), F.lit(0.75).alias("det_prob"),
        )

    own = (F.col("event_id") % 4).cast("string")
    return i.events.select(
        F.col("event_id").alias("id"),
        F.array(event(0.0, own), event(20.0, F.lit(None).cast("string"))).alias("annotation"),
    )


@pair(
    "prj01_file_events",
    f"""with {FILES}, ev as (select id, cls, event, t0 as start_time, ind from files
      union all select id, cls, event, t0 + 20 as start_time, '0' as ind from files)
    select id, round(start_time, 6) as start_time, 'class' as key, cls as value from ev where cls <> ''
    union all select id, round(start_time, 6) as start_time, 'event' as key, event as value from ev where event <> ''
    union all select id, round(start_time, 6) as start_time, 'individual' as key, ind as value from ev""",
)
def _(i):
    rows = projections.file_events(_documents(i)).withColumn("tag", F.explode("tags"))
    return rows.select("id", F.round("start_time", 6).alias("start_time"), "tag.key", "tag.value")


UUID = """with d as (select recording_id, path, sha1(unhex('97a9776bc0fd4c68accb0b0ecd719242') || encode(path || '_clip')) as h from recordings)
    select recording_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
      substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h,17,1)), 1) || substr(h,18,3) || '-' || substr(h,21,12) as clip_id
    from d"""


@pair("prj02_uuid5", UUID, "recordings")
def _(i):
    return i.recordings.select("recording_id", ids.compat_clip_id(F.col("path")).alias("clip_id"))


@pair(
    "prj03_task_status",
    """select o_orderkey as id, case when o_orderpriority = '1-URGENT' then 'rejected'
    when o_orderstatus <> 'P' then 'completed' end as state from orders""",
)
def _(i):
    return _files(i).select("id", projections.task_status(F.col("issues"), F.col("annotated")).alias("state"))


@pair(
    "prj04_annotation_groups",
    """with ids as (select *, case class_name when 'click' then 0 when 'purchase' then 1 when 'signup' then 2 else -1 end as class_id from ann)
    select c.clip_id, count(ann_id) as n, round(sum(start_time), 6) as starts,
      round(sum(high_freq - low_freq), 6) as band,
      string_agg(cast(class_id as varchar(3)), ',' order by start_time, ann_id) as class_ids,
      'Myotis ' || cast(c.clip_id%7 as varchar(3)) as class_name, 'a' || chr(10) || 'b' as notes
    from clips c left join ids i on i.clip_id = c.clip_id group by c.clip_id""",
    "ann clips",
)
def _(i):
    index = F.create_map(*[F.lit(x) for k, n in enumerate(CLASSES) for x in (n, k)])
    events = i.ann.withColumn("class_id", F.element_at(index, F.col("class_name")))
    species = F.struct(F.lit("species").alias("key"), F.concat(F.lit("Myotis "), (F.col("clip_id") % 7).cast("string")).alias("value"))
    clips = i.clips.withColumns({"notes": F.array(F.lit("a"), F.lit("b")), "tags": F.array(species)})
    groups = projections.annotation_groups(events, clips)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return groups.select(
        "clip_id", F.size("start_times").cast("bigint").alias("n"),
        F.round(total(F.col("start_times")), 6).alias("starts"),
        F.round(total(F.zip_with("high_freqs", "low_freqs", lambda h, l: h - l)), 6).alias("band"),
        F.array_join(F.transform("class_ids", lambda x: x.cast("string")), ",").alias("class_ids"),
        "class_name", "notes",
    )


@pair(
    "prj05_prediction_events",
    f"""with {FILES}, ev as (select id, cls, event, t0 as start_time from files union all select id, cls, event, t0 + 20 from files)
    select id, round(start_time, 6) as start_time, cast(0.75 as double) as score, 'class' as key, cls as value, cast(0.25 as double) as tag_score from ev
    union all select id, round(start_time, 6), cast(0.75 as double), 'event', event, cast(0.75 as double) from ev""",
)
def _(i):
    rows = projections.prediction_events(_documents(i)).withColumn("tag", F.explode("tags"))
    return rows.select(
        "id", F.round("start_time", 6).alias("start_time"), "score", "tag.key", "tag.value",
        F.col("tag.score").alias("tag_score"),
    )


@pair(
    "prj06_source_tag",
    """select doc_id, 'lang' as key, lang as value from documents where lang in ('en','fr')
    union all select doc_id, 'dcterms:source', 'set_' || lang from documents where lang in ('en','fr')""",
)
def _(i):
    tags = F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")))
    parts = [
        projections.add_source_tag(i.documents.where(F.col("lang") == lang).select("doc_id", tags.alias("tags")), f"set_{lang}")
        for lang in ("en", "fr")
    ]
    rows = parts[0].unionByName(parts[1]).withColumn("tag", F.explode("tags"))
    return rows.select("doc_id", "tag.key", "tag.value")


@pair(
    "prj07_recording_table",
    """select o_orderkey as clip_annotation_id, recording_id, round(duration, 6) as duration,
    'rec' || cast(recording_id as varchar(20)) || '.wav' as filename, samplerate, path
    from orders join recordings on recording_id = o_custkey""",
    "recordings",
)
def _(i):
    clips = i.orders.select(F.col("o_orderkey").alias("clip_annotation_id"), F.col("o_custkey").alias("recording_id")).join(
        i.recordings, "recording_id"
    ).withColumns({"clip_start": F.lit(1.0), "clip_end": F.col("duration") + 1.0})
    return projections.recording_table(clips).select(
        "clip_annotation_id", "recording_id", F.round("duration", 6).alias("duration"), "filename", "samplerate", "path"
    )


def _targets():
    detection = targets.TargetClass("bat", match_if=c.HasTag("event", "Echolocation"), assign_tags=[("event", "Echolocation")])
    return targets.Targets([targets.TargetClass(n, tags=[("class", n)]) for n in CLASSES], detection)


@pair(
    "prj08_event_table",
    """select ann_id, is_target, coalesce(class_name, 'bat') as class_name, start_time, end_time, low_freq, high_freq
    from ann where is_target""",
    "ann",
)
def _(i):
    rows = targets.event_table(tagged(i.ann), _targets(), exclude_generic=False)
    return rows.select("ann_id", "is_target", "class_name", "start_time", "end_time", "low_freq", "high_freq")


@pair(
    "prj09_time_expansion",
    """select recording_id, cast(samplerate as double) * case when recording_id%2=0 then 10 else 1 end as samplerate,
    round(least(duration / case when recording_id%2=0 then 10 else 1 end, 2), 6) as duration from recordings""",
    "recordings",
)
def _(i):
    rec = i.recordings.withColumn("time_expansion", F.when(F.col("recording_id") % 2 == 0, 10.0).otherwise(1.0))
    return projections.time_expanded(rec, max_duration=2.0).select(
        "recording_id", "samplerate", F.round("duration", 6).alias("duration")
    )


@pair(
    "prj10_clean_classes",
    """with named as (select p_partkey, p_type, case trim(p_name) when 'small ring' then 'large ring'
      when 'red widget' then 'blue bolt' else trim(p_name) end as n from part where p_type in ('ECONOMY','STANDARD','PROMO')),
    genus as (select p_partkey, split_part(n, ' ', 1) as class_name from named)
    select p_partkey, class_name from genus where class_name not in ('red', 'green')""",
)
def _(i):
    rows = i.part.select("p_partkey", F.col("p_type").alias("event"), F.col("p_name").alias("class_name"))
    return projections.clean_classes(
        rows, ["ECONOMY", "STANDARD", "PROMO"], {"small ring": "large ring", "red widget": "blue bolt"},
        convert_to_genus=True, classes_to_ignore=["red", "green"],
    ).select("p_partkey", "class_name")


@pair(
    "prj11_short_names",
    """select p_partkey, substr(split_part(p_name,' ',1),1,3) || ' ' || substr(split_part(p_name,' ',2),1,3) as short_name
    from part""",
)
def _(i):
    return i.part.select("p_partkey", projections.short_class_name(F.col("p_name")).alias("short_name"))


@pair(
    "prj12_genus_mapping",
    """with n as (select distinct p_name as class_name, split_part(p_name,' ',1) as genus from part)
    select class_name, genus, cast(dense_rank() over (order by genus) - 1 as integer) as genus_index from n""",
)
def _(i):
    return projections.genus_mapping(i.part.select(F.col("p_name").alias("class_name")))


@pair(
    "prj13_class_ids",
    """select event_id, case event_type when 'click' then 0 when 'purchase' then 1 when 'signup' then 2 else -1 end as class_id,
    case event_type when 'click' then 0 when 'purchase' then 1 when 'signup' then 2 when 'error' then 3 else -1 end as pred_class_id
    from events""",
)
def _(i):
    from chirpframe.functions.scores import class_index

    return i.events.select(
        "event_id", class_index(CLASSES, F.col("event_type")).alias("class_id"),
        class_index([*CLASSES, "error"], F.col("event_type")).alias("pred_class_id"),
    )


@pair(
    "prj14_normalized_keys",
    """select ann_id, case key when 'event' then 'soundevent:call_type' when 'class' then 'soundevent:class' else key end as key, value
    from tags""",
    "tags",
)
def _(i):
    tag = F.explode(projections.normalized_keys(F.col("tags"))).alias("tag")
    return tagged(i.ann).select("ann_id", tag).select("ann_id", "tag.key", "tag.value")


@pair(
    "prj15_drop_padding",
    """select event_id, cast(case when event_id%3=0 then 1 else 2 end as bigint) as n,
    cast(case when event_id%3=0 then event_id else event_id + event_id + 2 end as bigint) as total from events""",
)
def _(i):
    n = F.col("event_id")
    rows = i.events.select(
        n.alias("event_id"), F.array(n, n + 1, n + 2).alias("starts"),
        F.array(F.lit(1), F.lit(0), F.when(n % 3 == 0, 0).otherwise(1)).alias("is_valid"),
    )
    out = projections.drop_padding(rows, ["starts"])
    return out.select(
        "event_id", F.size("starts").cast("bigint").alias("n"),
        F.aggregate("starts", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"),
    )


# --- transforms ------------------------------------------------------------

@pair(
    "trf01_set_frequency",
    """select ann_id, cast(45000 as double) as low_a, greatest(high_freq, 45000) as high_a,
    least(low_freq, 50000) as low_b, cast(50000 as double) as high_b from ann""",
    "ann",
)
def _(i):
    low = transforms.transform_events(tagged(i.ann), transforms.SetFrequencyBound(45000)).select(
        "ann_id", F.col("low_freq").alias("low_a"), F.col("high_freq").alias("high_a"))
    high = transforms.SetFrequencyBound(50000, "high").fields(F.col)
    both = tagged(i.ann).select("ann_id", high["low_freq"].alias("low_b"), high["high_freq"].alias("high_b"))
    return low.join(both, "ann_id")


@pair(
    "trf02_replace_tag",
    """select ann_id, key, case when key='class' and value='click' then 'tap' else value end as value from tags""",
    "tags",
)
def _(i):
    rows = transforms.transform_events(tagged(i.ann), transforms.ReplaceTag(("class", "click"), ("class", "tap")))
    return rows.select("ann_id", F.explode("tags").alias("t")).select("ann_id", "t.key", "t.value")


@pair(
    "trf03_map_tag_value",
    """select ann_id, case when key='class' and value in ('click','purchase') then 'kind' else key end as key,
    case when key='class' and value='click' then 'A' when key='class' and value='purchase' then 'B' else value end as value from tags""",
    "tags",
)
def _(i):
    step = transforms.MapTagValue("class", {"click": "A", "purchase": "B"}, target_key="kind")
    rows = transforms.transform_events(tagged(i.ann), step)
    return rows.select("ann_id", F.explode("tags").alias("t")).select("ann_id", "t.key", "t.value")


@pair(
    "trf04_apply_if",
    """select ann_id, case when class_name='click' then least(low_freq, 40000) else low_freq end as low_freq,
    case when class_name='click' then cast(40000 as double) else high_freq end as high_freq from ann""",
    "ann",
)
def _(i):
    step = transforms.ApplyIf(c.HasTag("class", "click"), transforms.SetFrequencyBound(40000, "high"))
    return transforms.transform_events(tagged(i.ann), step).select("ann_id", "low_freq", "high_freq")


@pair(
    "trf05_apply_all",
    """with s1 as (select ann_id, cast(30000 as double) as low_freq, greatest(high_freq, 30000) as high_freq, class_name from ann),
    s2 as (select ann_id, case when high_freq > 60000 then least(low_freq, 60000) else low_freq end as low_freq,
      case when high_freq > 60000 then cast(60000 as double) else high_freq end as high_freq,
      case when class_name = 'click' then 'tap' else class_name end as class_name from s1)
    select ann_id, low_freq, high_freq, case when class_name = 'tap' then 'knock' else class_name end as class_name from s2""",
    "ann",
)
def _(i):
    steps = transforms.ApplyAll([
        transforms.SetFrequencyBound(30000),
        transforms.ApplyIf(c.Frequency("gt", "high", 60000), transforms.SetFrequencyBound(60000, "high")),
        transforms.MapTagValue("class", {"click": "tap"}),
        transforms.ReplaceTag(("class", "tap"), ("class", "knock")),
    ])
    rows = transforms.transform_events(tagged(i.ann), steps)
    name = F.get(F.filter("tags", lambda t: t["key"] == "class"), F.lit(0))["value"]
    return rows.select("ann_id", "low_freq", "high_freq", name.alias("class_name"))


@pair(
    "trf06_output_steps",
    """with shifted as (select d.*, start_time + 2.5 as s, end_time + 2.5 as e from det d)
    select det_id, round(s, 6) as start_time, round(e, 6) as end_time from shifted
    where e - s between 0.0035 and 1 and (low_freq >= 30000 or high_freq <= 25000) and s >= 2.6 and e <= 12.4""",
    "det",
)
def _(i):
    clips = i.clips.withColumns({"clip_start": F.col("clip_start") + 2.5, "clip_end": F.col("clip_end") + 2.5})
    out = transforms.output_steps(
        i.det, clips,
        [lambda d: filters.by_duration(d, 0.0035, 1.0), lambda d: filters.by_frequency(d, 30000, 25000)],
        [lambda d: filters.away_from_edges(d, clips, 0.1)],
    )
    return out.select("det_id", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@pair(
    "trf07_standardize_low_freq",
    """with m as (select avg(low_freq) as lo, avg(high_freq) as hi from ann where class_name = 'click')
    select ann_id, round(case when class_name='click' then lo else low_freq end, 6) as low_freq,
    round(case when class_name='click' and high_freq < lo then hi else high_freq end, 6) as high_freq from ann, m""",
    "ann",
)
def _(i):
    return transforms.standardize_low_freq(i.ann, "click").select(
        "ann_id", F.round("low_freq", 6).alias("low_freq"), F.round("high_freq", 6).alias("high_freq")
    )


@pair(
    "trf08_genus_rollup",
    """select det_id, round(s_purchase, 6) as barbastella, round(s_click + s_signup, 6) as myotis from det""",
    "det",
)
def _(i):
    from .base import scored

    names = ["Myotis alcathoe", "Barbastella barbastellus", "Myotis brandtii"]
    rows = transforms.genus_rollup(scored(i.det), names)
    return rows.select(
        "det_id", F.round(F.get("class_scores", F.lit(0)), 6).alias("barbastella"),
        F.round(F.get("class_scores", F.lit(1)), 6).alias("myotis"),
    )
