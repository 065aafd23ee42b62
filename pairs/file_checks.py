"""Sources and sinks on files written from the test tables.

Each query writes its input to a fresh path in the shared checkpoint folder and
reads it back through the scan under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chirpframe import plugins
from chirpframe.operators import filters, projections
from chirpframe.plans.session import shared_path
from chirpframe.sources import annotations, audio, documents, predictions, tables
from chirpframe.sources.ranges import write_file

from .base import CLASSES, pair, scored, tagged
from .dataset_checks import LONG, _nested

def _file_each(rows, path: str, suffix: str) -> str:
    """Write ``value`` of each row (k, value) to a file of its own in one of 64 folders: tasks write, so the driver moves no files."""

    def run(batches):
        for batch in batches:
            for k, value in zip(batch["k"].tolist(), batch["value"].tolist()):
                write_file(f"{path}/part={k % 64}/k={k}.{suffix}", [value.encode()])
            yield batch[["k"]]

    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(parts, "k").mapInPandas(run, "k long").agg(F.count(F.lit(1))).collect()
    return path


DOCS = """doc as (select s_suppkey as k, 'rec' || cast(s_suppkey as varchar) || '.wav' as id, s_suppkey%5 <> 0 as annotated, s_suppkey%7 = 0 as issues,
      s_suppkey%11 = 0 as broken from supplier)"""


def _supplier_documents(i):
    """One document per supplier, two events each; some un-annotated, with issues, or without their class name."""
    k = F.col("s_suppkey")

    def event(shift):
        return F.struct(
            F.lit("Myotis").alias("class"), F.lit("Echolocation").alias("event"), (k % 3).alias("individual"),
            (k % 10 / 10 + shift).alias("start_time"), (k % 10 / 10 + shift + 0.05).alias("end_time"),
            F.lit(2e4).alias("low_freq"), (F.lit(3e4) + k).alias("high_freq"),
        )

    return i.supplier.select(
        k.alias("k"), F.concat(F.lit("rec"), k.cast("string"), F.lit(".wav")).alias("id"), F.lit(1.5).alias("duration"),
        F.lit(1.0).alias("time_exp"), F.when(k % 11 != 0, "Myotis").alias("class_name"),
        (k % 5 != 0).alias("annotated"), (k % 7 == 0).alias("issues"), F.lit("").alias("notes"),
        F.array(event(0.0), event(0.5)).alias("annotation"),
    )


def _document_text(i):
    rows = _supplier_documents(i)
    return rows.select("k", F.to_json(F.struct(*[c for c in rows.columns if c != "k"])).alias("value"))


@pair(
    "src01_read_files",
    f"""with {DOCS}, ev as (select k, id, k%10/cast(10 as double) as s from doc where annotated and not issues and not broken union all
      select k, id, k%10/cast(10 as double) + 0.5 from doc where annotated and not issues and not broken)
    select id, round(s, 6) as start_time, cast(30000 + k as double) as high_freq, cast(k%3 as varchar) as individual from ev""",
)
def _(i):
    path = _file_each(_document_text(i), shared_path(i.spark, "documents"), "json")  # one document per file
    files = annotations.read_files(i.spark, f"{path}/*")
    rows = projections.file_events(files)
    individual = F.get(F.filter("tags", lambda t: t["key"] == "individual"), F.lit(0))["value"]
    return rows.select("id", F.round("start_time", 6).alias("start_time"), "high_freq", individual.alias("individual"))


@pair("src02_read_merged", f"with {DOCS} select id, issues from doc where annotated and not broken")
def _(i):
    whole = F.struct(*[c for c in _supplier_documents(i).columns if c != "k"])
    lists = _supplier_documents(i).groupBy(F.floor(F.col("k") / 50).alias("part")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(whole)), ","), F.lit("]")).alias("value")
    )
    # one list of 50 documents per file
    path = _file_each(lists.select(F.col("part").alias("k"), "value"), shared_path(i.spark, "merged"), "json")
    # ranges far shorter than a list, so that lists are cut
    return annotations.read_merged(i.spark, path, exclude_issues=False, range_bytes=4096).select("id", "issues")


@pair("src04_read_tree", f"with {DOCS} select id, '/audio/' || id as file_path from doc where annotated and not issues and not broken")
def _(i):
    path = _file_each(_document_text(i), shared_path(i.spark, "tree"), "json")
    return annotations.read_tree(i.spark, path, "/audio/", filter_issues=True).select("id", "file_path")


@pair(
    "src05_read_calls",
    """select 'Not Bat' as class, round(l_quantity / 1000, 5) as start_time, round((l_quantity + l_linenumber) / 1000, 5) as end_time,
    round(l_tax * 1000, 2) as low_freq, round(l_discount * 1000, 2) as high_freq, round(l_extendedprice, 2) as feature from lineitem""",
)
def _(i):
    path = shared_path(i.spark, "calls")
    i.lineitem.select(
        F.lit("x").alias("Filename"), F.lit("1").alias("Version"), F.col("l_orderkey").alias("CallNum"),
        F.col("l_quantity").alias("StTime"), F.col("l_linenumber").alias("Dur"), F.lit(0).alias("PrevSt"),
        F.col("l_discount").alias("Fmax"), F.col("l_tax").alias("Fmin"), F.col("l_extendedprice").alias("Energy"),
    ).write.option("sep", "\t").option("header", True).csv(path)
    calls = tables.read_calls_ms(i.spark, path, ["Energy"])
    return calls.select("class", "start_time", "end_time", "low_freq", "high_freq", F.round(F.get("features", F.lit(0)), 2).alias("feature"))


@pair(
    "src07_read_lists",
    """select 'txt' as format, cast(doc_id as varchar) as value from labels union all select 'csv', n_name from nation
    union all select 'json', r_name from region""",
)
def _(i):
    txt, csv, js = (shared_path(i.spark, f"list-{n}") for n in ("txt", "csv", "json"))
    padded = F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit(" "))
    i.labels.select(padded.alias("value")).unionByName(i.labels.select(F.lit(" ").alias("value"))).write.text(txt)
    i.nation.select("n_nationkey", "n_name").write.option("header", True).csv(csv)
    names = i.region.agg(F.to_json(F.struct(F.collect_list("r_name").alias("ids"))).alias("value"))  # five regions
    names.coalesce(1).write.text(js)
    parts = {
        "txt": tables.read_list(i.spark, txt, "txt"), "csv": tables.read_list(i.spark, csv, "csv", column="n_name"),
        "json": tables.read_list(i.spark, js, "json", field="ids"),
    }
    from chirpframe.operators.reports import union_all

    return union_all([frame.select(F.lit(n).alias("format"), "value") for n, frame in parts.items()])


@pair(
    "snk01_save_and_load_rows",
    """select cast(det_id as bigint) as det_id, cast(clip_id as varchar) as clip_uuid, round(detection_score, 6) as detection_score, round(start_time, 6) as start_time,
    high_freq, round(s_purchase, 6) as purchase, path, cast(samplerate as integer) as samplerate
    from det join recordings on recording_id = clip_id""",
    "det recordings",
)
def _(i):
    clips = i.clips.withColumn("recording_id", F.col("clip_id"))
    dets = scored(i.det).withColumn("features", F.array(F.col("det_id").cast("double")))
    rec = i.recordings.withColumn("path", F.concat(F.lit("/data/"), "path"))
    path = shared_path(i.spark, "detections")
    predictions.save_rows(predictions.detection_rows(dets, clips, rec, audio_dir="/data"), path)
    back = predictions.load_rows(i.spark, path, 3)
    return back.select(
        F.get("features", F.lit(0)).cast("bigint").alias("det_id"), "clip_uuid", F.round("detection_score", 6).alias("detection_score"),
        F.round("start_time", 6).alias("start_time"), "high_freq", F.round(F.get("class_scores", F.lit(1)), 6).alias("purchase"),
        "recording.path", "recording.samplerate",
    )


@pair(
    "snk02_group_by_clip",
    """select cast(clip_id as varchar) as clip_uuid, cast(count(*) over (partition by clip_id) as bigint) as n,
    cast(row_number() over (partition by clip_id order by detection_score desc, start_time desc, low_freq desc, end_time desc, high_freq desc) - 1 as integer) as place,
    round(detection_score, 6) as score, round(start_time, 6) as start_time, low_freq, round(end_time, 6) as end_time, high_freq, cast(0 as double) as class_sum, path
    from det join recordings on recording_id = clip_id""",
    "det recordings",
)
def _(i):
    """Every detection at its place in the nested list of its clip."""
    clips = i.clips.withColumn("recording_id", F.col("clip_id"))
    rows = predictions.detection_rows(scored(i.det), clips, i.recordings, include_class_scores=False, include_features=False)
    path = shared_path(i.spark, "slim")
    predictions.save_rows(rows, path)
    nested = predictions.group_by_clip(predictions.load_rows(i.spark, path, 3))
    each = nested.select("clip_uuid", F.size("detections").cast("bigint").alias("n"), "recording.path", F.posexplode("detections").alias("place", "d"))
    return each.select(
        "clip_uuid", "n", "place", F.round("d.detection_score", 6).alias("score"), F.round("d.start_time", 6).alias("start_time"), "d.low_freq",
        F.round("d.end_time", 6).alias("end_time"), "d.high_freq",
        F.aggregate("d.class_scores", F.lit(0.0), lambda a, x: a + x).alias("class_sum"), "path")


@pair(
    "snk04_detection_csv",
    f"""with {LONG}, top as (select det_id, class_name, score, row_number() over (partition by det_id order by score desc, class_idx) as r from lng),
    cs as (select cast(d.clip_id as varchar) || '.csv' as file, round(detection_score, 3) as det_prob, round(start_time, 4) as start_time, round(end_time, 4) as end_time,
      cast(high_freq as integer) as high_freq, cast(low_freq as integer) as low_freq, class_name as class, round(score, 3) as class_prob
      from det d join top on top.det_id = d.det_id and r = 1)
    select *, row_number() over (partition by file order by det_prob desc, start_time, low_freq, end_time, high_freq, class) - 1 as "index" from cs""",
    "det",
)
def _(i):
    """A file per recording with an index column."""
    path = shared_path(i.spark, "csv")
    rows = predictions.document_rows(scored(i.det).withColumnRenamed("clip_id", "recording_id"), CLASSES)
    predictions.save_detection_csv(rows, path)
    schema = "index bigint, det_prob double, start_time double, end_time double, high_freq int, low_freq int, `class` string, class_prob double"
    back = i.spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return back.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


@pair(
    "snk05_feature_csv",
    """select 'rec' || cast(label as varchar) || '_cnn_features.csv' as file, printf('%.5f', cast(embedding[1] as double)) as "0",
    printf('%.5f', cast(embedding[2] as double)) as "1", printf('%.5f', cast(embedding[3] as double)) as "2", count(*) as n from embeddings group by all""",
)
def _(i):
    path = shared_path(i.spark, "features")
    rows = i.embeddings.select(
        F.concat(F.lit("rec"), F.col("label").cast("string")).alias("recording_id"), F.col("vec_id").alias("det_id"), F.col("embedding").alias("features"))
    predictions.save_feature_csv(rows, 3, path)
    back = i.spark.read.schema("`0` string, `1` string, `2` string").option("header", True).csv(path)
    return back.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).groupBy("file", "0", "1", "2").agg(
        F.count(F.lit(1)).alias("n"))


@pair(
    "snk09_annotation_set",
    """select cast(event_id as varchar) as clip_id, cast(event_id * 2 + k as varchar) as ann_id, event_type as value, cast(user_id as varchar) as clip_tag,
    round(cast(0.1 as double) + k, 6) as start_time, round(cast(0.2 as double) + k, 6) as end_time, cast(20000 + event_id%9*1000 + k as double) as low_freq,
    cast(60000 as double) as high_freq, 'BoundingBox' as geom_type, cast(event_id as varchar) || '.wav' as path, cast(3 as double) as clip_end, 'n' || cast(event_id as varchar) as note
    from events, (select unnest([0, 1]) as k) x""",
)
def _(i):
    """Written as one document of collections and read back through the scan of projects."""
    path = f"{shared_path(i.spark, 'set')}/events.json"
    clips = _nested(0)(i).unionByName(_nested(1)(i)).withColumns({
        "path": F.concat(F.col("clip_id").cast("string"), F.lit(".wav")), "duration": F.lit(3.0), "samplerate": F.lit(8000),
        "clip_start": F.lit(0.0), "clip_end": F.lit(3.0), "notes": F.array(F.concat(F.lit("n"), F.col("clip_id").cast("string")))})
    annotations.save_annotation_set(clips, path, name="events")
    back = annotations.load_project_clips(i.spark, path).withColumn("e", F.explode("events"))
    name = lambda tags, key: F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]
    return back.select(
        "clip_id", "e.ann_id", name("e.tags", "class").alias("value"), name("tags", "user").alias("clip_tag"),
        F.round("e.start_time", 6).alias("start_time"), F.round("e.end_time", 6).alias("end_time"), "e.low_freq", "e.high_freq",
        "e.geom_type", "path", "clip_end", F.get("notes", F.lit(0)).alias("note"))


@pair(
    "snk06_prediction_set",
    f"""with {LONG}, cl as (select det_id, class_name, score, row_number() over (partition by det_id order by score desc, class_idx) as r from lng)
    select d.det_id, path, cast(d.clip_id as varchar) as clip_id, round(d.start_time, 6) as start_time, d.high_freq, round(detection_score, 6) as score, r, class_name as tag, round(cl.score, 6) as tag_score
    from det d join recordings on recording_id = d.clip_id join cl on cl.det_id = d.det_id and r <= 2
    union all select d.det_id, path, cast(d.clip_id as varchar), round(d.start_time, 6), d.high_freq, round(detection_score, 6), 0, 'Echolocation', round(detection_score, 6)
    from det d join recordings on recording_id = d.clip_id""",
    "det recordings",
)
def _(i):
    """Scored tags of every detection, through the written document and back."""
    path = f"{shared_path(i.spark, 'predictions')}/set.json"
    dets = predictions.prediction_tags(
        scored(i.det), CLASSES, {c: [("class", c)] for c in CLASSES}, [("event", "Echolocation")], top_k=2)
    clips = i.clips.withColumn("recording_id", F.col("clip_id"))
    numbered = dets.withColumn("high_freq", F.col("high_freq") + F.col("det_id") / 1e7)  # the id travels in the box
    documents.save_prediction_set(numbered, clips.join(i.recordings.select("recording_id"), "recording_id"), i.recordings, path)
    back = documents.read_prediction_set(i.spark, path).select("*", F.posexplode("tags").alias("r", "t"))
    high = F.get("box", F.lit(3))
    return back.select(
        F.round((high - F.floor(high)) * 1e7).cast("bigint").alias("det_id"), "path", "clip_id", F.round(F.get("box", F.lit(0)), 6).alias("start_time"),
        F.floor(high).cast("double").alias("high_freq"), F.round("score", 6).alias("score"), F.col("r").cast("bigint").alias("r"),
        F.col("t.value").alias("tag"), F.round("t.score", 6).alias("tag_score"))


@pair(
    "snk10_save_metrics",
    """select 'lang/' || lang as name, cast(count(*) as double) as value from documents group by lang""",
)
def _(i):
    path = shared_path(i.spark, "metrics")
    counts = i.documents.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("value"))
    predictions.save_metrics(counts.select(F.concat(F.lit("lang/"), "lang").alias("name"), "value"), path)
    return i.spark.read.schema("name string, value double").json(path)


# --- audio: WAV files made of bytes below 128, so that they can be written as text ---------------

WAVES = """w as (select s_suppkey as k, s_suppkey%4 as v, 16 + s_suppkey%24 as n, case s_suppkey%4 when 0 then 8 when 2 then 24 else 16 end as bits from supplier)"""


def _wave_files(i) -> str:
    """One file per supplier: 8 bit; 16 bit after a JUNK chunk; 24 bit with "data" in a comment; an unknown code."""
    k, v, n = F.col("k"), F.col("k") % 4, F.lit(16) + F.col("k") % 24
    byte = lambda x: F.char(x if hasattr(x, "cast") else F.lit(x))
    long = lambda x: F.concat(byte(x), byte(0), byte(0), byte(0))
    low = lambda j: byte((k * 7 + j * 3) % 128)
    middle, high = (lambda j: byte((k + j) % 100)), (lambda j: byte((j * 5) % 90))
    width = F.when(v == 0, 1).when(v == 2, 3).otherwise(2)
    sample = lambda j: F.concat(
        low(j), F.when(v == 0, "").otherwise(middle(j)), F.when(v == 2, high(j)).otherwise("")
    )
    form = F.concat(
        F.lit("fmt "), long(16), byte(F.when(v == 3, 85).otherwise(1)), byte(0), byte(1), byte(0), byte(0x40), byte(0x1F),
        *[byte(0)] * 8, byte(width * 8), byte(0),
    )
    content = F.concat(
        F.lit("RIFF"), long(0), F.lit("WAVE"), F.when(v == 1, F.concat(F.lit("JUNK"), long(33), F.lit("x" * 34))).otherwise(""),
        form, F.when(v == 2, F.concat(F.lit("LIST"), long(24), F.lit("comment with data inside"))).otherwise(""),
        F.lit("data"), long(n * width), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), sample), ""),
    )
    rows = i.supplier.select(F.col("s_suppkey").alias("k")).select("k", F.concat(content, F.lit("\n")).alias("value"))
    return _file_each(rows, shared_path(i.spark, "waves"), "txt")


def _number(path):
    return F.regexp_extract(path, "k=([0-9]+)", 1).cast("bigint")


@pair(
    "src08_catalogue",
    f"""with {WAVES} select k, v <> 3 as readable, case when v <> 3 then cast(n as bigint) end as n_samples, case when v <> 3 then cast(bits as integer) end as bits,
    case when v <> 3 then cast(8000 as integer) end as samplerate, case when v <> 3 then round(n / cast(8000 as double), 6) end as duration from w""",
)
def _(i):
    good, bad = audio.catalogue(i.spark, _wave_files(i), "*.txt")
    none = lambda kind: F.lit(None).cast(kind)
    return good.select(
        _number(F.col("path")).alias("k"), F.lit(True).alias("readable"), "n_samples", "bits", "samplerate", F.round("duration", 6).alias("duration"),
    ).union(bad.select(_number(F.col("path")), F.lit(False), none("bigint"), none("int"), none("int"), none("double")))


@pair(
    "src09_clip_samples",
    f"""with {WAVES}, s as (select k, v, unnest(range(0, n)) as j from w where v <> 3),
    x as (select k, j, case v when 0 then ((k*7 + j*3)%128 - 128) / cast(128 as double)
      when 1 then ((k*7 + j*3)%128 + 256 * ((k + j)%100)) / cast(32768 as double)
      else ((k*7 + j*3)%128 + 256 * ((k + j)%100) + 65536 * ((j*5)%90)) / cast(8388608 as double) end as x from s)
    select k, cast(j as bigint) as idx, round(x, 6) as x from x""",
)
def _(i):
    chunks = audio.sample_chunks(i.spark, _wave_files(i), 0.001, "*.txt")
    rows = audio.chunk_samples(chunks, 0.001)
    return rows.select(_number(F.col("recording_id")).alias("k"), "idx", F.round(F.col("x").cast("double"), 6).alias("x"))


# --- annotation sets and projects ---------------------------------------------------------------

@pair(
    "src03_project",
    """with d as (select s_suppkey as k, s_suppkey%5 as g, (s_suppkey%50) / cast(100 as double) as t, cast(20 + s_suppkey%30 as double) as f from supplier
      where s_suppkey%2 = 0 or s_suppkey%3 = 0)
    select k, case g when 0 then 'BoundingBox' when 1 then 'Polygon' when 2 then 'LineString' when 3 then 'Point' else 'TimeInterval' end as geom_type,
    round(t, 6) as start_time, case when g <> 4 then case when g = 2 then f - 8 else f end end as low_freq,
    round(case g when 0 then t + 0.25 when 1 then t + 0.5 when 2 then t + 0.25 when 3 then t else t + 0.25 end, 6) as end_time,
    case g when 0 then f + 10 when 1 then f + 9 when 2 then f when 3 then f end as high_freq, 'Echolocation' as event from d""",
)
def _(i):
    k = F.col("k")
    t, f, g = k % 50 / 100, F.lit(20) + k % 30, k % 5
    text = lambda *parts: F.concat(*[p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts])
    kind = F.when(g == 0, "BoundingBox").when(g == 1, "Polygon").when(g == 2, "LineString").when(g == 3, "Point").otherwise("TimeInterval")
    shape = (
        F.when(g == 0, text("[", t, ",", f, ",", t + 0.25, ",", f + 10, "]"))
        .when(g == 1, text("[[[", t, ",", f, "],[", t + 0.5, ",", f + 5, "],[", t + 0.25, ",", f + 9, "]]]"))
        .when(g == 2, text("[[", t + 0.25, ",", f, "],[", t, ",", f - 8, "]]"))
        .when(g == 3, text("[", t, ",", f, "]")).otherwise(text("[", t, ",", t + 0.25, "]"))
    )
    document = text(
        '{"data":{"uuid":"d', k, '","collection_type":"', F.when(k % 2 == 0, "annotation_set").otherwise("annotation_project"),
        '","tags":[{"id":0,"key":"event","value":"Echolocation"}],"recordings":[{"uuid":"r', k, '","path":"', k,
        '.wav","duration":1.0,"channels":1,"samplerate":8000,"tags":[]}],"clips":[{"uuid":"k', k, '","recording":"r', k,
        '","start_time":0.0,"end_time":1.0}],"sound_events":[{"uuid":"s', k, '","recording":"r', k, '","geometry":{"type":"', kind,
        '","coordinates":', shape, '}}],"sound_event_annotations":[{"uuid":"n', k, '","sound_event":"s', k,
        '","tags":[0]}],"clip_annotations":[{"uuid":"c', k, '","clip":"k', k, '","tags":[],"sound_events":["n', k,
        '"],"notes":[]}],"tasks":[{"uuid":"t', k, '","clip":"k', k, '","status_badges":[',
        F.when(k % 3 == 0, '{"state":"completed"}').otherwise(""), "]}]}}",
    )
    rows = i.supplier.select(F.col("s_suppkey").alias("k")).select("k", document.alias("value"))
    path = _file_each(rows, shared_path(i.spark, "projects"), "json")
    clips = annotations.load_project_clips(i.spark, f"{path}/*")
    return clips.select(F.explode("events").alias("e"), "clip_annotation_id").select(
        F.substring("clip_annotation_id", 2, 20).cast("bigint").alias("k"), "e.geom_type",
        *[F.round(F.col(f"e.{c}"), 6).alias(c) for c in ("start_time", "low_freq", "end_time", "high_freq")],
        F.get("e.tags", F.lit(0))["value"].alias("event"),
    )


# --- plug-ins -----------------------------------------------------------------------------------

@pair("udf01_condition_by_path", "select ann_id from ann where not is_target", "ann")
def _(i):
    social = plugins.load("chirpframe.functions.conditions.HasTag", key="event", value="Social")
    return filters.keep(tagged(i.ann), social).select("ann_id")


@pair("udf02_registered_scorer", "select event_id as ann_id, round(sqrt(cast(value as double)), 6) as score from events")
def _(i):
    plugins.register_scorer(i.spark, "root_score", _root, "double")
    i.events.createOrReplaceTempView("events_to_score")
    return i.spark.sql("select event_id as ann_id, round(root_score(value), 6) as score from events_to_score")


def _root(values):
    return values.astype(float) ** 0.5
