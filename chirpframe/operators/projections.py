"""Projections: documents to rows, normalised names, ids and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.conditions import tag_struct
from ..schemas import TAGS

# Term names of tag keys and labels of missing values.
KEY_ALIASES = {
    "class": "soundevent:class",
    "individual": "soundevent:individual",
    "event": "soundevent:call_type",
    "call_type": "soundevent:call_type",
    "source": "dcterms:source",
}
SOURCE_KEY = "dcterms:source"
UNKNOWN_CLASS = "__UNKNOWN__"
SPECIES_KEY = "species"


def _field(name: str):
    return lambda entry: entry[name]


def event_tags(
    label: Column, event: Column, individual: Column,
    label_key: str = "class", event_key: str = "event", individual_key: str = "individual",
) -> Column:
    """Tags of one event; empty class or event adds none."""

    def tag(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    every = F.array(
        tag(label_key, F.nullif(label, F.lit(""))),
        tag(event_key, F.nullif(event, F.lit(""))),
        tag(individual_key, individual),
    )
    return F.filter(every, lambda t: t["value"].isNotNull())


def file_events(files: DataFrame, **keys: str) -> DataFrame:
    """One row per annotated event of a file document, box geometry, tags and ids.

    Event ids derive from ``recording_id`` when the files carry one.
    """
    rows = files.withColumn("_e", F.explode("annotation"))
    event = F.col("_e")
    individual = F.coalesce(event["individual"], F.lit("0"))
    out = rows.select(
        *[c for c in files.columns if c != "annotation"],
        event["start_time"].alias("start_time"),
        event["end_time"].alias("end_time"),
        event["low_freq"].alias("low_freq"),
        event["high_freq"].alias("high_freq"),
        F.lit("BoundingBox").alias("geom_type"),
        event_tags(event["class"], event["event"], individual, **keys).alias("tags"),
    )
    if "recording_id" in files.columns:
        sound = ids.sound_event_id(F.col("recording_id"), F.col("start_time"), F.col("end_time"))
        out = out.withColumn("sound_event_id", sound).withColumn(
            "ann_id", ids.sound_event_annotation_id(F.col("sound_event_id"))
        )
    return out


def file_clips(files: DataFrame, recordings: DataFrame, file_key: str = "file_name") -> DataFrame:
    """File documents joined to their audio: recording, clip and clip annotation ids.

    Documents without audio drop out. ``recordings`` needs (file_name, hash,
    duration, samplerate). The time expansion of the document scales the rate
    up and the duration down.
    """
    expansion = F.coalesce(F.col("time_exp"), F.lit(1.0))
    audio = recordings.select(
        F.col(file_key).alias("id"), F.col("hash"),
        F.col("samplerate").alias("_rate"), F.col("duration").alias("_length"),
    )
    return (
        files.join(audio, "id")
        .withColumn("recording_id", ids.recording_id(F.col("hash")))
        .withColumn("duration", F.col("_length") / expansion)
        .withColumn("samplerate", (F.col("_rate") * expansion).cast("int"))
        .withColumn("clip_id", ids.whole_clip_id(F.col("recording_id"), F.col("duration")))
        .withColumn("clip_annotation_id", ids.clip_annotation_id(F.col("clip_id")))
        .withColumn(
            "clip_tags",
            F.when(F.col("class_name") != "", F.array(F.struct(
                F.lit("class").alias("key"), F.col("class_name").alias("value"))))
            .otherwise(F.array().cast(TAGS)),
        )
        .drop("_rate", "_length")
    )


def task_status(issues: Column, annotated: Column) -> Column:
    """Badge state of a file: rejected, completed or none."""
    return F.when(F.coalesce(issues, F.lit(False)), "rejected").when(
        F.coalesce(annotated, F.lit(False)), "completed"
    )


def annotation_tasks(files: DataFrame) -> DataFrame:
    state = task_status(F.col("issues"), F.col("annotated"))
    badges = F.filter(F.array(F.struct(state.alias("state"))), lambda b: b["state"].isNotNull())
    return files.select(
        ids.task_id(F.col("id")).alias("task_id"),
        *[c for c in ("clip_id",) if c in files.columns],
        state.alias("state"), badges.alias("badges"),
    )


def annotation_groups(
    events: DataFrame, clips: DataFrame, key: str = "clip_id",
    order: Sequence[str] = ("start_time", "ann_id"),
) -> DataFrame:
    """One row per clip with aligned arrays; a missing class id becomes -1 (0 stays 0).

    ``clips`` may carry ``notes``
    (array of text) and ``tags`` of the recording.
    """
    fields = ("start_time", "end_time", "low_freq", "high_freq", "class_id")
    entry = F.struct(*order, *[
        (F.coalesce("class_id", F.lit(-1)) if f == "class_id" else F.col(f)).alias(f)
        for f in fields if f not in order
    ])
    packed = events.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_events"))
    rows = clips.join(packed, key, "left")
    out = rows.withColumns(
        {
            ("class_ids" if f == "class_id" else f + "s"): F.coalesce(
                F.transform("_events", _field(f)), F.array()
            )
            for f in fields
        }
    ).drop("_events")
    if "notes" in clips.columns:
        out = out.withColumn("notes", F.concat_ws("\n", "notes"))
    if "tags" in clips.columns:
        out = out.withColumn("class_name", recording_class_name(F.col("tags")))
    return out


def recording_class_name(tags: Column) -> Column:
    species = F.filter(tags, lambda t: t["key"] == SPECIES_KEY)
    return F.coalesce(F.get(species, F.lit(0))["value"], F.lit(UNKNOWN_CLASS))


def prediction_events(files: DataFrame, label_key: str = "class", event_key: str = "event") -> DataFrame:
    """Rows of a prediction document: score is ``det_prob``, tags carry their own scores."""
    event = F.col("_e")
    return files.withColumn("_e", F.explode("annotation")).select(
        *[c for c in files.columns if c != "annotation"],
        event["start_time"].alias("start_time"), event["end_time"].alias("end_time"),
        event["low_freq"].alias("low_freq"), event["high_freq"].alias("high_freq"),
        F.lit("BoundingBox").alias("geom_type"),
        event["det_prob"].alias("score"),
        F.array(
            F.struct(F.lit(label_key).alias("key"), event["class"].alias("value"), event["class_prob"].alias("score")),
            F.struct(F.lit(event_key).alias("key"), event["event"].alias("value"), event["det_prob"].alias("score")),
        ).alias("tags"),
    )


def add_source_tag(clips: DataFrame, source: str, column: str = "tags") -> DataFrame:
    return clips.withColumn(column, F.array_append(F.col(column), tag_struct(SOURCE_KEY, source)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def recording_table(clips: DataFrame) -> DataFrame:
    """One row per clip annotation with the metadata of its recording."""
    wanted = ("samplerate", "hash", "path", "date", "time", "latitude", "longitude")
    return clips.select(
        "clip_annotation_id", "recording_id",
        (F.col("clip_end") - F.col("clip_start")).alias("duration"),
        file_name(F.col("path")).alias("filename"),
        *[F.col(c) if c in clips.columns else F.lit(None).alias(c) for c in wanted],
    )


def time_expanded(recordings: DataFrame, factor: str | float = "time_expansion", max_duration: float | None = None) -> DataFrame:
    """Real sample rate and duration of slowed-down recordings, optionally capped."""
    f = F.col(factor) if isinstance(factor, str) else F.lit(float(factor))
    length = F.col("duration") / f
    return recordings.withColumns(
        {
            "samplerate": F.col("samplerate") * f,
            "duration": length if max_duration is None else F.least(length, F.lit(float(max_duration))),
        }
    )


def clean_classes(
    events: DataFrame,
    events_of_interest: Sequence[str] | None = None,
    name_replace: Mapping[str, str] | None = None,
    convert_to_genus: bool = False,
    classes_to_ignore: Sequence[str] | None = None,
    column: str = "class_name",
    event_column: str = "event",
) -> DataFrame:
    """Event whitelist, trim, rename, genus, ignore list – in that order."""
    out = events
    if events_of_interest is not None:
        out = out.where(F.col(event_column).isin(*events_of_interest))
    name = F.trim(F.col(column))
    if name_replace:
        pairs = F.create_map(*[F.lit(x) for kv in name_replace.items() for x in kv])
        name = F.coalesce(F.element_at(pairs, name), name)
    if convert_to_genus:
        name = F.get(F.split(name, " "), F.lit(0))
    out = out.withColumn(column, name)
    if classes_to_ignore is not None:
        out = out.where(~F.col(column).isin(*classes_to_ignore))
    return out


def short_class_name(name: Column, letters: int = 3) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, letters)), " ")


def genus_mapping(classes: DataFrame, column: str = "class_name") -> DataFrame:
    """class → (genus, genus index); the index follows sorted genus names.

    The window runs over distinct genera of a class list, not over events.
    """
    from pyspark.sql import Window

    names = classes.select(column).distinct().withColumn("genus", F.get(F.split(column, " "), F.lit(0)))
    index = names.select("genus").distinct().withColumn(
        "genus_index", (F.row_number().over(Window.orderBy("genus")) - 1).cast("int")
    )
    return names.join(index, "genus").select(column, "genus", "genus_index")


def normalized_keys(tags: Column) -> Column:
    """Alias keys of a tag array replaced by full term names."""
    aliases = F.create_map(*[F.lit(x) for kv in KEY_ALIASES.items() for x in kv])
    return F.transform(
        tags,
        lambda t: F.struct(
            F.coalesce(F.element_at(aliases, t["key"]), t["key"]).alias("key"), t["value"].alias("value")
        ),
    )


def drop_padding(files: DataFrame, arrays: Sequence[str], valid: str = "is_valid") -> DataFrame:
    """Remove padded entries of aligned arrays by their validity flag."""
    zipped = F.filter(F.arrays_zip(valid, *arrays), lambda x: x[valid] == 1)
    return files.withColumn("_z", zipped).withColumns(
        {a: F.transform("_z", _field(a)) for a in arrays}
    ).drop("_z", valid)
