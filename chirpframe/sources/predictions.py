"""Detections in and out: Parquet rows, wide layout, result documents, CSV, prediction sets."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as class_scores
from ..functions.conditions import Tag
from ..operators.aggregates import recording_class
from ..operators.detections import best_class_rows
from ..plans.ordered import order_rows, with_rank
from ..schemas import DETECTION_ROW, RECORDING_INFO
from .ranges import write_file

BOX = ("start_time", "low_freq", "end_time", "high_freq")
# Texts and columns of result documents.
EVENT_NAME = "Echolocation"
ANNOTATION_NOTE = "Automatically generated."
LABEL_KEY = "dwc:scientificName"
CSV_COLUMNS = ("det_prob", "start_time", "end_time", "high_freq", "low_freq", "class", "class_prob")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``: an absolute path outside fails, a shared relative prefix is stripped."""
    base = root.rstrip("/")
    inside = path.startswith(base + "/")
    outside = F.raise_error(F.concat(path, F.lit(f" lies outside {base}"))).cast("string")
    cut = path.substr(F.lit(len(base) + 2), F.length(path))
    return F.when(inside, cut).when(path.startswith("/"), outside).otherwise(path)


# --- one row per detection -------------------------------------------------

def box_json() -> Column:
    return F.to_json(F.struct(F.lit("BoundingBox").alias("type"), F.array(*BOX).alias("coordinates")))


def detection_rows(
    dets: DataFrame, clips: DataFrame, recordings: DataFrame, audio_dir: str | None = None,
    include_class_scores: bool = True, include_features: bool = True, include_geometry: bool = True,
) -> DataFrame:
    """Storage rows; the switches leave column groups out."""
    known = [c.split(" ")[0] for c in RECORDING_INFO.split(", ") if c.split(" ")[0] in recordings.columns and c.split(" ")[0] not in ("uuid", "path")]
    path = relative_path(F.col("path"), audio_dir) if audio_dir is not None else F.col("path")
    info = recordings.select(
        "recording_id",
        F.to_json(F.struct(F.col("recording_id").cast("string").alias("uuid"), path.alias("path"), *known)).alias("recording_info"),
    )
    placed = clips.select("clip_id", "recording_id", F.col("clip_start").alias("clip_start_time"), F.col("clip_end").alias("clip_end_time"))
    rows = dets.join(placed, "clip_id").join(info, "recording_id")
    columns = [F.col("clip_id").cast("string").alias("clip_uuid"), "clip_start_time", "clip_end_time", "recording_info", "detection_score"]
    if include_geometry:
        shape = F.coalesce("geometry", box_json()) if "geometry" in dets.columns else box_json()
        columns += [*BOX, shape.alias("geometry")]
    if include_class_scores:
        columns.append("class_scores")
    if include_features:
        columns.append("features")
    return rows.select(*columns)


def save_rows(rows: DataFrame, path: str) -> bool:
    """Write as Parquet; nothing is written when there are no rows."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def load_rows(spark: SparkSession, path: str, num_classes: int) -> DataFrame:
    """Stored detections. Missing shape → box, missing scores → zeros, missing features → empty."""
    raw = spark.read.schema(DETECTION_ROW).parquet(path)
    return raw.withColumns(
        {
            "recording": F.from_json("recording_info", RECORDING_INFO),
            "geometry": F.coalesce(F.nullif("geometry", F.lit("")), box_json()),
            "class_scores": F.coalesce("class_scores", F.array_repeat(F.lit(0.0), num_classes)),
            "features": F.coalesce("features", F.array().cast("array<double>")),
        }
    )


def group_by_clip(rows: DataFrame) -> DataFrame:
    """Nested form, one row per clip, best detection first. The flat form has no long rows; prefer it for long clips."""
    det = F.struct("detection_score", *BOX, "geometry", "class_scores", "features")
    return rows.groupBy("clip_uuid").agg(
        F.first("clip_start_time").alias("clip_start_time"), F.first("clip_end_time").alias("clip_end_time"),
        F.first("recording").alias("recording"), F.sort_array(F.collect_list(det), asc=False).alias("detections"),
    )


# --- wide layout -----------------------------------------------------------

def wide_rows(dets: DataFrame, class_names: Sequence[str], include_class_scores: bool = True, include_features: bool = True, include_geometry: bool = True) -> DataFrame:
    """Add the top class; the score matrix, features and shape can be left out."""
    index = class_scores.top_index(F.col("class_scores"))
    out = dets.withColumns(
        {
            "top_class": class_scores.class_at(class_names, index),
            "top_class_score": class_scores.top_score(F.col("class_scores")),
        }
    )
    gone = [c for c, keep in (("class_scores", include_class_scores), ("features", include_features), ("geometry", include_geometry)) if not keep]
    return out.drop(*gone)


def read_wide(rows: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Rebuild a missing score array from the top class alone."""
    if "class_scores" in rows.columns:
        return rows
    return rows.withColumn(
        "class_scores", class_scores.rebuild_scores(F.col("top_class"), F.col("top_class_score"), class_names)
    )


# --- result documents ------------------------------------------------------

def class_labels(
    class_names: Sequence[str], decoding: Mapping[str, Sequence[Tag]], mode: str = "decoded_tag",
    key: str = LABEL_KEY, fallback: bool = True,
) -> list[str]:
    """Shown name per class: the class name, or the value of its decoded tag."""
    if mode == "class_name":
        return list(class_names)
    labels = []
    for name in class_names:
        values = [v for k, v in decoding.get(name, ()) if k == key]
        if not values and not fallback:
            raise ValueError(f"class {name!r} decodes to no tag with key {key!r}")
        labels.append(values[0] if values else name)
    return labels


def document_rows(dets: DataFrame, labels: Sequence[str], event_name: str = EVENT_NAME) -> DataFrame:
    """Flat result rows in document form, still one row per detection."""
    return best_class_rows(dets, labels).withColumns(
        {"individual": F.lit("-1"), "event": F.lit(event_name)}
    )


FALLING = [("detection_score", True), *[(c, True) for c in BOX]]


def _entries(dets: DataFrame, labels: Sequence[str], event_name: str, key: str, cnn_features: bool) -> DataFrame:
    """(key, _score and _box columns, doc): one document entry per detection."""
    keep = [key, "detection_score", *BOX, "class_scores", *(["features"] if cnn_features else [])]
    rows = document_rows(dets.select(*keep).withColumns({f"_{c}": F.col(c) for c, _ in FALLING}), labels, event_name)
    names = ["start_time", "end_time", "low_freq", "high_freq", "class_prob", "det_prob", "individual", "event", "class"]
    if cnn_features:
        names.append("features")
    return rows.select(key, *[f"_{c}" for c, _ in FALLING], F.struct(*sorted(names)).alias("doc"))


def _rest(recordings: DataFrame, note: str, include_file_path: bool) -> tuple[Column, list[Column]]:
    """(document id, fields that follow the annotations)."""
    name = F.element_at(F.split("path", "/"), -1)
    expansion = F.col("time_expansion") if "time_expansion" in recordings.columns else F.lit(1.0)
    fields = [F.coalesce("recording_class", F.lit("None")).alias("class_name"), F.round("duration", 4).alias("duration")]
    if include_file_path:
        fields.append(F.col("path").alias("file_path"))
    fields += [name.alias("id"), F.lit(False).alias("issues"), F.lit(note).alias("notes"), expansion.alias("time_exp")]
    return name, fields


def result_documents(
    dets: DataFrame, recordings: DataFrame, labels: Sequence[str], save_if_empty: bool = False,
    event_name: str = EVENT_NAME, note: str = ANNOTATION_NOTE, key: str = "recording_id",
    cnn_features: bool = False, include_file_path: bool = False,
) -> DataFrame:
    """One document per recording: (recording_id, id, document JSON), entries in falling (score, bounds) order.

    A document is one value here; ``document_lines`` is the form for writing, which never holds a whole list.
    """
    entry = F.struct(*[F.col(f"_{c}").alias(f"o_{c}") for c, _ in FALLING], "doc")
    lists = _entries(dets, labels, event_name, key, cnn_features).groupBy(key).agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("_l")
    ).select(key, F.transform("_l", lambda e: e["doc"]).alias("annotation"))
    best = recording_class(dets, labels, key)
    joined = recordings.join(lists, key, "left" if save_if_empty else "inner").join(best, key, "left")
    kind = lists.schema["annotation"].dataType.simpleString()
    name, rest = _rest(recordings, note, include_file_path)
    fields = [F.lit(False).alias("annotated"), F.coalesce("annotation", F.array().cast(kind)).alias("annotation"), *rest]
    return joined.select(key, name.alias("id"), F.to_json(F.struct(*fields)).alias("document"))


def document_lines(
    dets: DataFrame, recordings: DataFrame, labels: Sequence[str], save_if_empty: bool = False,
    event_name: str = EVENT_NAME, note: str = ANNOTATION_NOTE, key: str = "recording_id",
    cnn_features: bool = False, include_file_path: bool = False,
) -> DataFrame:
    """The documents of ``result_documents`` as lines (recording_id, position, line): head, one per entry, foot.

    Entries are ranked over ranges of (recording, score, bounds), so a recording of any size is cut across tasks.
    """
    entries = _entries(dets, labels, event_name, key, cnn_features)
    ranked = with_rank(order_rows(entries, [key], [(f"_{c}", down) for c, down in FALLING]), "position").clean()
    body = ranked.select(
        key, "position", F.concat(F.when(F.col("position") > 1, ",").otherwise(""), F.to_json("doc")).alias("line"))
    some = dets.select(key).distinct()
    joined = recordings if save_if_empty else recordings.join(some, key, "left_semi")
    joined = joined.join(recording_class(dets, labels, key), key, "left")
    _, rest = _rest(recordings, note, include_file_path)
    last = F.concat(F.lit("],"), F.substring(F.to_json(F.struct(*rest)), 2, 1 << 30))
    head = joined.select(key, F.lit(0).cast("bigint").alias("position"), F.lit('{"annotated":false,"annotation":[').alias("line"))
    foot = joined.select(key, F.lit((1 << 63) - 1).cast("bigint").alias("position"), last.alias("line"))
    return head.unionByName(body.join(recordings.select(key), key, "left_semi")).unionByName(foot)


def save_documents(lines: DataFrame, path: str, key: str = "recording_id") -> None:
    """One folder and file per recording: its lines (``document_lines``) in order make one JSON document."""
    lines.repartition(key).sortWithinPartitions(key, "position").select(key, "line").write.mode("overwrite").partitionBy(
        key).text(path)


def save_files(lines: DataFrame, path: str, name: str, head: str, order: Sequence[Column]) -> None:
    """One finished file per ``name`` under ``path``: ``head``, then its ``line`` values in ``order``.

    The lines of a file meet in one task, which streams them; a file appears under its name when
    it is whole, so a task that fails or is killed leaves none, and its second try replaces nothing but its own.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((n, line) for batch in batches for n, line in zip(batch[name].tolist(), batch["line"].tolist()))
        for number, group in groupby(rows, key=lambda row: row[0]):
            text = chain([head], (line for _, line in group))
            yield pd.DataFrame({"name": [str(number)], "bytes": [write_file(f"{path}/{number}", (f"{t}\n".encode() for t in text))]})

    sorted_ = lines.repartition(name).sortWithinPartitions(name, *order).select(F.col(name).cast("string"), "line")
    sorted_.mapInPandas(run, "name string, bytes long").write.format("noop").mode("overwrite").save()


def _csv(values: Sequence[Column | str]) -> Column:
    """A line of comma-separated values; texts with commas, quotes or line ends are quoted, null is empty."""
    def field(value: Column) -> Column:
        text = F.coalesce(value.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[field(F.col(v) if isinstance(v, str) else v) for v in values])


def save_detection_csv(rows: DataFrame, path: str, key: str = "recording_id") -> None:
    """``<recording>.csv`` under ``path`` for every recording with detections: an index column, then the fixed columns.

    Rows (``document_rows``) come in falling order of score and bounds. The index is
    a rank over ranges, so that a recording's order is not made in one task.
    """
    order = [("det_prob", True), *[(c, False) for c in BOX], ("class", False)]
    ranked = with_rank(order_rows(rows.select(key, *CSV_COLUMNS), [key], order), "_index").clean()
    named = ranked.select(
        F.concat(F.col(key).cast("string"), F.lit(".csv")).alias("name"), "_index",
        _csv([F.col("_index") - 1, *CSV_COLUMNS]).alias("line"))
    save_files(named, path, "name", ",".join(["", *CSV_COLUMNS]), [F.col("_index")])


def feature_rows(dets: DataFrame, n_features: int, features: str = "features") -> DataFrame:
    """One text column per feature index with five decimals."""
    keys = [c for c in ("recording_id", "det_id") if c in dets.columns]
    return dets.select(
        *keys, *[F.format_string("%.5f", F.get(F.col(features), i).cast("double")).alias(str(i)) for i in range(n_features)]
    )


def save_feature_csv(dets: DataFrame, n_features: int, path: str, key: str = "recording_id", order: str = "det_id") -> None:
    """``<recording>_cnn_features.csv`` under ``path``: a column per feature, five decimals, no index."""
    names = [str(i) for i in range(n_features)]
    rows = dets.select(key, F.col(order).alias("_order"), *[
        F.format_string("%.5f", F.get(F.col("features"), i).cast("double")).alias(str(i)) for i in range(n_features)])
    named = rows.select(F.concat(F.col(key).cast("string"), F.lit("_cnn_features.csv")).alias("name"), "_order", _csv(names).alias("line"))
    save_files(named, path, "name", ",".join(names), [F.col("_order")])


# --- prediction sets -------------------------------------------------------

def prediction_tags(
    dets: DataFrame, class_names: Sequence[str], decoding: Mapping[str, Sequence[Tag]],
    generic_tags: Sequence[Tag], top_k: int | None = 1, min_score: float | None = None,
) -> DataFrame:
    """``tags`` column: detection-class tags, then the best ``top_k`` classes until one is below ``min_score``."""
    tags = F.concat(
        class_scores.detection_tags(generic_tags, F.col("detection_score")),
        class_scores.class_tags(F.col("class_scores"), class_names, decoding, threshold=min_score, top_k=top_k),
    )
    return dets.withColumn("tags", tags)


# --- metrics ---------------------------------------------------------------

def save_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows (name, value); a report has one row per metric and class."""
    metrics.repartition(1).write.mode("overwrite").json(path)
