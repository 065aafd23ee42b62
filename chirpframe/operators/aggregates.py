"""Class summaries, recording-level classes and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as class_scores


def class_summary(events: DataFrame, clips: DataFrame, key: str = "clip_id", duration: str = "duration") -> DataFrame:
    """Calls, distinct clips, summed duration of those clips and call rate per class, most calls first.

    One aggregation to (class, clip) carries the call counts, so events are
    shuffled once and a hot class is reduced before its clips are counted.
    """
    per_clip = events.groupBy("class_name", key).agg(F.count(F.lit(1)).alias("_calls"))
    joined = per_clip.join(clips.select(key, F.col(duration).alias("_d")), key, "left")
    return (
        joined.groupBy("class_name")
        .agg(
            F.sum("_calls").alias("num_calls"),
            F.count(F.lit(1)).alias("num_recordings"),
            F.sum("_d").alias("duration"),
        )
        .withColumn("call_rate", F.when(F.col("duration") > 0, F.col("num_calls") / F.col("duration")))
        .orderBy(F.col("num_calls").desc(), "class_name")
    )


def class_counts(events: DataFrame, classes_to_ignore: Sequence[str] = (), column: str = "class_name") -> DataFrame:
    """Count per class and its sample weight (mean count / count). Classes are few; events are not touched twice."""
    rows = events.where(~F.col(column).isin(*classes_to_ignore)) if classes_to_ignore else events
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n").alias("_mean"))
    return counts.crossJoin(F.broadcast(mean)).select(  # one row
        column, "n", (F.col("_mean") / F.col("n")).alias("weight")
    )


def sample_weights(events: DataFrame, classes_to_ignore: Sequence[str] = (), column: str = "class_name") -> DataFrame:
    """Weight next to every event that is not ignored."""
    return events.join(class_counts(events, classes_to_ignore, column).drop("n"), column)


def recording_class_scores(
    dets: DataFrame, class_names: Sequence[str], key: str = "recording_id",
    scores: str = "class_scores", score: str = "detection_score",
) -> DataFrame:
    """Share of each class in a recording: Σ class score × detection score, normalised.

    The sums live in one row per recording (as many as there are classes), so
    no event is exploded. ``share`` is null when the total is not positive.
    """
    n = len(class_names)
    weighted = [F.sum(F.get(F.col(scores), i) * F.col(score)).alias(f"_w{i}") for i in range(n)]
    sums = dets.groupBy(key).agg(*weighted)
    total = sum((F.col(f"_w{i}") for i in range(1, n)), F.col("_w0"))
    shares = F.array(*[F.when(total > 0, F.col(f"_w{i}") / total) for i in range(n)])
    return sums.select(key, F.posexplode(shares).alias("class_idx", "share")).withColumn(
        "class_name", class_scores.class_at(class_names, F.col("class_idx"))
    )


def recording_class(
    dets: DataFrame, class_names: Sequence[str], key: str = "recording_id",
    scores: str = "class_scores", score: str = "detection_score", none_label: str = "None",
) -> DataFrame:
    """Best class per recording, ``None`` when its total weight is not positive."""
    n = len(class_names)
    weighted = [F.sum(F.get(F.col(scores), i) * F.col(score)).alias(f"_w{i}") for i in range(n)]
    sums = dets.groupBy(key).agg(*weighted)
    vector = F.array(*[f"_w{i}" for i in range(n)])
    total = sum((F.col(f"_w{i}") for i in range(1, n)), F.col("_w0"))
    best = class_scores.class_at(class_names, class_scores.top_index(vector))
    return sums.select(key, F.when(total > 0, best).otherwise(F.lit(none_label)).alias("recording_class"))


def top_classes(dets: DataFrame, class_names: Sequence[str], n: int = 3, key: str = "recording_id", **columns: str) -> DataFrame:
    """The ``n`` strongest classes per recording (one row per class at most, so groups are small)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("share").desc(), F.col("class_idx")))
    rows = recording_class_scores(dets, class_names, key, **columns).where(F.col("share").isNotNull())
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def merge_detections(dets: DataFrame, clips: DataFrame, clip_key: str = "clip_id", key: str = "recording_id") -> DataFrame:
    """Detections of all clips of a recording under the recording key.

    The falling (score, bounds) order is set where documents are written.
    """
    rows = dets if key in dets.columns else dets.join(clips.select(clip_key, key), clip_key)
    return rows.drop(clip_key)


def merged_order() -> list[Column]:
    return [F.col(c).desc() for c in ("detection_score", "start_time", "low_freq", "end_time", "high_freq")]
