"""Metric tables per evaluation task: rows of (metric, class_name, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import is_true
from ..plans.session import cut_lineage
from . import curves
from .curves import nan, ratio


def _metric(df: DataFrame, name: str, value: str, class_column: str | None = None) -> DataFrame:
    label = F.col(class_column) if class_column else F.lit(None).cast("string")
    return df.select(
        F.lit(name).alias("metric"), label.alias("class_name"), F.col(value).cast("double").alias("value")
    )


def _spread_metrics(areas: DataFrame, at: DataFrame) -> DataFrame:
    """One row per metric from two one-row tables."""
    one = areas.crossJoin(F.broadcast(at))  # one row each
    names = ("average_precision", "roc_auc", "recall", "precision")
    pairs = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.lit(None).cast("string").alias("class_name"), F.col(n).cast("double").alias("value"))
        for n in names
    ])
    return one.select(F.explode(pairs).alias("_m")).select("_m.*")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _row_id() -> Column:
    """Stable tie-break of a match row: its detection, else its ground truth."""
    return F.coalesce(F.col("det_id"), F.col("ann_id")).alias("row_id")


def _mean_over_classes(df: DataFrame, value: str) -> DataFrame:
    """Mean that leaves NaN classes out; NaN when none is left."""
    return df.agg(
        F.coalesce(F.avg(F.when(~F.isnan(value), F.col(value))), nan()).alias(value)
    )


# --- observations ----------------------------------------------------------

def detection_observations(matches: DataFrame, ignore_non_predictions: bool = True) -> tuple[DataFrame, DataFrame]:
    """(observations, positives) of detection match rows."""
    obs = matches.where("is_prediction") if ignore_non_predictions else matches
    positives = matches.agg(F.coalesce(F.sum(F.col("is_ground_truth").cast("bigint")), F.lit(0)).alias("n_pos"))
    return obs.select(_row_id(), "score", F.col("is_ground_truth").alias("is_true")), positives


def classification_observations(
    matches: DataFrame, class_names: Sequence[str],
    ignore_non_predictions: bool = True, ignore_generic: bool = True,
) -> tuple[DataFrame, DataFrame]:
    rows = matches.where(~F.col("is_generic")) if ignore_generic else matches
    rows = rows.withColumn("is_true", is_true(F.col("true_class") == F.col("task_class")))
    classes = matches.sparkSession.createDataFrame([(c,) for c in class_names], "task_class string")
    counted = rows.groupBy("task_class").agg(F.sum(F.col("is_true").cast("bigint")).alias("_n"))
    positives = classes.join(counted, "task_class", "left").select(
        "task_class", F.coalesce("_n", F.lit(0)).alias("n_pos")
    )
    obs = rows.where("is_prediction") if ignore_non_predictions else rows
    return obs.select("task_class", _row_id(), "score", "is_true"), positives


def top_class_observations(
    matches: DataFrame, ignore_non_predictions: bool = True, ignore_generic: bool = True
) -> tuple[DataFrame, DataFrame]:
    """True means predicted class equals true class, where two missing classes are equal too."""
    rows = matches.where(~F.col("is_generic")) if ignore_generic else matches
    positives = rows.agg(F.coalesce(F.sum(F.col("is_ground_truth").cast("bigint")), F.lit(0)).alias("n_pos"))
    obs = rows.where("is_prediction") if ignore_non_predictions else rows
    same = F.col("pred_class").eqNullSafe(F.col("true_class"))
    return obs.select(_row_id(), "score", same.alias("is_true")), positives


# --- detection -------------------------------------------------------------

def _threshold_metrics(matches: DataFrame, right: Column, threshold: float) -> DataFrame:
    called = F.col("score") >= F.lit(float(threshold))
    count = lambda c: F.sum(c.cast("bigint"))
    return matches.agg(
        count(F.col("is_ground_truth")).alias("_p"), count(called).alias("_d"),
        count(called & right).alias("_t"),
    ).select(
        F.coalesce(ratio(F.col("_t"), F.col("_p")), nan()).alias("recall"),
        F.coalesce(ratio(F.col("_t"), F.col("_d")), nan()).alias("precision"),
    )


def detection_metrics(matches: DataFrame, threshold: float = 0.5, ignore_non_predictions: bool = True) -> DataFrame:
    """Average precision, ROC AUC, and recall and precision at a threshold.

    Reads the match rows several times: give a checkpointed match table
    (``plans.session.cut_lineage``) when they are not stored yet.
    """
    obs, positives = detection_observations(matches, ignore_non_predictions)
    at = _threshold_metrics(matches, F.col("is_ground_truth"), threshold)
    return _spread_metrics(curves.curve_areas(obs, positives=positives), at)


# --- classification --------------------------------------------------------

def _per_class_report(
    scored: DataFrame, name: str, value: str, include: Sequence[str] | None, exclude: Sequence[str] | None
) -> DataFrame:
    """Mean over all classes; ``include`` and ``exclude`` only choose the classes listed."""
    shown = scored
    if include is not None:
        shown = shown.where(F.col("task_class").isin(*include))
    elif exclude is not None:
        shown = shown.where(~F.col("task_class").isin(*exclude))
    return _metric(_mean_over_classes(scored, value), f"mean_{name}", value).unionByName(
        _metric(shown, name, value, "task_class")
    )


def classification_metrics(
    matches: DataFrame, class_names: Sequence[str], ignore_non_predictions: bool = True,
    ignore_generic: bool = True, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
) -> DataFrame:
    """Average precision and ROC AUC per class and their means over classes that have one."""
    obs, positives = classification_observations(matches, class_names, ignore_non_predictions, ignore_generic)
    keys = ["task_class"]
    areas = cut_lineage(curves.curve_areas(obs, keys, positives))  # one row per class
    return _per_class_report(areas, "average_precision", "average_precision", include, exclude).unionByName(
        _per_class_report(areas, "roc_auc", "roc_auc", include, exclude)
    )


# --- top class -------------------------------------------------------------

def top_class_metrics(
    matches: DataFrame, threshold: float = 0.5, ignore_non_predictions: bool = True, ignore_generic: bool = True,
) -> DataFrame:
    """``ignore_non_predictions`` is honoured by both area metrics."""
    obs, positives = top_class_observations(matches, ignore_non_predictions, ignore_generic)
    at = _threshold_metrics(
        matches, F.col("pred_class").eqNullSafe(F.col("true_class")), threshold
    )
    return _spread_metrics(curves.curve_areas(obs, positives=positives), at)


def balanced_accuracy(matches: DataFrame, exclude_noise: bool = False, noise_class: str = "noise") -> DataFrame:
    """Mean recall over true classes; unmatched rows are class ``noise`` unless excluded."""
    rows = matches.where(~F.col("is_generic"))
    if exclude_noise:
        rows = rows.where(F.col("is_ground_truth") & F.col("pred_class").isNotNull())
    noise = F.lit(noise_class)
    hit = (F.coalesce("true_class", noise) == F.coalesce("pred_class", noise)).cast("double")
    per_class = rows.groupBy(F.coalesce("true_class", noise).alias("_class")).agg(F.avg(hit).alias("_recall"))
    return per_class.agg(F.avg("_recall").alias("balanced_accuracy"))


def confusion_matrix(
    matches: DataFrame, class_names: Sequence[str], threshold: float = 0.2, normalize: str = "true",
    exclude_generic: bool = True, exclude_false_positives: bool = True,
    exclude_false_negatives: bool = True, noise_class: str = "noise", generic_class: str = "bat",
) -> DataFrame:
    """Long matrix (true_label, pred_label, value) over all label pairs, zeros included.

    Labels are the sorted class names, then the generic class and the noise
    class when they can occur; rows with other labels are left out.
    """
    rows = matches
    if exclude_false_negatives:
        rows = rows.where("is_prediction")
    if exclude_false_positives:
        rows = rows.where("is_ground_truth")
    weak = F.col("score") < F.lit(float(threshold))
    if exclude_false_negatives:
        rows = rows.where(~weak)
    if exclude_generic:
        rows = rows.where(~F.col("is_generic"))
    noise = F.lit(noise_class)
    true_label = F.when(F.col("is_generic"), F.lit(generic_class)).otherwise(F.coalesce("true_class", noise))
    pred_label = F.when(weak, noise).otherwise(F.coalesce("pred_class", noise))
    labels = sorted(class_names)
    if not exclude_generic:
        labels.append(generic_class)
    if not (exclude_false_positives and exclude_false_negatives):
        labels.append(noise_class)
    counts = rows.groupBy(true_label.alias("true_label"), pred_label.alias("pred_label")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    spark = matches.sparkSession
    every = spark.createDataFrame([(a, b) for a in labels for b in labels], "true_label string, pred_label string")
    full = every.join(counts, ["true_label", "pred_label"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    groups = {"true": ["true_label"], "pred": ["pred_label"], "all": [], "none": None}[normalize]
    if groups is None:
        value = full.withColumn("value", F.col("_n").cast("double"))
    else:
        sums = full.groupBy(*groups).agg(F.sum("_n").alias("_total"))
        value = curves.attach(full, sums, groups).withColumn(
            "value", F.when(F.col("_total") > 0, F.col("_n") / F.col("_total")).otherwise(F.lit(0.0))
        )
    return value.select("true_label", "pred_label", "value")


# --- clips -----------------------------------------------------------------

def clip_detection_scores(clips: DataFrame, targets: DataFrame, dets: DataFrame, key: str = "clip_id") -> DataFrame:
    """Score and truth per clip. ``targets`` and ``dets`` are already bounds-filtered."""
    best = dets.groupBy(key).agg(F.max("detection_score").alias("_best"))
    truth = targets.select(key).distinct().withColumn("_hit", F.lit(True))
    return clips.select(key).join(best, key, "left").join(truth, key, "left").select(
        key,
        F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0)).alias("score"),
        F.coalesce("_hit", F.lit(False)).alias("is_true"),
    )


def clip_class_scores(
    targets: DataFrame, dets: DataFrame, class_names: Sequence[str], key: str = "clip_id", scores: str = "class_scores"
) -> DataFrame:
    """Best score per clip and class, with truth. Clips without detections give no row."""
    names = F.array(*[F.lit(c) for c in class_names])
    best = (
        dets.select(key, F.posexplode(scores).alias("_i", "_s"))
        .groupBy(key, F.get(names, F.col("_i")).alias("class_name"))
        .agg(F.greatest(F.max("_s"), F.lit(0.0)).alias("score"))
        .where(F.col("class_name").isNotNull())
    )
    truth = targets.where(F.col("class_name").isNotNull()).select(key, "class_name").distinct()
    return best.join(truth.withColumn("is_true", F.lit(True)), [key, "class_name"], "left").withColumn(
        "is_true", F.coalesce("is_true", F.lit(False))
    )


def clip_class_observations(
    clips: DataFrame, scored: DataFrame, targets: DataFrame, class_names: Sequence[str], key: str = "clip_id"
) -> DataFrame:
    """Observations of the clip-classification curves: every clip and class, 0 where nothing was detected."""
    every = clips.select(key, F.explode(F.array(*[F.lit(c) for c in class_names])).alias("class_name"))
    truth = targets.where(F.col("class_name").isNotNull()).select(key, "class_name").distinct()
    best = scored.select(key, "class_name", "score")
    return (
        every.join(best, [key, "class_name"], "left")
        .join(truth.withColumn("_hit", F.lit(True)), [key, "class_name"], "left")
        .select(
            F.col("class_name").alias("task_class"), F.col(key).alias("row_id"),
            F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("_hit", F.lit(False)).alias("is_true"),
        )
    )


def clip_detection_metrics(scored: DataFrame, threshold: float = 0.5, key: str = "clip_id") -> DataFrame:
    obs = scored.select(F.col(key).alias("row_id"), "score", "is_true")
    at = _threshold_metrics(
        obs.withColumn("is_ground_truth", F.col("is_true")), F.col("is_true"), threshold
    )
    return _spread_metrics(curves.curve_areas(obs), at)


def clip_classification_metrics(scored: DataFrame, key: str = "clip_id") -> DataFrame:
    """NaN classes are left out of the listing and of the mean."""
    obs = scored.select(F.col("class_name").alias("task_class"), F.col(key).alias("row_id"), "score", "is_true")
    areas = cut_lineage(curves.curve_areas(obs, ["task_class"]))  # one row per class
    frames = []
    for name in ("average_precision", "roc_auc"):
        frames.append(_metric(_mean_over_classes(areas, name), f"mean_{name}", name))
        frames.append(_metric(areas.where(~F.isnan(name)), name, name, "task_class"))
    return union_all(frames)


# --- report ----------------------------------------------------------------

def evaluation_report(tasks: Mapping[str, DataFrame]) -> DataFrame:
    """All tasks in one table; names are ``prefix/metric`` or ``prefix/metric/class``."""
    frames = [
        m.select(
            F.concat_ws("/", F.lit(prefix), "metric", "class_name").alias("name"), "value"
        )
        for prefix, m in tasks.items()
    ]
    return union_all(frames)
