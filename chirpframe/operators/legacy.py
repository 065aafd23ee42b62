"""The older file-based evaluation: nearest-start matching, file accuracy, summary report.

Ground truth: file_id, duration, gt_id, class_id (-1 is unknown) and box
columns. Predictions: file_id, det_id, det_prob, class_probs and box columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as class_scores
from . import curves
from .curves import nan, ratio
from .matching import nearest_pairs
from .reports import union_all

#: Means and sums that differ by less than this share are equal: their last digits depend on the order of addition.
EQUAL = 1e-12
THRESHOLDS = tuple(round(0.1 * i, 1) for i in range(1, 10))


def _inside(margin: float) -> Column:
    return F.col("start_time").between(F.lit(float(margin)), F.col("duration") - F.lit(float(margin)))


def observations(
    gts: DataFrame, dets: DataFrame, files: DataFrame, mode: str, num_classes: int,
    threshold: float = 0.01, margin: float = 0.01,
) -> tuple[DataFrame, DataFrame]:
    """(observations, positives) for ``detection``, ``per_class`` or ``top_class``.

    ``per_class`` does all classes at once, keyed by ``class_id``. A detection
    matched to an unknown-class event leaves the curve in the class modes. A
    start beyond the file's end fails the job.
    """
    length = files.select("file_id", "duration")
    wrong = F.concat(F.lit("an event starts after the end of file "), F.col("file_id").cast("string"))
    truth = gts.join(length, "file_id").withColumn(
        "start_time",
        F.when(F.col("start_time") > F.col("duration"), F.raise_error(wrong).cast("double"))
        .otherwise(F.col("start_time")),
    ).where(_inside(margin)).select("file_id", F.col("gt_id").alias("ann_id"), "start_time", "class_id")
    found = dets.join(length, "file_id").where(_inside(margin))
    classes = F.sequence(F.lit(0), F.lit(num_classes - 1))
    keys = ["file_id"]
    if mode == "detection":
        found = found.select("file_id", "det_id", "start_time", F.col("det_prob").alias("score"))
        positives = truth.agg(F.count(F.lit(1)).alias("n_pos"))
    elif mode == "top_class":
        known = F.slice("class_probs", 1, num_classes)
        found = found.select(
            "file_id", "det_id", "start_time", class_scores.top_score(known).alias("score"),
            class_scores.top_index(known).alias("pred_class"),
        )
        positives = truth.agg(F.coalesce(F.sum((F.col("class_id") > -1).cast("bigint")), F.lit(0)).alias("n_pos"))
    elif mode == "per_class":
        keys = ["class_of_interest", "file_id"]
        found = found.select(
            "file_id", "det_id", "start_time",
            F.posexplode(F.slice("class_probs", 1, num_classes)).alias("class_of_interest", "score"),
        )
        own = F.when(F.col("class_id") >= 0, F.array("class_id")).otherwise(classes)
        truth = truth.withColumn("class_of_interest", F.explode(own))
        counted = truth.groupBy("class_of_interest").agg(
            F.sum((F.col("class_id") >= 0).cast("bigint")).alias("_n")
        )
        every = gts.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("class_of_interest"))
        positives = every.join(counted, "class_of_interest", "left").select(
            "class_of_interest", F.coalesce("_n", F.lit(0)).alias("n_pos")
        )
    else:
        raise ValueError(f"Unknown mode {mode}")
    near = nearest_pairs(found, truth, keys, 0.0, threshold, "score").where(
        F.col("distance") <= F.lit(float(threshold))
    )
    won = near.groupBy(*keys, "ann_id").agg(
        F.min_by("det_id", F.struct(-F.col("score"), F.col("det_id"))).alias("det_id")
    ).join(truth.select(*keys, "ann_id", "class_id"), [*keys, "ann_id"]).drop("ann_id")
    rows = found.join(won, [*keys, "det_id"], "left")
    matched = F.col("class_id").isNotNull()
    if mode != "detection":
        rows = rows.where(~(matched & (F.col("class_id") == -1)))
    right = matched & (F.col("class_id") == F.col("pred_class")) if mode == "top_class" else matched
    group = [k for k in keys if k != "file_id"]
    obs = rows.select(
        *group, F.col("det_id").alias("row_id"), "score", F.coalesce(right, F.lit(False)).alias("is_true")
    )
    return obs, positives


def precision_recall(
    gts: DataFrame, dets: DataFrame, files: DataFrame, mode: str, num_classes: int, **kwargs
) -> DataFrame:
    """Average precision and recall at 0.95 precision, rounded to 5; NaN without positives."""
    obs, positives = observations(gts, dets, files, mode, num_classes, **kwargs)
    keys = ["class_of_interest"] if mode == "per_class" else []
    areas = curves.curve_areas(obs, keys, positives)
    recall = F.when(F.col("n_pos") > 0, F.col("recall_at_x")).otherwise(nan())
    return areas.select(
        *keys, F.col("n_pos").alias("num_gt"),
        F.round("average_precision", 5).alias("avg_prec"), F.round(recall, 5).alias("rec_at_x"),
    )


def operating_points(gts, dets, files, mode, num_classes, **kwargs) -> DataFrame:
    obs, positives = observations(gts, dets, files, mode, num_classes, **kwargs)
    keys = ["class_of_interest"] if mode == "per_class" else []
    return curves.curve_points(curves.pr_curve(obs, keys, positives), THRESHOLDS, keys, legacy=True)


# --- file accuracy ---------------------------------------------------------

def _best_class(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pred_class): the class ``_c`` of the largest ``_v`` (not negative), the smallest class of equal ones."""
    best = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_c", "_v"))).alias("_l"))  # a row per class
    enough = F.array_max(F.transform("_l", lambda x: x["_v"])) * (1 - EQUAL)
    return best.select(*keys, F.get(F.filter("_l", lambda x: x["_v"] >= enough), F.lit(0))["_c"].alias("pred_class"))


def single_class_files(gts: DataFrame) -> DataFrame:
    """Files whose events all have the same known class: (file_id, true_class)."""
    return gts.groupBy("file_id").agg(
        F.min("class_id").alias("true_class"), F.max("class_id").alias("_max")
    ).where((F.col("true_class") == F.col("_max")) & (F.col("true_class") != -1)).drop("_max")


def _file_class(files: DataFrame, dets: DataFrame, num_classes: int, value, extra: Sequence[str] = ()) -> DataFrame:
    long = dets.select("file_id", F.posexplode(F.slice("class_probs", 1, num_classes)).alias("_c", "_p"))
    scored = _best_class(value(long), ["file_id", *extra])
    return files.join(scored, "file_id", "left").withColumn("pred_class", F.coalesce("pred_class", F.lit(0)))


def _ordered_best(dets: DataFrame, num_classes: int, order: str) -> DataFrame:
    """(file_id, pred_class): the largest mean probability as it comes out when a file's rows are added in ``order``."""
    run = Window.partitionBy("file_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(F.get("class_probs", F.lit(i))).over(run).alias(f"_s{i}") for i in range(num_classes)]
    counts = [F.count(F.get("class_probs", F.lit(i))).over(run).alias(f"_n{i}") for i in range(num_classes)]
    running = dets.select("file_id", F.col(order).alias("_at"), *sums, *counts)
    whole = running.groupBy("file_id").agg(F.max_by(F.struct(*running.columns[2:]), "_at").alias("_w"))
    means = F.array(*[F.try_divide(F.col(f"_w._s{i}"), F.col(f"_w._n{i}")) for i in range(num_classes)])
    return whole.select("file_id", (F.array_position(means, F.array_max(means)) - 1).cast("int").alias("pred_class"))


def file_accuracy_simple(gts: DataFrame, dets: DataFrame, num_classes: int, order: str | None = None) -> DataFrame:
    """Predicted class per file is the best mean class probability (class 0 without detections).

    Means that differ by rounding alone are equal. With ``order``, a column that is distinct within a file, they are
    the means of an addition in that order and are compared to the last digit, as SQL over ordered rows does.
    """
    files = single_class_files(gts)
    if order is not None:
        best = _ordered_best(dets, num_classes, order)
        return files.join(best, "file_id", "left").withColumn("pred_class", F.coalesce("pred_class", F.lit(0)))
    return _file_class(
        files, dets, num_classes,
        lambda long: long.groupBy("file_id", "_c").agg(F.avg("_p").alias("_v")),
    )


def file_accuracy(gts: DataFrame, dets: DataFrame, num_classes: int) -> DataFrame:
    """(file_id, true_class, pred_class) at the best of ten cut-offs.

    Cut-offs run evenly from the lowest to the highest class probability; a
    file's class has the largest sum of probabilities at or above the cut-off.
    """
    files = single_class_files(gts)
    bounds = dets.agg(
        F.coalesce(F.min(F.array_min("class_probs")), F.lit(0.0)).alias("_lo"),
        F.coalesce(F.max(F.array_max("class_probs")), F.lit(1.0)).alias("_hi"),
    )
    steps = bounds.select(F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("_lo") + i * ((F.col("_hi") - F.col("_lo")) / 10)
    )).alias("_step", "_cut"))
    cuts = steps.agg(F.array_sort(F.collect_list(F.struct("_step", "_cut"))).alias("_cuts"))  # ten entries

    def sums(long: DataFrame) -> DataFrame:
        parts = [
            F.sum(F.when(F.col("_p") >= F.get(F.col("_cuts"), i)["_cut"], F.col("_p")).otherwise(F.lit(0.0))).alias(f"_s{i}")
            for i in range(10)
        ]
        wide = long.crossJoin(F.broadcast(cuts)).groupBy("file_id", "_c").agg(*parts)  # one row
        return wide.select("file_id", "_c", F.posexplode(F.array(*[f"_s{i}" for i in range(10)])).alias("_step", "_v"))

    steps10 = files.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(9))))
    long = dets.select("file_id", F.posexplode(F.slice("class_probs", 1, num_classes)).alias("_c", "_p"))
    best = _best_class(sums(long), ["file_id", "_step"])
    called = steps10.join(best, ["file_id", "_step"], "left").withColumn(
        "pred_class", F.coalesce("pred_class", F.lit(0))
    )
    accuracy = called.groupBy("_step").agg(F.avg((F.col("true_class") == F.col("pred_class")).cast("double")).alias("_acc"))
    chosen = accuracy.agg(F.min_by("_step", F.struct(-F.col("_acc"), F.col("_step"))).alias("_step"))
    return called.join(F.broadcast(chosen), "_step").drop("_step")  # one row


def accuracy_of(files: DataFrame) -> DataFrame:
    """Share of files with the right class, rounded to 5."""
    hit = (F.col("true_class") == F.col("pred_class")).cast("double")
    return files.agg(F.count(F.lit(1)).alias("num_valid_files"), F.round(F.avg(hit), 5).alias("file_acc"))


def class_file_accuracy(files: DataFrame, num_classes: int) -> DataFrame:
    """Accuracy per true class; NaN for classes without files."""
    classes = files.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("true_class"))
    hit = (F.col("true_class") == F.col("pred_class")).cast("double")
    known = files.groupBy("true_class").agg(F.avg(hit).alias("accuracy"))
    return classes.join(known, "true_class", "left").withColumn("accuracy", F.coalesce("accuracy", nan()))


def classification_error(rows: DataFrame, cut: float = 0.5) -> DataFrame:
    """Accuracy in percent at a cut-off, and ROC AUC. ``rows``: row_id, score, is_true."""
    right = ((F.col("score") > F.lit(float(cut))) == F.col("is_true")).cast("double")
    return rows.agg((F.avg(right) * 100).alias("class_acc")).crossJoin(
        F.broadcast(curves.roc_auc(rows))  # one row each
    )


def report(gts: DataFrame, dets: DataFrame, files: DataFrame, class_names: Sequence[str], **kwargs) -> DataFrame:
    """(name, value) rows; the class mean runs over classes with ground truth."""
    n = len(class_names)
    modes = {m: precision_recall(gts, dets, files, m, n, **kwargs) for m in ("detection", "top_class", "per_class")}
    per_class = modes["per_class"]
    names = F.array(*[F.lit(c) for c in class_names])
    label = F.concat(F.lit("class_pr/"), F.get(names, F.col("class_of_interest")))
    return union_all([
        modes["detection"].select(F.lit("avg_prec").alias("name"), F.col("avg_prec").alias("value")),
        modes["top_class"].select(F.lit("top_class").alias("name"), F.col("avg_prec").alias("value")),
        per_class.agg(F.round(F.avg(F.when(F.col("num_gt") > 0, F.col("avg_prec"))), 5).alias("value"))
        .select(F.lit("avg_prec_class").alias("name"), "value"),
        per_class.select(label.alias("name"), F.col("avg_prec").alias("value")),
        accuracy_of(file_accuracy(gts, dets, n)).select(F.lit("file_acc").alias("name"), F.col("file_acc").alias("value")),
    ])


__all__ = [
    "THRESHOLDS", "accuracy_of", "class_file_accuracy", "classification_error", "file_accuracy",
    "file_accuracy_simple", "observations", "operating_points", "precision_recall", "ratio", "report",
    "single_class_files",
]
