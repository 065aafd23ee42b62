"""Matching of detections to ground truth.

A detection may take one ground truth and each ground truth is taken once, the
highest score first. In strict matching a detection only ever tries its single
best ground truth, so the sequential rule is two independent minima: best
ground truth per detection, then best detection per ground truth.

Columns: detections carry ``det_id`` and a score, ground truth ``ann_id``; both
carry the match keys (``clip_id`` and, per class, ``class_name``) and box
columns. Match rows: keys, det_id, ann_id, score, is_prediction,
is_ground_truth (and class columns from the tasks below).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as class_scores
from ..functions.geometry import TimeAffinity, point_in_time, scaled_box_iou
from ..plans.clusters import interval_clusters
from ..plans.intervals import Axis, range_join
from ..plans.session import cut_lineage
from ..plans.tiles import core_only, with_halo

BOX = ("start_time", "end_time", "low_freq", "high_freq", "geom_type", "geometry")


def _box_columns(df: DataFrame) -> list[str]:
    return [c for c in BOX if c in df.columns]


def nearest_pairs(
    dets: DataFrame,
    gts: DataFrame,
    keys: Sequence[str] = ("clip_id",),
    ratio: float = 0.0,
    reach: float = 0.01,
    score: str = "score",
) -> DataFrame:
    """Best ground truth in time per distinct detection position, within ``reach``.

    Works on distinct positions: detections at one position share their nearest
    ground truth, so each position keeps only its best detection, and each
    ground-truth position only its lowest id. Time tiles with copied borders
    split hot clips, and the neighbours come from running windows, so no pairs
    are formed. Rows: keys, ann_id, distance, score, det_id.
    """
    keys = list(keys)
    d = (
        dets.withColumn("_at", point_in_time(F.col, ratio))
        .groupBy(*keys, "_at")
        .agg(F.min(F.struct((-F.col(score)).alias("neg"), F.col("det_id").alias("id"))).alias("_det"))
    )
    g = (
        gts.withColumn("_at", point_in_time(F.col, ratio))
        .groupBy(*keys, "_at")
        .agg(F.min("ann_id").alias("_ann"))
    )
    width = max(reach * 8, 1e-9)
    tiled = with_halo(g, "_at", width, reach * 1.001).withColumn("_gt", F.struct("_at", "_ann")).drop("_ann")
    points = with_halo(d, "_at", width, 0.0).unionByName(tiled, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_tile")
    back = inside.orderBy(F.col("_at").asc(), F.col("_det").isNotNull()).rowsBetween(
        Window.unboundedPreceding, 0)
    ahead = inside.orderBy(F.col("_at").desc(), F.col("_det").isNotNull()).rowsBetween(
        Window.unboundedPreceding, 0)
    seen = points.withColumn("_before", F.last("_gt", ignorenulls=True).over(back)).withColumn(
        "_after", F.last("_gt", ignorenulls=True).over(ahead)
    ).where(F.col("_det").isNotNull())

    def candidate(side: str) -> Column:
        gap = F.abs(F.col(f"{side}._at") - F.col("_at"))
        return F.when(
            F.col(side).isNotNull(), F.struct(gap.alias("distance"), F.col(f"{side}._ann").alias("ann_id"))
        )

    return (
        core_only(seen)
        .withColumn("_best", F.least(candidate("_before"), candidate("_after")))
        .where(F.col("_best").isNotNull())
        .select(
            *keys, F.col("_best.ann_id").alias("ann_id"), F.col("_best.distance").alias("distance"),
            (-F.col("_det.neg")).alias(score), F.col("_det.id").alias("det_id"),
        )
    )


def _winner(pairs: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Best-scored detection per ground truth, lowest id on ties."""
    return pairs.groupBy(*keys, "ann_id").agg(
        F.min_by(F.struct("det_id", "affinity"), F.struct(-F.col(score), F.col("det_id"))).alias("_w")
    ).select(*keys, F.col("_w.det_id").alias("det_id"), "ann_id", F.col("_w.affinity").alias("affinity"))


def candidate_pairs(
    dets: DataFrame,
    gts: DataFrame,
    affinity,
    keys: Sequence[str] = ("clip_id",),
    threshold: float = 0.0,
    score: str = "score",
    slot: float = 0.1,
    band: float = 20000.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Detection–ground-truth pairs above the affinity threshold (which must be ≥ 0).

    Joined on time slots, for box affinities on frequency bands too.
    """
    if threshold < 0:
        raise ValueError("affinity threshold must be non-negative")
    left = dets.select(*keys, "det_id", score, *_box_columns(dets))
    right = gts.select(
        *keys, "ann_id", *keep, *[F.col(c).alias(f"g_{c}") for c in _box_columns(gts)]
    )
    gt_row = lambda n: F.col(f"g_{n}")
    axes = [Axis(affinity.span(F.col, "det"), affinity.span(gt_row, "gt"), slot)]
    if hasattr(affinity, "band"):
        axes.append(Axis(affinity.band(F.col), affinity.band(gt_row), band))
    pairs = range_join(left, right, keys, axes)
    return (
        pairs.withColumn("affinity", affinity.column(F.col, gt_row))
        .where(F.col("affinity") > F.lit(float(threshold)))
        .withColumn("closeness", -affinity.distance(F.col, gt_row) if hasattr(affinity, "distance") else F.col("affinity"))
        .select(*keys, "det_id", "ann_id", "affinity", "closeness", score, *keep)
    )


def strict_pairs(
    dets: DataFrame,
    gts: DataFrame,
    affinity,
    keys: Sequence[str] = ("clip_id",),
    threshold: float = 0.0,
    score: str = "score",
    slot: float = 0.1,
) -> DataFrame:
    """Matched (det_id, ann_id) under strict matching."""
    keys = list(keys)
    if isinstance(affinity, TimeAffinity):
        near = nearest_pairs(dets, gts, keys, affinity.ratio, affinity.max_distance, score)
        near = near.withColumn("affinity", affinity.from_distance(F.col("distance")))
        return _winner(near.where(F.col("affinity") > F.lit(float(threshold))), keys, score)
    # equal boxes share their best ground truth, so only the best detection of a box
    # can win, and of equal ground-truth boxes only the lowest id is ever asked
    shape = _box_columns(dets)
    one_det = dets.groupBy(*keys, *shape).agg(
        F.min(F.struct((-F.col(score)).alias("neg"), F.col("det_id").alias("id"))).alias("_d")
    ).select(*keys, *shape, (-F.col("_d.neg")).alias(score), F.col("_d.id").alias("det_id"))
    one_gt = gts.groupBy(*keys, *_box_columns(gts)).agg(F.min("ann_id").alias("ann_id"))
    pairs = candidate_pairs(one_det, one_gt, affinity, keys, threshold, score, slot)
    best = pairs.groupBy(*keys, "det_id").agg(
        F.min_by(F.struct("ann_id", "affinity", score), F.struct(-F.col("affinity"), F.col("ann_id"))).alias("_b")
    ).select(*keys, "det_id", "_b.*")
    return _winner(best, keys, score)


#: Rows of a cluster that one task scans; clusters beyond it are settled in rounds over all tasks.
SCAN_ROWS = 10_000_000


def box_id(df: DataFrame) -> Column:
    """One number for all equal boxes."""
    return F.xxhash64(*_box_columns(df))


def scan_choices(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The sequential rule, cluster by cluster, on rows sorted by (keys, cluster, kind, order, proposer, receiver).

    Kind 0 lists the receivers of a box, kind 1 the boxes a box of proposers can take, best
    first, kind 2 the proposers in the order of their turn. Kept are only the lists of the present cluster.
    """
    group, now = [*keys, "cluster"], None
    free: dict[int, deque] = {}  # box of receivers -> ids, smallest first
    wishes: dict[int, deque] = {}  # box of proposers -> (-affinity, box of receivers), best first
    for batch in batches:
        out = []
        columns = [batch[c].tolist() for c in ("kind", "order", "proposer_box", "receiver_box", "proposer", "receiver")]
        for place, kind, order, p_box, r_box, who, what in zip(zip(*(batch[c].tolist() for c in group)), *columns):
            if place != now:
                now, free, wishes = place, {}, {}
            if kind == 0:
                free.setdefault(r_box, deque()).append(what)
            elif kind == 1:
                wishes.setdefault(p_box, deque()).append((order, r_box))
            else:
                wish, best = wishes[p_box], None
                while wish and not free[wish[0][1]]:
                    wish.popleft()  # all equal proposers have the same wishes
                for cost, box in wish:
                    if best is not None and cost > best[0]:
                        break
                    if free[box] and (best is None or free[box][0] < free[best[1]][0]):
                        best = cost, box
                if best is not None:
                    out.append((*place[:-1], who, free[best[1]].popleft(), -best[0]))
        yield pd.DataFrame(out, columns=[*keys, "proposer", "receiver", "affinity"])


def in_rounds(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same choice over pairs (keys, turn, proposer, receiver, affinity), in rounds over all tasks.

    A pair whose receiver is the proposer's best and whose
    proposer is the first in line of all that could still take the receiver is
    settled: nobody before it in the scan wants that receiver. All such pairs of
    a round are settled at once, and every pair that shares a side with them goes;
    only what is still contested is written again. The first in line of what is
    left always settles, so the rounds end; their number is the longest chain of
    proposers waiting for one another.
    """
    cols, proposer, receiver = pairs.columns, [*keys, "proposer"], [*keys, "receiver"]
    left = cut_lineage(pairs.withColumns({
        "_want": F.struct(-F.col("affinity"), F.col("receiver")), "_rank": F.struct("turn", "proposer")}))
    settled = []
    while not left.isEmpty():
        best = left.groupBy(*proposer).agg(F.min("_want").alias("_best"))
        first = left.groupBy(*receiver).agg(F.min("_rank").alias("_first"))
        marked = left.join(best, proposer).join(first, receiver)
        done = cut_lineage(
            marked.where((F.col("_want") == F.col("_best")) & (F.col("_rank") == F.col("_first"))).select(*cols)
        )
        settled.append(done)
        left = cut_lineage(
            left.join(done.select(*proposer), proposer, "left_anti").join(done.select(*receiver), receiver, "left_anti")
        )
    found = reduce(DataFrame.union, settled) if settled else pairs.limit(0)
    return found.select(*keys, "proposer", "receiver", "affinity")


def serial_choice(
    boxes: DataFrame, proposers: DataFrame, receivers: DataFrame, keys: Sequence[str] = ("clip_id",),
) -> DataFrame:
    """Proposers choose in turn, each its best free receiver: (keys, proposer, receiver, affinity).

    ``boxes`` (keys, proposer_box, receiver_box, affinity, low, high) says which equal boxes
    can meet; ``proposers`` is (keys, proposer_box, proposer, turn), ``receivers`` (keys, receiver_box,
    receiver). Ties go to the smaller id. Equal boxes are never paired out.

    Choices only depend on each other inside a component of the graph of ``boxes``. The
    components (clusters of the spans [low, high] between the places of both sides) take a
    fixed number of jobs, and each is settled by one scan in a task. Clusters over ``SCAN_ROWS`` rows, which
    no task should hold, are settled in rounds, with the same result.
    """
    keys = list(keys)
    linked = interval_clusters(boxes, keys, F.col("low"), F.col("high"))
    linked = cut_lineage(linked.select(*keys, "cluster", "proposer_box", "receiver_box", "affinity"))
    ours = proposers.join(linked.select(*keys, "proposer_box", "cluster").distinct(), [*keys, "proposer_box"])
    theirs = receivers.join(linked.select(*keys, "receiver_box", "cluster").distinct(), [*keys, "receiver_box"])
    fields = [*keys, "cluster", "kind", "order", "proposer_box", "receiver_box", "proposer", "receiver"]
    zero = F.lit(0.0)
    parts = [
        theirs.withColumns({"kind": F.lit(0), "order": zero, "proposer_box": F.lit(0).cast("long")}),
        linked.withColumns({"kind": F.lit(1), "order": -F.col("affinity")}),
        ours.withColumns({"kind": F.lit(2), "order": F.col("turn").cast("double"), "receiver_box": F.lit(0).cast("long")}),
    ]
    kinds = {"proposer": proposers.schema["proposer"].dataType, "receiver": receivers.schema["receiver"].dataType}
    # no nulls, which pandas would turn whole numbers into floats for
    rows = reduce(DataFrame.union, [
        part.withColumns({n: F.lit(0).cast(t) for n, t in kinds.items() if n not in part.columns}).select(*fields)
        for part in parts])
    rows = cut_lineage(rows)
    large = cut_lineage(rows.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SCAN_ROWS))
    none = large.isEmpty()
    small = rows if none else rows.join(large, [*keys, "cluster"], "left_anti")
    schema = ", ".join(f"`{k}` {linked.schema[k].dataType.simpleString()}" for k in keys) + "".join(
        f", {n} {t.simpleString()}" for n, t in kinds.items()) + ", affinity double"
    sort = [*keys, "cluster", "kind", "order", "proposer", "receiver"]
    found = small.repartition(*keys, "cluster").sortWithinPartitions(*sort).mapInPandas(
        lambda batches: scan_choices(batches, keys), schema)
    if none:
        return found
    wide = linked.join(large.drop("_n"), [*keys, "cluster"]).drop("cluster")
    pairs = wide.join(proposers, [*keys, "proposer_box"]).join(receivers, [*keys, "receiver_box"])
    return found.union(in_rounds(pairs.select(*keys, "turn", "proposer", "receiver", "affinity"), keys))


def box_pairs(
    left: DataFrame, right: DataFrame, affinity, keys: Sequence[str], threshold: float, slot: float,
) -> DataFrame:
    """Which boxes of ``left`` (det_id side) and ``right`` (ann_id side) meet: (keys, det_box, ann_box, affinity, low, high).

    ``affinity`` is the closeness that ranks them: minus the distance where the affinity has one.
    """
    ours = left.select(*keys, box_id(left).alias("det_id"), *_box_columns(left)).dropDuplicates([*keys, "det_id"])
    theirs = right.select(*keys, box_id(right).alias("ann_id"), *_box_columns(right)).dropDuplicates([*keys, "ann_id"])
    met = candidate_pairs(
        ours.withColumn("score", F.col("start_time")), theirs.withColumn("_at", F.col("start_time")), affinity, keys,
        threshold, "score", slot, keep=["_at"])
    return met.select(
        *keys, F.col("det_id").alias("det_box"), F.col("ann_id").alias("ann_box"), F.col("closeness").alias("affinity"),
        F.least("score", "_at").alias("low"), F.greatest("score", "_at").alias("high"))


def free_choice_pairs(
    dets: DataFrame, gts: DataFrame, affinity, keys: Sequence[str] = ("clip_id",),
    threshold: float = 0.0, score: str = "score", slot: float = 0.1,
) -> DataFrame:
    """Non-strict matching: a detection falls back to its next best free ground truth."""
    met = box_pairs(dets, gts, affinity, keys, threshold, slot)
    found = serial_choice(
        met.withColumnsRenamed({"det_box": "proposer_box", "ann_box": "receiver_box"}),
        dets.select(*keys, box_id(dets).alias("proposer_box"), F.col("det_id").alias("proposer"), (-F.col(score)).alias("turn")),
        gts.select(*keys, box_id(gts).alias("receiver_box"), F.col("ann_id").alias("receiver")), keys)
    if hasattr(affinity, "distance"):
        found = found.withColumn("affinity", affinity.from_distance(F.col("affinity")))
    return found.withColumnsRenamed({"proposer": "det_id", "receiver": "ann_id"})


def match_rows(
    dets: DataFrame, gts: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("clip_id",),
    score: str = "score", det_columns: Sequence[str] = (), gt_columns: Sequence[str] = (),
) -> DataFrame:
    """Matched, false-positive and false-negative rows. Missed ground truth scores 0.

    The pairs are attached to the ground truth first, then one full outer join
    with the detections gives all three kinds. Unmatched ground truth joins on
    its own id (on a side of its own), so the keys stay spread.
    """
    keys = list(keys)
    side = [*keys, "_matched", "_id"]
    link = pairs.select(*keys, "det_id", "ann_id")
    truth = gts.select(*keys, "ann_id", *gt_columns).join(link, [*keys, "ann_id"], "left").withColumns(
        {"_matched": F.col("det_id").isNotNull(), "_id": F.coalesce("det_id", "ann_id")}
    ).drop("det_id")
    found = dets.select(*keys, "det_id", F.col(score).alias("score"), *det_columns).withColumns(
        {"_matched": F.lit(True), "_id": F.col("det_id")}
    )
    return found.join(truth, side, "full").drop("_matched", "_id").withColumns(
        {
            "score": F.coalesce("score", F.lit(0.0)),
            "is_prediction": F.col("det_id").isNotNull(),
            "is_ground_truth": F.col("ann_id").isNotNull(),
        }
    )


def _pairs(strict: bool):
    return strict_pairs if strict else free_choice_pairs


def detection_matches(
    dets: DataFrame, gts: DataFrame, affinity=TimeAffinity(), threshold: float = 0.0,
    strict: bool = True, key: str = "clip_id", score: str = "detection_score", slot: float = 0.1,
) -> DataFrame:
    """Task "detection": any target counts. Inputs are already target- and bounds-filtered."""
    pairs = _pairs(strict)(dets, gts, affinity, [key], threshold, score, slot)
    return match_rows(dets, gts, pairs, [key], score)


def per_class_matches(
    dets: DataFrame, gts: DataFrame, class_names: Sequence[str], affinity=TimeAffinity(),
    threshold: float = 0.0, strict: bool = True, include_generics: bool = True,
    key: str = "clip_id", scores: str = "class_scores", slot: float = 0.1,
) -> DataFrame:
    """Task "classification": every class is matched on its own score, all detections again.

    The class of the task is ``task_class``; ground truth of other classes does
    not take part, generic events (null class) do when asked.
    """
    names = F.array(*[F.lit(c) for c in class_names])
    wide = dets.select(key, "det_id", *_box_columns(dets), F.posexplode(scores).alias("_i", "score")).withColumn(
        "task_class", F.get(names, F.col("_i"))
    ).where(F.col("task_class").isNotNull()).drop("_i")
    own = F.when(F.col("class_name").isNotNull(), F.array("class_name"))
    tasks = F.coalesce(own, names) if include_generics else own
    truth = gts.withColumn("task_class", F.explode(tasks)).where(
        F.array_contains(names, F.col("task_class"))
    ).withColumnRenamed("class_name", "true_class")
    keys = ["task_class", key]
    pairs = _pairs(strict)(wide, truth, affinity, keys, threshold, "score", slot)
    rows = match_rows(wide, truth, pairs, keys, "score", gt_columns=["true_class"])
    return rows.withColumn("is_generic", F.col("is_ground_truth") & F.col("true_class").isNull())


def top_class_matches(
    dets: DataFrame, gts: DataFrame, class_names: Sequence[str], affinity=TimeAffinity(),
    threshold: float = 0.0, strict: bool = True, key: str = "clip_id",
    scores: str = "class_scores", slot: float = 0.1,
) -> DataFrame:
    """Task "top class": score and predicted class come from the best class score."""
    top = dets.withColumns(
        {
            "score": class_scores.top_score(F.col(scores)),
            "pred_class": class_scores.class_at(class_names, class_scores.top_index(F.col(scores))),
        }
    )
    truth = gts.withColumnRenamed("class_name", "true_class")
    pairs = _pairs(strict)(top, truth, affinity, [key], threshold, "score", slot)
    rows = match_rows(
        top, truth, pairs, [key], "score", det_columns=["pred_class"], gt_columns=["true_class"]
    )
    return rows.withColumn("is_generic", F.col("is_ground_truth") & F.col("true_class").isNull())


def assign_truth_classes(
    gts: DataFrame, dets: DataFrame, threshold: float, keys: Sequence[str] = ("clip_id",),
    slot: float = 0.1,
) -> DataFrame:
    """Give predictions the class of a ground truth, ground truth in id order.

    Each ground truth takes its best remaining prediction by box IoU when that
    is above the threshold. Predictions without one keep their class.
    """
    class _Scaled:
        span = staticmethod(lambda row, side: (row("start_time"), row("end_time")))
        band = staticmethod(lambda row: (row("low_freq"), row("high_freq")))
        column = staticmethod(scaled_box_iou)

    met = box_pairs(dets, gts, _Scaled, keys, threshold, slot)
    chosen = serial_choice(
        met.withColumnsRenamed({"ann_box": "proposer_box", "det_box": "receiver_box"}),
        gts.select(*keys, box_id(gts).alias("proposer_box"), F.col("ann_id").alias("proposer"), F.lit(0.0).alias("turn")),
        dets.select(*keys, box_id(dets).alias("receiver_box"), F.col("det_id").alias("receiver")), keys)
    labels = chosen.select(*keys, F.col("receiver").alias("det_id"), F.col("proposer").alias("ann_id")).join(
        gts.select(*keys, "ann_id", F.col("class_name").alias("_class")), [*keys, "ann_id"]
    ).drop("ann_id")
    return dets.join(labels, [*keys, "det_id"], "left").withColumn(
        "class_name", F.coalesce("_class", "class_name")
    ).drop("_class")


def outcome(threshold: float = 0.2) -> Column:
    """Outcome of a top-class match row; null for rows that count nowhere."""
    called = F.col("score") >= F.lit(float(threshold))
    known = F.col("true_class").isNotNull()
    return (
        F.when(~called & known, "false_negative")
        .when(~called, None)
        .when(~known, "false_positive")
        .when(F.col("true_class") == F.col("pred_class"), "true_positive")
        .otherwise("cross_trigger")
    )


def grouped_outcomes(matches: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Match rows with ``outcome`` and the class they are shown under (``group_class``)."""
    label = outcome(threshold)
    return matches.withColumn("outcome", label).where(F.col("outcome").isNotNull()).withColumn(
        "group_class",
        F.when(F.col("outcome").isin("false_negative", "true_positive"), F.col("true_class"))
        .otherwise(F.col("pred_class")),
    )
