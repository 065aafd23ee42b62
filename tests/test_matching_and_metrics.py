"""Small cases with known answers, and brute force on random clips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpframe.functions import geometry as g
from chirpframe.functions.polygons import pair_iou
from chirpframe.plans import clusters
from chirpframe.operators import curves, legacy, matching, reports

BOX = "start_time double, end_time double, low_freq double, high_freq double"


def detection_case(spark):
    """100 calls 0.1 s apart with rising scores; even ones are targets."""
    times = [(k, 1 + 0.1 * k) for k in range(100)]
    dets = spark.createDataFrame(
        [(1, k, t, t + 0.01, 1e4, 2e4, float(s)) for (k, t), s in zip(times, np.linspace(0, 1, 100))],
        f"clip_id int, det_id int, {BOX}, detection_score double",
    )
    gts = spark.createDataFrame(
        [(1, k, t, t + 0.01, 1e4, 2e4, None) for k, t in times if k % 2 == 0],
        f"clip_id int, ann_id int, {BOX}, class_name string",
    )
    return dets, gts


def test_detection_ap_is_one_half(spark):
    dets, gts = detection_case(spark)
    obs, positives = reports.detection_observations(matching.detection_matches(dets, gts))
    ap = curves.average_precision(obs, (), positives).first()[0]
    assert ap == pytest.approx(0.5, abs=0.005)


def test_classification_ap(spark):
    times = [(k, 1 + 0.1 * k) for k in range(100)]
    score = np.linspace(0, 1, 100)
    dets = spark.createDataFrame(
        [(1, k, t, t + 0.01, 1e4, 2e4, [float(s), float(s)]) for (k, t), s in zip(times, score)],
        f"clip_id int, det_id int, {BOX}, class_scores array<double>",
    )
    labels = [(k, t, "a" if k % 2 == 0 else "b" if k % 3 == 0 else None) for k, t in times]
    gts = spark.createDataFrame(
        [(1, k, t, t + 0.01, 1e4, 2e4, c) for k, t, c in labels if c], f"clip_id int, ann_id int, {BOX}, class_name string"
    )
    rows = matching.per_class_matches(dets, gts, ["a", "b"])
    got = {(r["metric"], r["class_name"]): r["value"] for r in reports.classification_metrics(rows, ["a", "b"]).collect()}
    assert got[("average_precision", "a")] == pytest.approx(0.5, abs=0.01)
    mean = np.mean([got[("average_precision", c)] for c in "ab"])
    assert got[("mean_average_precision", None)] == pytest.approx(mean)


def average_precision(y_true, y_score, n_pos):
    order = sorted(range(len(y_true)), key=lambda k: (-y_score[k], k))
    tp, best, points = 0, [], []
    for rank, k in enumerate(order, 1):
        tp += y_true[k]
        points.append((tp / n_pos, tp / rank))
    top = 0.0
    for recall, precision in reversed(points):
        top = max(top, precision)
        best.append((recall, top))
    best.reverse()
    area, last = 0.0, 0.0
    for recall, precision in best:
        area += (recall - last) * precision
        last = recall
    return area


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_ap_over_many_ranges_with_one_hot_score(spark, ranges):
    rng = random.Random(ranges)
    data = [(k, 0.5 if k % 3 == 0 else round(rng.random(), 2), rng.random() < 0.4) for k in range(400)]
    obs = spark.createDataFrame(data, "row_id int, score double, is_true boolean")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        ap = curves.average_precision(obs).first()[0]
        auc = curves.roc_auc(obs).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert ap == pytest.approx(average_precision([d[2] for d in data], [d[1] for d in data], sum(d[2] for d in data)))
    pos = [d[1] for d in data if d[2]]
    neg = [d[1] for d in data if not d[2]]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(pairs)


def test_metrics_without_positives(spark):
    obs = spark.createDataFrame([(1, 0.5, False), (2, 0.7, False)], "row_id int, score double, is_true boolean")
    none = spark.createDataFrame([(0,)], "n_pos bigint")
    assert np.isnan(curves.average_precision(obs, (), none).first()[0])
    assert curves.average_precision(obs).first()[0] == 0.0
    assert np.isnan(curves.roc_auc(obs).first()[0])


def random_case(seed, clips=12):
    rng = random.Random(seed)
    dets, gts = [], []
    for clip in range(clips):
        n = rng.choice([0, 1, 4, 9])
        for k in range(rng.choice([0, 1, 5, 12])):
            t = round(rng.random(), 2)
            dets.append((clip, len(dets), t, t + 0.05, 1e4, 3e4, round(rng.random(), 1)))
        for k in range(n):
            t = round(rng.random(), 2)
            gts.append((clip, len(gts), t, t + 0.05, 1e4, 3e4, "a"))
    return dets, gts


def sequential(dets, gts, affinity, strict):
    taken, out = set(), set()
    for d in sorted(dets, key=lambda x: (-x[6], x[1])):
        options = sorted(
            (-affinity(d, t), t[1]) for t in gts if t[0] == d[0] and affinity(d, t) > 0
        )
        for k, (_, ann) in enumerate(options):
            if strict and k > 0:
                break
            if ann not in taken:
                taken.add(ann)
                out.add((d[1], ann))
                break
    return out


def closeness(d, t):
    return max(0.0, 1 - abs(d[2] - t[2]) / 0.1)


def iou(d, t):
    shared = max(0.0, min(d[3], t[3]) - max(d[2], t[2])) * max(0.0, min(d[5], t[5]) - max(d[4], t[4]))
    area = lambda x: (x[3] - x[2]) * (x[5] - x[4])
    return shared / (area(d) + area(t) - shared) if shared else 0.0


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("kind", ["time", "box"])
def test_matching_equals_sequential_scan(spark, strict, kind):
    dets, gts = random_case(3 + strict)
    d = spark.createDataFrame(dets, f"clip_id int, det_id int, {BOX}, detection_score double")
    t = spark.createDataFrame(gts, f"clip_id int, ann_id int, {BOX}, class_name string")
    affinity, plain = (g.TimeAffinity(0.1), closeness) if kind == "time" else (g.BBoxIOU(), iou)
    rows = matching.detection_matches(d, t, affinity, strict=strict, slot=0.07)
    got = {(r["det_id"], r["ann_id"]) for r in rows.where("is_prediction and is_ground_truth").collect()}
    assert got == sequential(dets, gts, plain, strict)
    assert rows.count() == len(dets) + len(gts) - len(got)


@pytest.mark.parametrize("most", [10**7, 0, 30])
def test_equal_boxes_and_large_clusters(spark, monkeypatch, most):
    """Many equal boxes and scores; clusters scanned in tasks, all in rounds, or both."""
    monkeypatch.setattr(matching, "SCAN_ROWS", most)
    rng = random.Random(4)
    dets, gts = [], []
    for clip in range(5):
        for k in range(25):
            t = rng.choice([0.1, 0.13, 0.18, 0.5, 0.9])
            dets.append((clip, len(dets), t, t + 0.05, 1e4, 3e4, rng.choice([0.2, 0.5, 0.5, 0.7])))
            if k % 2:
                t = rng.choice([0.12, 0.14, 0.16, 0.5, 2.0])
                gts.append((clip, len(gts), t, t + 0.05, 1e4, 3e4, "a"))
    d = spark.createDataFrame(dets, f"clip_id int, det_id int, {BOX}, detection_score double")
    t = spark.createDataFrame(gts, f"clip_id int, ann_id int, {BOX}, class_name string")
    rows = matching.detection_matches(d, t, g.TimeAffinity(0.1), strict=False)
    got = {(r["det_id"], r["ann_id"]) for r in rows.where("is_prediction and is_ground_truth").collect()}
    assert got == sequential(dets, gts, closeness, False)
    keyed = matching.free_choice_pairs(
        d.withColumnRenamed("detection_score", "score").withColumn("task", F.lit("x")),
        t.withColumn("task", F.lit("x")), g.TimeAffinity(0.1), ["task", "clip_id"])
    assert {(r["det_id"], r["ann_id"]) for r in keyed.collect()} == got


def test_free_choice_takes_a_fixed_number_of_jobs(spark):
    """A chain in which every detection takes its neighbour's ground truth, short and long."""
    jobs = {}
    for n in (20, 2000):
        d = spark.range(n).select(
            F.lit(1).alias("clip_id"), F.col("id").alias("det_id"), (F.col("id") * 0.01).alias("start_time"),
            (F.col("id") * 0.01 + 0.005).alias("end_time"), (1 - F.col("id") / n).alias("detection_score"))
        t = d.select("clip_id", F.col("det_id").alias("ann_id"), (F.col("start_time") - 0.0051).alias("start_time"), "end_time")
        spark.sparkContext.setJobGroup(f"chain-{n}", "free choice")
        rows = matching.detection_matches(d, t, g.TimeAffinity(0.02), strict=False)
        assert rows.where("is_prediction and is_ground_truth").count() == n - 1  # the last one finds its own taken
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{n}"))
    spark.sparkContext.setJobGroup("rest", "")
    # adaptive planning may add a job or two for larger tables; rounds would add one for every link of the chain
    assert jobs[2000] <= jobs[20] + 4


def test_hot_clip_of_many_boxes(spark):
    """100 000 boxes in one clip, half of them in one place: equal boxes are not paired out."""
    n = 50_000
    at = F.when(F.col("id") % 2 == 0, F.lit(0.5)).otherwise(F.col("id") * 0.001)
    boxes = spark.range(n).select(F.lit(1).alias("clip_id"), F.col("id"), at.alias("start_time"), (at + 0.01).alias("end_time"))
    d = boxes.withColumnRenamed("id", "det_id").withColumn("detection_score", F.rand(1))
    t = boxes.withColumnRenamed("id", "ann_id").withColumn("start_time", F.col("start_time") + 0.0001)
    rows = matching.detection_matches(d, t, g.TimeAffinity(0.0005), strict=False)
    assert rows.where("is_prediction and is_ground_truth").count() == n


def test_interval_clusters(spark):
    rng = random.Random(2)
    rows = [(k, i, a := rng.random() * 50, a + rng.random() * 0.3) for k in "xy" for i in range(150)]
    frame = spark.createDataFrame(rows, "k string, i int, a double, b double").repartition(7)
    found = {(r["k"], r["i"]): r["cluster"] for r in clusters.interval_clusters(frame, ["k"], F.col("a"), F.col("b")).collect()}
    for key in "xy":
        top, number = None, 0
        for _, i, a, b in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            number += top is None or a > top
            top = b if top is None else max(top, b)
            assert found[key, i] == number


def test_one_hot_clip_and_position(spark):
    """All detections in one place: the best-scored wins, the rest are false positives."""
    d = spark.range(3000).select(
        F.lit(1).alias("clip_id"), F.col("id").alias("det_id"), F.lit(0.5).alias("start_time"), F.lit(0.6).alias("end_time"),
        (F.col("id") % 97 / 97).alias("detection_score"),
    )
    t = spark.range(40).select(
        F.lit(1).alias("clip_id"), F.col("id").alias("ann_id"), F.lit(0.502).alias("start_time"), F.lit(0.6).alias("end_time")
    )
    rows = matching.detection_matches(d, t)
    hit = rows.where("is_prediction and is_ground_truth").collect()
    assert [(r["det_id"], r["ann_id"]) for r in hit] == [(96, 0)]
    assert rows.where("not is_ground_truth").count() == 2999 and rows.where("not is_prediction").count() == 39


def test_truth_classes_in_ground_truth_order(spark):
    gts = spark.createDataFrame([(1, 0, 0.0, 1.0, 0.0, 10.0, "a"), (1, 1, 0.1, 1.0, 0.0, 10.0, "b")], f"clip_id int, ann_id int, {BOX}, class_name string")
    dets = spark.createDataFrame(
        [(1, 0, 0.1, 1.0, 0.0, 10.0, "Not Bat"), (1, 1, 0.5, 1.0, 0.0, 10.0, "Not Bat"), (1, 2, 5.0, 6.0, 0.0, 10.0, "Not Bat")],
        f"clip_id int, det_id int, {BOX}, class_name string",
    )
    out = {r["det_id"]: r["class_name"] for r in matching.assign_truth_classes(gts, dets, 0.01).collect()}
    assert out == {0: "a", 1: "b", 2: "Not Bat"}


def test_polygon_iou():
    square = '{"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}'
    diamond = '{"type": "Polygon", "coordinates": [[[1, 0], [2, 1], [1, 2], [0, 1]]]}'
    box = '{"type": "BoundingBox", "coordinates": [1, 0, 3, 2]}'
    notch = '{"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [2, 1], [0, 4]]]}'
    far = '{"type": "BoundingBox", "coordinates": [9, 9, 10, 10]}'
    assert pair_iou(square, square) == pytest.approx(1.0)
    assert pair_iou(square, diamond) == pytest.approx(0.5)
    assert pair_iou(square, box) == pytest.approx(2 / 6)
    assert pair_iou(square, far) == 0.0
    whole = '{"type": "BoundingBox", "coordinates": [0, 0, 4, 4]}'
    assert pair_iou(notch, whole) == pytest.approx(10 / 16)


def test_negative_buffers_are_errors():
    for make in (lambda: g.IntervalIOU(-1), lambda: g.BBoxIOU(0, -1), lambda: g.GeometricIOU(-0.1)):
        with pytest.raises(ValueError, match="below 0"):
            make()


def test_legacy_wrong_duration_fails(spark):
    gts = spark.createDataFrame([(1, 0, 9.0, 0)], "file_id int, gt_id int, start_time double, class_id int")
    dets = spark.createDataFrame([(1, 0, 1.0, 0.5, [0.5])], "file_id int, det_id int, start_time double, det_prob double, class_probs array<double>")
    files = spark.createDataFrame([(1, 2.0)], "file_id int, duration double")
    with pytest.raises(Exception, match="after the end of file"):
        legacy.precision_recall(gts, dets, files, "detection", 1).collect()


def test_balanced_accuracy_and_confusion_small(spark):
    rows = spark.createDataFrame(
        [(True, True, False, "a", "a", 0.9), (True, True, False, "a", "b", 0.8), (True, False, False, None, "b", 0.7),
         (False, True, False, "b", None, 0.0), (True, True, True, None, "a", 0.9)],
        "is_prediction boolean, is_ground_truth boolean, is_generic boolean, true_class string, pred_class string, score double",
    )
    assert reports.balanced_accuracy(rows, exclude_noise=True).first()[0] == pytest.approx(0.5)
    assert reports.balanced_accuracy(rows).first()[0] == pytest.approx((0.5 + 0 + 0) / 3)
    cm = {(r[0], r[1]): r[2] for r in reports.confusion_matrix(rows, ["b", "a"], normalize="none").collect()}
    assert cm == {("a", "a"): 1.0, ("a", "b"): 1.0, ("b", "a"): 0.0, ("b", "b"): 0.0}


def test_clips_of_recordings_without_events_are_not_copied_into_slots(spark):
    from chirpframe.operators import clips

    events = spark.createDataFrame([(7, 0.2, 1.4)], "recording_id long, start_time double, end_time double")
    tiles = clips.tile_recordings(
        spark.range(100).select(F.col("id").alias("recording_id"), F.lit(3.0).alias("duration")), 0.5, with_ids=False)
    found = clips.events_in_clips(events, tiles.drop("duration"), 0.05)
    assert sorted(r["clip_index"] for r in found.collect()) == [0, 1, 2]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2  # the known recordings first


def test_free_choice_takes_the_nearest_where_affinities_round_to_one(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 0.1, 0.5)], "clip_id int, det_id int, start_time double, end_time double, detection_score double")
    t = spark.createDataFrame([(1, 0, 2e-18, 0.1), (1, 1, 1e-18, 0.1)], "clip_id int, ann_id int, start_time double, end_time double")
    rows = matching.detection_matches(d, t, g.TimeAffinity(0.05), strict=False)
    assert [r["ann_id"] for r in rows.where("is_prediction").collect()] == [1]
    pairs = matching.free_choice_pairs(d.withColumnRenamed("detection_score", "score"), t, g.TimeAffinity(0.05))
    assert [(r["ann_id"], r["affinity"]) for r in pairs.collect()] == [(1, 1.0)]


def test_scaled_box_iou_has_no_rounding_of_its_own(spark):
    rng = random.Random(8)

    def box():
        s, low = rng.randrange(100) / 1000, rng.randrange(20, 30) * 1e3
        return [s, s + rng.randrange(1, 100) / 1000, low, low + rng.randrange(1, 20) * 1e3]

    boxes = [box() + box() for _ in range(300)]
    df = spark.createDataFrame(boxes, ", ".join(f"{side}{n} double" for side in ("", "g_") for n in ("start_time", "end_time", "low_freq", "high_freq")))
    got = [r["v"] for r in df.select(g.scaled_box_iou(F.col, lambda n: F.col(f"g_{n}")).alias("v")).collect()]
    want = []
    for a, b, c, d, e, f, h, k in boxes:
        shared = max(min(b, f) - max(a, e), 0) * max(min(d, k) - max(c, h), 0)
        want.append(shared / ((b - a) * (d - c) + (f - e) * (k - h) - shared))
    assert got == want


def test_file_class_does_not_depend_on_the_order_of_addition(spark):
    gts = spark.createDataFrame([(1, 0)], "file_id int, class_id int")
    rows = [(1, [a, b]) for a, b in ((0.3, 0.1), (0.2, 0.2), (0.1, 0.3))]  # 0.6 and 0.6000000000000001
    dets = spark.createDataFrame(rows, "file_id int, class_probs array<double>").coalesce(1)
    assert [r["pred_class"] for r in legacy.file_accuracy_simple(gts, dets, 2).collect()] == [0]
    low = spark.createDataFrame([(1, [0.0, 0.0])], "file_id int, class_probs array<double>")
    assert [r["pred_class"] for r in legacy.file_accuracy_simple(gts, low, 2).collect()] == [0]


def test_file_class_by_means_added_in_an_order(spark):
    gts = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "file_id int, class_id int")
    rows = [(1, n, [a, b]) for n, (a, b) in enumerate(((0.3, 0.1), (0.2, 0.2), (0.1, 0.3)))]  # 0.6 and 0.6000000000000001
    rows += [(2, 0, [None, None]), (2, 1, [0.25, None])]
    for parts in (1, 3):  # whatever the partitions
        dets = spark.createDataFrame(rows[::-1], "file_id int, at int, class_probs array<double>").repartition(parts)
        got = {r["file_id"]: r["pred_class"] for r in legacy.file_accuracy_simple(gts, dets, 2, order="at").collect()}
        assert got == {1: 1, 2: 0, 3: 0}
