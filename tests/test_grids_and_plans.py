"""Grid operators against numpy, invariance, streaming, plug-ins and plan shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpframe import plugins, streaming
from chirpframe.functions import coords
from chirpframe.operators import augment, clips, detections, features, filters, labels, matching, signal, targets, transforms, waves
from chirpframe.plans import ordered, scan


def cells_of(spark, grid, clip=1):
    h, w = grid.shape
    return spark.createDataFrame(
        [(clip, f, t, float(grid[f, t])) for f in range(h) for t in range(w)], "clip_id int, f bigint, t bigint, value double"
    )


def grid_of(frame, h, w, clip=1):
    out = np.zeros((h, w))
    for r in frame.where(F.col("clip_id") == clip).collect():
        out[r["f"], r["t"]] = r["value"]
    return out


def wave_of(spark, x, size, clip=1):
    rows = [(clip, k, [float(v) for v in x[k * size:(k + 1) * size]]) for k in range(-(-len(x) // size))]
    return waves.Waves(spark.createDataFrame(rows, "clip_id int, chunk bigint, samples array<double>"), size)


def samples_of(found, clip=1):
    rows = waves.to_samples(found).where(F.col("clip_id") == clip).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(len(rows)))
    return np.array([r["x"] for r in rows])


def brute_nms(grid, k=9):
    r = (k - 1) // 2
    out = np.zeros_like(grid)
    for f in range(grid.shape[0]):
        for t in range(grid.shape[1]):
            near = grid[max(0, f - r) : f + r + 1, max(0, t - r) : t + r + 1]
            out[f, t] = grid[f, t] if grid[f, t] == near.max() else 0
    return out


@pytest.mark.parametrize("tile", [5, 16, 1000])
def test_suppression_with_ties_and_tiles(spark, tile):
    grid = np.random.default_rng(1).integers(0, 20, (12, 40)) / 20
    want = brute_nms(grid)
    assert np.array_equal(grid_of(detections.suppress(cells_of(spark, grid), tile=tile), 12, 40), want)
    sparse = detections.suppress_sparse(cells_of(spark, grid).where("value > 0.3"))
    assert np.array_equal(grid_of(sparse, 12, 40), np.where(grid > 0.3, want, 0))


def torch_like_resize(grid, h, w):
    def axis(n_in, n_out):
        src = np.maximum((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0)
        lo = np.floor(src).astype(int)
        hi = np.minimum(lo + 1, n_in - 1)
        m = np.zeros((n_out, n_in))
        m[np.arange(n_out), lo] += 1 - (src - lo)
        m[np.arange(n_out), hi] += src - lo
        return m

    return axis(grid.shape[0], h) @ grid @ axis(grid.shape[1], w).T


@pytest.mark.parametrize(("h", "factor"), [(5, 0.5), (31, 1.7), (12, 1.0), (1, 0.1)])
def test_resize_any_ratio(spark, h, factor):
    grid = np.random.default_rng(2).random((12, 23))
    w = int(23 * factor)
    assert np.allclose(grid_of(signal.resize(cells_of(spark, grid), h, factor), h, w), torch_like_resize(grid, h, w))


@pytest.mark.parametrize("window", ["hann", "hamming", "blackman", "bartlett", "kaiser"])
def test_stft_against_numpy(spark, window):
    x = np.random.default_rng(3).standard_normal(203)
    n, hop = 32, 8
    padded = np.pad(x, n // 2, mode="reflect")
    frames = np.stack([padded[s : s + n] for s in range(0, len(x) // hop * hop + 1, hop)])
    want = np.abs(np.fft.rfft(frames * waves.window_values(window, n), axis=1)).T
    for size in (64, 100, 101, 203, 1000):  # last chunks of many lengths, also one chunk only
        got = grid_of(signal.to_cells(waves.magnitude_stft(wave_of(spark, x, size), n, hop, window)), *want.shape)
        assert np.allclose(got, want)
    with pytest.raises(NotImplementedError):
        waves.window_values("boxcar", 8)
    with pytest.raises(ValueError):
        waves.magnitude_stft(wave_of(spark, x, 40), n, hop)


def test_frames_of_chunks_and_joints():
    """Every frame comes from exactly one chunk or joint, whatever the sizes."""
    rng = np.random.default_rng(9)
    for _ in range(400):
        n_fft = int(rng.choice([2, 4, 6, 7, 16]))
        hop, size = int(rng.integers(1, n_fft + 1)), int(rng.integers(2 * n_fft, 5 * n_fft))
        n = int(rng.integers(n_fft // 2 + 1, 6 * size))
        x, ones = rng.standard_normal(n), np.ones(n_fft)
        padded = np.pad(x, n_fft // 2, mode="reflect")
        want = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop], axis=1))
        found = []
        for k in range(-(-n // size)):
            found.append(waves.chunk_spectra(x[k * size:(k + 1) * size], k, n, size, n_fft, hop, ones))
            if k:
                head = x[k * size:(k + 1) * size][:n_fft + 1]
                found += waves.joint_spectra(x[k * size - n_fft - 1:k * size], head, k, n, size, n_fft, hop, ones)
        places = np.concatenate([np.arange(first, first + len(v)) for first, v in found])
        assert sorted(places) == list(range(len(want)))
        assert np.allclose(np.concatenate([v for _, v in found])[np.argsort(places)], want)


@pytest.mark.parametrize("s", [0.04877, 0.3, 0.9])
def test_smoothing_over_many_blocks(spark, s):
    v = np.random.default_rng(4).random((2, 900)) * 10.0 ** np.random.default_rng(5).integers(-3, 4, (2, 900))
    want = np.zeros_like(v)
    for t in range(v.shape[1]):
        want[:, t] = (1 - s) * (want[:, t - 1] if t else 0) + s * v[:, t]
    out = signal.smooth(cells_of(spark, v), s, F.col("value")).withColumn("value", F.col("_m"))
    assert np.allclose(grid_of(out, *v.shape), want, rtol=1e-12)


def test_preprocess_shape_and_rate(spark):
    rate = 16000
    x = np.sin(2 * math.pi * 3000 * np.arange(1600) / rate)
    samples = wave_of(spark, x, 500)
    spec = signal.preprocess(samples, rate, [waves.center, waves.peak_normalize], min_freq=1000, max_freq=7000, height=24)
    size = spec.agg(F.max("f"), F.max("t"), F.min("value")).first()
    frames = 1600 // 8 + 1
    assert (size[0], size[1]) == (23, int(frames * 0.5) - 1) and size[2] >= 0
    assert signal.output_samplerate(256000) == 1000.0
    loud = signal.preprocess(samples, rate, min_freq=1000, max_freq=7000, height=24, spectrogram_steps=[])
    peak = loud.groupBy("f").agg(F.avg("value").alias("v")).orderBy(F.desc("v")).first()["f"]
    assert abs(1000 + (peak + 0.5) * 6000 / 24 - 3000) < 500


def test_arrays_fix_length(spark):
    row = spark.range(1).select(
        signal.fix_length(F.array(F.lit(1.0), F.lit(2.0)), 4).alias("long"), signal.fix_length(F.array(F.lit(1.0), F.lit(2.0)), 1).alias("short")
    ).first()
    assert row["long"] == [1.0, 2.0, 0.0, 0.0] and row["short"] == [1.0]


def test_padding_for_network(spark):
    out = samples_of(waves.pad_for_network(wave_of(spark, np.ones(1000), 300)))
    width = spark.range(1).select(coords.spectrogram_width(F.lit(float(len(out))))).first()[0]
    assert width % 32 == 0 and (out == 1).sum() == 1000


def test_waves_against_numpy(spark):
    x = np.random.default_rng(7).standard_normal(230)
    one = wave_of(spark, x, 64)
    assert np.allclose(samples_of(waves.center(one)), x - x.mean())
    assert np.allclose(samples_of(waves.peak_normalize(one)), x / np.abs(x).max())
    assert (samples_of(waves.peak_normalize(wave_of(spark, np.zeros(70), 64))) == 0).all()
    for n in (0, 1, 64, 129, 230, 256, 257, 700):
        want = np.pad(x, (0, max(0, n - 230)))[:n]
        assert np.allclose(samples_of(waves.pad_to(one, F.lit(n).cast("bigint"))), want)
    for delay in (0, 1, 63, 64, 65, 128, 200, 300):
        settings = spark.createDataFrame([(1, delay, 0.25)], "clip_id int, delay int, weight double")
        late = np.concatenate([np.zeros(delay), x])[:230]
        assert np.allclose(samples_of(waves.echo(one, settings)), 0.25 * x + 0.75 * late), delay
    other = np.random.default_rng(8).standard_normal(100)
    both = one.with_rows(one.rows.unionByName(wave_of(spark, other, 64, clip=2).rows))
    pairs = spark.createDataFrame([(1, 2, 0.3), (2, 1, 0.6)], "clip_id int, partner_id int, weight double")
    mixed = waves.mix(both, pairs)
    assert np.allclose(samples_of(mixed), 0.3 * x + 0.7 * np.pad(other, (0, 130)))
    assert np.allclose(samples_of(mixed, 2), 0.6 * other + 0.4 * x[:100])
    with pytest.raises(ValueError):
        waves.mix(one, pairs, wave_of(spark, other, 65))
    pieces = [(1, a, [float(v) for v in x[a:b]]) for a, b in ((0, 5), (5, 5), (5, 150), (150, 151), (151, 230))]
    cut = waves.join_pieces(spark.createDataFrame(pieces, "clip_id int, start bigint, samples array<double>"), 40)
    assert np.allclose(samples_of(cut), x) and {r["n"] for r in cut.rows.select(F.size("samples").alias("n")).collect()} == {40, 30}


def test_waves_do_not_move_samples(spark):
    """No row per sample, no gathered lists; only halos are exchanged for a spectrum."""
    spark.range(30).selectExpr("id % 3 as clip_id", "id div 3 as chunk", "array_repeat(cast(id as double), 64) as samples").createOrReplaceTempView("w")
    one = waves.Waves(spark.table("w"), 64)
    settings = spark.createDataFrame([(k, 9, 0.5) for k in range(3)], "clip_id long, delay int, weight double")
    for found in (waves.center(one), waves.peak_normalize(one)):
        text = plan(found.rows)
        assert "Exchange hash" not in text and "collect_list" not in text and "Generate" not in text
    assert "collect_list" not in plan(waves.pad_to(one, F.lit(700).cast("bigint")).rows)
    text = plan(waves.magnitude_stft(one, 32, 8))
    assert "collect_list" not in text and text.count("Exchange hashpartitioning") <= 2  # tails and heads
    assert "collect_list" not in plan(waves.echo(one, settings).rows)


@pytest.mark.parametrize("width", [2, 3, 64])
def test_affine_scan(spark, width):
    rng = np.random.default_rng(width)
    rows, want = [], {}
    for key in range(3):
        m = 0.0
        for place in sorted(rng.choice(200, 90, replace=False).tolist()):
            a, b = rng.random(), rng.standard_normal()
            rows.append((key, place, a, b))
            want[key, place] = m
            m = a * m + b
    frame = spark.createDataFrame(rows, "k int, place bigint, factor double, term double").repartition(5)
    got = {(r["k"], r["place"]): r["carry"] for r in scan.affine_prefix(frame, ["k"], width=width).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_heatmap_is_the_exact_maximum(spark):
    spots = spark.createDataFrame([(1, 3, 5, "a"), (1, 8, 20, None), (1, 3, 9, "a")], "clip_id int, f0 int, t0 int, class_name string")
    got = labels.heatmaps(spots, 12, 30, sigma=2.0)
    f, t = np.mgrid[0:12, 0:30]
    blob = lambda f0, t0: np.exp(-((f - f0) ** 2 + (t - t0) ** 2) / 8)
    det = np.maximum.reduce([blob(3, 5), blob(8, 20), blob(3, 9)])
    layer = lambda n: got.where(F.col("layer") == n)
    assert np.allclose(grid_of(layer(labels.DETECTION), 12, 30), det, atol=1e-38)
    assert np.allclose(grid_of(layer("a"), 12, 30), np.maximum(blob(3, 5), blob(3, 9)), atol=1e-38)


@pytest.mark.parametrize("tile", [7, 64, 256])
def test_heatmap_over_tiles_and_dense_events(spark, monkeypatch, tile):
    rng = np.random.default_rng(tile)
    spots = [(1, int(f), int(t), None) for f, t in zip(rng.integers(0, 40, 300), rng.integers(0, 130, 300))]
    other = [(2, 39 - f, t, "x") for _, f, t, _ in spots[:2]]
    frame = spark.createDataFrame(spots + other, "clip_id int, f0 int, t0 int, class_name string")
    monkeypatch.setattr(labels, "GRID_CELLS", 10_000)  # a few grids at a time
    maps = labels.heatmaps(frame, 40, 130, sigma=0.7, tile=tile)
    got = grid_of(maps, 40, 130)
    assert maps.where("clip_id = 2").groupBy("layer").count().count() == 2
    f, t = np.mgrid[0:40, 0:130]
    nearest = np.min([(f - a) ** 2 + (t - b) ** 2 for _, a, b, _ in spots], axis=0)
    assert np.allclose(got, np.exp(-nearest / (2 * 0.7**2)), atol=1e-38)


def test_lower_envelope():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 40))
        squares = rng.integers(0, 30, (n, 9)).astype(float) ** 2
        rows = np.arange(n)
        want = np.min(squares[:, None, :] + ((rows[None, :] - rows[:, None]) ** 2)[:, :, None], axis=0)
        assert np.array_equal(labels.lower_envelope(squares), want)


@pytest.mark.parametrize("tile", [4, 1000])
def test_max_power_from_running_sums(spark, tile):
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 9, (6, 30)).astype(float)
    grid[2] = 0  # a row without cells below
    boxes = [(1, k, int(rng.integers(-2, 32)), int(rng.integers(0, 8)), int(rng.integers(0, 12)), int(rng.integers(0, 6))) for k in range(40)]
    dets = spark.createDataFrame(boxes, "clip_id int, det_id int, x_pos int, y_pos int, bb_width int, bb_height int")
    got = {r["det_id"]: r for r in features.max_power(dets, cells_of(spark, grid).where("value > 0"), tile=tile).collect()}
    hertz = lambda row: int(round((6 - row) / 6 * 110000 + 10000, 2))
    for _, k, x, y, w, h in boxes:
        x0, x1, y1, y0 = max(x, 0), min(29, x + w), min(5, y), max(y - h, 0)
        half = x0 + max(x1 - x0, 0) // 2
        spans = [grid[:, a:max(a, b)].sum(axis=1) for a, b in ((x0, x1), (x0, half), (half, x1))]
        want = [hertz(int(np.argmax(s))) for s in spans]
        assert [got[k]["max_power"], got[k]["max_power_first"], got[k]["max_power_second"]] == want
        assert got[k]["max_power_bb"] == (hertz(y0 + int(np.argmax(spans[0][y0:y1]))) if y1 > y0 else None)


def test_tiling_and_subclips(spark):
    rec = spark.createDataFrame([("6ba7b811-9dad-11d1-80b4-00c04fd430c8", 2.0), ("6ba7b811-9dad-11d1-80b4-00c04fd430c9", 1.2)], "recording_id string, duration double")
    assert [r["count"] for r in clips.tile_recordings(rec, 0.5).groupBy("recording_id").count().orderBy("recording_id").collect()] == [4, 2]
    assert clips.tile_recordings(rec, 0.5, discard_empty=False).count() == 7
    assert clips.tile_recordings(rec, 0.5, max_empty=0.35).count() == 7
    windows = clips.random_subclips(spark.range(200).select(F.col("id").alias("clip_id"), F.lit(0.0).alias("clip_start"), F.lit(1.0).alias("clip_end")), 0.5, 0.2)
    span = windows.agg(F.min("clip_start"), F.max("clip_start")).first()
    assert 0 <= span[0] < 0.1 and 0.6 < span[1] <= 0.7


def test_batch_size_does_not_change_scores(spark):
    grid = np.random.default_rng(6).random((4, 10))
    frames = [cells_of(spark, grid[:, : 4 + k], clip=k) for k in range(6)]
    cells = frames[0]
    for f in frames[1:]:
        cells = cells.unionByName(f)

    def scorer(block):
        return [[(float(g.max()), float(g.sum()))] for g in block]

    packed = detections.pack_grids(cells, 4)
    runs = [
        sorted(map(tuple, detections.score_clips(packed, scorer, "top double, total double", batch_size=n, partitions=p).collect()))
        for n, p in ((1, 1), (3, 2), (8, 1))
    ]
    assert np.allclose(runs[0], runs[1]) and np.allclose(runs[0], runs[2])
    tiled = detections.pack_grids(frames[5], 4, columns=4, border=1).orderBy("tile").collect()
    assert [(r["tile"], r["first"]) for r in tiled] == [(0, 0), (1, 3), (2, 7)]
    assert np.allclose(np.array(tiled[1]["spec"]), grid[:, 3:9]) and np.allclose(np.array(tiled[2]["spec"]), grid[:, 7:9])


def test_six_augmentation_steps_scan_once(spark, tmp_path):
    spark.range(40).selectExpr("id % 4 as clip_id", "id as t", "cast(id as double) as x").write.parquet(str(tmp_path / "x"))
    steps = [(lambda d: d.withColumn("x", F.col("x") * 2), 0.5)] * 6
    out = augment.augment(spark.read.parquet(str(tmp_path / "x")), steps)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert out.count() == 40


def test_features_across_ranges(spark):
    dets = spark.range(300).select(
        (F.col("id") % 2).alias("recording_id"), F.col("id").alias("det_id"), (F.col("id") * 7 % 300 / 10).alias("start_time")
    ).withColumn("end_time", F.col("start_time") + 0.05)
    got = {r["det_id"]: r["call_interval"] for r in features.call_interval(dets).collect()}
    for rec in (0, 1):
        mine = sorted((k * 7 % 300 / 10, k) for k in range(300) if k % 2 == rec)
        assert got[mine[0][1]] is None
        for (s0, _), (s1, k) in zip(mine, mine[1:]):
            assert got[k] == pytest.approx(round(s1 - (s0 + 0.05), 5))


def test_ordered_work_equals_one_window(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 37 % 101).alias("v"))
    cut = ordered.order_rows(rows, ["k"], [("v", True), ("id", False)], ranges=9)
    assert cut.rows.select("_range").distinct().count() > 3
    out = ordered.running(ordered.with_rank(cut), sums={"s": F.col("v")}, maxima={"m": F.col("id")}).clean().collect()
    for key in range(3):
        total, top = 0, -1
        mine = sorted((r for r in out if r["k"] == key), key=lambda r: (-r["v"], r["id"]))
        for place, r in enumerate(mine, 1):
            total, top = total + r["v"], max(top, r["id"])
            assert (r["rank"], r["s"], r["m"]) == (place, total, top)


def test_augmentation_invariants(spark):
    settings = spark.createDataFrame([(1, 3, 0.25)], "clip_id int, delay int, weight double")
    got = samples_of(waves.echo(wave_of(spark, np.arange(1.0, 101.0), 30), settings))
    assert got[0] == 0.25 and got[10] == pytest.approx(0.25 * 11 + 0.75 * 8)
    ring = augment.partners(spark.range(20).select(F.col("id").alias("clip_id"))).collect()
    assert {r["clip_id"] for r in ring} == {r["partner_id"] for r in ring} == set(range(20))
    assert all(r["clip_id"] != r["partner_id"] for r in ring)
    samples = spark.range(100).select(F.lit(1).alias("clip_id"), F.col("id").alias("idx"), (F.col("id") + 1.0).alias("x"))
    same = augment.maybe_apply(samples, lambda d: d.withColumn("x", F.lit(0.0)), 0.0)
    assert same.agg(F.sum("x")).first()[0] == 5050.0


def test_row_local_steps_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, 0.0, 0.01 * k, 2e4, 3e4 + 1e3 * k) for k in range(10)], "det_id int, start_time double, end_time double, low_freq double, high_freq double")
    rows.write.parquet(str(tmp_path / "in"))
    schema = "det_id int, start_time double, end_time double, low_freq double, high_freq double"
    stream = streaming.read_detections(spark, str(tmp_path / "in"), schema)
    steps = [lambda d: filters.by_duration(d, 0.03), lambda d: filters.by_frequency(d, 0, 37000, "high_freq"),
             lambda d: d.withColumns(features.box_features())]
    query = streaming.write_available(streaming.apply_steps(stream, steps), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["det_id"] for r in out.collect()) == [3, 4, 5, 6, 7]


def test_plugins(spark):
    rule = plugins.load("chirpframe.functions.conditions.HasTag", key="a", value="b")
    assert rule.key == "a"
    step = plugins.load("chirpframe.operators.filters.by_duration")
    assert step is filters.by_duration
    with pytest.raises(ValueError):
        plugins.load("nodots")
    plugins.register_scorer(spark, "twice", lambda s: s.map(lambda a: [2 * v for v in a]))
    assert spark.sql("select twice(array(1D, 2D)) as v").first()["v"] == [2.0, 4.0]


def test_nested_transform_keeps_order_and_fields(spark):
    tags = "array<struct<key:string,value:string>>"
    nested = spark.createDataFrame(
        [(1, [(1, 100.0, 500.0, "BoundingBox", [("class", "x")]), (2, 900.0, 950.0, "TimeInterval", [])])],
        f"clip_id int, events array<struct<ann_id:int,low_freq:double,high_freq:double,geom_type:string,tags:{tags}>>",
    )
    steps = transforms.ApplyAll([transforms.SetFrequencyBound(300.0), transforms.MapTagValue("class", {"x": "y"})])
    out = transforms.transform_nested(nested, steps, fields=("ann_id", "low_freq", "high_freq", "geom_type", "tags")).first()["events"]
    assert [(e["ann_id"], e["low_freq"]) for e in out] == [(1, 300.0), (2, 900.0)]
    assert out[0]["tags"][0]["value"] == "y"


# --- plan shapes -----------------------------------------------------------

def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def boxes(spark):
    d = spark.range(50).select(F.lit(1).alias("clip_id"), F.col("id").alias("det_id"), F.col("id").cast("double").alias("start_time"),
                               (F.col("id") + 1.0).alias("end_time"), F.lit(0.5).alias("detection_score"))
    t = d.select("clip_id", F.col("det_id").alias("ann_id"), "start_time", "end_time")
    return d, t


def test_matching_has_no_cross_or_nested_loop_join(boxes):
    from chirpframe.functions.geometry import IntervalIOU, TimeAffinity

    for affinity in (TimeAffinity(), IntervalIOU()):
        text = plan(matching.detection_matches(*boxes, affinity))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_peaks_are_cut_before_the_shuffle(spark):
    text = plan(detections.peaks(cells_of(spark, np.zeros((2, 3))), 5))
    assert text.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("det_id"), F.col("id").cast("double").alias("low_freq"), F.lit(1.0).alias("high_freq"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "d"))
    frame = filters.by_frequency(spark.read.parquet(str(tmp_path / "d")), 3.0, 5.0, "low_freq").select("det_id")
    text = plan(frame)
    assert "GreaterThanOrEqual(low_freq,3.0)" in text and "unused" not in text


def test_group_stats_use_partial_aggregation(spark):
    text = plan(signal.spectral_mean_subtraction(cells_of(spark, np.zeros((2, 3)))))
    assert "partial_avg" in text and "Window" not in text


def test_peaks_join_blocks_of_columns_not_cells(spark):
    rng = np.random.default_rng(5)
    loud = rng.integers(0, 9, (40, 6)).astype(float)  # many equal cells; 40 columns are three blocks
    cells = spark.createDataFrame(
        [(1, t, f, float(loud[t, f])) for t in range(40) for f in range(6)], "clip_id long, t long, f long, value double")
    grid = spark.createDataFrame([(1, 0.0, 40.0, 40, 0.0, 60.0, 6)], "clip_id long, clip_start double, clip_end double, n_time int, min_freq double, max_freq double, n_freq int")
    boxes = [(k, 1, float(a), float(a + w), float(b), float(b + 25)) for k, (a, w, b) in enumerate(
        zip(rng.integers(-3, 42, 60), rng.integers(0, 38, 60), rng.integers(-5, 55, 60)))]
    events = spark.createDataFrame(boxes, "ann_id long, clip_id long, start_time double, end_time double, low_freq double, high_freq double")
    found = targets.with_peaks(events, cells, grid)
    got = {r["ann_id"]: (r["peak_time"], r["peak_freq"]) for r in found.collect()}
    for k, _, start, end, low, high in boxes:
        inside = [(-loud[t, f], t, f) for t in range(40) for f in range(6) if start <= t <= end and low <= 10 * f <= high]
        want = (float(min(inside)[1]), 10.0 * min(inside)[2]) if inside else (None, None)
        assert got[k] == want, k
    joined = [x for x in plan(found).splitlines() if "Join" in x]
    assert any("_block" in x for x in joined) and not any("min_by" in x for x in plan(found).splitlines())
