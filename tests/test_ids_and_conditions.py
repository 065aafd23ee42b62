import uuid

import pytest
from pyspark.sql import functions as F

from chirpframe.functions import conditions as c
from chirpframe.functions import draws, ids
from chirpframe.operators import filters, targets


def test_uuid5_equals_standard(spark):
    names = ["", "a", "rec_0_0.5", "Grüße", "x" * 300]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["u"] for r in frame.select("n", ids.uuid5(ids.URL_NAMESPACE, F.col("n")).alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_number_text_equals_repr(spark):
    values = [0.0, 0.5, 1.0, 0.1 + 0.2, 1e-3, 5e-4, 1.25e-4, 9.9e-5, 1e-5, 123456.789, 1e7, 12345678.25, 1e15, 1.5e16, 1e22, -0.25, -2e-4, -3e7]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r["t"] for r in frame.orderBy("k").select(ids.number_text(F.col("v")).alias("t")).collect()]
    assert got == [repr(v) for v in values]


def test_file_ids(spark):
    ns = uuid.UUID(ids.FORMAT_NAMESPACE)
    sub = lambda n: uuid.uuid5(ns, n)
    rec = uuid.uuid5(sub("recording"), "abc")
    clip = uuid.uuid5(sub("clip"), f"{rec}_0_{0.5}")
    event = uuid.uuid5(sub("sound_event"), f"{rec}_{0.1}_{0.25}")
    row = spark.range(1).select(
        ids.recording_id(F.lit("abc")).alias("r"),
        ids.whole_clip_id(F.lit(str(rec)), F.lit(0.5)).alias("c"),
        ids.clip_annotation_id(F.lit(str(clip))).alias("ca"),
        ids.sound_event_id(F.lit(str(rec)), F.lit(0.1), F.lit(0.25)).alias("s"),
        ids.sound_event_annotation_id(F.lit(str(event))).alias("sa"),
        ids.task_id(F.lit("f.wav")).alias("t"),
        ids.tile_clip_id(F.lit(str(rec)), F.lit(0.5), F.lit(1.0)).alias("tile"),
    ).first()
    assert row["r"] == str(rec) and row["c"] == str(clip) and row["s"] == str(event)
    assert row["ca"] == str(uuid.uuid5(sub("clip_annotation"), str(clip)))
    assert row["sa"] == str(uuid.uuid5(sub("sound_event_annotation"), str(event)))
    assert row["t"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "f.wav_task"))
    assert row["tile"] == str(uuid.uuid5(rec, "0.5_1.0"))


def test_draws_are_uniform_and_partition_free(spark):
    frame = spark.range(20000)
    a = frame.select(draws.draw("s", F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(a[0] - 0.5) < 0.01 and 0 <= a[1] and a[2] < 1
    one = frame.repartition(3).select(F.sum(draws.integer("s", F.col("id"), 2, 5))).first()[0]
    two = frame.repartition(11).select(F.sum(draws.integer("s", F.col("id"), 2, 5))).first()[0]
    assert one == two


def test_empty_tag_lists_are_errors():
    with pytest.raises(ValueError):
        c.HasAllTags([])
    with pytest.raises(ValueError):
        c.HasAnyTag([])


def events(spark):
    tags = "array<struct<key:string,value:string>>"
    return spark.createDataFrame(
        [
            (1, [("a", "1"), ("b", "2")], 0.0, 1.0, 10.0, 20.0, "BoundingBox"),
            (2, [("a", "2")], 0.0, 0.5, None, None, "TimeInterval"),
            (3, [], None, None, None, None, None),
            (4, None, 0.0, 2.0, 5.0, 50.0, "BoundingBox"),
        ],
        f"id int, tags {tags}, start_time double, end_time double, low_freq double, high_freq double, geom_type string",
    )


@pytest.mark.parametrize(
    ("rule", "wanted"),
    [
        (c.HasTag("a", "1"), {1}),
        (c.HasAllTags([("a", "1"), ("b", "2")]), {1}),
        (c.HasAnyTag([("a", "2"), ("b", "2")]), {1, 2}),
        (c.Not(c.HasTag("a", "1")), {2, 3, 4}),
        (c.Duration("gte", 1.0), {1, 4}),
        (c.Not(c.Duration("gte", 1.0)), {2, 3}),
        (c.Frequency("lt", "low", 8.0), {4}),
        (c.Not(c.Frequency("lt", "low", 8.0)), {1, 2, 3}),
        (c.AllOf([]), {1, 2, 3, 4}),
        (c.AnyOf([]), set()),
        (c.AllOf([c.Duration("gt", 0.1), c.Not(c.HasTag("a", "2"))]), {1, 4}),
    ],
)
def test_conditions_are_null_safe(spark, rule, wanted):
    assert {r["id"] for r in filters.keep(events(spark), rule).collect()} == wanted


def test_nested_filter_keeps_empty_clips(spark):
    nested = events(spark).groupBy((F.col("id") % 2).alias("clip")).agg(F.collect_list(F.struct("*")).alias("events"))
    out = filters.filter_events(nested, c.HasTag("a", "1")).select("clip", F.size("events").alias("n"))
    assert {(r["clip"], r["n"]) for r in out.collect()} == {(0, 0), (1, 1)}


def test_invalid_uuid_names_its_position(spark):
    good = spark.createDataFrame([("6BA7B8119DAD11D180B400C04FD430C8", 0)], "value string, position int")
    assert filters.checked_uuids(good).first()["value"] == ids.URL_NAMESPACE
    bad = spark.createDataFrame([("nope", 7)], "value string, position int")
    with pytest.raises(Exception, match="entry 7 is no id"):
        filters.checked_uuids(bad).collect()


def test_path_lists_outside_policy(spark):
    rec = spark.createDataFrame([("/base/a.wav",), ("/else/b.wav",), ("c.wav",), ("/base/d.wav",)], "path string")
    listed = spark.createDataFrame([("/base/a.wav",), ("c.wav",)], "p string")
    kept = filters.path_in_list(rec, listed, "/base")
    assert {r["path"] for r in kept.collect()} == {"/base/a.wav", "/else/b.wav", "c.wav"}
    warned = filters.path_in_list(rec, listed, "/base", "warn").where("_outside")
    assert [r["path"] for r in warned.collect()] == ["/else/b.wav"]
    with pytest.raises(Exception, match="outside"):
        filters.path_in_list(rec, listed, "/base", "error").collect()


def test_target_config_checks():
    a = targets.TargetClass("a", tags=[("class", "a")])
    with pytest.raises(ValueError, match="unique"):
        targets.Targets([a, a])
    with pytest.raises(ValueError, match="not both"):
        targets.TargetClass("a", tags=[("x", "y")], match_if=c.HasTag("x", "y"))
    with pytest.raises(ValueError, match="must have"):
        targets.TargetClass("a")
    with pytest.raises(ValueError, match="missing"):
        targets.Targets([a]).check_model(["a", "b"])
    with pytest.raises(ValueError, match="dimension order"):
        targets.BoxMapping(overrides={"a": targets.PeakBox()})
    assert targets.Targets([a]).decoding == {"a": [("class", "a")]}


def test_anchor_round_trip(spark):
    box = spark.createDataFrame([(1.0, 2.0, 1000.0, 5000.0)], "start_time double, end_time double, low_freq double, high_freq double")
    from chirpframe.functions.geometry import ANCHORS

    for anchor in ANCHORS:
        mapper = targets.AnchorBox(anchor)
        coded = box.select(*[col.alias(n) for n, col in mapper.encode().items()])
        row = coded.select(*[col.alias(n) for n, col in mapper.decode().items()]).first()
        assert row.asDict() == pytest.approx({"start_time": 1.0, "end_time": 2.0, "low_freq": 1000.0, "high_freq": 5000.0})
    with pytest.raises(ValueError, match="no anchor"):
        targets.AnchorBox("middle").encode()
