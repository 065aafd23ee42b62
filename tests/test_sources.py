"""Files in and out, on documents written by the tests."""

import io
import json
import random
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpframe.functions import ids
from chirpframe.functions.conditions import HasTag
from chirpframe.operators import dataset, filters, projections, splits
from chirpframe.plans.session import ensure_checkpoint_dir
from chirpframe.sources import annotations, audio, documents, predictions, ranges, tables


def event(**changes):
    return {
        "class": "Myotis daubentonii", "event": "Echolocation", "individual": 0, "start_time": 0.1, "end_time": 0.2,
        "low_freq": 20000, "high_freq": 60000, **changes,
    }


def document(name, **changes):
    return {
        "id": name, "duration": 0.5, "time_exp": 1, "class_name": "Myotis daubentonii", "annotated": True,
        "issues": False, "notes": "", "annotation": [event()], **changes,
    }


@pytest.fixture
def folder(tmp_path):
    def put(name, content):
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content, indent=2))

    put("a.json", document("a.wav"))
    put("b.json", document("b.wav", annotated=False))
    put("c.json", document("c.wav", issues=True))
    put("d.json", "{not json")
    put("e.json", {"id": "e.wav", "duration": 1.0, "annotated": True})
    put("f.json", document("f.wav", annotation=[event(individual="7"), event(**{"class": "", "start_time": 0.3})]))
    return tmp_path


def names(frame, column="id"):
    return sorted(r[column] for r in frame.select(column).collect())


def test_file_documents(spark, folder):
    assert names(annotations.read_files(spark, str(folder))) == ["a.wav", "f.wav"]
    assert names(annotations.read_files(spark, str(folder), only_annotated=False)) == ["a.wav", "b.wav", "f.wav"]
    assert names(annotations.read_files(spark, str(folder), exclude_issues=False)) == ["a.wav", "c.wav", "f.wav"]
    assert len(names(annotations.broken_files(spark, str(folder)), "file")) == 2
    events = projections.file_events(annotations.read_files(spark, str(folder)))
    tags = {(r["id"], r["start_time"]): [(t["key"], t["value"]) for t in r["tags"]] for r in events.collect()}
    assert tags[("f.wav", 0.3)] == [("event", "Echolocation"), ("individual", "0")]
    assert ("individual", "7") in tags[("f.wav", 0.1)]


def test_file_clips_join_audio(spark, folder):
    files = annotations.read_files(spark, str(folder))
    recordings = spark.createDataFrame([("a.wav", "abc", 0.5, 256000)], "file_name string, hash string, duration double, samplerate int")
    rows = projections.file_clips(files, recordings).collect()
    assert [r["id"] for r in rows] == ["a.wav"]  # f.wav has no audio
    expected = spark.range(1).select(ids.whole_clip_id(ids.recording_id(F.lit("abc")), F.lit(0.5)).alias("c")).first()["c"]
    assert rows[0]["clip_id"] == expected
    tasks = projections.annotation_tasks(annotations.read_files(spark, str(folder), exclude_issues=False)).collect()
    assert sorted(r["state"] for r in tasks) == ["completed", "completed", "rejected"]


def test_merged_documents(spark, tmp_path):
    good = tmp_path / "merged.json"
    good.write_text(json.dumps([document("a.wav"), {"id": "x"}, document("b.wav", annotated=False)]))
    assert names(annotations.read_merged(spark, str(good))) == ["a.wav"]
    bad = tmp_path / "single.json"
    bad.write_text(json.dumps(document("a.wav")))
    with pytest.raises(TypeError):
        annotations.read_merged(spark, str(bad))


def test_tree_attaches_audio_path(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.json").write_text(json.dumps(document("a.wav", issues=True)))
    (tmp_path / "x" / "y" / "b.json").write_text(json.dumps(document("b.wav")))
    (tmp_path / "x" / "y" / "c.json").write_text(json.dumps(document("c.wav", annotated=False)))
    assert names(annotations.read_tree(spark, str(tmp_path), "/audio/"), "file_path") == ["/audio/a.wav", "/audio/b.wav"]
    assert names(annotations.read_tree(spark, str(tmp_path), "/audio/", filter_issues=True)) == ["b.wav"]


def project(kind="annotation_project"):
    clip = lambda k: {"uuid": f"clip{k}", "recording": "rec", "start_time": 0.0, "end_time": 1.0}
    ann = lambda k, ev: {"uuid": f"ca{k}", "clip": f"clip{k}", "tags": [0], "sound_events": ev, "notes": [{"message": "hi"}]}
    task = lambda k, *states: {"uuid": f"task{k}", "clip": f"clip{k}", "status_badges": [{"state": s} for s in states]}
    return {
        "created_on": "2024-01-01", "version": "1.1.0",
        "data": {
            "uuid": "doc", "collection_type": kind, "name": "n", "description": "d",
            "tags": [{"id": 0, "key": "event", "value": "Echolocation"}, {"id": 1, "key": "class", "value": "Myotis"}],
            "recordings": [{"uuid": "rec", "path": "a/b.wav", "duration": 1.0, "channels": 1, "samplerate": 256000, "tags": [1]}],
            "clips": [clip(k) for k in range(4)],
            "sound_events": [{"uuid": "se", "recording": "rec", "geometry": {"type": "BoundingBox", "coordinates": [0.1, 100.0, 0.2, 200.0]}}],
            "sound_event_annotations": [{"uuid": "sea", "sound_event": "se", "tags": [0, 1]}],
            "clip_annotations": [ann(0, ["sea"]), ann(1, []), ann(2, []), ann(3, [])],
            "tasks": [task(0, "completed"), task(1), task(2, "completed", "rejected"), task(3, "completed", "verified")],
        },
    }


def test_annotation_project(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(project()))
    clips = annotations.load_project_clips(spark, str(path))
    assert names(clips, "clip_id") == ["clip0", "clip3"]
    row = clips.where("clip_id = 'clip0'").first()
    assert row["path"] == "a/b.wav" and row["notes"] == ["hi"]
    assert [(e["start_time"], e["high_freq"], [t["value"] for t in e["tags"]]) for e in row["events"]] == [(0.1, 200.0, ["Echolocation", "Myotis"])]
    assert names(annotations.load_project_clips(spark, str(path), only_verified=True), "clip_id") == ["clip3"]
    assert len(names(annotations.load_project_clips(spark, str(path), only_completed=False), "clip_id")) == 3
    assert len(names(annotations.load_project_clips(spark, str(path), use_filter=False), "clip_id")) == 4
    path.write_text(json.dumps(project("annotation_set")))
    assert len(names(annotations.load_project_clips(spark, str(path)), "clip_id")) == 4
    path.write_text(json.dumps(project("dataset")))
    with pytest.raises(Exception, match="neither annotation set"):
        annotations.load_project_clips(spark, str(path)).collect()


def test_dataset_round_trip(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(project("annotation_set")))
    config = dataset.DatasetConfig("d", [dataset.Source("s", lambda s: annotations.load_project_clips(s, str(path)))], event_filter=HasTag("class", "None"))
    clips = dataset.load_dataset(spark, config)
    annotations.save_annotation_set(clips, str(tmp_path / "out" / "set.json"), name="n", created="2024-01-01")
    saved = json.loads((tmp_path / "out" / "set.json").read_text())["data"]
    assert saved["name"] == "n" and list(saved)[3:] == list(documents.ANNOTATION_SECTIONS[:-1])
    assert [t["id"] for t in saved["tags"]] == list(range(len(saved["tags"])))
    back = annotations.load_project_clips(spark, str(tmp_path / "out" / "set.json"))
    assert names(back, "clip_id") == ["clip0", "clip1", "clip2", "clip3"]  # empty clips stay
    assert back.where(F.size("events") > 0).count() == 0
    assert all(r["tags"][-1]["value"] == "s" for r in back.collect())


def test_lists(spark, tmp_path):
    put = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    values = lambda *a, **k: names(tables.read_list(spark, *a, **k), "value")
    assert values(put("a.json", '["x", "y"]')) == ["x", "y"]
    assert values(put("b.json", '{"ids": ["x"], "other": 1}'), field="ids") == ["x"]
    assert values(put("c.txt", " x \n\n y\n"), "txt") == ["x", "y"]
    assert values(put("d.csv", "id,name\n1, x \n2,\n3,y\n"), "csv", column="name") == ["x", "y"]
    with pytest.raises(ValueError):
        values(str(tmp_path / "d.csv"), "csv", column="nope")
    with pytest.raises(KeyError):
        values(str(tmp_path / "b.json"), field="nope")
    with pytest.raises(TypeError):
        values(str(tmp_path / "a.json"), field="ids")
    with pytest.raises(Exception, match="must be a JSON array"):
        values(put("e.json", '{"x": 1}'))


def test_call_tables(spark, tmp_path):
    (tmp_path / "rec one.ta").write_text("Filename\tVersion\tCallNum\tStTime\tDur\tPrevSt\tFmax\tFmin\tf1\nx\t1\t0\t12.5\t5\t0\t60\t20.5\t0.25\n")
    row = tables.read_calls_ms(spark, str(tmp_path), ["f1"]).first()
    assert (row["recording"], row["start_time"], row["end_time"], row["low_freq"], row["high_freq"], row["features"]) == (
        "rec one.wav", 0.0125, 0.0175, 20500.0, 60000.0, [0.25])
    table = tmp_path / "batch.txt"
    cols = ["Path", "Filename", "a", "b", "1st", "Prob", "c", "d", "2nd", "Prob2"]
    table.write_text("\t".join(cols) + "\n" + "p\tf.wav\t\t\tx\tx\t\t\tMyodau\t0.5\n" + "p\tg.wav\t\t\tMyodau\t0.75\t\t\tx\tx\n")
    strict = {r["Filename"]: (r["class_name"], r["class_prob"]) for r in tables.read_file_species(spark, str(table), ["Myotis daubentonii"]).collect()}
    assert strict == {"f.wav": ("", 0.0), "g.wav": ("Myotis daubentonii", 0.75)}
    loose = tables.read_file_species(spark, str(table), ["Myotis daubentonii"], only_accepted=False)
    assert {r["class_name"] for r in loose.collect()} == {"Myotis daubentonii"}


def wav(path, samples, rate=1000, channels=1):
    data = np.asarray(samples, "<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16, b"data", len(data))
    path.write_bytes(head + data)


def test_audio_catalogue_and_clips(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    wave = np.arange(2500) % 1000
    wav(tmp_path / "a.wav", wave)
    wav(tmp_path / "sub" / "b b.WAV", np.repeat(wave, 2), channels=2)
    (tmp_path / "bad.wav").write_bytes(b"nothing here")
    (tmp_path / "note.txt").write_text("x")
    good, bad = audio.catalogue(spark, str(tmp_path))
    got = {r["file_name"]: (r["samplerate"], r["channels"], r["n_samples"], r["duration"]) for r in good.collect()}
    assert got == {"a.wav": (1000, 1, 2500, 2.5), "b b.WAV": (1000, 2, 2500, 2.5)}
    assert bad.count() == 1
    chunks = audio.sample_chunks(spark, str(tmp_path), 1.0)
    assert chunks.groupBy("recording_id").count().where("count = 3").count() == 2
    path = chunks.where(F.col("recording_id").endswith("a.wav")).first()["recording_id"]
    clips = spark.createDataFrame([("c", path, 0.75, 2.25)], "clip_id string, recording_id string, clip_start double, clip_end double")
    parts = audio.cut_clips(chunks, clips, 1.0).orderBy("chunk_idx").collect()
    joined = np.concatenate([p["samples"] for p in parts])
    assert np.allclose(joined, (wave / 32768)[750:2250])
    long = audio.chunk_samples(chunks.where(F.col("recording_id") == path), 1.0).orderBy("idx").collect()
    assert np.allclose([r["x"] for r in long], wave / 32768)


def riff(path, kind, data, before=(), extensible=False):
    code, bits = kind
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else code, 1, 1000, 1000 * bits // 8, bits // 8, bits)
    if extensible:
        form += struct.pack("<HHIH", 22, bits, 4, code) + b"\x00\x00\x00\x00\x10\x00\x80\x00\x00\xaa\x00\x38\x9b\x71"
    chunks = [*before, (b"fmt ", form), (b"LIST", b"comment with data inside"), (b"data", data)]
    body = b"".join(tag + struct.pack("<I", len(x)) + x + b"\x00" * (len(x) % 2) for tag, x in chunks)
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)


def test_wav_formats_and_chunk_orders(spark, tmp_path):
    x = np.linspace(-0.9, 0.9, 301)
    raw24 = (np.round(x * 2**23).astype("<i4")[:, None].view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    riff(tmp_path / "u8.wav", (1, 8), np.round(x * 127 + 128).astype(np.uint8).tobytes())
    riff(tmp_path / "i16.wav", (1, 16), np.round(x * 2**15).astype("<i2").tobytes(), before=[(b"JUNK", b"x" * 33)])
    riff(tmp_path / "i24.wav", (1, 24), raw24, before=[(b"guan", b"y" * 600)])
    riff(tmp_path / "i32.wav", (1, 32), np.round(x * 2**31).astype("<i4").tobytes(), extensible=True)
    riff(tmp_path / "f64.wav", (3, 64), x.astype("<f8").tobytes())
    riff(tmp_path / "f32.wav", (3, 32), x.astype("<f4").tobytes(), extensible=True)
    riff(tmp_path / "odd.wav", (85, 16), b"mp3 in disguise")
    good, bad = audio.catalogue(spark, str(tmp_path))
    assert {r["file_name"]: r["n_samples"] for r in good.collect()} == dict.fromkeys(
        ["u8.wav", "i16.wav", "i24.wav", "i32.wav", "f64.wav", "f32.wav"], 301)
    assert [("odd.wav" in r["path"], "unsupported" in r["error"]) for r in bad.collect()] == [(True, True)]
    rows = audio.chunk_samples(audio.sample_chunks(spark, str(tmp_path), 0.1), 0.1).orderBy("recording_id", "idx").collect()
    assert len(rows) == 6 * 301
    for name, step in (("u8", 0.02), ("i16", 1e-4), ("i24", 1e-6), ("i32", 1e-6), ("f32", 1e-6), ("f64", 1e-6)):
        assert np.allclose([r["x"] for r in rows if r["recording_id"].endswith(f"{name}.wav")], x, atol=step)


def test_geometry_bounds_and_kind_per_document(spark, tmp_path):
    shapes = {
        "a": ("BoundingBox", [0.1, 10, 0.2, 20]), "b": ("Polygon", [[[0.3, 5], [0.5, 9], [0.4, 30]]]), "c": ("LineString", [[0.2, 7], [0.9, 3]]),
        "d": ("Point", [0.6, 8]), "e": ("TimeInterval", [0.7, 0.8]),
    }
    for number, kind in enumerate(("annotation_set", "annotation_project")):
        tag = lambda x: f"{x}{number}"
        data = {
            "uuid": tag("doc"), "collection_type": kind, "tags": [],
            "recordings": [{"uuid": tag("r"), "path": "x.wav", "duration": 1.0, "channels": 1, "samplerate": 8000}],
            "clips": [{"uuid": tag("k"), "recording": tag("r"), "start_time": 0.0, "end_time": 1.0}],
            "sound_events": [{"uuid": tag(f"s{i}"), "recording": tag("r"), "geometry": {"type": t, "coordinates": c}} for i, (t, c) in shapes.items()],
            "sound_event_annotations": [{"uuid": tag(f"n{i}"), "sound_event": tag(f"s{i}"), "tags": []} for i in shapes],
            "clip_annotations": [{"uuid": tag("ca"), "clip": tag("k"), "tags": [], "sound_events": [tag(f"n{i}") for i in shapes], "notes": []}],
            "tasks": [{"uuid": tag("t"), "clip": tag("k"), "status_badges": []}],
        }
        (tmp_path / f"{kind}.json").write_text(json.dumps({"data": data}))
    events = annotations.read_project(spark, str(tmp_path))["events"].where("ann_id like '%0'").collect()
    got = {r["ann_id"][1]: (r["start_time"], r["low_freq"], r["end_time"], r["high_freq"]) for r in events}
    assert got == {"a": (0.1, 10, 0.2, 20), "b": (0.3, 5, 0.5, 30), "c": (0.2, 3, 0.9, 7), "d": (0.6, 8, 0.6, 8), "e": (0.7, None, 0.8, None)}
    clips = annotations.load_project_clips(spark, str(tmp_path)).collect()
    assert [r["clip_annotation_id"] for r in clips] == ["ca0"]  # the project's task is not completed
    assert all(e["geometry"] for e in clips[0]["events"])


def tables_for_output(spark):
    recordings = spark.createDataFrame([(1, "/data/s/a.wav", 2.0, 256000), (2, "/data/s/b.wav", 1.0, 256000)], "recording_id int, path string, duration double, samplerate int")
    clips = spark.createDataFrame([(10, 1, 0.0, 1.0), (11, 1, 1.0, 2.0), (20, 2, 0.0, 1.0)], "clip_id int, recording_id int, clip_start double, clip_end double")
    dets = spark.createDataFrame(
        [(0, 10, 0.1, 0.2, 1e4, 2e4, 0.5, [0.2, 0.6], [1.0, 2.0]), (1, 11, 1.1, 1.2, 1e4, 2e4, 0.9, [0.7, 0.6], [3.0, 4.0])],
        "det_id int, clip_id int, start_time double, end_time double, low_freq double, high_freq double, detection_score double, class_scores array<double>, features array<double>",
    )
    return dets, clips, recordings


def test_detection_parquet_round_trip(spark, tmp_path):
    dets, clips, recordings = tables_for_output(spark)
    rows = predictions.detection_rows(dets, clips, recordings, audio_dir="/data")
    assert predictions.save_rows(rows, str(tmp_path / "full"))
    back = predictions.load_rows(spark, str(tmp_path / "full"), 2)
    row = back.where("detection_score = 0.9").first()
    assert row["recording"]["path"] == "s/a.wav" and row["class_scores"] == [0.7, 0.6]
    assert json.loads(row["geometry"])["coordinates"] == [1.1, 1e4, 1.2, 2e4]
    nested = predictions.group_by_clip(back)
    assert sorted((r["clip_uuid"], len(r["detections"])) for r in nested.collect()) == [("10", 1), ("11", 1)]
    slim = predictions.detection_rows(dets, clips, recordings, include_class_scores=False, include_features=False)
    assert {"class_scores", "features"}.isdisjoint(slim.columns)
    predictions.save_rows(slim, str(tmp_path / "slim"))
    thin = predictions.load_rows(spark, str(tmp_path / "slim"), 2).first()
    assert thin["class_scores"] == [0.0, 0.0] and thin["features"] == []
    assert not predictions.save_rows(rows.where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(Exception, match="lies outside"):
        predictions.detection_rows(dets, clips, recordings, audio_dir="/elsewhere").collect()


def test_polygon_geometry_is_kept(spark, tmp_path):
    dets, clips, recordings = tables_for_output(spark)
    shape = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}'
    rows = predictions.detection_rows(dets.withColumn("geometry", F.lit(shape)), clips, recordings)
    predictions.save_rows(rows, str(tmp_path / "p"))
    assert {r["geometry"] for r in predictions.load_rows(spark, str(tmp_path / "p"), 2).collect()} == {shape}


def test_result_documents_and_csv(spark, tmp_path):
    dets, clips, recordings = tables_for_output(spark)
    merged = dets.join(clips.select("clip_id", "recording_id"), "clip_id")
    docs = predictions.result_documents(merged, recordings, ["A", "B"]).collect()
    assert len(docs) == 1
    doc = json.loads(docs[0]["document"])
    assert doc["id"] == "a.wav" and [a["det_prob"] for a in doc["annotation"]] == [0.9, 0.5]
    assert doc["annotation"][1]["class"] == "B" and doc["class_name"] == "B" and doc["annotated"] is False
    both = predictions.result_documents(merged, recordings, ["A", "B"], save_if_empty=True)
    empty = json.loads(both.where("recording_id = 2").first()["document"])
    assert empty["annotation"] == [] and empty["class_name"] == "None"
    lines = predictions.document_lines(merged, recordings, ["A", "B"], save_if_empty=True)
    predictions.save_documents(lines, str(tmp_path / "docs"))
    written = {f.parent.name: json.loads(f.read_text()) for f in (tmp_path / "docs").rglob("*.txt")}
    assert written == {f"recording_id={r['recording_id']}": json.loads(r["document"]) for r in both.collect()}
    predictions.save_detection_csv(predictions.document_rows(merged, ["A", "B"]), str(tmp_path / "csv"))
    lines = (tmp_path / "csv" / "1.csv").read_text().splitlines()
    assert sorted(f.name for f in (tmp_path / "csv").iterdir()) == ["1.csv"]
    assert lines[0] == "," + ",".join(predictions.CSV_COLUMNS) and lines[1].startswith("0,0.9,") and lines[2].startswith("1,0.5,")
    predictions.save_feature_csv(merged, 2, str(tmp_path / "feats"))
    assert (tmp_path / "feats" / "1_cnn_features.csv").read_text() == "0,1\n1.00000,2.00000\n3.00000,4.00000\n"


def test_failed_writer_leaves_no_file(spark, tmp_path):
    """A file is there whole or not at all."""
    from chirpframe.sources.ranges import write_file

    def blocks():
        yield b"half"
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        write_file(str(tmp_path / "x.csv"), blocks())
    assert list(tmp_path.iterdir()) == []
    lines = spark.createDataFrame([("a", 1, "one"), ("a", 0, 'say "x", y'), ("b", 0, "two")], "name string, at int, line string")
    predictions.save_files(lines, str(tmp_path), "name", "head", [F.col("at")])
    assert {f.name: f.read_text() for f in tmp_path.iterdir()} == {"a": 'head\nsay "x", y\none\n', "b": "head\ntwo\n"}
    assert spark.range(1).select(predictions._csv([F.lit('say "x", y'), F.lit(None), F.lit(1.5)])).first()[0] == '"say ""x"", y",,1.5'


def test_class_labels():
    decoding = {"m": [("dwc:scientificName", "Myotis")], "x": []}
    assert predictions.class_labels(["m", "x"], decoding) == ["Myotis", "x"]
    assert predictions.class_labels(["m"], decoding, "class_name") == ["m"]
    with pytest.raises(ValueError):
        predictions.class_labels(["x"], decoding, fallback=False)


def test_prediction_set_and_metrics(spark, tmp_path):
    dets, _, _ = tables_for_output(spark)
    tagged = predictions.prediction_tags(dets, ["A", "B"], {"A": [("class", "a")], "B": [("class", "b")]}, [("event", "E")], top_k=1)
    dets, clips, recordings = tables_for_output(spark)
    documents.save_prediction_set(tagged, clips, recordings, str(tmp_path / "set.json"), name="p")
    saved = json.loads((tmp_path / "set.json").read_text())["data"]
    assert saved["collection_type"] == "prediction_set" and list(saved)[3:] == list(documents.PREDICTION_SECTIONS)
    assert len(saved["clip_predictions"]) == 3 and sorted(len(c["sound_events"]) for c in saved["clip_predictions"]) == [0, 1, 1]
    numbers = {t["id"]: (t["key"], t["value"]) for t in saved["tags"]}
    got = {p["score"]: [(*numbers[n], s) for n, s in p["tags"]] for p in saved["sound_event_predictions"]}
    assert got == {0.5: [("event", "E", 0.5), ("class", "b", 0.6)], 0.9: [("event", "E", 0.9), ("class", "a", 0.7)]}
    back = {r["score"]: (r["path"], r["box"]) for r in documents.read_prediction_set(spark, str(tmp_path / "set.json")).collect()}
    assert back[0.9] == ("/data/s/a.wav", [1.1, 1e4, 1.2, 2e4])
    metrics = spark.createDataFrame([("detection/average_precision", 0.5)], "name string, value double")
    predictions.save_metrics(metrics, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["value"] == 0.5


def test_splits(spark):
    files = spark.createDataFrame([(f"f{k}", "ab"[k % 2]) for k in range(40)], "file_id string, class_name string")
    folds = splits.first_fold(splits.group_folds(files, 5))
    assert folds.count() == 40 and folds.where("split = 'test'").count() in range(6, 11)
    splits.require_same_classes(files, folds)
    with pytest.raises(RuntimeError):
        splits.require_same_classes(files, folds.withColumn("split", F.when(F.col("class_name") == "a", "train").otherwise("test")))
    lists = [spark.createDataFrame([(n,)], "id string") for n in ("f1", "f2")]
    fixed = splits.split_from_lists(files.withColumnRenamed("file_id", "id"), *lists)
    assert {(r["id"], r["split"]) for r in fixed.collect()} == {("f1", "train"), ("f2", "test")}
    with pytest.raises(ValueError):
        splits.named_split(spark.createDataFrame([("same", "d", True, False)], "split_name string, dataset_name string, is_test boolean, is_binary boolean"), "other")


def test_source_choice_prunes_scans(spark):
    def broken(_):
        raise AssertionError("must not be scanned")

    good = dataset.Source("a", lambda s: s.createDataFrame([(1, [], [])], "clip_id int, tags array<struct<key:string,value:string>>, events array<int>"))
    config = dataset.DatasetConfig("d", [good, dataset.Source("b", broken)])
    assert dataset.load_dataset(spark, config, include_sources=["a"]).count() == 1
    assert not filters.source_selected("b", exclude=["b"])


def test_large_lists_are_cut_at_element_borders(spark, tmp_path):
    rng = random.Random(1)
    odd = ['quote " and \\ back', "\\\\", "{[,]}", "é😀", "", 'end\\"']
    docs = [dict(document(f"{k}.wav"), notes=rng.choice(odd) * rng.randrange(4)) for k in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(docs[:40], indent=1))
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf \n" + json.dumps(docs[40:], ensure_ascii=False).encode() + b"\n")
    (tmp_path / "none.json").write_text(" [ ] ")
    for size in (150, 5000, 1 << 20):
        got = annotations.read_merged(spark, str(tmp_path), range_bytes=size)
        assert sorted((r["id"], r["notes"]) for r in got.collect()) == sorted((d["id"], d["notes"]) for d in docs)
    assert ranges.list_elements(spark, str(tmp_path), range_bytes=150).rdd.getNumPartitions() > 50


def test_structural_scan_of_any_cut():
    rng = random.Random(3)

    def value(depth=0):
        kind = rng.randrange(6 if depth < 3 else 3)
        if kind == 0:
            return "".join(rng.choice('a"\\[]{},: \né😀') for _ in range(rng.randrange(9)))
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {f"k{n}": value(depth + 1) for n in range(rng.randrange(4))} if kind > 3 else rng.choice([None, 17, True])

    for _ in range(300):
        doc = [value() for _ in range(rng.randrange(8))]
        raw = json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()
        size, state, depth, got = rng.randrange(1, 20), 0, 0, []
        for a in range(0, len(raw), size):
            b = min(a + size, len(raw))
            got += ranges.elements(io.BytesIO(raw), a, b, len(raw), state, depth, step=rng.choice([1, 3, 64]))
            state, change = ranges.summary(np.frombuffer(raw[a:b], np.uint8), state)
            depth += change
        assert (state, depth) == (0, 0) and [json.loads(g) for g in got] == doc


def test_recording_beyond_two_gigabytes(spark, tmp_path):
    """A sparse RF64 file: headers by seeking, chunks by many tasks, no file in one piece."""
    n = (5 << 30) // 2
    rate, path = 48000, tmp_path / "long.wav"
    with open(path, "wb") as out:
        fmt = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
        out.write(b"RF64" + b"\xff" * 4 + b"WAVEds64" + struct.pack("<IQQQI", 28, 0, 2 * n, n, 0))
        out.write(b"fmt " + struct.pack("<I", 16) + fmt + b"data" + b"\xff" * 4)
        start = out.tell()
        out.seek(start + 2 * (n - 3))
        out.write(struct.pack("<hhh", 0, -(1 << 14), 1 << 14))
    form = audio.parse_wav(open(path, "rb"), path.stat().st_size)
    assert (form.n_samples, form.data_start) == (n, start)
    runs = audio.sample_runs(spark, str(tmp_path), range_bytes=64 << 20)
    assert runs.count() >= 80 and runs.agg(F.sum(F.col("last") - F.col("first"))).first()[0] == -(-n // rate)
    assert audio.read_runs(runs).rdd.getNumPartitions() == runs.count()
    last = audio.read_runs(runs.orderBy(F.desc("first")).limit(1)).where(F.col("chunk_idx") == n // rate)
    row = last.select(F.slice("samples", -3, 3).alias("s"), F.size("samples").alias("n")).first()
    assert row["s"] == [0.0, -0.5, 0.5] and row["n"] == n % rate


def test_recordings_as_waves(spark, tmp_path):
    from chirpframe.operators import waves

    x = np.round(np.sin(np.arange(2500) / 7) * 2**14)
    riff(tmp_path / "a.wav", (1, 16), x.astype("<i2").tobytes())
    rate = audio.catalogue(spark, str(tmp_path))[0].first()["samplerate"]
    one = audio.as_waves(audio.sample_chunks(spark, str(tmp_path), 1000 / rate), rate, 1000 / rate)
    rows = waves.to_samples(waves.center(one)).orderBy("idx").collect()
    assert np.allclose([r["x"] for r in rows], x / 2**15 - (x / 2**15).mean(), atol=1e-7)


def test_document_is_cut_anywhere(spark, tmp_path):
    """Brackets, quotes and backslashes in texts, nested lists, other members and ranges of any length."""
    odd = ['a]b', 'c"[{', "d\\", '\\"}', "é,", "x" * 70]
    data = {
        "uuid": "u", "collection_type": "prediction_set", "extra": {"tags": [1, {"a": [2]}], "b": 3},
        "tags": [{"id": n, "key": "k", "value": v} for n, v in enumerate(odd)], "recordings": [],
        "clips": [{"uuid": v, "nested": [[1, [2]], {"z": ["]"]}]} for v in odd], "name": "na,me",
    }
    (tmp_path / "d.json").write_text(json.dumps({"version": "1", "other": {"tags": [{"id": 9}]}, "data": data, "tail": [[[1]], 2]}, indent=1))
    want = sorted([("tags", json.dumps(t)) for t in data["tags"]] + [("clips", json.dumps(c)) for c in data["clips"]])
    for size in (7, 64, 1 << 20):
        rows = ranges.document_members(spark, str(tmp_path), range_bytes=size).collect()
        assert sorted((r["name"], json.dumps(json.loads(r["value"]))) for r in rows if r["name"]) == want
        plain = [json.loads("{" + r["value"] + "}") for r in rows if not r["name"]]
        assert sorted(p for d in plain for p in d.items()) == [("collection_type", "prediction_set"), ("name", "na,me"), ("uuid", "u")]
    dets, clips, recordings = tables_for_output(spark)
    tagged = predictions.prediction_tags(dets, ["A", "B"], {"A": [("class", "a")], "B": [("class", "b")]}, [("event", "E")], top_k=1)
    documents.save_prediction_set(tagged, clips, recordings, str(tmp_path / "out" / "set.json"))
    whole, cut = (sorted(map(str, documents.read_prediction_set(spark, str(tmp_path / "out" / "set.json"), n).collect())) for n in (1 << 20, 50))
    assert whole == cut and len(whole) == 2


def test_short_files_share_tasks_and_long_ones_do_not(spark):
    files = spark.range(2000).select(F.col("id").alias("path"), F.lit(100).cast("long").alias("length"))
    assert ranges.spread_rows(files, F.col("length")).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert ranges.spread_rows(files.limit(3), F.col("length")).rdd.getNumPartitions() == 3
    assert ranges.spread_rows(files, F.col("length") * 100_000).rdd.getNumPartitions() == 2000  # more bytes than a range each


def test_a_written_set_leaves_little_on_the_way(spark, tmp_path):
    n = 3000
    clips = spark.range(n).select(
        F.col("id").cast("string").alias("clip_id"), F.concat(F.col("id").cast("string"), F.lit(".wav")).alias("path"),
        F.array(F.struct(F.lit("class").alias("key"), (F.col("id") % 7).cast("string").alias("value"))).alias("tags"), F.lit(None).alias("notes"),
        F.array(F.struct(
            F.concat(F.lit("e"), F.col("id").cast("string")).alias("ann_id"), F.lit(0.5).alias("start_time"), F.lit(20.0).alias("low_freq"),
            F.lit(0.75).alias("end_time"), F.lit(30.0).alias("high_freq"), F.lit(None).alias("geometry"),
            F.array(F.struct(F.lit("b").alias("key"), F.lit("1").alias("value")), F.struct(F.lit("a").alias("key"), F.lit(None).cast("string").alias("value"))).alias("tags"))).alias("events"))
    ensure_checkpoint_dir(spark)
    scratch = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def size() -> int:
        return sum(f.stat().st_size for f in scratch.rglob("*") if f.is_file())

    before, path = size(), tmp_path / "set.json"
    annotations.save_annotation_set(clips, str(path))
    assert size() - before < path.stat().st_size // 4
    saved = json.loads(path.read_text())["data"]
    assert [len(saved[s]) for s in documents.ANNOTATION_SECTIONS[:-1]] == [9, n, n, n, n, n]
    tags = {t["id"]: (t["key"], t.get("value")) for t in saved["tags"]}
    assert {tuple(tags[i] for i in a["tags"]) for a in saved["sound_event_annotations"]} == {(("b", "1"), ("a", None))}
    assert {tuple(tags[i] for i in a["tags"]) for a in saved["clip_annotations"]} == {(("class", str(k)),) for k in range(7)}
    assert saved["recordings"][0]["tags"] == []
