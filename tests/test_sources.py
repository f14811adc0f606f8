"""Readers and writers on small made-up files, and the stream."""

import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from framesift import sinks
from framesift.sources import files, labels
from framesift.streaming import scores


def touch(path, data=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_discover_frames(spark, tmp_path):
    for p in ("vid1/f_0.jpg", "vid1/f_1.JPG", "catA/vid_001/f_0.jpg", "catB/vid_001/f_0.png", "skip/vid9/f.jpg", "catA/skip/f.jpg", "vid1/note.txt", "a/b/c/d.jpg"):
        touch(tmp_path / p)
    got = files.discover_frames(spark, str(tmp_path), exclude=("skip",)).collect()
    assert sorted((r.video, r.sample_idx) for r in got) == [("catA/vid_001", 0), ("catB/vid_001", 0), ("vid1", 0), ("vid1", 1)]
    assert {r.video for r in files.video_keys(spark, str(tmp_path), ("skip", "catB")).collect()} == {"vid1", "catA/vid_001"}
    assert [r.video for r in files.discover_frames(spark, str(tmp_path), categories=("catA",), videos=("vid_001",)).collect()] == ["catA/vid_001"]


def test_read_embeddings(spark, tmp_path):
    def npy(x):
        b = io.BytesIO()
        np.save(b, np.asarray(x, np.float16))
        return b.getvalue()

    touch(tmp_path / "catA/vid/frame_000007.npy", npy([1, 2]))
    touch(tmp_path / "catA/vid/frame_000008.npy", b"broken")
    touch(tmp_path / "catB/other/block.npy", npy([[1, 2], [3, 4]]))
    got = sorted(((r.video, r.frame, r.nth, r.embedding) for r in files.read_embeddings(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("vid", 7, 0, [1.0, 2.0]), ("vid", 8, 0, None), ("other", None, 0, [1.0, 2.0]), ("other", None, 1, [3.0, 4.0])], key=str)
    read = lambda **k: sorted((r.video, r.frame) for r in files.read_embeddings(spark, str(tmp_path), drop=True, **k).collect())
    assert read(categories=("catA",)) == [("vid", 7)] and read(videos=("vid", "none")) == [("vid", 7)] and read(exclude=("other",)) == [("vid", 7)]
    assert read(categories=()) == []


def test_sample_map(spark):
    v = spark.createDataFrame([("a", 7, 2.5), ("b", 0, 30.0), ("c", 3, 0.2)], "video string, total int, fps double")
    assert [(r.video, r.source_frame) for r in files.sample_map(v).orderBy("video", "sample_idx").collect()] == [("a", 0), ("a", 2), ("a", 4), ("a", 6), ("c", 0), ("c", 1), ("c", 2)]


def test_phase_sequences(spark, tmp_path):
    doc = {"sequences": [{"videoId": "ABC", "videoAnnotations": [{"label": {"displayName": "B", "code": "b"}, "timestampStart": 2500, "timestampEnd": 9000}, {"label": {"displayName": "A", "code": "a"}, "timestampStart": -1, "timestampEnd": 2500}]}, {"videoId": "empty", "videoAnnotations": []}]}
    touch(tmp_path / "p.json", json.dumps(doc).encode())
    got = labels.seconds(labels.phase_sequences(spark, str(tmp_path / "p.json"))).orderBy("pos").collect()
    assert [(r.uuid, r.pos, r.code, r.start_s, r.end_s) for r in got] == [("abc", 0, "a", -1, 2), ("abc", 1, "b", 2, 9)]


def book(sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}"/>' for n in sheets) + "</sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si></sst>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join("<row>" + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v != "shared" else f'<c r="{chr(65 + c)}{r}" t="s"><v>0</v></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_first_sheet_wins(spark, tmp_path):
    u, v = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b"
    touch(tmp_path / "w.xlsx", book({"one": [["name", "link"], [None, f"http://x/{u.upper()}", "shared"]], "two": [["vid_002", u], ["vid_003", v], ["none"]]}))
    got = {r.uuid: (r.name, r.sheet) for r in labels.uuid_table(labels.workbook(spark, str(tmp_path / "w.xlsx"))).collect()}
    assert got == {u: ("shared", "one"), v: ("vid_003", "two")}


def test_tracker_states(spark, tmp_path):
    base = {"objects": {"1": {"label": "Tool", "box": [0, 0, 1, 1], "n_blobs": 1, "obj_start": 0, "obj_end": 5}, "2": {"label": "Other"}}, "bboxes": {"0": {"1": [1, 2, 3, 4], "2": None, "9": [0, 0, 1, 1]}, "4": {"1": [1, 1, 2, 2]}, "5": {}}, "review_marks": [], "blurry_ranges": []}
    for name, oof in (("list", [[9, 1], [4, 1]]), ("single", {"1": 4}), ("ranges", {"1": [[0, 3], [5, None]]})):
        touch(tmp_path / name / "state.json", json.dumps(base | {"oof": oof}).encode())
    states = labels.tracker_states(spark, str(tmp_path / "*" / "state.json"))
    assert sorted((r.video, r.oid, r.start, r.end) for r in labels.out_of_frame(states).collect() if r.end is None or r.end) == [("list", "1", 4, None), ("ranges", "1", 0, 3), ("ranges", "1", 5, None), ("single", "1", 4, None)]
    assert sorted((r.start, r.end) for r in labels.out_of_frame(states.where("video = 'list'"), points=True).collect()) == [(4, 4), (9, 9)]
    got = {(r.video, r.frame): ([b.oid for b in r.boxes], r.hidden) for r in labels.annotations(states).collect()}
    assert got["list", 0] == (["1"], []) and got["list", 4] == ([], ["1"]) and got["list", 5] == ([], [])
    assert got["ranges", 0] == ([], ["1"]) and got["ranges", 4] == (["1"], [])


def test_tables_and_lines(spark, tmp_path):
    touch(tmp_path / "t.tsv", "﻿Frame\tHook\tClip\n0\t1\n\n1\tx\t1\t9\n2\t1\t1\n".encode())
    rows = labels.table(labels.tsv(spark, str(tmp_path / "t.tsv")), ["frame", "hook", "clip"])
    assert [(r.frame, r.hook, r.clip) for r in rows.orderBy("line").collect()] == [("0", "1", ""), ("1", "x", "1"), ("2", "1", "1")]
    assert {r.label: r.total for r in labels.tool_totals(rows, ["hook", "clip"]).collect()} == {"hook": 2.0, "clip": 2.0}
    touch(tmp_path / "b.txt", b"0 0.5 0.5 0.1 0.1\n1 0.5\n2 a b c d\n3 0.1 0.2 0.3 0.4 extra\n")
    assert sorted(r.class_id for r in labels.detection_lines(spark, str(tmp_path / "b.txt")).collect()) == [0, 3]
    touch(tmp_path / "s.csv", b"video,dataset,split,n_frames\na,x,train,1\nb,x,other,2\n")
    assert [r.video for r in labels.split_list(spark, str(tmp_path / "s.csv")).collect()] == ["a"]
    touch(tmp_path / "c.txt", b"# note\n3 5 # why\n9 8\n7 7\nbad\n")
    assert sorted(r.frame for r in labels.exclusions(spark, str(tmp_path / "c.txt")).collect()) == [3, 4, 5, 7]
    touch(tmp_path / "p.json", json.dumps({"f1": {"phases_score_dist": [0.1, 0.9]}, "f2": {}}).encode())
    assert [tuple(r) for r in labels.predictions(spark, str(tmp_path / "p.json"), 2).collect()] == [("f1", 0.1, 0.9)]
    touch(tmp_path / "m1.json", json.dumps({"epoch": 1, "metrics": {"knn": {"top1": 0.5}}}).encode())
    touch(tmp_path / "m2.json", json.dumps({"epoch": 2, "metrics": {"knn": {"error": "x"}}}).encode())
    assert sorted(tuple(r) for r in labels.metric_series(spark, str(tmp_path / "m*.json"), "knn.top1").collect()) == [(1, 0.5), (2, None)]


def test_sinks(spark, tmp_path):
    p = str(tmp_path)
    boxes = spark.createDataFrame([("a", "train", 1, 0, 0.5, 0.5, 0.1, 0.1, "ok"), ("a", "train", 2, 0, 0.5, 0.5, 0.0, 0.1, "degenerate")], "video string, split string, frame int, class_id int, cx double, cy double, w double, h double, status string")
    sinks.detection_labels(boxes, f"{p}/yolo")
    assert [r.value for r in spark.read.text(f"{p}/yolo").collect()] == ["000001 0 0.500000 0.500000 0.100000 0.100000"]
    pairs = spark.createDataFrame([(1, 2, True), (3, 4, False)], "query long, match long, is_match boolean")
    sinks.pair_index(pairs, 0.8, f"{p}/pairs")
    assert spark.read.json(f"{p}/pairs/summary").first().match_rate == 0.5
    sinks.split_list(spark.createDataFrame([("a", "x", "train")], "video string, dataset string, split string"), f"{p}/split")
    assert labels.split_list(spark, f"{p}/split").count() == 1
    doc = spark.createDataFrame([(1, 0.5)], "epoch int, value double")
    sinks.metrics(doc, f"{p}/m")
    sinks.metrics(doc, f"{p}/m")
    assert spark.read.json(f"{p}/m").count() == 2
    f = spark.createDataFrame([("a", 0), ("a", 1)], "video string, sample_idx long")
    sinks.new_features(f.where("sample_idx = 0"), f.limit(0), f"{p}/feat")
    sinks.new_features(f, spark.read.parquet(f"{p}/feat"), f"{p}/feat")
    assert spark.read.parquet(f"{p}/feat").count() == 2
    kept, lost = sinks.without(spark.createDataFrame([("a", "p1"), ("b", "p2")], "video string, path string"), spark.createDataFrame([("p1",)], "path string"))
    assert [r.path for r in kept.collect()] == ["p2"] and [r.video for r in lost.collect()] == ["a"]
    export = spark.createDataFrame([("a", 1, 7, "Tool", 1, 2, 3, 4, False), ("a", 1, 8, "Hook", 1, 2, 3, 4, True)], "video string, frame int, oid int, label string, x1 int, y1 int, x2 int, y2 int, oof boolean")
    sinks.annotation_export(export, f"{p}/ann")
    got = json.loads(spark.read.text(f"{p}/ann").first().value)["objects"]
    assert got["7"]["bbox"] == [1, 2, 3, 4] and "bbox" not in got["8"] and got["8"]["out_of_frame"]


def test_stream_recomputes_only_touched_videos(spark, tmp_path):
    rng = np.random.default_rng(1)
    folder, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))

    def add(video, start, n):
        rows = [(i, video, i, [float(v) for v in rng.normal(size=4)]) for i in range(start, start + n)]
        spark.createDataFrame(rows, scores.FRAMES).write.mode("append").parquet(folder)

    add("a", 0, 12)
    add("b", 0, 12)
    scores.watch(spark, folder, out, check, 5).awaitTermination()
    before = {(r.video, r.position): r.score for r in spark.read.parquet(out).collect()}
    assert len(before) == 6
    add("a", 12, 3)
    scores.watch(spark, folder, out, check, 5).awaitTermination()
    after = {(r.video, r.position): r.score for r in spark.read.parquet(out).collect()}
    assert len(after) == 9 and all(after[k] == v for k, v in before.items())
