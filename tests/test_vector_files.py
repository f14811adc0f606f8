"""The data source of vector folders, files of detections and copies, and features of phases against plain Python."""

import io
import json

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not

from framesift import sinks
from framesift.operators import labels, phases
from framesift.sources import vector_files


def npy(x):
    b = io.BytesIO()
    np.save(b, np.asarray(x, np.float32))
    return b.getvalue()


def folders(root):
    held = {"flat/f_1.npy": npy([1, 2]), "catA/v1/f_1.npy": npy([3, 4]), "catA/v1/f_2.npy": b"broken", "catA/v2/block.npy": npy([[5, 6], [7, 8]]), "catB/v1/f_9.npy": npy([9, 10]), "catB/v1/note.txt": b"x", "catB/v3/cube_1.npy": npy(np.zeros((2, 2, 2)))}
    for name, data in held.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def load(spark, root, **options):
    vector_files.register(spark)
    return spark.read.format("vector_files").options(**options).load(root)


def test_rows(spark, tmp_path):
    root = folders(tmp_path)
    rows = {(r.category, r.video, r.frame, r.nth, tuple(r.embedding) if r.embedding else None) for r in load(spark, root).collect()}
    want = {(None, "flat", 1, 0, (1, 2)), ("catA", "v1", 1, 0, (3, 4)), ("catA", "v1", 2, 0, None), ("catA", "v2", None, 0, (5, 6)), ("catA", "v2", None, 1, (7, 8)), ("catB", "v1", 9, 0, (9, 10)), ("catB", "v3", 1, 0, None)}
    assert rows == want
    assert load(spark, root, drop="true").count() == 5
    names = load(spark, root, vectors="false").collect()
    assert len(names) == 6 and all(r.embedding is None for r in names)
    (tmp_path / "none").mkdir()
    assert load(spark, str(tmp_path / "none")).collect() == []


def test_filters_give_the_same_rows_as_without_them(spark, tmp_path):
    root = folders(tmp_path)
    every = load(spark, root).collect()
    for sql, holds in (
        ("category = 'catA'", lambda r: r.category == "catA"), ("category is null", lambda r: r.category is None), ("video in ('v1', 'flat')", lambda r: r.video in ("v1", "flat")),
        ("frame > 1", lambda r: r.frame is not None and r.frame > 1), ("frame is null", lambda r: r.frame is None), ("video like 'v%' and nth = 1", lambda r: r.video[0] == "v" and r.nth == 1),
        ("category <> 'catA'", lambda r: r.category not in (None, "catA")), ("category <=> null and embedding is not null", lambda r: r.category is None and r.embedding), ("category = 'catA' or frame = 9", lambda r: r.category == "catA" or r.frame == 9),
    ):
        assert sorted(map(str, load(spark, root).where(sql).collect())) == sorted(str(r) for r in every if holds(r)), sql


def test_ruled_out_files_are_not_planned(tmp_path):
    root = folders(tmp_path)

    def planned(*filters, **options):
        reader = vector_files.VectorReader({"path": root, **options})
        left = list(reader.pushFilters(list(filters)))
        return [[f[3][len(root) + 1 :] for f in p.files] for p in reader.partitions()], left

    assert planned(EqualTo(("category",), "catB"), In(("video",), ("v1",))) == ([["catB/v1/f_9.npy"]], [])
    assert planned(GreaterThan(("frame",), 1)) == ([["catA/v1/f_2.npy", "catB/v1/f_9.npy"]], [])
    kept = Not(EqualTo(("category",), "catA"))
    assert planned(kept)[1] == [kept]
    parts, _ = planned(bytes="1")
    assert [len(p) for p in parts] == [1] * 6


def test_detection_dataset(spark, tmp_path):
    b = spark.createDataFrame(
        [("a", 3, 1, 2, -5, 0, 10, 20), ("a", 3, 0, 1, 0, 0, 1, 3), ("a", 4, 0, 0, 5, 5, 5, 9), ("a", 9, 0, 0, 0, 0, 9, 9), ("b", 0, 0, 0, 0, 0, 9, 9), ("c", 0, 0, 0, 0, 0, 9, 9)],
        "video string, frame long, oid int, class_id int, x1 int, y1 int, x2 int, y2 int",
    )
    splits = spark.createDataFrame([("a", "train"), ("b", "val")], "video string, split string")
    sizes = spark.createDataFrame([("a", 640, 480), ("b", 640, 480), ("c", 640, 480)], "video string, width int, height int")
    got = labels.detection_frames(b, splits, sizes, spark.createDataFrame([("a", 9)], "video string, n long"))
    n = sinks.detection_dataset(got, ["hook", 'odd: "name"'], str(tmp_path / "set"))
    assert {(r.split, r.status, r.n) for r in n.collect()} == {("train", "ok", 1), ("train", "empty", 1), ("train", "out_of_range", 1), ("val", "no_frames", 1), (None, "no_split", 1)}
    assert [p.name for p in (tmp_path / "set/labels").rglob("*.txt")] == ["a__000003.txt"]
    want = f"1 {0.5 / 640:.6f} {1.5 / 480:.6f} {1 / 640:.6f} {3 / 480:.6f}\n2 {5 / 640:.6f} {10 / 480:.6f} {10 / 640:.6f} {20 / 480:.6f}\n"
    assert (tmp_path / "set/labels/train/a__000003.txt").read_text() == want
    lines = (tmp_path / "set/data.yaml").read_text().splitlines()
    assert lines[1:5] == ["train: images/train", "val: images/val", "test: images/test", "names:"] and lines[-1] == "  1: " + json.dumps('odd: "name"')
    again = sinks.detection_dataset(got, ["hook"], str(tmp_path / "set"))
    assert again.count() == 5 and (tmp_path / "set/labels/train/a__000003.txt").read_text() == want


def test_copies_under_unique_names(spark, tmp_path):
    for name in ("x/vid/a.jpg", "y/vid/a.jpg", "x/vid/a.png", "x/other/.hidden"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    asked = ["x/vid/a.jpg", "y/vid/a.jpg", "x/vid/a.png", "x/other/.hidden", "x/vid/gone.jpg"]
    rows = spark.createDataFrame([(f"{tmp_path}/{p}", 0.25) for p in asked], "path string, distance double")
    got = {r.name: r.copied for r in sinks.copies(sinks.unique_names(rows), str(tmp_path / "out")).collect()}
    assert got == {"vid_a_dist0.2500.jpg": True, "vid_a_dist0.2500_1.jpg": True, "vid_a_dist0.2500.png": True, "other_.hidden_dist0.2500": True, "vid_gone_dist0.2500.jpg": False}
    assert (tmp_path / "out/vid_a_dist0.2500_1.jpg").read_text() == "y/vid/a.jpg" and len(list((tmp_path / "out").iterdir())) == 4


def test_markov_features_against_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = [(f"v{v}", int(f), None if rng.random() < 0.1 else "abc"[rng.integers(3)], None if rng.random() < 0.1 else float(rng.random()), float(rng.integers(2))) for v, n in enumerate((40, 7, 1)) for f in rng.permutation(n)]
    frames = spark.createDataFrame(rows, "video string, frame long, phase_id string, x double, y double")
    ids = ["UNK", "a", "b", "c"]
    got = {r.video: r for r in phases.markov_features(frames, frames.select("video").union(spark.sql("select 'empty'")), ids, ["x", "y"]).collect()}
    for v in ("v0", "v1", "v2", "empty"):
        mine = sorted(r[1:] for r in rows if r[0] == v)
        seq = [ids.index(r[1] or "UNK") for r in mine]
        steps = np.zeros((4, 4))
        np.add.at(steps, (seq[:-1], seq[1:]), 1)
        share = np.bincount(seq, minlength=4) / max(len(seq), 1) if seq else np.zeros(4)
        on = np.array([[(x or 0) > 0.5 for x in r[2:]] for r in mine], int).reshape(-1, 2)
        code = on[:-1] * 2 + on[1:]
        of_label = [np.bincount(code[:, j], minlength=4) / max(len(code), 1) for j in range(2)]
        assert np.allclose(got[v].phase_share, share) and np.allclose(got[v].phase_steps, (steps / np.maximum(steps.sum(1, keepdims=True), 1)).ravel())
        assert np.allclose(got[v].label_share, on.mean(0) if len(on) else 0) and np.allclose(got[v].label_steps, np.ravel(of_label))


def test_features_without_any_frames(spark):
    frames = spark.createDataFrame([], "video string, frame long, phase_id string, x double")
    assert phases.markov_features(frames, frames, ["a"], ["x"]).collect() == []
    assert phases.markov_features(frames, spark.sql("select 'v' as video"), ["a"], ["x"]).select(F.size("label_steps")).collect()[0][0] == 4
