"""Choice of videos and test lists on small cases."""

from framesift.operators import selection


def test_chosen_videos(spark):
    rows = spark.createDataFrame([("Lap_01", "Cholec"), ("x2", "My_LAP_set"), ("x3", None), ("x4", "lap"), ("gone", "lap"), (None, "lap")], "video string, parent string")
    known = spark.createDataFrame([("Lap_01",), ("x2",), ("x3",), ("gone",), ("gone",)], "video string")
    names = lambda *a, **k: sorted(r.video for r in selection.chosen_videos(rows, *a, **k).collect())
    assert names(known, ("gone",), "lAp") == ["Lap_01", "x2"]
    assert names(contains="") == names() == ["Lap_01", "gone", "x2", "x3", "x4"]
    assert names(contains="nothing") == []


def test_enough_objects(spark):
    frames = spark.createDataFrame([("a", 0, []), ("a", 1, ["x"]), ("b", 0, ["x", "y"]), ("c", 0, None)], "video string, frame int, boxes array<string>")
    at = lambda n: sorted((r.video, r.frame) for r in selection.enough_objects(frames, n).collect())
    assert len(at(0)) == 4 and at(1) == [("a", 1), ("b", 0)] and at(2) == [("b", 0)]
    videos = spark.createDataFrame([("a", 1), ("z", 2)], "video string, n int")
    assert [r.video for r in selection.with_annotations(videos, selection.enough_objects(frames, 1)).collect()] == ["a"]


def test_listed_folders(spark):
    listed = spark.createDataFrame([("D", "a b"), ("D", "v1"), ("D", "GP2 left"), ("E", " v1 "), ("D", "none"), (None, "v1"), ("D", None), ("D", "v1"), ("D", "")], "dataset string, name string")
    folders = spark.createDataFrame([("d", "a_b"), ("d", "v1"), ("d", "v1_x_y"), ("d", "v10"), ("d", "Patient2"), ("E", "v1_"), ("E", "w"), ("d", None)], "place string, folder string")
    places = spark.createDataFrame([("D", "d"), ("D", "d")], "dataset string, place string")
    same = spark.createDataFrame([("g", "GP2"), ("g", "Patient2"), ("h", "GP3")], "group string, prefix string")
    found = selection.listed_folders(listed, folders, places, same)
    want = [("D", "GP2 left", "d", "Patient2"), ("D", "a b", "d", "a_b"), ("D", "v1", "d", "v1"), ("D", "v1", "d", "v1_x_y"), ("E", "v1", "E", "v1_")]
    assert sorted(map(tuple, found.collect())) == want
    split = {(r.place, r.folder): r.split for r in selection.split_by_list(folders, found).collect()}
    assert split["d", "v10"] == split["E", "w"] == "train" and split["E", "v1_"] == split["d", "Patient2"] == "test" and len(split) == 7
    assert sorted((r.dataset, r.name) for r in selection.unmatched(listed, found).collect()) == [("D", ""), ("D", "none")]
