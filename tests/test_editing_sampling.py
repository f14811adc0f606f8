"""Edits, samples, masks, reports and writers on small cases."""

import bisect
import itertools
import json
import random

import pytest

from framesift import sinks
from framesift.operators import catalog, editing, reduce, sampling, similarity, splits
from framesift.sources import files, labels


def test_durations_end_with_the_last_clip_without_a_gap(spark):
    clips = spark.createDataFrame([("v", 0, 9), ("v", 10, 19), ("v", 25, 30), ("w", 0, 99)], "video string, start long, end long")
    asked = [("v", 5, 50, 100), ("v", 22, 50, 100), ("v", 26, 2, 100), ("v", 27, 50, 29), ("v", 120, 7, 100), ("x", 0, 3, 9)]
    starts = spark.createDataFrame(asked, "video string, start long, duration long, total long")
    got = {(r.video, r.start): r.capped for r in editing.capped_durations(starts, clips).collect()}
    assert got == {("v", 5): 15, ("v", 22): 50, ("v", 26): 2, ("v", 27): 2, ("v", 120): 7, ("x", 0): 3}


def test_edits_of_unknown_objects_change_nothing(spark):
    boxes = spark.createDataFrame([("v", 1, 1, "a", 0, 0, 5, 5), ("v", 2, 1, "a", 1, 1, 6, 6), ("v", 2, 2, "b", 2, 2, 7, 7)], "video string, frame long, oid int, label string, x1 int, y1 int, x2 int, y2 int")
    edits = spark.createDataFrame([("v", 1, 1, "x"), ("v", 1, 2, "y"), ("v", 9, 3, "z")], "video string, oid int, nth int, label string")
    assert [(r.oid, r.label) for r in editing.relabelled(boxes, edits).orderBy("frame", "oid").collect()] == [(1, "y"), (1, "y"), (2, "b")]
    gone = editing.deleted(boxes, spark.createDataFrame([("v", 1), ("v", 1)], "video string, oid int"))
    assert [tuple(r) for r in editing.extents(gone).collect()] == [("v", 2, 2)]
    ranges = spark.createDataFrame([("v", 1, 0, 3), ("v", 1, 4, None), ("v", 1, 6, 8), ("v", 2, 1, None)], "video string, oid int, start long, end long")
    got = editing.trimmed_ranges(ranges, spark.createDataFrame([("v", 1, 6), ("v", 1, 5)], "video string, oid int, at long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("v", 1, 0, 3), ("v", 1, 4, 5), ("v", 2, 1, None)], key=str)


def test_draws_follow_weights_and_never_take_last_frames(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}", 0.0 if i == 4 else float(1 + 8 * (i == 2))) for i in range(6)], "id long, g string, w double")
    got = [r.id for r in sampling.weighted_draws(rows, "w", "id", "g", 3000, 1).collect()]
    assert len(got) == 3000 and 4 not in got and 0.64 < got.count(2) / 3000 < 0.75
    frames = spark.createDataFrame([("a", 0), ("a", 5), ("a", 9), ("b", 1)], "video string, sample_idx long")
    assert {(r.video, r.sample_idx) for r in sampling.sampled_queries(frames, 60, 2).collect()} == {("a", 0), ("a", 5)}
    assert sampling.sampled_queries(frames.limit(0), 5, 1).count() == 0


@pytest.mark.parametrize("block", [1_000_000, 40, 7])
def test_draws_are_those_of_running_sums(spark, block):
    rng = random.Random(5)
    plain = [(i, f"g{rng.randrange(4)}", 900.0 if i == 17 else rng.choice([0.5, 1.0, 2.25, 3.0])) for i in range(200)]
    odd = [(900, "g1", None), (901, "g1", float("nan")), (902, "g1", -1.0), (903, "g1", 0.0), (904, "g1", float("inf"))]
    rows = spark.createDataFrame(plain + odd, "id long, g string, w double").repartition(3)
    order = sorted(plain, key=lambda r: (r[1], r[0]))
    upto = list(itertools.accumulate(r[2] for r in order))
    n = 2000
    u = {r.draw: r.u for r in sampling.draws(spark, n).select("draw", sampling.uniform("draw", 3).alias("u")).collect()}
    want = {d: order[bisect.bisect_right(upto, x * upto[-1])][0] for d, x in u.items()}
    got = sampling.weighted_draws(rows, "w", "id", "g", n, 3, block).collect()
    assert len(got) == n and {r.draw: r.id for r in got} == want


def test_draws_without_rows_and_of_one_row(spark):
    rows = spark.createDataFrame([(None, None, 2.0)], "id long, g string, w double")
    assert [(r.draw, r.id) for r in sampling.weighted_draws(rows, "w", "id", "g", 3, 1, 1).orderBy("draw").collect()] == [(0, None), (1, None), (2, None)]
    assert sampling.weighted_draws(rows.limit(0), "w", "id", "g", 3, 1).count() == 0


def test_tokens_after_the_last_whole_tube_stay_visible(spark):
    cells = spark.createDataFrame([("k", t, s, 1.0 * s) for t in range(5) for s in range(4)], "key string, t int, s int, motion double")
    masked = reduce.masked_slots(reduce.mask_weights(reduce.tube_slots(cells, 5, 2), 2.0), 0.75, 3)
    assert masked.count() == 6
    tokens = reduce.token_split(masked, cells, 5, 4, 2).collect()
    assert len(tokens) == 20 and sum(r.is_masked for r in tokens) == 12 and not any(r.is_masked for r in tokens if r["index"] >= 16)


def test_block_sizes_of_a_periodic_signal(spark):
    signals = [("a", 0, [float(i % 8 == 0) for i in range(64)]), ("a", 1, [float(i % 8 == 3) for i in range(64)]), ("a", 2, [1.0] * 64), ("b", 0, [1.0, 2.0])]
    sizes = reduce.block_sizes(spark.createDataFrame(signals, "key string, line int, values array<double>"))
    assert {(r.key, r.line): r["size"] for r in sizes.collect()} == {("a", 0): 8, ("a", 1): 8, ("a", 2): 0, ("b", 0): 0}
    assert {r.key: r["size"] for r in reduce.usual_block_size(sizes).collect()} == {"a": 8, "b": 0}


def test_large_reference_sets_give_the_same_as_small_ones(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(60)], "vec_id long, embedding array<float>")
    refs = spark.createDataFrame([(i, [float(i % 4), 1.0, float(i)]) for i in range(9)] + [(20, None)], "vec_id long, embedding array<float>")
    small, large = (sorted(map(tuple, similarity.against_references(rows, refs, most).collect())) for most in (1 << 20, 8))
    assert small == large and len(small) == 60
    assert similarity.against_references(rows, refs.limit(0)).count() == 0


def test_a_few_that_ask_are_sent_to_the_rows_and_not_the_rows_around(spark):
    rows = [(i, f"v{i % 3}", [float(i * 7 % 11) - 5, float(i % 5), 1.0]) for i in range(80)] + [(80, "v0", None)]
    f = spark.createDataFrame(rows, "vec_id long, video string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(4,), (4,), (17,), (80,), (999,)], "vec_id long")
    near = similarity.nearest_other(f, 3, queries=asked)
    every = {(r["query"], r.match, r.similarity, r["rank"]) for r in similarity.nearest_other(f, 3).collect() if r["query"] in (4, 17)}
    assert {(r["query"], r.match, r.similarity, r["rank"]) for r in near.collect()} == every and len(every) == 6
    assert "FlatMapGroupsInPandas" not in near._jdf.queryExecution().toString()  # no blocks are made
    none = similarity.nearest_other(f, queries=asked.where("vec_id > 90"))
    assert none.count() == 0 and "FlatMapGroupsInPandas" not in none._jdf.queryExecution().toString()


def test_best_splits_and_their_outputs(spark, tmp_path):
    frames = spark.createDataFrame([(f"v{i}", c) for i in range(8) for c in (0, 1, i % 2)], "video string, cluster int")
    best = splits.fast_split(frames, frames, 0.25, 40, 2)
    assert [(r["rank"], r.n) for r in best.where("is_test").groupBy("rank").count().withColumnRenamed("count", "n").orderBy("rank").collect()] == [(1, 2), (2, 2)]
    sinks.ranked_splits(best, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s/videos"), header=True).count() == 16
    flags = spark.read.csv(str(tmp_path / "s/flags"), header=True)
    assert flags.columns == ["video", "rank_1", "rank_2"] and flags.count() == 8


def test_reports_lists_and_errors(spark, tmp_path):
    rows = catalog.filter_report(spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", None)], "path string, distance double"), "distance", 0.3)
    sinks.filter_report(rows, str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "r/summary")).select("n_total", "n_out", "n_keep").collect()] == [(3, 1, 2)]
    sinks.path_list(spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "nth long, path string"), str(tmp_path / "l"))
    assert sorted((r.nth, r.path) for r in spark.read.json(str(tmp_path / "l")).collect()) == [(0, "x"), (1, "y")]
    (tmp_path / "anti.json").write_text(json.dumps({"paths": ["p/b.npy", "p/a.npy"]}))
    listed = labels.path_list(spark, str(tmp_path / "anti.json"))
    vectors = spark.createDataFrame([("p/a.npy", 0, [1.0]), ("p/b.npy", 0, None)], "path string, nth int, embedding array<float>")
    assert [(r.nth, r.path) for r in files.listed_vectors(listed, vectors).collect()] == [(1, "p/a.npy")]
    one = spark.createDataFrame([("m", 1.5)], "metric string, value double")
    got = sinks.evaluations(spark, {"good": lambda: one, "bad": lambda: one.select("nothing")}, 3, str(tmp_path / "e"))
    assert {(r.evaluator, r.metric, r.value, bool(r.error)) for r in got.collect()} == {("good", "m", 1.5, False), ("bad", None, None, True)}
    sinks.evaluations(spark, {"good": lambda: one}, 3, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 3


def test_manifests_need_their_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text("video_idx,embedding_path\n3,a.npy\nVideo7,b.npy\n")
    assert [tuple(r) for r in labels.manifest(spark, str(tmp_path / "m.csv")).collect()] == [("video03", "a.npy"), ("video07", "b.npy")]
    with pytest.raises(ValueError):
        labels.manifest_rows(spark.range(1))
