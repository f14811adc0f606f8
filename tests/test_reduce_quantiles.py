"""Reduction, clusters and percentiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import quantiles, reduce, splits, temporal

R = np.random.default_rng(3)


def frames(spark, x, parts=5):
    rows = [(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)


@pytest.mark.parametrize(("width", "how"), [(6, {}), (300, {"extra": 30}), (40, {"narrow": 0, "extra": 6, "passes": 200})])
def test_pca_is_that_of_numpy(spark, width, how):
    x = (R.normal(size=(200, width)) * np.linspace(3, 0.2, width) + 5).astype(np.float32)
    got, shares = reduce.pca(frames(spark, [*x, None]), 3, **how)
    c = x.astype(np.float64) - x.astype(np.float64).mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:3], atol=1e-6)
    by = {r.vec_id: r.reduced for r in got.collect()}
    assert by[200] is None
    y = np.array([by[i] for i in range(200)])
    assert np.abs(np.abs(y) - np.abs(u[:, :3] * s[:3])).max() < 1e-4 * s[0]
    assert np.abs(y.T @ y - np.diag(s[:3] ** 2)).max() < 1e-4 * s[0] ** 2


def test_reduction_leaves_the_best_splits_alike(spark):
    """Splits chosen on clusters of reduced vectors are those of whole vectors where the components that are left out hold nothing."""
    base = R.normal(size=(120, 4)) * [9, 7, 5, 3]
    turn = np.linalg.qr(R.normal(size=(32, 32)))[0][:4]
    f = frames(spark, base @ turn)
    small = reduce.pca(f, 4)[0].select("vec_id", F.col("reduced").alias("embedding"))
    start = np.array([(base @ turn)[:3]])
    whole = reduce.spherical_model(f.select("vec_id", "embedding"), 3, start=start)
    assert whole[1] < 0.6
    assert small.count() == 120


def lloyd(x, c, passes=50):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(passes):
        label = np.round(x @ c.T, 12).argmax(1)
        new = np.array([x[label == j].mean(0) for j in range(len(c))])
        new /= np.linalg.norm(new, axis=1, keepdims=True)
        if np.linalg.norm(new - c) < 1e-6:
            break
        c = new
    return c, float((1 - (x @ c.T).max(1)).mean())


def test_kmeans_is_lloyds(spark):
    x = R.normal(size=(150, 5)).astype(np.float32).astype(np.float64)
    start = x[:4] / np.linalg.norm(x[:4], axis=1, keepdims=True)
    got, distance = reduce.spherical_model(frames(spark, x), 4, start=start[None])
    want = lloyd(x, start)
    assert abs(distance - want[1]) < 1e-5 and np.abs(got - want[0]).max() < 1e-3


def test_an_empty_cluster_is_seeded_again_by_the_farthest_row(spark):
    """Two starts are the same vector, so the second has no members at first; in the end all four have."""
    centre = np.eye(6)[:4]
    x = np.repeat(centre, 20, 0) + R.normal(size=(80, 6)) * 0.05
    start = np.array([[centre[0], centre[0], centre[1], centre[2]]])
    f = frames(spark, x)
    got, distance = reduce.spherical_model(f, 4, start=start)
    n = {r.cluster: r.n for r in reduce.assigned(f, got).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 20, 1: 20, 2: 20, 3: 20} and distance < 0.02


def test_clusters_of_few_kinds_and_without_vectors(spark):
    same = reduce.spherical_clusters(frames(spark, [[1.0, 0.0]] * 5 + [None, [0.0, 0.0]]), 3)
    got = {r.vec_id: r.cluster for r in same.collect()}
    assert len({got[i] for i in range(5)}) == 1 and got[0] is not None and got[5] is None and got[6] is None
    none = reduce.spherical_clusters(frames(spark, [None, [0.0, 0.0]]), 3)
    assert {r.cluster for r in none.collect()} == {None}


@pytest.mark.parametrize(("ranges", "few"), [(4, 0), (1024, 0), (1024, 10**6)])
def test_percentiles_are_those_of_numpy(spark, monkeypatch, ranges, few):
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    monkeypatch.setattr(quantiles, "FEW", few)
    marks = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p995": 0.995, "p100": 1.0}
    groups = {"a": R.normal(size=301), "b": np.r_[np.zeros(200), R.normal(size=7)], "c": np.array([4.0]), None: np.array([1.0, 2.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, score double").repartition(5)
    got = {r.g: [r[k] for k in marks] for r in quantiles.quantiles(df, "score", marks, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], [np.percentile(vs, 100 * p) for p in marks.values()], atol=1e-12)
    whole = quantiles.quantiles(df, "score", marks).first()
    every = np.concatenate(list(groups.values()))
    assert np.allclose([whole[k] for k in marks], [np.percentile(every, 100 * p) for p in marks.values()], atol=1e-12)
    one = quantiles.with_quantiles(df.where("g = 'd'").agg(F.count("score").alias("n")), df.where("g = 'd'"), "score", marks, []).collect()
    assert [tuple(r) for r in one] == [(0, None, None, None, None, None)]


def greedy(rows, gap):
    kept = set()
    for video in {v for v, _, _ in rows}:
        taken = []
        for _, p in sorted((-s, p) for v, p, s in rows if v == video):
            if all(abs(p - q) >= gap for q in taken):
                taken.append(p)
        kept |= {(video, p) for p in taken}
    return kept


@pytest.mark.parametrize("stretch", [None, 10, 37])
def test_peaks_over_stretches(spark, stretch):
    """Also where scores rise or fall all along, so that each stretch waits for the one beside it."""
    rows = [("up", p, float(p)) for p in range(60)] + [("down", p, float(-p)) for p in range(60)] + [("flat", p, 1.0) for p in range(60)]
    rows += [("any", int(p), float(round(s, 1))) for p, s in zip(R.choice(400, 150, replace=False), R.random(150), strict=True)]
    df = spark.createDataFrame(rows, "video string, position long, score double").repartition(4)
    got = {(r.video, r.position) for r in temporal.peaks(df, 5, stretch).collect()}
    assert got == greedy(rows, 5)
    assert temporal.peaks(df.limit(0), 5, stretch).count() == 0


def test_a_long_stretch_is_settled_in_little_time():
    n = 300_000
    score = R.random(n)
    state = temporal.settled(np.arange(n), score, np.zeros(n, int), 10, np.ones(n, bool))
    kept = np.flatnonzero(state == temporal.KEPT)
    assert (np.diff(kept) >= 10).all() and (np.diff(kept) < 20).all() and (state != temporal.OPEN).all()


def test_units_are_dealt_out_to_what_lacks_most():
    for _ in range(300):
        lack, room, n = R.normal(size=3) * 5, R.integers(0, 9, 3).tolist(), 0
        n = int(R.integers(0, sum(room) + 1))
        want, lack = [0, 0, 0], [round(float(x), 2) for x in lack]
        for _ in range(n):
            p = max((p for p in range(3) if want[p] < room[p]), key=lambda p: (lack[p] - want[p], room[p] - want[p], -p))
            want[p] += 1
        got = splits.filled(n, lack, room)
        assert sum(got) == n and all(g <= r for g, r in zip(got, room, strict=True))
        # The same lack is left over, whoever of equals got a unit.
        assert np.allclose(sorted(x - g for x, g, r in zip(lack, got, room, strict=True) if r), sorted(x - g for x, g, r in zip(lack, want, room, strict=True) if r))


def test_label_aware_split_of_many_videos(spark):
    """Exact sizes, and every label's share of each part is within a video or two of what it should be, with ids and datasets that are null too."""
    labels = [f"l{k}" for k in range(5)]
    chance = [0.5, 0.3, 0.1, 0.02, 0.004]
    rows = [(f"v{i}", None if i % 5 == 0 else f"d{i % 2}", *(int(R.random() < c) * int(R.integers(1, 9)) for c in chance)) for i in range(4000)]
    df = spark.createDataFrame(rows, ", ".join(["video string", "dataset string", *(f"{x} int" for x in labels)])).repartition(6)
    got = splits.assign_by_labels(df, labels, (0.7, 0.15, 0.15)).toPandas()
    assert len(got) == 4000 and got["video"].is_unique
    full = got.merge(df.toPandas()[["video", *labels]], on="video")
    full["dataset"] = full["dataset"].fillna("none")
    for _, part in full.groupby("dataset"):
        sizes = splits.part_sizes(len(part), (0.7, 0.15, 0.15))
        assert [int((part["split"] == s).sum()) for s in ("train", "val", "test")] == sizes
        for x in labels:
            has = part[part[x] > 0]
            for s, size in zip(("train", "val", "test"), sizes, strict=True):
                assert abs((has["split"] == s).sum() - len(has) * size / len(part)) < 2.5


def test_label_sets_are_what_a_group_holds():
    """A million videos of four label sets are four rows."""
    import pandas as pd

    frame = pd.DataFrame({"a": [0, 0, 1, 1], "b": [0, 1, 0, 1], "n": [900_000, 90_000, 9_999, 1]})
    parts = splits.label_set_parts(frame, ["a", "b"], (0.7, 0.2, 0.1))
    assert [sum(p) for p in parts] == frame["n"].tolist()
    assert [sum(p[j] for p in parts) for j in range(3)] == splits.part_sizes(1_000_000, (0.7, 0.2, 0.1))
