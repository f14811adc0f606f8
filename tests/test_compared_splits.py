"""Splits before and after a reduction, and lines of images, against numpy."""

import numpy as np
from pyspark.sql import functions as F

from framesift.operators import reduce, splits


def test_splits_before_and_after_reduction_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"cat{v % 2}/v{v:02d}", rng.normal(size=6) * [5, 3, 2, 1, 0.1, 0.1] + v % 3) for v in range(14) for i in range(v * 100, v * 100 + 3 + v % 4)]
    frames = spark.createDataFrame([(i, v, [float(a) for a in x]) for i, v, x in rows], "vec_id long, video string, embedding array<double>")
    reduced = reduce.pca(frames, 3)[0].select("video", F.col("reduced").alias("embedding"))
    stratum = F.substring("video", 1, 4)
    got = {r.representation: r for r in splits.compared_splits({"native": frames, "pca": reduced}, stratum, 0.3, 30).collect()}

    x = np.array([r[2] for r in rows])
    centred = x - x.mean(0)
    low = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    names = sorted({r[1] for r in rows})
    at = {v: [k for k, r in enumerate(rows) if r[1] == v] for v in names}
    trials = splits.stratified_trials(frames.select("video").distinct().withColumn("stratum", stratum), 0.3, 30).where("is_test").collect()
    tests = {t: {r.video for r in trials if r.trial == t} for t in range(30)}
    length = np.array([len(at[v]) for v in names])

    def scores(y):
        unit = np.array([y[at[v]].mean(0) for v in names])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        out = []
        for t in range(30):
            m = np.array([v in tests[t] for v in names])
            a, b = unit[m].mean(0), unit[~m].mean(0)
            out.append(0.9 * (1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) + 0.1 * abs(length[m].mean() - length[~m].mean()) / length.std())
        return np.round(out, 9)

    native, pca = scores(x), scores(low)
    assert got["native"].trial == native.argmin() and np.isclose(got["native"].score, native.min(), atol=2e-9) and got["native"].score == got["native"].base_score
    assert got["pca"].trial == pca.argmin() and np.isclose(got["pca"].score, pca.min(), atol=1e-6) and np.isclose(got["pca"].base_score, native[pca.argmin()], atol=2e-9)
    assert got["pca"].base_score >= got["native"].score and {(r.n_train, r.n_test) for r in got.values()} == {(10, 4)}


def test_lines_of_images_against_numpy(spark):
    rng = np.random.default_rng(6)
    blocks = np.kron(rng.integers(0, 255, (9, 12)), np.ones((8, 8), int))
    images = {"blocks": blocks, "noise": rng.integers(0, 255, (33, 71)), "low": rng.integers(0, 255, (31, 80)), "tall": rng.integers(0, 255, (130, 32))}
    rows = [(k, *a.shape, [int(v) for v in a.ravel()]) for k, a in images.items()] + [("torn", 40, 40, [1, 2]), ("none", 40, 40, None), (None, None, None, [1])]
    signals = reduce.line_signals(spark.createDataFrame(rows, "key string, height int, width int, gray array<int>"))
    got = {(r["key"], r["line"]): r["values"] for r in signals.collect()}
    want = {}
    for k in ("blocks", "noise", "tall"):
        a = images[k].astype(float)
        n = min(50, *a.shape)
        lines = [a[i] for i in np.linspace(0, a.shape[0] - 1, n, dtype=int)] + [a[:, i] for i in np.linspace(0, a.shape[1] - 1, n, dtype=int)]
        want |= {(k, i): np.abs(np.diff(v)).tolist() for i, v in enumerate(lines)}
    assert got == want
    assert {r.key: r["size"] for r in reduce.usual_block_size(reduce.block_sizes(signals)).collect()}["blocks"] == 8
