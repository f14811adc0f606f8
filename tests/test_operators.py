"""Hand-computed cases and properties of the library's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import boxes, names
from framesift.operators import catalog, labels, phases, similarity, splits, temporal


def one(df):
    return [tuple(r) for r in df.collect()]


def test_range_end_closed_and_half_open(spark):
    b = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, 9)], "video int, oid int, frame int")
    r = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 9, None)], "video int, oid int, start int, end int")
    closed = {(x.oid, x.frame): x.oof for x in labels.hidden(b, r, True).collect()}
    half = {(x.oid, x.frame): x.oof for x in labels.hidden(b, r, False).collect()}
    assert closed == {(1, 5): True, (1, 6): False, (2, 9): True}
    assert half == {(1, 5): False, (1, 6): False, (2, 9): True}


def test_interval_frames(spark):
    i = spark.createDataFrame([("v", 0, "a", -3, 2), ("v", 1, "b", 2, 99), ("v", 2, "zz", 0, 9), ("v", 3, "a", 8, 7)], "video string, pos int, code string, start_s long, end_s long")
    n = spark.createDataFrame([("v", 5)], "video string, n long")
    codes = spark.createDataFrame([("a", 0), ("b", 1)], "code string, phase_id int")
    got = sorted((r.frame, r.phase_id) for r in labels.interval_frames(i, n, codes).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)]  # a later interval overwrites, the end second counts, a backward one is empty


def test_targets_round_half_to_even(spark):
    t = splits.targets(F.col("n"), (0.5, 0.25, 0.25))
    got = {r.n: (r.a, r.b, r.c) for r in spark.range(9).withColumnRenamed("id", "n").select("n", t[0].alias("a"), t[1].alias("b"), t[2].alias("c")).collect()}
    assert got[2] == (2, 0, 0) and got[3] == (1, 1, 1)
    assert got[5] == (3, 1, 1)  # 2 x 0.25 = 0.5 rounds to 0
    assert all(sum(v) == k for k, v in got.items())


def test_nearest_is_never_of_the_same_video_and_ties_go_to_the_least_id(spark):
    rows = [(1, "a", 0, [1.0, 0.0]), (2, "a", 1, [1.0, 0.0]), (3, "b", 0, [2.0, 0.0]), (4, "b", 1, [1.0, 0.0]), (5, "c", 0, [0.0, 0.0]), (6, "c", 1, None)]
    f = spark.createDataFrame(rows, "vec_id long, video string, sample_idx long, embedding array<float>")
    got = {r.query: (r.match, round(r.similarity, 6)) for r in similarity.nearest_other(f).collect()}
    assert got == {1: (3, 1.0), 2: (3, 1.0), 3: (1, 1.0), 4: (1, 1.0), 5: (1, 0.0)}


def _nearest_by_hand(x, groups, k, asks=None):
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    sim, n = np.round(unit @ unit.T, 9), len(x)
    out = set()
    for i in range(n) if asks is None else asks:
        other = [j for j in range(n) if groups[j] != groups[i]]
        out |= {(i, j, r + 1) for r, j in enumerate(sorted(other, key=lambda j: (-sim[i, j], j))[:k])}
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize(("block", "held"), [(4 << 20, 256 << 20), (300, 1000), (120, 1 << 20)])
def test_nearest_over_several_blocks_and_bands(spark, kind, block, held):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 5))
    x[40:60] = x[3]  # many equal vectors
    x[70] = 0
    x = x.astype(np.float32 if kind == "float" else np.float64)
    groups = [None if i % 5 == 4 else f"v{i % 5}" for i in range(90)]
    f = spark.createDataFrame([(i, groups[i], i, [float(v) for v in x[i]]) for i in range(90)], f"vec_id long, video string, sample_idx long, embedding array<{kind}>")
    for k in (1, 3):
        assert {(r.query, r.match, r.rank) for r in similarity.nearest_other(f, k, block_bytes=block, held_bytes=held).collect()} == _nearest_by_hand(x.astype(np.float64), groups, k)
    asked = spark.createDataFrame([(i,) for i in (2, 41, 70, 70)], "vec_id long")
    got = {(r.query, r.match, r.rank) for r in similarity.nearest_other(f, 2, queries=asked, block_bytes=block, held_bytes=held).collect()}
    assert got == _nearest_by_hand(x.astype(np.float64), groups, 2, [2, 41, 70])


def _blocks_by_hand(x, groups, cuts, asks=None):
    for n, at in enumerate(np.split(np.arange(len(x)), cuts)):
        at = at[np.lexsort((at, groups[at]))]
        yield similarity._Packed(n, at, groups[at], np.ones(len(at), bool) if asks is None else asks[at], x[at], np.full(len(at), similarity.NONE))


def _met(blocks, k):
    known = similarity._Nearest(k, np.zeros((1, 1)))
    for b in blocks:
        before = list(known.kept)
        known.add(b, 2.0, 0)
        for other in [b.number, *before]:
            known.meet(b.number, other)
    found = [r for n in list(known.kept) for batch in known.leave(n) for r in batch.to_pylist()]
    out = set()
    for q in {r["query"] for r in found}:
        best = sorted((-r["similarity"], r["match"]) for r in found if r["query"] == q)
        out |= {(q, m, n + 1) for n, (_, m) in enumerate(best)}
    return out


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("k", [1, 4, 20])
def test_tiles_of_blocks_give_the_nearest(monkeypatch, kind, k):
    """Few and many groups, equal vectors within and over tiles, zero vectors, blocks shorter than k."""
    rng = np.random.default_rng(k)
    for tile, n_groups in (((7, 11), 3), ((64, 5), 150), ((512, 2048), 1), ((3, 200), 40)):
        monkeypatch.setattr(similarity, "TILE", tile, raising=False)
        x = rng.normal(size=(220, 4)).astype(kind)
        x[rng.integers(0, 220, 60)] = x[5]
        x[[9, 100]] = 0
        groups = rng.integers(0, n_groups, 220) * 7 - 50
        assert _met(_blocks_by_hand(x, groups, [3, 90, 91, 180]), k) == _nearest_by_hand(x.astype(np.float64), groups, k)


def test_two_blocks_hold_no_product_of_all_their_vectors():
    """Blocks of 4 MB are 16,384 vectors of 64 floats; a product of two of them would be 1 GB."""
    import tracemalloc

    n = 5000
    x = np.random.default_rng(0).normal(size=(2 * n, 8)).astype(np.float32)
    blocks = list(_blocks_by_hand(x, np.arange(2 * n) % 10, [n]))
    tracemalloc.start()
    _met(blocks, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < n * n * 4 / 2


def test_far_blocks_are_left_out(spark):
    """Vectors around few directions: most pairs of blocks can't hold a nearest neighbour, and the result is the same."""
    rng = np.random.default_rng(1)
    centre = np.eye(12)[:8] * 10
    x = (centre[np.arange(400) % 8] + rng.normal(size=(400, 12)) * 0.1).astype(np.float32)
    groups = [f"v{i // 8 % 3}" for i in range(400)]
    f = spark.createDataFrame([(i, groups[i], [float(v) for v in x[i]]) for i in range(400)], "vec_id long, video string, embedding array<float>")
    skipped, compared = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = {(r.query, r.match, r.rank) for r in similarity.nearest_other(f, block_bytes=1500, skipped=skipped, compared=compared).collect()}
    assert got == _nearest_by_hand(x.astype(np.float64), groups, 1)
    assert skipped.value + compared.value >= 400 * 400 / 2
    assert skipped.value > 2 * compared.value


def test_a_block_goes_to_one_cell_of_each_band(spark):
    """116,479 vectors of 12,288 floats: 22 bands of 256 MB, so 22 times the vectors are dealt out, whatever the number of blocks."""
    size = 116_479 * 12_288 * 4
    assert similarity.bands_of(size, -(-size // similarity.BLOCK_BYTES), similarity.HELD_BYTES, 52) == 22
    assert similarity.bands_of(1000, 1, 256, 8) == 1
    f = spark.createDataFrame([(i, f"v{i % 7}", [float(i), 1.0]) for i in range(60)], "vec_id long, video string, embedding array<float>")
    plan = similarity.nearest_other(f, block_bytes=80, held_bytes=160)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_settings_are_one_json_object(spark):
    import hashlib
    import json

    runs = {"a": {"b": "x \"y\"", "a": "1"}, "c": {"z": None}}
    rows = [(r, k, v) for r, s in runs.items() for k, v in s.items()]
    got = {r.run: r.key for r in catalog.settings_key(spark.createDataFrame(rows, "run string, setting string, value string")).collect()}
    assert got == {r: hashlib.sha1(json.dumps(s, sort_keys=True).encode()).hexdigest() for r, s in runs.items()}


def test_last_frame_never_matches(spark):
    f = spark.createDataFrame([(1, "a", 0, [1.0, 0.1]), (2, "a", 1, [0.0, 1.0]), (3, "b", 0, [1.0, 0.0])], "vec_id long, video string, sample_idx long, embedding array<float>")
    got = {r["query"]: r["is_match"] for r in similarity.mined_pairs(f, 0.8).collect()}
    assert got == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("n,rows", [(9, 0), (10, 1), (13, 4)])
def test_change_scores_need_both_windows(spark, n, rows):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3))
    f = spark.createDataFrame([("v", i, [float(v) for v in x[i]]) for i in range(n)], "video string, sample_idx long, embedding array<float>")
    got = {r.position: r.score for r in temporal.change_scores(f, 5).collect()}
    assert len(got) == rows
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for p, s in got.items():
        a, b = unit[p - 5 : p].mean(0), unit[p : p + 5].mean(0)
        a, b = a / (np.linalg.norm(a) + 1e-8), b / (np.linalg.norm(b) + 1e-8)
        assert s == pytest.approx(1 - a @ b, abs=1e-5)


def test_peaks_keep_their_distance(spark):
    rng = np.random.default_rng(5)
    s = spark.createDataFrame([(f"v{i % 2}", i // 2, float(rng.random())) for i in range(200)], "video string, position long, score double")
    kept = temporal.peaks(s, 7).collect()
    every = {(r.video, r.position): r.score for r in s.collect()}
    for v in ("v0", "v1"):
        p = sorted(r.position for r in kept if r.video == v)
        assert min(np.diff(p)) >= 7
        for (w, q), score in every.items():  # one left out is near a better or equal one
            if w == v and q not in p:
                assert any(abs(q - k) < 7 and every[v, k] >= score for k in p)


def test_nearest_fill_prefers_the_earlier_and_nearest_allowed_the_later(spark):
    r = spark.createDataFrame([("v", 0, 1), ("v", 1, None), ("v", 2, None), ("v", 3, None), ("v", 4, 9), ("w", 0, None)], "video string, sample_idx long, x int")
    assert sorted((t.video, t.sample_idx, t.x) for t in temporal.nearest_fill(r, "x").collect() if t.video == "v") == [("v", 0, 1), ("v", 1, 1), ("v", 2, 1), ("v", 3, 9), ("v", 4, 9)]
    asked = spark.createDataFrame([("v", 5), ("v", 1), ("w", 3)], "video string, frame long")
    allowed = spark.createDataFrame([("v", 4), ("v", 6)], "video string, frame long")
    assert {(t.video, t.frame): t.nearest for t in labels.nearest_allowed(asked, allowed).collect()} == {("v", 5): 6, ("v", 1): 4, ("w", 3): None}


def test_nearest_fill_costs_a_long_video_no_square(spark):
    """A window frame that reaches to the end of its partition is computed anew for each row."""
    n = 20_000
    r = spark.range(n).select(F.lit("v").alias("video"), F.col("id").alias("sample_idx"), F.when(F.col("id") % 1000 == 500, F.col("id")).alias("x"))
    filled = temporal.nearest_fill(r, "x")
    want = {i: min((abs(i - k), k) for k in range(500, n, 1000))[1] for i in range(n)}
    assert {t.sample_idx: t.x for t in filled.collect()} == want
    assert "currentrow$(), unboundedfollowing$()" not in filled._jdf.queryExecution().optimizedPlan().toString()



def test_toggles_leave_the_last_range_open(spark):
    e = spark.createDataFrame([("v", 3), ("v", 9), ("v", 12)], "video string, frame long")
    assert sorted((r.start, r.end) for r in temporal.toggles_to_ranges(e, ["video"], "frame").collect()) == [(3, 9), (12, None)]


def test_diverse_takes_the_farthest_first(spark):
    c = spark.createDataFrame([("v", i, i * 4, i * 4 + 3, m) for i, m in enumerate([[0.0, 0.0], [0.1, 0.0], [9.0, 0.0], [0.0, 8.0], [0.2, 0.1]])], "video string, clip long, start long, end long, mean array<double>")
    assert {r.start for r in temporal.diverse(c, 0.4, 4).collect()} == {8, 12}


def test_split_choice_is_exact_and_disjoint(spark):
    v = spark.createDataFrame([(i, i % 3) for i in range(37)], "video int, stratum int")
    assert splits.random_choice(v, 0.3, 1).where("is_test").count() == 11
    s = splits.stratified(v, 0.3, 1)
    assert s.where("is_test").count() == 11 and s.count() == 37
    assert one(splits.random_choice(v, 0.3, 1).orderBy("video")) == one(splits.random_choice(v, 0.3, 1).orderBy("video"))


def test_quantile_bins_with_few_values(spark):
    v = spark.createDataFrame([(i, 5) for i in range(6)], "video int, n int")
    assert {r.bin for r in splits.quantile_bins(v, "n", 4).collect()} == {0}


def test_relative_difference_of_zeros(spark):
    r = spark.range(1).select(splits.relative_difference(F.lit(0.0), F.lit(0.0)).alias("a"), splits.relative_difference(F.lit(1.0), F.lit(4.0)).alias("b")).first()
    assert (r.a, r.b) == (0.0, 75.0)


def test_names(spark):
    rows = ["MVD_003_left", "RS-046_x", "tl_7", "plain", "_odd", "a_toolong_b"]
    df = spark.createDataFrame([(n,) for n in rows], "n string")
    got = {r.n: (r.i, r.v) for r in df.select("n", names.video_id(F.col("n")).alias("i"), names.id_variants(F.col("n")).alias("v")).collect()}
    assert got["MVD_003_left"] == ("MVD_003", ["MVD_003_left"])
    assert got["RS-046_x"][1] == ["RS-046_x", "TL-046_x"] and got["tl_7"][1] == ["tl_7", "RS_7"]
    assert got["plain"][0] == "plain" and got["a_toolong_b"][0] == "a"
    u = "x/0A1B2C3D-0000-1111-2222-ABCDEFABCDEF?"
    assert spark.range(1).select(names.uuid(F.lit(u)), names.uuid(F.lit("none"))).first()[:] == ("0a1b2c3d-0000-1111-2222-abcdefabcdef", None)


def test_resolution_needs_a_separator(spark):
    from framesift.operators.names import collisions, resolve

    n = spark.createDataFrame([("ATLR_3",), ("TL-5",), ("zzz",), ("atlr_31_a",)], "name string")
    d = spark.createDataFrame([("ATLR_31_a", 0), ("ATLR_3_b", 1), ("RS-5", 2)], "dir string, nth int")
    got = {r.name: r.dir for r in resolve(n, d).collect()}
    assert got == {"ATLR_3": "ATLR_3_b", "TL-5": "RS-5", "zzz": None, "atlr_31_a": "ATLR_31_a"}
    assert collisions(resolve(n, d)).count() == 0


def test_containment_of_short_empty_and_null_names(spark):
    from framesift.operators.names import containing

    asked = ["", "a", "ab", "abc", "b_ab", "ABCA", "zz", "é", None, "abcabcabcabc", "ca"]
    held = ["abcab", "xxab_abc", "b_abc", "", None, "caé", "abcab"]
    n, low = spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame([(f"d{k}", k, x) for k, x in enumerate(held)], "dir string, nth int, low string")
    got = sorted((r.name, r.nth) for r in containing(n, low).collect())
    assert got == sorted([("", 0), *((x, k) for x in asked if x for k, h in enumerate(held) if h and x.lower() in h)])


def test_iou_and_empty_boxes(spark):
    b = [F.lit(float(x)) for x in (0, 0, 2, 2)]
    c = [F.lit(float(x)) for x in (1, 1, 3, 3)]
    z = [F.lit(1.0)] * 4
    assert spark.range(1).select(boxes.iou(b, c), boxes.iou(z, z)).first()[:] == (pytest.approx(1 / 7), 0.0)


def test_clip_completion_looks_up_the_clip_before(spark):
    c = spark.createDataFrame([("v", 0, 9), ("v", 20, 29), ("v", 40, 49)], "video string, start long, end long")
    f = spark.createDataFrame([("v", 9), ("v", 35), ("v", 40)], "video string, frame long")
    assert {r.start: r.done for r in phases.annotated_clips(c, f).collect()} == {0: True, 20: False, 40: True}


def test_weighted_choice_never_takes_weightless_rows(spark):
    r = spark.createDataFrame([(i, 0.0 if i % 2 else 1.0) for i in range(40)], "k int, w double")
    got = splits.weighted_choice(r, "w", "k", 15, 3).collect()
    assert len(got) == 15 and all(x.k % 2 == 0 for x in got)


def test_stems_by_rule(spark):
    from framesift.operators.names import match_stems, with_record_number

    s = spark.createDataFrame([("ABC",), ("ab",), ("RS-001_long",), ("x_20231",), ("none",)], "stem string")
    c = spark.createDataFrame([("abc",), ("ab_z",), ("abq",), ("rs-001_a",), ("rs-0019",), ("q20231",), ("z_20231_q",)], "candidate string")
    got = {r.stem: (r.match, r.rule) for r in match_stems(s, c).collect()}
    assert got == {"ABC": ("abc", 1), "ab": ("ab_z", 2), "RS-001_long": ("rs-001_a", 3), "x_20231": ("q20231", 4), "none": ("none", 0)}
    names_ = spark.createDataFrame([("case_1234567_a",), ("other",)], "name string")
    dirs = spark.createDataFrame([("v_1234567", 0), ("w_1234567_b", 1)], "dir string, nth int")
    resolved = spark.createDataFrame([("case_1234567_a", None), ("other", "o")], "name string, dir string")
    assert {r.name: r.dir for r in with_record_number(names_, dirs, resolved).collect()} == {"case_1234567_a": "v_1234567", "other": "o"}


def test_names_meet_one_directory_of_their_record_number(spark, tmp_path):
    from framesift import registry
    from framesift.operators.names import with_record_number

    names_ = spark.range(300).select(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit("_1000001_x")).alias("name"))
    dirs = spark.range(400).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("_1000001")).alias("dir"), (-F.col("id")).alias("nth"))
    got = with_record_number(names_, dirs, names_.select("name", F.lit(None).cast("string").alias("dir")))
    assert {r.dir for r in got.collect()} == {"d399_1000001"} and got.count() == 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("min(struct(nth")  # the least is taken below the join, not above
    spark.createDataFrame([(0, "a"), (40, "a"), (50, "b")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10,), (70,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(one(registry.functions()["record_numbers"](spark, str(tmp_path)))) == [("a_1000000_x", None), ("b_1000010_x", "d10_1000010")]


def test_pca_is_centred_and_keeps_wide_requests(spark):
    from framesift.operators.reduce import pca, spherical_clusters

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) * [5, 1, 0.1, 0.1] + 9
    f = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "vec_id int, embedding array<float>")
    reduced, share = pca(f, 2)
    y = np.array([r.reduced for r in reduced.orderBy("vec_id").collect()])
    assert np.abs(y.mean(0)).max() < 1e-5 and share[0] > 0.9
    assert pca(f, 4)[1] == []
    two = spark.createDataFrame([(i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(20)] + [(99, [0.0, 0.0])], "vec_id int, embedding array<float>")
    got = {r.vec_id: r.cluster for r in spherical_clusters(two, 2).collect()}
    assert got[99] is None and len({got[i] for i in range(0, 20, 2)}) == 1 and got[0] != got[1]


def test_label_aware_split_spreads_a_rare_label(spark):
    v = spark.createDataFrame([(i, "d", 10 + i, int(i in (1, 5, 9)), 1) for i in range(12)], "video int, dataset string, n_frames int, rare int, common int")
    got = {r.video: r.split for r in splits.assign_by_labels(v, ["rare", "common"], (0.34, 0.33, 0.33)).collect()}
    assert {got[i] for i in (1, 5, 9)} == {"train", "val", "test"}
    assert sorted(got.values()).count("train") == 4


def test_positions_and_records(spark):
    f = spark.createDataFrame([("a", 0, "p0"), ("a", 1, "p1")], "video string, sample_idx int, path string")
    a = spark.createDataFrame([("a", 1), ("a", 2), ("z", 0)], "video string, sample_idx int")
    assert {(r.video, r.sample_idx): r.status for r in splits.by_position(a, f).collect()} == {("a", 1): "ok", ("a", 2): "out_of_range", ("z", 0): "no_video"}
    t = spark.createDataFrame([("a", 5)], "video string, hooks int")
    p = spark.createDataFrame([], "video string, phases int")
    assert [(r.video, r.n_frames, r.hooks, r.missing) for r in splits.joined_records(f, t, p).collect()] == [("a", 2, 5, "phases")]


def test_labels_without_a_vocabulary(spark):
    boxes = spark.createDataFrame([("a", 1, "x")], "video string, frame int, label string")
    vocabulary = spark.createDataFrame([], "nth int, label string")
    assert labels.per_label(boxes, vocabulary).count() == 0


def test_strata_go_into_the_split(spark):
    from framesift.plans.reduce import strata_split

    rows = strata_split(spark, "/root/testdata/sf0.001").collect()
    assert len({r.video for r in rows}) == len(rows) > 0
    for stratum in {r.stratum for r in rows}:
        held = [r.is_test for r in rows if r.stratum == stratum]
        assert abs(sum(held) - 0.2 * len(held)) <= 1


def _step_by_hand(frames, clips):
    out = set()
    for v, x in frames:
        own = [(a, b) for w, a, b in clips if w == v]
        on = lambda f: any(a <= f <= b for a, b in own)  # noqa: B023, E731
        later, earlier = min((a for a, _ in own if a > x), default=None), max((b for _, b in own if b < x), default=None)
        if own:
            out.add((v, x, x + 1 if on(x + 1) else later, x - 1 if on(x - 1) else earlier))
    return out


def test_steps_over_many_clips_hold_no_list_of_them(spark):
    rng = np.random.default_rng(3)
    clips = [(v, int(a), int(a + rng.integers(0, 9))) for v in "ab" for a in np.cumsum(rng.integers(1, 14, 60)) - 20] + [("a", 300, 320), ("a", 305, 310)]
    frames = [(v, x) for v in "abc" for x in range(-25, 420, 2)]
    asked, held = spark.createDataFrame(frames, "video string, frame long"), spark.createDataFrame(clips, "video string, start long, end long")
    got = labels.step(asked, held)
    assert set(one(got)) == _step_by_hand(frames, clips)
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_regular_steps_are_those_over_their_clips(spark):
    from framesift import registry

    frames = [(v, x) for v, most in (("a", 47), ("b", 12), ("c", -3)) for x in range(-15, most + 1)] + [("d", 3)]
    asked = spark.createDataFrame(frames, "video string, frame long")
    last = {v: max(x for w, x in frames if w == v) for v in "abcd"}
    for every, length in ((10, 4), (5, 0), (7, 6)):
        clips = [(v, i * every, i * every + length) for v in last for i in range(last[v] // every + 1)]
        assert set(one(labels.regular_step(asked, every, length))) == _step_by_hand(frames, clips)
    plan = registry.functions()["interval_step"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "explode" not in plan  # the number of clips is not that of rows
