"""Splits of videos: quotas, stratified and random choice, balance measures, sampling weights.

Random choice is by the order of a seeded hash, so it is the same wherever it runs. Group sizes, quotas and cumulative
places are windows over groups of videos; a table of videos has one row for each video, never one for each frame.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions import vectors
from framesift.operators.quantiles import quantiles
from framesift.operators.sampling import seeded, uniform


def targets(n: Column, ratios: tuple[float, float, float]) -> list[Column]:
    """train, val, test counts of a group of n: all to train under 3; else one each, the rest by ratio rounded half to even, residue to train."""
    rest = n - 3
    extra = [F.bround(rest * F.lit(r)).cast("long") for r in ratios]
    diff = rest - extra[0] - extra[1] - extra[2]
    big = n >= 3
    return [F.when(big, 1 + extra[0] + diff).otherwise(n), F.when(big, 1 + extra[1]).otherwise(0), F.when(big, 1 + extra[2]).otherwise(0)]


def assign(videos: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    """videos (video, dataset, n_frames) with split: within a dataset by falling frame count, train first, then val, then test."""
    group = Window.partitionBy("dataset")
    place = F.row_number().over(group.orderBy(F.desc("n_frames"), "video"))
    counted = videos.withColumns({"n": F.count("*").over(group), "place": place})
    train, val, _ = targets(F.col("n"), ratios)
    split = F.when(F.col("place") <= train, "train").when(F.col("place") <= train + val, "val").otherwise("test")
    return counted.withColumn("split", split).drop("n", "place")


def summary(assigned: DataFrame) -> DataFrame:
    """dataset, split, n_videos, n_frames with totals: `all` in place of either."""
    rows = assigned.cube("dataset", "split").agg(F.count("*").alias("n_videos"), F.sum("n_frames").alias("n_frames"), F.grouping("dataset").alias("g"), F.grouping("split").alias("h"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("dataset").cast("string")).alias("dataset"), F.when(F.col("h") == 1, "all").otherwise(F.col("split")).alias("split"), "n_videos", "n_frames")


def random_choice(videos: DataFrame, share: float, seed: int) -> DataFrame:
    """videos with is_test: exactly round(n x share) of them, half to even."""
    n = videos.count()
    chosen = videos.select("video").orderBy(seeded("video", seed), "video").limit(int(round(n * share)))
    return videos.join(chosen.withColumn("is_test", F.lit(True)), "video", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def quotas(strata: DataFrame, share: float) -> DataFrame:
    """stratum, n, quota: floor of n x share, then one more to those with the largest remainder until the total is round(total x share)."""
    n = strata.groupBy("stratum").agg(F.count("*").alias("n"))
    exact = F.col("n") * F.lit(share)
    whole = Window.partitionBy()
    low = n.withColumns({"low": F.floor(exact), "rest": F.round(exact - F.floor(exact), 9)})
    missing = F.bround(F.sum("n").over(whole) * F.lit(share)).cast("long") - F.sum("low").over(whole)
    order = F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), "stratum"))
    return low.withColumns({"missing": missing, "order": order}).select("stratum", "n", (F.col("low") + F.when(F.col("order") <= F.col("missing"), 1).otherwise(0)).alias("quota"))


def stratified(strata: DataFrame, share: float, seed: int) -> DataFrame:
    """video, stratum, is_test: the quota of each stratum, first in the order of a seeded hash."""
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(seeded("video", seed), "video"))
    return strata.withColumn("place", place).join(quotas(strata, share).select("stratum", "quota"), "stratum").select("video", "stratum", (F.col("place") <= F.col("quota")).alias("is_test"))


def quantile_bins(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """rows with bin: how many inner quantile edges lie below the value (an edge belongs to the bin under it); one bin if at most two edges differ."""
    marks = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(rows, value, marks).select(F.array_sort(F.array_distinct(F.array(*marks))).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    at = F.when(F.coalesce(F.size("edges") <= 2, F.lit(True)), 0).otherwise(F.size(F.filter(inner, lambda e: F.col(value) > e)))
    return rows.join(F.broadcast(edges), F.lit(True), "left").withColumn("bin", at).drop("edges")


def balance(videos: DataFrame, columns: list[str], total: str) -> DataFrame:
    """label, train, test, diff: share of each label in either part of the split. videos: counts, total, is_test."""
    part = lambda c, t: F.sum(F.when(F.col("is_test") == t, F.col(c)).otherwise(0))
    sums = videos.agg(*(part(c, t).alias(f"{c}_{int(t)}") for c in [*columns, total] for t in (False, True)))
    share = lambda c, t: F.col(f"{c}_{t}") / F.greatest(F.col(f"{total}_{t}"), F.lit(1))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), share(c, 0).alias("train"), share(c, 1).alias("test")) for c in columns))).alias("r")).select("r.*")
    return rows.withColumn("diff", F.abs(F.col("train") - F.col("test")))


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger, in percent; 0 if both are 0."""
    top = F.greatest(a, b)
    return F.when(top > 0, F.abs(a - b) / top * 100).otherwise(0.0)


def sampling_weights(frames: DataFrame, scores: DataFrame, alpha: float) -> DataFrame:
    """frames with weight: the video's largest score (1e-8 at least) to the power alpha, over the sum of all."""
    top = scores.groupBy("video").agg(F.max("score").alias("top"))
    raw = F.pow(F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(1e-8)), F.lit(alpha))
    held = frames.join(top, "video", "left").withColumn("raw", raw).drop("top")
    total = held.agg(F.sum("raw").alias("total"))
    return held.join(F.broadcast(total)).withColumn("weight", F.col("raw") / F.col("total")).drop("raw", "total")


def weighted_choice(rows: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement with chances by weight: the least of -ln(u) / weight for hashed uniform u."""
    return rows.where(F.col(weight) > 0).orderBy(-F.ln(uniform(key, seed) + F.lit(2.0**-53)) / F.col(weight), key).limit(n)


def random_trials(videos: DataFrame, share: float, n: int) -> DataFrame:
    """videos with trial (0 to n - 1) and is_test: exactly round(videos x share) of each trial, half to even."""
    k = int(round(videos.count() * share))
    each = videos.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.row_number().over(Window.partitionBy("trial").orderBy(seeded(F.concat_ws("/", "trial", "video"), 7), "video"))
    return each.withColumn("is_test", place <= k)


def stratified_trials(strata: DataFrame, share: float, n: int) -> DataFrame:
    """strata (video, stratum, ...) with trial (0 to n - 1) and is_test: the quota of each stratum in each trial."""
    each = strata.join(quotas(strata, share).select("stratum", "quota"), "stratum").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.row_number().over(Window.partitionBy("trial", "stratum").orderBy(seeded(F.concat_ws("/", "trial", "video"), 7), "video"))
    return each.withColumn("is_test", place <= F.col("quota")).drop("quota")


def embedding_balances(chosen: DataFrame) -> DataFrame:
    """trial, score: 0.9 x cosine distance of the parts' mean unit vectors + 0.1 x gap of their mean lengths in standard deviations.

    chosen: trial, is_test, unit (array), length; a trial without either part has a null score."""
    parts = chosen.groupBy("trial", "is_test").agg(Summarizer.mean(array_to_vector("unit")).alias("m"), F.avg("length").alias("length"))
    spread = chosen.groupBy("trial").agg(F.greatest(F.stddev_pop("length"), F.lit(1e-6)).alias("std"))
    side = lambda c, t: F.max(F.when(F.col("is_test") == t, F.col(c)))
    wide = parts.withColumn("m", vector_to_array("m")).groupBy("trial").agg(*(side(c, t).alias(f"{c}_{int(t)}") for c in ("m", "length") for t in (False, True)))
    gap = vectors.distance(F.col("m_0"), F.col("m_1"))
    return wide.join(spread, "trial").select("trial", (0.9 * gap + 0.1 * F.abs(F.col("length_0") - F.col("length_1")) / F.col("std")).alias("score"))


def cluster_counts(frames: DataFrame) -> DataFrame:
    """video, cluster, n: frames of each cluster in each video."""
    return frames.groupBy("video", "cluster").agg(F.count("*").alias("n"))


def cluster_deviations(counts: DataFrame, chosen: DataFrame, target: float) -> DataFrame:
    """trial, score: the largest distance of a cluster's share of frames in the test part from the target; empty clusters deviate by 0.

    counts: video, cluster, n; chosen: trial, video, is_test."""
    each = counts.join(chosen.select("trial", "video", "is_test"), "video").groupBy("trial", "cluster").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_test"), F.col("n")).otherwise(0)).alias("t"))
    return each.groupBy("trial").agg(F.max(F.when(F.col("n") > 0, F.abs(F.col("t") / F.col("n") - F.lit(target))).otherwise(0.0)).alias("score"))


def best_splits(scores: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """rank (from 1), trial, score, video, is_test of the `most` trials of the least score, earlier trials first among equals."""
    top = scores.withColumn("score", F.round("score", 9)).orderBy("score", "trial").limit(most)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("score", "trial")))
    return chosen.select("trial", "video", "is_test").join(F.broadcast(ranked), "trial").select("rank", "trial", "score", "video", "is_test")


def fast_split(frames: DataFrame, clusters: DataFrame, share: float, n: int, most: int) -> DataFrame:
    """The best of n random splits by clusters, with the relative difference (percent) of the parts' mean lengths.

    frames: video; clusters: video, cluster of each frame. rank, trial, score, video, is_test, length_difference."""
    videos = frames.groupBy("video").agg(F.count("*").alias("length"))
    chosen = random_trials(videos, share, n)
    best = best_splits(cluster_deviations(cluster_counts(clusters), chosen, share), chosen, most)
    side = lambda t: F.avg(F.when(F.col("is_test") == t, F.col("length")))
    gaps = best.join(videos, "video").groupBy("rank").agg(relative_difference(side(True), side(False)).alias("length_difference"))
    return best.join(F.broadcast(gaps), "rank")


def compared_splits(representations: dict[str, DataFrame], stratum: Column, share: float, n: int) -> DataFrame:
    """representation, trial, score, base_score, n_train, n_test, length_difference: the best of the same n stratified splits by each representation.

    representations: frames (video, embedding) by name, of the same videos; lengths and strata (an expression on video) are the first one's,
    and base_score is what the first one says of the chosen split. Videos without an embedding take part in no score. The score is that of
    embedding_balances; the earlier trial wins among equals at nine decimals."""
    from framesift.operators.temporal import mean_vector

    first = next(iter(representations))
    videos = representations[first].groupBy("video").agg(F.count("*").alias("length")).withColumn("stratum", stratum)
    scores = None
    for name, frames in representations.items():
        unit = mean_vector(frames, ["video"]).select("video", vectors.scaled(F.col("mean")).alias("unit"))
        got = embedding_balances(stratified_trials(videos.join(unit, "video"), share, n)).select(F.lit(name).alias("representation"), "trial", F.round("score", 9).alias("score"))
        scores = got if scores is None else scores.union(got)
    best = scores.where("score is not null").groupBy("representation").agg(F.min(F.struct("score", "trial")).alias("b")).select("representation", "b.trial", "b.score")
    base = scores.where(F.col("representation") == first).select("trial", F.col("score").alias("base_score"))
    side = lambda t: F.avg(F.when(F.col("is_test") == t, F.col("length")))
    parts = stratified_trials(videos, share, n).join(F.broadcast(best), "trial").groupBy("representation", "trial", "score")
    parts = parts.agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"), relative_difference(side(True), side(False)).alias("length_difference"))
    return parts.join(base, "trial").select("representation", "trial", "score", "base_score", "n_train", "n_test", "length_difference")


def label_sets(tools: DataFrame) -> DataFrame:
    """video, missing, unexpected: labels by which a video's set differs from that of the first video; videos that agree are left out."""
    sets = tools.groupBy("video").agg(F.array_sort(F.collect_set("label")).alias("own"))
    first = sets.agg(F.min_by("own", "video").alias("want"))
    both = sets.join(F.broadcast(first)).select("video", F.array_except("want", "own").alias("missing"), F.array_except("own", "want").alias("unexpected"))
    return both.where((F.size("missing") > 0) | (F.size("unexpected") > 0))


def trials(videos: DataFrame, columns: list[str], share: float, n: int) -> DataFrame:
    """trial, score of random splits: the largest difference of a label's share in the test part from the whole. Every
    trial is a shuffled row set of its own; nothing is broadcast."""
    chosen = random_trials(videos.select("video", *columns), share, n)
    sums = chosen.groupBy("trial").agg(*(F.sum(c).alias(f"{c}_all") for c in columns), *(F.sum(F.when(F.col("is_test"), F.col(c)).otherwise(0)).alias(f"{c}_test") for c in columns))
    gaps = [F.when(F.col(f"{c}_all") > 0, F.abs(F.col(f"{c}_test") / F.col(f"{c}_all") - F.lit(share))).otherwise(0.0) for c in columns]
    return sums.select("trial", F.greatest(*gaps).alias("score"))


def part_sizes(n: int, ratios: tuple[float, float, float]) -> list[int]:
    """As `targets`, of one number."""
    if n < 3:
        return [n, 0, 0]
    extra = [round((n - 3) * r) for r in ratios]
    return [1 + n - 3 - extra[1] - extra[2], 1 + extra[1], 1 + extra[2]]


def filled(n: int, lack: list[float], room: list[int]) -> list[int]:
    """n units dealt out one by one to the part that lacks most (of equals the one with most room, then the first) and has room, at once.

    Each part is filled from its lack down to a common level; the few that are left below a whole unit go one by one."""
    lo, hi = min(lack) - n - 1, max(lack)
    down = lambda level: [max(0, min(r, int(x - level))) for x, r in zip(lack, room, strict=True)]
    for _ in range(80):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(down(level)) > n else (lo, level)
    out = down(hi)
    for _ in range(n - sum(out)):
        p = max((p for p in range(len(room)) if out[p] < room[p]), key=lambda p: (lack[p] - out[p], room[p] - out[p], -p))
        out[p] += 1
    return out


def label_set_parts(frame: pd.DataFrame, labels: list[str], ratios: tuple[float, float, float]) -> list[list[int]]:
    """How many videos of each label set (a row: presence of each label, and n) go to train, val and test.

    Again and again the label that fewest videos left have is taken, and its label sets, the largest first, are dealt out to the parts
    that still lack it most. Part sizes are exactly the targets."""
    has, n = frame[labels].to_numpy(bool), frame["n"].tolist()
    room = part_sizes(sum(n), ratios)
    share = [r / max(sum(n), 1) for r in room]
    lack = [[float(sum(c for c, h in zip(n, has[:, k], strict=True) if h)) * f for k in range(len(labels))] for f in share]
    out: list[list[int] | None] = [None] * len(n)

    def put(i: int, wanted: list[float]) -> None:
        out[i] = filled(n[i], wanted, room)
        for p, c in enumerate(out[i]):
            room[p] -= c
            for k in np.flatnonzero(has[i]):
                lack[p][k] -= c

    while True:
        left = [(sum(n[i] for i in range(len(n)) if out[i] is None and has[i, k]), k) for k in range(len(labels))]
        left = [x for x in left if x[0]]
        if not left:
            break
        k = min(left)[1]
        for i in sorted((i for i in range(len(n)) if out[i] is None and has[i, k]), key=lambda i: (-n[i], i)):
            put(i, [lack[p][k] for p in range(3)])
    for i in range(len(n)):
        if out[i] is None:
            put(i, [float(r) for r in room])
    return out


def assign_by_labels(videos: DataFrame, labels: list[str], ratios: tuple[float, float, float], seed: int = 7) -> DataFrame:
    """video, dataset, split: sizes as `assign` gives, but spreading labels (counts; present if over 0) over the parts.

    Videos of a dataset with the same labels can stand for each other, so what is decided for a dataset as a whole is only how many of
    each label set go where (`label_set_parts`): a group holds a row for each set of labels, not for each video. The videos of a set
    then take these places in the order of a seeded hash: by its first digits, whose counts are added up, so no window holds more than the
    videos of one set and one of 4,096 beginnings."""
    present = [(F.coalesce(F.col(c), F.lit(0)) > 0).cast("int").alias(c) for c in labels]
    each = videos.select("video", "dataset", F.concat_ws("", *(F.when(F.coalesce(F.col(c), F.lit(0)) > 0, "1").otherwise("0") for c in labels)).alias("labels_"), *present, seeded("video", seed).alias("hash_")).withColumn("first_", F.substring("hash_", 1, 3))
    keys = ["dataset", "labels_"]
    firsts = each.groupBy(*keys, "first_", *labels).agg(F.count("*").alias("n"))
    sets = firsts.groupBy(*keys, *labels).agg(F.sum("n").alias("n"))
    kind = videos.schema["dataset"].dataType.simpleString()

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("labels_").reset_index(drop=True)
        parts = label_set_parts(frame, labels, ratios)
        return frame[["dataset", "labels_"]].assign(train=[p[0] for p in parts], val=[p[1] for p in parts])

    decided = sets.groupBy("dataset").applyInPandas(decide, f"dataset {kind}, labels_ string, train long, val long")
    past = Window.partitionBy(*keys).orderBy("first_").rowsBetween(Window.unboundedPreceding, -1)
    before = firsts.select(*keys, "first_", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    same = lambda a, b, cols: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"{c}_of"]) for c in cols))
    named = lambda df, cols: df.select(*(F.col(c).alias(f"{c}_of") for c in cols), *(c for c in df.columns if c not in cols))
    before, decided = named(before, [*keys, "first_"]), named(decided, keys)
    placed = each.join(before, same(each, before, [*keys, "first_"]))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*keys, "first_").orderBy("hash_", "video"))
    placed = placed.select("video", *keys, place.alias("place"))
    out = placed.join(decided, same(placed, decided, keys))
    split = F.when(F.col("place") <= F.col("train"), "train").when(F.col("place") <= F.col("train") + F.col("val"), "val").otherwise("test")
    return out.select("video", "dataset", split.alias("split"))


def joined_records(frames: DataFrame, tools: DataFrame, phases: DataFrame) -> DataFrame:
    """video, frames and what the two label tables say of it; `missing` names the table without the video (null: complete)."""
    rows = frames.groupBy("video").agg(F.count("*").alias("n_frames"))
    t, p = tools.withColumn("has_tools", F.lit(True)), phases.withColumn("has_phases", F.lit(True))
    both = rows.join(t, "video", "left").join(p, "video", "left")
    return both.withColumn("missing", F.when(F.col("has_tools").isNull(), "tools").when(F.col("has_phases").isNull(), "phases")).drop("has_tools", "has_phases")


def by_position(annotations: DataFrame, frames: DataFrame) -> DataFrame:
    """annotations (video, sample_idx) with the path of the frame at that position, and status: ok, no_video or out_of_range."""
    videos = frames.select("video").distinct().withColumn("known", F.lit(True))
    rows = annotations.join(frames.select("video", "sample_idx", "path"), ["video", "sample_idx"], "left").join(videos, "video", "left")
    return rows.withColumn("status", F.when(F.col("path").isNotNull(), "ok").when(F.col("known"), "out_of_range").otherwise("no_video")).drop("known")
