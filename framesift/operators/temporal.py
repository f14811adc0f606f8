"""Operators along a video: change scores, peaks, clips, diverse clips, fills."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators.quantiles import with_quantiles


def scores_along(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with both windows, and the score of each, of vectors in their order."""
    n = len(x)
    if n < 2 * window:
        return np.zeros(0, np.int64), np.zeros(0)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    total = np.vstack([np.zeros(x.shape[1]), np.cumsum(x / np.where(size == 0, 1, size), axis=0)])
    at = np.arange(window, n - window + 1)
    before, after = (total[at] - total[at - window]) / window, (total[at + window] - total[at]) / window
    before, after = (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8) for m in (before, after))
    return at, 1 - (before * after).sum(1)


def change_scores(frames: DataFrame, window: int) -> DataFrame:
    """video, position, score: 1 - cosine of the mean unit vectors of `window` frames before and from a position on.

    Only positions with both windows; shorter videos give no rows. Means are scaled by their length plus 1e-8.
    A video's frames are one group; a group is as long as a video, never the table."""

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sample_idx")
        at, found = scores_along(np.stack(frame["embedding"].to_numpy()).astype(np.float64), window)
        return pd.DataFrame({"video": frame["video"].iloc[0], "position": at, "score": found})

    return frames.select("video", "sample_idx", "embedding").groupBy("video").applyInPandas(score, "video string, position long, score double")


def score_stats(scores: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """n, min, max, mean, median, population std and percentiles (linear between ranks) of the scores."""
    marks = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995}
    r = lambda c: F.round(c, digits)
    plain = scores.groupBy(*(by or [])).agg(F.count("score").alias("n"), r(F.min("score")).alias("min"), r(F.max("score")).alias("max"), r(F.avg("score")).alias("mean"), r(F.stddev_pop("score")).alias("std"))
    return with_quantiles(plain, scores, "score", marks, by or []).withColumns({k: r(F.col(k)) for k in marks})


def histogram(scores: DataFrame, bins: int) -> DataFrame:
    """bin, n: equal bins from least to largest score; the last one is closed; one bin if all are equal."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return scores.join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


#: Positions of a video that one task looks at when peaks are chosen.
STRETCH = 1_000_000
OPEN, KEPT, GONE = 0, 1, 2


def settled(position: np.ndarray, score: np.ndarray, state: np.ndarray, gap: int, own: np.ndarray) -> np.ndarray:
    """What is known of each position (sorted): kept, gone or open. Those that aren't `own` keep what they are.

    By falling score, then by position: nearer than `gap` to a kept one a position is gone; nearer to an open one before it, it stays open."""
    lo, hi = np.searchsorted(position, position - gap, "right"), np.searchsorted(position, position + gap, "left")
    out, near_kept, near_open = state.copy(), np.zeros(len(state), bool), np.zeros(len(state), bool)
    for i in np.flatnonzero(state == KEPT):
        near_kept[lo[i] : hi[i]] = True
    for i in np.lexsort((position, -score)).tolist():
        if own[i] and out[i] == OPEN:
            if near_kept[i]:
                out[i] = GONE
            elif not near_open[i]:
                out[i] = KEPT
                near_kept[lo[i] : hi[i]] = True
        if out[i] == OPEN:
            near_open[lo[i] : hi[i]] = True
    return out


def peaks(scores: DataFrame, gap: int, stretch: int | None = None) -> DataFrame:
    """Greedy choice in each video: by falling score, a position stays if none kept is nearer than `gap`; ties by position. One score for each position.

    A video is cut into stretches that tasks look at with `gap` positions on both sides. What can't be told without knowing what a
    neighbour decides waits for the next round; a round settles whole stretches but for such chains, so there are as many rounds as
    stretches that one chain of falling scores runs through, and one where videos are shorter than a stretch."""
    size = max(STRETCH if stretch is None else stretch, 2 * gap)
    kind = "video string, position long, score double, state int"
    ends = scores.agg(F.min("position").alias("lo"), F.max("position").alias("hi")).first()
    rows = scores.select(F.col("video").cast("string").alias("video"), F.col("position").cast("long").alias("position"), "score", F.lit(OPEN).alias("state"))
    at = F.floor(F.col("position") / size)

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        own = (frame["stretch"] == frame["position"] // size).to_numpy()
        state = settled(frame["position"].to_numpy(), frame["score"].to_numpy(), frame["state"].to_numpy(), gap, own)
        return frame.assign(state=state)[own][["video", "position", "score", "state"]]

    def round_(rows: DataFrame) -> DataFrame:
        around = F.array_distinct(F.array(at, F.floor((F.col("position") - gap) / size), F.floor((F.col("position") + gap) / size)))
        return rows.withColumn("stretch", F.explode(around)).groupBy("video", "stretch").applyInPandas(look, kind)

    done = round_(rows)
    if ends.lo is not None and ends.lo // size != ends.hi // size:
        done, held = done.persist(), None
        while done.where(F.col("state") == OPEN).limit(1).count():
            held, done = done, round_(done).persist()
            done.count()
            held.unpersist()
    return done.where(F.col("state") == KEPT).select("video", "position", "score")


def mean_vector(rows: DataFrame, by: list[str], name: str = "mean") -> DataFrame:
    """The mean of the embeddings of each group, as a partial aggregate of whole vectors. Null embeddings don't count; a group's vectors have one length."""
    held = rows.where(F.col("embedding").isNotNull()).select(*by, array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return held.groupBy(*by).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias(name))


def vector_stats(rows: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each dimension, as arrays."""
    held = rows.where(F.col("embedding").isNotNull()).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    both = held.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("v"), F.col("s.count").alias("n"))
    # Summarizer's variance is that of a sample.
    return both.select("mean", F.transform("v", lambda x: F.sqrt(x * (F.col("n") - 1) / F.col("n"))).alias("std"))


def clips(frames: DataFrame, length: int) -> DataFrame:
    """video, clip, start, end, mean: runs of `length` frames, the last one shorter."""
    cut = frames.withColumn("clip", F.floor(F.col("sample_idx") / length))
    ends = cut.groupBy("video", "clip").agg(F.min("sample_idx").alias("start"), F.max("sample_idx").alias("end"))
    return ends.join(mean_vector(cut, ["video", "clip"]), ["video", "clip"])


def diverse(clips: DataFrame, share: float, length: int) -> DataFrame:
    """video, start, end, score: clips chosen to differ. The first is the one farthest from the video's mean; each next one has the
    largest least distance to those chosen. One more is taken if the share of frames isn't covered, and one more if the last is short."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("clip").reset_index(drop=True)
        x = np.stack(frame["mean"].to_numpy()).astype(np.float64)
        size = (frame["end"] - frame["start"] + 1).to_numpy()
        away = np.linalg.norm(x - x.mean(0), axis=1)
        n = max(1, int(len(x) * share))
        n += int(size[:n].sum() < size.sum() * share and n < len(x))
        chosen = [int(away.argmax())]
        near = np.linalg.norm(x - x[chosen[0]], axis=1)

        def add() -> None:
            nonlocal near
            rest = near.copy()
            rest[chosen] = -1
            chosen.append(int(rest.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))

        while len(chosen) < n:
            add()
        if size[max(chosen)] < length / 2 and len(chosen) < len(x):
            add()
        out = frame.iloc[sorted(chosen)][["video", "start", "end"]].copy()
        out["score"] = away[sorted(chosen)]
        return out

    return clips.select("video", "clip", "start", "end", "mean").groupBy("video").applyInPandas(choose, "video string, start long, end long, score double")


def clip_starts(frames: DataFrame, length: int, stride: int) -> DataFrame:
    """video, start: every stride-th start of clips of `length` frames, `stride` apart, that fit into the video."""
    need = (length - 1) * stride + 1
    n = frames.groupBy("video").agg(F.count("*").alias("n")).where(F.col("n") >= need)
    return n.select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - need, F.lit(stride).cast("long"))).alias("start"))


def clip_frames(starts: DataFrame, frames: DataFrame, length: int, stride: int) -> DataFrame:
    """video, start, nth, sample_idx: the frames of each clip; beyond the end the last frame of the clip's steps repeats."""
    n = frames.groupBy("video").agg(F.count("*").alias("n"))
    step = F.explode(F.sequence(F.lit(0), F.lit(length - 1)))
    each = starts.join(n, "video").select("video", "start", "n", step.alias("nth"))
    last = F.floor((F.col("n") - 1 - F.col("start")) / stride)
    return each.select("video", "start", "nth", (F.col("start") + F.least(F.col("nth"), last) * stride).alias("sample_idx"))


def nearest_fill(rows: DataFrame, value: str, by: str = "video", at: str = "sample_idx") -> DataFrame:
    """Null values take that of the nearest row with one; the earlier among two as near; all stay null if there is none.

    The next value is the last one in the other order: a frame of Spark's that reaches to the end is computed anew for each row."""
    back = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    held = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    a, b = F.last(held, ignorenulls=True).over(back), F.last(held, ignorenulls=True).over(ahead)
    near = F.when(a.isNull(), b).when(b.isNull(), a).when(F.col(at) - a["at"] <= b["at"] - F.col(at), a).otherwise(b)
    return rows.withColumn(value, near["v"])


def toggles_to_ranges(events: DataFrame, by: list[str], at: str) -> DataFrame:
    """Odd events open a range, the next one closes it; a range without a closing one is open (null end)."""
    order = Window.partitionBy(*by).orderBy(at)
    nth = events.withColumns({"nth": F.row_number().over(order), "end": F.lead(at).over(order)})
    return nth.where("nth % 2 = 1").select(*by, F.col(at).alias("start"), "end")


def islands(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """start, end of the runs of neighbouring values of `at` in each group."""
    order = Window.partitionBy(*by).orderBy(at)
    return rows.select(*by, at).distinct().withColumn("run", F.col(at) - F.row_number().over(order)).groupBy(*by, "run").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("run")


def merged_clips(clips: DataFrame, by: str = "video") -> DataFrame:
    """Clips that touch or overlap as one."""
    order = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= reach + 1, 0).otherwise(1)
    return clips.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def outlier_of_pair(changes: DataFrame, before: Column, after: Column) -> Column:
    """Which frame of a pair is farther out: the one after unless the one before has the larger norm."""
    return F.when(before > after, F.lit("before")).otherwise(F.lit("after"))
