"""Change scores kept up to date by a stream of frame files. Each batch reads its own files; what it needs of earlier ones is state.

The state of a video is the last frames (two windows and `slack` more) and the ranges of all indices seen, so that a position
is known without looking back. Frames that come so late that the kept ones don't reach far enough make their video be scored
anew from the folder; the state stays right by the ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framesift.operators.temporal import change_scores, scores_along

FRAMES = "vec_id long, video string, sample_idx long, embedding array<float>"
_SCORED = "video string, position long, score double, late boolean"
#: seen: ranges of indices (first, last); at, tail: indices and vectors of the last frames.
_STATE = "seen binary, at binary, tail binary"
_USABLE = "video is not null and sample_idx is not null and embedding is not null"


def ranges_of(indices: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """The ranges (first, last; sorted, apart) with further indices in them."""
    if not len(indices):
        return ranges
    both = np.vstack([ranges, np.stack([indices, indices], axis=1)])
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    first = np.flatnonzero(np.r_[True, both[1:, 0] > reach[:-1] + 1])
    return np.stack([both[first, 0], np.r_[reach[first[1:] - 1], reach[-1]]], axis=1)


def unseen(indices: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Whether each index lies in none of the ranges."""
    if not len(ranges):
        return np.ones(len(indices), bool)
    at = np.searchsorted(ranges[:, 0], indices, "right") - 1
    return (at < 0) | (indices > ranges[np.maximum(at, 0), 1])


def follow(window: int, slack: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """One step of a video: the positions whose windows hold a new frame, with their scores; or one late row without."""
    keep = 2 * window - 1 + slack

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames)).sort_values("sample_idx", kind="stable").drop_duplicates("sample_idx")
        seen, at, tail = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), None
        if state.exists:
            held = state.get
            seen, at = np.frombuffer(held[0], np.int64).reshape(-1, 2), np.frombuffer(held[1], np.int64)
            tail = np.frombuffer(held[2], np.float32).reshape(len(at), -1)
        new = new[unseen(new["sample_idx"].to_numpy(), seen)]
        if new.empty:
            return
        came = new["sample_idx"].to_numpy()
        before = int((seen[:, 1] - seen[:, 0] + 1).sum()) - len(at)  # frames ahead of the kept ones
        seen = ranges_of(came, seen)
        x = np.stack(new["embedding"].to_numpy()).astype(np.float32)
        # A frame ahead of the kept ones isn't needed again: the first score that it changes is to be had from the folder only.
        ahead = (came < at[0]) if before else np.zeros(len(came), bool)
        before += int(ahead.sum())
        index, x = np.r_[at, came[~ahead]], x[~ahead] if tail is None else np.vstack([tail, x[~ahead]])
        order = np.argsort(index)
        index, x, fresh = index[order], x[order], np.r_[np.zeros(len(at), bool), np.ones((~ahead).sum(), bool)][order]
        first = int(np.argmax(fresh)) if fresh.any() else len(index)
        late = bool(ahead.any()) or (before > 0 and first < 2 * window - 1)
        state.update((seen.tobytes(), index[-keep:].tobytes(), np.ascontiguousarray(x[-keep:]).tobytes()))
        if late:
            yield pd.DataFrame({"video": [key[0]], "position": [None], "score": [None], "late": [True]})
            return
        start = max(0, first - 2 * window + 1)
        place, score = scores_along(x[start:].astype(np.float64), window)
        yield pd.DataFrame({"video": key[0], "position": place + before + start, "score": score, "late": False})

    return step


def refresh(frames: DataFrame, touched: DataFrame, window: int) -> DataFrame:
    """video, position, score of the touched videos (and only those) from all their frames."""
    dirty = frames.where(_USABLE).join(touched.select("video").distinct(), "video", "left_semi").dropDuplicates(["video", "sample_idx"])
    return change_scores(dirty, window)


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, window: int, slack: int | None = None, files: int | None = None) -> StreamingQuery:
    """Start the stream on Parquet files of frames that land in a folder; it takes what is there and ends. Call it again for more.

    `out` gets the scores that a batch changes, by video and batch; read them with `current`. slack: by how many frames files may be late
    without a look at the folder (default: window). files: most files of a batch. Frames without video, index or embedding are left out;
    of frames with one index the first counts. The checkpoint must be in a shared folder. A batch that is repeated after a
    failure starts from the same state and writes the same partitions again."""

    def batch(scored: DataFrame, number: int) -> None:
        held = scored.persist()
        late = held.where("late").select("video").distinct()
        rows = held.where("not late").select("video", "position", "score")
        if late.limit(1).count():
            rows = rows.unionByName(refresh(scored.sparkSession.read.schema(FRAMES).parquet(folder), late, window))
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video", "batch").parquet(out)
        held.unpersist()

    reader = spark.readStream.schema(FRAMES)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder).where(_USABLE).select("video", "sample_idx", "embedding")
    scored = stream.groupBy("video").applyInPandasWithState(follow(window, window if slack is None else slack), _SCORED, _STATE, "append", GroupStateTimeout.NoTimeout)
    return scored.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """video, position, score: of each position what the last batch says."""
    rows = spark.read.schema("position long, score double, video string, batch long").parquet(out)
    return rows.groupBy("video", "position").agg(F.max_by("score", "batch").alias("score"))
