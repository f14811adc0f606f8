"""The stream of change scores against a full run: in order, late, repeated, null, and with earlier files gone."""

from pathlib import Path

import numpy as np
import pytest

from framesift.operators.temporal import change_scores
from framesift.streaming import scores


class Feed:
    """Frames of videos that are written file by file."""

    def __init__(self, spark, tmp_path):
        self.spark, self.rng, self.rows = spark, np.random.default_rng(3), {}
        self.folder, self.out, self.check = (str(tmp_path / d) for d in ("in", "out", "check"))

    def add(self, video, indices, again=False):
        rows = []
        for i in indices:
            if not again or (video, i) not in self.rows:
                self.rows[video, i] = [float(np.float32(v)) for v in self.rng.normal(size=4)]
            rows.append((i, video, i, self.rows[video, i]))
        self.spark.createDataFrame(rows, scores.FRAMES).coalesce(1).write.mode("append").parquet(self.folder)

    def run(self, **k):
        scores.watch(self.spark, self.folder, self.out, self.check, 5, **k).awaitTermination()
        return {(r.video, r.position): r.score for r in scores.current(self.spark, self.out).collect()}

    def full(self):
        df = self.spark.createDataFrame([(v, i, x) for (v, i), x in self.rows.items()], "video string, sample_idx long, embedding array<float>")
        return {(r.video, r.position): r.score for r in change_scores(df, 5).collect()}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def same(got, want):
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_batch_needs_no_earlier_file(feed):
    feed.add("001", range(0, 40))
    same(feed.run(), feed.full())
    for p in Path(feed.folder).glob("part-*"):
        p.unlink()
    feed.add("001", range(40, 60))
    feed.add("b/2", range(0, 3))  # too short for a score
    same(feed.run(), feed.full())
    feed.add("b/2", range(3, 12))
    same(feed.run(files=1), feed.full())


def test_late_and_repeated_frames(feed):
    feed.add("a", [i for i in range(60) if i not in (3, 50, 55)])
    feed.add("b", range(20))
    feed.run()
    feed.add("a", [55])  # within the kept frames
    same(feed.run(slack=8), feed.full())
    feed.add("a", [3, 58], again=True)  # 3 isn't kept any more, 58 is there already
    feed.add("b", range(15, 25), again=True)
    same(feed.run(slack=8), feed.full())
    feed.add("a", range(60, 70))
    feed.add("a", [50])
    same(feed.run(slack=8, files=1), feed.full())


def test_rows_without_a_value_are_left_out(feed, spark):
    feed.add("a", range(12))
    spark.createDataFrame([(1, None, 1, [1.0] * 4), (2, "a", None, [1.0] * 4), (3, "a", 90, None)], scores.FRAMES).write.mode("append").parquet(feed.folder)
    same(feed.run(), feed.full())


def test_ranges_of_indices():
    held = scores.ranges_of(np.array([5, 1, 2, 9]), np.zeros((0, 2), np.int64))
    assert held.tolist() == [[1, 2], [5, 5], [9, 9]]
    held = scores.ranges_of(np.array([3, 4]), held)
    assert held.tolist() == [[1, 5], [9, 9]]
    assert scores.unseen(np.array([0, 1, 5, 6, 9, 10]), held).tolist() == [True, False, False, True, False, True]
