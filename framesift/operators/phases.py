"""Statistics of phases per frame. frames: video, frame, phase_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(frames: DataFrame) -> DataFrame:
    """phase_id, n, pct of all frames."""
    n = frames.groupBy("phase_id").agg(F.count("*").alias("n"))
    return n.select("phase_id", "n", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 4).alias("pct"))


def transitions(frames: DataFrame) -> DataFrame:
    """video, n_transitions, n_phases: changes between frames that follow each other in the table."""
    order = Window.partitionBy("video").orderBy("frame")
    moved = frames.withColumn("was", F.lag("phase_id").over(order))
    return moved.groupBy("video").agg(F.count_if(F.col("was") != F.col("phase_id")).alias("n_transitions"), F.count_distinct("phase_id").alias("n_phases"))


def pivot(frames: DataFrame, ids: list[int]) -> DataFrame:
    """video, phase_<id>...: frames of each phase."""
    held = frames.groupBy("video").pivot("phase_id", ids).agg(F.count("frame")).na.fill(0)
    return held.select("video", *(F.col(str(i)).alias(f"phase_{i}") for i in ids))


def coverage(frames: DataFrame) -> DataFrame:
    """video, n_labelled, coverage: labelled frames over the span from first to last."""
    span = F.max("frame") - F.min("frame") + 1
    return frames.groupBy("video").agg(F.count("*").alias("n_labelled"), F.round(F.count("*") / span, 6).alias("coverage"))


def markov(frames: DataFrame) -> DataFrame:
    """from_phase, to_phase, n, share: steps to the next labelled frame, shares by row."""
    order = Window.partitionBy("video").orderBy("frame")
    step = frames.withColumn("to_phase", F.lead("phase_id").over(order)).where("to_phase is not null")
    n = step.groupBy(F.col("phase_id").alias("from_phase"), "to_phase").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_phase")), 6))


def markov_features(frames: DataFrame, videos: DataFrame, phases: list[str], labels: list[str]) -> DataFrame:
    """video, phase_share, phase_steps, label_share, label_steps: one row of features for each video of `videos`.

    phase_share: share of each phase; phase_steps: for each phase the shares of the phases that follow it, row by row (zeros where none
    does); label_share: mean of each label (on above 0.5, null is off); label_steps: for each label the shares of steps off-off, off-on, on-off,
    on-on. frames: video, frame (each once in a video), phase_id and the labels. A null phase is "UNK"; phases that aren't listed count in no
    share. A video without frames has zeros. A video's frames are counted by pairs of phases first, so arrays hold counts, never frames."""
    order = Window.partitionBy("video").orderBy("frame")
    phase = F.coalesce(F.col("phase_id").cast("string"), F.lit("UNK"))
    on = {f"on_{i}": F.coalesce((F.col(c) > 0.5).cast("int"), F.lit(0)) for i, c in enumerate(labels)}
    rows = frames.select("video", "frame", phase.alias("p"), *(c.alias(n) for n, c in on.items()))
    rows = rows.withColumns({"q": F.lead("p").over(order)} | {f"to_{n}": F.lead(n).over(order) for n in on})
    states = [F.count_if((F.col(n) == a) & (F.col(f"to_{n}") == b)).alias(f"{n}_{a}{b}") for n in on for a in (0, 1) for b in (0, 1)]
    pairs = rows.groupBy("video", "p", "q").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in on), *states)
    sums = [n for n in pairs.columns if n.startswith("on_")]
    entry = F.struct(F.concat_ws("\n", "p", F.coalesce("q", F.lit(""))).alias("k"), F.col("n").alias("v"))
    by_video = pairs.groupBy("video").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(entry)).alias("m"), *(F.sum(c).alias(c) for c in sums))
    count = lambda p, q: F.coalesce(F.try_element_at("m", F.lit(f"{p}\n{q}")), F.lit(0))
    held = F.array(*(sum((count(p, q) for q in [*phases, ""]), F.lit(0)) for p in phases))
    follow = [F.array(*(count(p, q) for q in phases)) for p in phases]

    def shares(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
        return F.transform(a, lambda x: F.when(total > 0, x / total).otherwise(0.0))

    known = by_video.select(
        "video", shares(held).alias("phase_share"), F.flatten(F.array(*map(shares, follow))).alias("phase_steps"),
        F.array(*(F.col(n) / F.col("n") for n in on)).cast("array<double>").alias("label_share"),
        F.flatten(F.array(*(shares(F.array(*(F.col(f"{n}_{s}") for s in ("00", "01", "10", "11")))) for n in on))).cast("array<double>").alias("label_steps"),
    )
    sizes = {"phase_share": len(phases), "phase_steps": len(phases) ** 2, "label_share": len(labels), "label_steps": 4 * len(labels)}
    none = {c: F.coalesce(c, F.array_repeat(F.lit(0.0), n)) for c, n in sizes.items()}
    return videos.select("video").distinct().join(known, "video", "left").withColumns(none)


def annotated_clips(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """clips with done: whether a frame of the video lies in the clip. Clips must not overlap: each frame looks up the last clip that begins before it."""
    c = clips.select("video", F.col("start").alias("at"), F.struct("start", "end").alias("clip"), F.lit(0).alias("frame"))
    f = frames.select("video", F.col("frame").alias("at"), F.lit(None).cast(c.schema["clip"].dataType).alias("clip"), F.lit(1).alias("frame"))
    order = Window.partitionBy("video").orderBy("at", "frame").rowsBetween(Window.unboundedPreceding, 0)
    met = c.unionByName(f).withColumn("clip", F.last("clip", True).over(order)).where((F.col("frame") == 1) & (F.col("at") <= F.col("clip.end")))
    hit = met.select("video", F.col("clip.start").alias("start")).distinct().withColumn("done", F.lit(True))
    return clips.join(hit, ["video", "start"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
