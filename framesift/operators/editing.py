"""Edits of tracked objects as joins: new labels, moved boxes, deletions, trims, and the reach of selected clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators.temporal import merged_clips


def relabelled(boxes: DataFrame, edits: DataFrame) -> DataFrame:
    """boxes with the label of the last edit of their object. edits: video, oid, nth, label; unknown objects are ignored."""
    last = edits.groupBy("video", "oid").agg(F.max_by("label", "nth").alias("new"))
    return boxes.join(last, ["video", "oid"], "left").withColumn("label", F.coalesce("new", "label")).drop("new").select(boxes.columns)


def moved(boxes: DataFrame, edits: DataFrame) -> DataFrame:
    """boxes with the corners of the last edit of object and frame, as whole numbers; an edit makes no new box. edits: video, frame, oid, nth, box."""
    last = edits.groupBy("video", "frame", "oid").agg(F.max_by("box", "nth").alias("new"))
    corner = {c: F.coalesce(F.get("new", i).cast("int"), F.col(c)) for i, c in enumerate(("x1", "y1", "x2", "y2"))}
    return boxes.join(last, ["video", "frame", "oid"], "left").withColumns(corner).select(boxes.columns)


def deleted(boxes: DataFrame, gone: DataFrame) -> DataFrame:
    """boxes without those of objects (video, oid) that are gone; frames left without a box are gone with them."""
    return boxes.join(gone.select("video", "oid").distinct(), ["video", "oid"], "left_anti")


def trimmed(boxes: DataFrame, trims: DataFrame) -> DataFrame:
    """boxes before the first trim of their object. trims: video, oid, at."""
    first = trims.groupBy("video", "oid").agg(F.min("at").alias("at"))
    return boxes.join(first, ["video", "oid"], "left").where("at is null or frame < at").drop("at").select(boxes.columns)


def trimmed_ranges(ranges: DataFrame, trims: DataFrame) -> DataFrame:
    """video, oid, start, end: ranges that begin before the first trim, cut at it; open ones (null end) end there."""
    first = trims.groupBy("video", "oid").agg(F.min("at").alias("at"))
    end = F.when(F.col("at").isNull(), F.col("end")).otherwise(F.least(F.coalesce("end", "at"), "at"))
    return ranges.join(first, ["video", "oid"], "left").where("at is null or start < at").select("video", "oid", "start", end.alias("end"))


def extents(boxes: DataFrame) -> DataFrame:
    """video, first, last: frames of the earliest and latest box of any object."""
    return boxes.groupBy("video").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def capped_durations(starts: DataFrame, clips: DataFrame) -> DataFrame:
    """starts (video, start, duration, total) with `capped`: cut where selected clips that follow without a gap, or the video, end.

    A start outside all clips, or beyond the video, keeps its duration."""
    reach = merged_clips(clips.select("video", "start", "end")).select(F.col("video").alias("v"), F.col("start").alias("a"), F.col("end").alias("b"))
    inside = (F.col("video") == F.col("v")) & (F.col("start") >= F.col("a")) & (F.col("start") <= F.col("b"))
    most = F.greatest(F.lit(1), F.least("b", F.col("total") - 1) - F.col("start") + 1)
    capped = F.when(F.col("b").isNull() | (F.col("start") >= F.col("total")), F.col("duration")).otherwise(F.least("duration", most))
    return starts.join(reach, inside, "left").withColumn("capped", capped).select(*starts.columns, "capped")
