"""Labels per frame: merging sources, counts, pivots, spans, lookups, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions import boxes as box


def merged(instruments: DataFrame, phases: DataFrame) -> DataFrame:
    """Full outer merge on (video, frame): labels (sorted, distinct) and phase_id, -1 without one; no labels: an empty array."""
    left = instruments.groupBy("video", "frame").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.count("*").alias("n_boxes"))
    both = left.join(phases, ["video", "frame"], "full")
    return both.select("video", "frame", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), F.coalesce(F.col("phase_id"), F.lit(-1)).alias("phase_id"))


def has_both(records: DataFrame) -> DataFrame:
    return records.where((F.col("n_boxes") > 0) & (F.col("phase_id") >= 0))


def per_label(boxes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """label, n_boxes, n_frames, pct_frames of every label of the vocabulary; labels outside it count as Others, its last one. No vocabulary: no rows."""
    known = [r.label for r in vocabulary.orderBy("nth").collect()]
    named = boxes.withColumn("label", F.when(F.col("label").isin(known), F.col("label")).otherwise(F.lit(known[-1] if known else None)))
    frames = boxes.select("video", "frame").distinct().agg(F.count("*").alias("all"))
    seen = named.groupBy("label").agg(F.count("*").alias("b"), F.count_distinct("video", "frame").alias("f"))
    rows = vocabulary.join(seen, "label", "left").join(F.broadcast(frames))
    return rows.select("label", F.coalesce("b", F.lit(0)).alias("n_boxes"), F.coalesce("f", F.lit(0)).alias("n_frames"), F.round(F.coalesce("f", F.lit(0)) * 100 / F.greatest("all", F.lit(1)), 4).alias("pct_frames"))


def cooccurrence(boxes: DataFrame) -> DataFrame:
    """a, b, n: in how many frames both labels occur, a < b. Pairs come from the frame's distinct labels, so from a vocabulary."""
    held = boxes.groupBy("video", "frame").agg(F.array_sort(F.collect_set("label")).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return held.where(F.size("l") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def hidden(boxes: DataFrame, ranges: DataFrame, closed: bool = True) -> DataFrame:
    """boxes with oof: whether the object is out of frame. ranges: video, oid, start, end (null: open)."""
    own = ranges.groupBy("video", "oid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return boxes.join(own, ["video", "oid"], "left").withColumn("oof", F.coalesce(box.in_ranges(F.col("ranges"), F.col("frame"), closed), F.lit(False))).drop("ranges")


def last_box(boxes: DataFrame, asked: DataFrame) -> DataFrame:
    """As-of lookup: for each (video, oid, frame) asked the last box at or before it, null if none. Both sides meet in one sorted pass."""
    b = boxes.select("video", "oid", "frame", F.struct("frame", "x1", "y1", "x2", "y2").alias("box"), F.lit(0).alias("ask"))
    a = asked.select("video", "oid", "frame", F.lit(None).cast(b.schema["box"].dataType).alias("box"), F.lit(1).alias("ask"))
    order = Window.partitionBy("video", "oid").orderBy("frame", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return b.unionByName(a).withColumn("box", F.last("box", ignorenulls=True).over(order)).where("ask = 1").select("video", "oid", "frame", F.col("box.frame").alias("box_frame"), "box.x1", "box.y1", "box.x2", "box.y2")


def nearest_allowed(asked: DataFrame, allowed: DataFrame) -> DataFrame:
    """video, frame, nearest: the nearest allowed frame of the video; the later one of two as near; null without any."""
    both = allowed.select("video", "frame", F.col("frame").alias("a"), F.lit(0).alias("ask")).unionByName(asked.select("video", "frame", F.lit(None).cast("long").alias("a"), F.lit(1).alias("ask")))
    before = Window.partitionBy("video").orderBy("frame", "ask").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("video").orderBy("frame", F.desc("ask")).rowsBetween(0, Window.unboundedFollowing)
    seen = both.withColumns({"p": F.last("a", True).over(before), "n": F.first("a", True).over(after)}).where("ask = 1")
    near = F.when(F.col("p").isNull(), F.col("n")).when(F.col("n").isNull(), F.col("p")).when(F.col("n") - F.col("frame") <= F.col("frame") - F.col("p"), F.col("n")).otherwise(F.col("p"))
    return seen.select("video", "frame", near.alias("nearest"))


def step(asked: DataFrame, clips: DataFrame) -> DataFrame:
    """next_frame, prev_frame: one on or back inside a clip, else the start of the next clip and the end of the previous one; null beyond.
    Videos without clips give no rows.

    clips: video, start, end; a video can have any number, as no list of them is held: frames, starts and ends are sorted together."""
    marks = ("frame", "start", "end", "until")
    mark = lambda rows, at, **has: rows.select("video", F.col(at).cast("long").alias("at"), *(F.col(has[m]).cast("long").alias(m) if m in has else F.lit(None).cast("long").alias(m) for m in marks))
    every = mark(asked, "frame", frame="frame").unionByName(mark(clips.where("start is not null"), "start", start="start", until="end")).unionByName(mark(clips.where("end is not null"), "end", end="end"))
    own = Window.partitionBy("video")
    upto = lambda n: own.orderBy("at").rangeBetween(Window.unboundedPreceding, n)
    # What lies ahead is what lies behind in the other order: a frame of Spark's that reaches to the end is computed anew for each row.
    ahead = own.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    seen = every.where("video is not null").withColumns({
        "up": F.max("until").over(upto(1)), "down": F.max("until").over(upto(-1)), "earlier": F.max("end").over(upto(-1)),
        "later": F.min("start").over(ahead), "any": F.max(F.coalesce("start", "end")).over(own),
    }).where("frame is not null and any is not null")
    up, down = F.col("frame") + 1, F.col("frame") - 1
    return seen.select("video", "frame", F.when(F.col("up") >= up, up).otherwise(F.col("later")).alias("next_frame"), F.when(F.col("down") >= down, down).otherwise(F.col("earlier")).alias("prev_frame"))


def regular_step(asked: DataFrame, every: int, length: int) -> DataFrame:
    """As step, for clips that begin at 0 and every so many frames up to the video's last asked one and end `length` after their start.

    Where a clip lies is arithmetic, so none is made: their number grows with the videos' lengths and not with the rows. Needs 0 <= length < every."""
    x = F.col("frame")
    last = F.floor(F.max("frame").over(Window.partitionBy("video")) / every)
    inside = lambda f: (f >= 0) & (F.floor(f / every) <= F.col("last")) & (f % every <= length)
    after = F.greatest(F.floor(x / every) + 1, F.lit(0))
    before = F.least(F.ceil((x - length) / every) - 1, F.col("last"))
    later, earlier = F.when(after <= F.col("last"), after * every), F.when(before >= 0, before * every + length)
    seen = asked.where("video is not null and frame is not null").withColumn("last", last).where("last >= 0")
    return seen.select("video", "frame", F.when(inside(x + 1), x + 1).otherwise(later).alias("next_frame"), F.when(inside(x - 1), x - 1).otherwise(earlier).alias("prev_frame"))


def overlaps(boxes: DataFrame) -> DataFrame:
    """video, frame, oid, max_iou: largest overlap with another box of the frame; 0 for a lone one. A frame's boxes are few."""
    cols = ["x1", "y1", "x2", "y2"]
    other = boxes.select("video", "frame", F.col("oid").alias("o"), *(F.col(c).alias(f"o_{c}") for c in cols))
    pairs = boxes.join(other, ["video", "frame"]).where(F.col("oid") != F.col("o"))
    best = pairs.groupBy("video", "frame", "oid").agg(F.max(box.iou([F.col(c) for c in cols], [F.col(f"o_{c}") for c in cols])).alias("max_iou"))
    return boxes.select("video", "frame", "oid").join(best, ["video", "frame", "oid"], "left").withColumn("max_iou", F.coalesce("max_iou", F.lit(0.0)))


def export_status(boxes: DataFrame, splits: DataFrame, sizes: DataFrame, n_classes: Column) -> DataFrame:
    """boxes with split and status: ok, or why one is left out: video without split, class unknown, box without area inside the image."""
    held = boxes.join(splits, "video", "left").join(sizes, "video", "left")
    cx, cy, w, h = box.normalised(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("width"), F.col("height"))
    flat = (w <= 0) | (h <= 0)
    status = F.when(F.col("split").isNull(), "no_split").when(F.col("class_id").isNull() | (F.col("class_id") >= n_classes), "bad_class").when(F.coalesce(flat, F.lit(True)), "degenerate").otherwise("ok")
    return held.withColumns({"status": status, "cx": cx, "cy": cy, "w": w, "h": h})


def detection_frames(boxes: DataFrame, splits: DataFrame, sizes: DataFrame, on_disk: DataFrame) -> DataFrame:
    """video, frame, split, status, stem, lines: a row for each frame with boxes.

    status: no_split (the video is in none), no_frames (none on disk), out_of_range (a frame beyond those on disk), empty (no box has
    area inside the image), else ok. lines: class_id, cx, cy, w, h of the boxes with area, in the order of oid. boxes: video, frame, oid,
    class_id, x1 to y2; splits: video, split; sizes: video, width, height; on_disk: video, n. Videos are unique in the last three."""
    cx, cy, w, h = box.normalised(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("width"), F.col("height"))
    kept = boxes.join(sizes, "video", "left").withColumns({"cx": cx, "cy": cy, "w": w, "h": h})
    line = F.when((F.col("w") > 0) & (F.col("h") > 0), F.struct("oid", "class_id", "cx", "cy", "w", "h"))
    rows = kept.groupBy("video", "frame").agg(F.array_sort(F.collect_list(line)).alias("lines")).join(splits.select("video", "split"), "video", "left").join(on_disk.select("video", "n"), "video", "left")
    here = F.coalesce("n", F.lit(0))
    status = F.when(F.col("split").isNull(), "no_split").when(here == 0, "no_frames").when(F.col("frame") >= here, "out_of_range").when(F.size("lines") == 0, "empty").otherwise("ok")
    return rows.select("video", "frame", "split", status.alias("status"), F.format_string("%s__%06d", F.col("video").cast("string"), F.col("frame")).alias("stem"), F.transform("lines", lambda x: x.dropFields("oid")).alias("lines"))


def annotation_sizes(boxes: DataFrame, standard: list[tuple[int, int]]) -> DataFrame:
    """video, width, height: the first standard size, in order, that holds all boxes; else what they need."""
    most = boxes.groupBy("video").agg(F.max("x2").alias("x"), F.max("y2").alias("y"))
    width, height = F.col("x"), F.col("y")
    for w, h in reversed(standard):
        fits = (F.col("x") <= w) & (F.col("y") <= h)
        width, height = F.when(fits, w).otherwise(width), F.when(fits, h).otherwise(height)
    return most.select("video", width.alias("width"), height.alias("height"))


def interval_frames(intervals: DataFrame, n_frames: DataFrame, codes: DataFrame) -> DataFrame:
    """video, frame, phase_id: frames from the start on to the end second, both included, cut to the video; a later interval
    overwrites an earlier one, unknown codes are skipped. Seconds must be whole; intervals are exploded, not range-joined."""
    known = intervals.join(F.broadcast(codes), "code").join(n_frames, "video")
    lo, hi = F.greatest(F.col("start_s"), F.lit(0)), F.least(F.col("n") - 1, F.col("end_s"))
    each = known.where(lo <= hi).select("video", "pos", "phase_id", F.explode(F.sequence(lo, hi)).alias("frame"))
    return each.groupBy("video", "frame").agg(F.max_by("phase_id", "pos").alias("phase_id"))
