"""A log of edits of tracked objects, and the state of every video at any version of it.

An event has video, n (its number), kind, oid, frame, label, box, start, end; what a kind doesn't use is null:

    object  label of an object                  drop    an object goes, with its boxes and ranges; later events bring it back
    box     box of object and frame; null: none away    a range (end null: open) in which an object is out of frame
    here    all ranges of an object go          mark    a frame is to be reviewed; unmark takes that back
    blurry  a range of blurry frames            sharp   all blurry ranges go
    span    first and last frame of the video   at      the frame that was looked at

The last writer counts, by number; of equal numbers the greater value. So events may be written twice, come in any order and be read from any
number of files. Events without video, number or kind, and unknown kinds, change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "video string, n long, kind string, oid int, frame int, label string, box array<int>, start int, end int"
_OBJECTS, _BOXES, _RANGES = "map<string,struct<label:string>>", "map<string,map<string,array<int>>>", "array<array<int>>"
STATE = f"objects {_OBJECTS}, bboxes {_BOXES}, oof map<string,{_RANGES}>, review_marks array<int>, blurry_ranges {_RANGES}, start int, end int, current_frame int"
#: Kinds that clear others of the same object.
_CLEARS = {"drop": ("object", "box", "away"), "here": ("away",), "sharp": ("blurry",)}


def standing(events: DataFrame, upto: int | None = None) -> DataFrame:
    """The events up to a version (all without one) that no later one has cleared."""
    rows = events.where("video is not null and n is not null and kind is not null")
    rows = rows if upto is None else rows.where(F.col("n") <= upto)
    cleared = F.coalesce(*(F.when(F.col("kind") == k, F.array(*map(F.lit, of))) for k, of in _CLEARS.items()))
    about = F.when(F.col("kind").isin("blurry", "sharp"), F.lit(None)).otherwise(F.col("oid"))
    clears = rows.where(F.col("kind").isin(*_CLEARS)).select("video", about.alias("oid"), F.explode(cleared).alias("kind"), "n")
    clears = clears.groupBy("video", "oid", "kind").agg(F.max("n").alias("gone")).select(F.col("video").alias("v"), F.col("oid").alias("o"), F.col("kind").alias("k"), "gone")
    same = (F.col("video") == F.col("v")) & about.eqNullSafe(F.col("o")) & (F.col("kind") == F.col("k"))
    return rows.join(clears, same, "left").where("gone is null or n > gone").select(events.columns)


def _last(rows: DataFrame, kinds: tuple[str, ...], by: list[str], *values: str) -> DataFrame:
    last = rows.where(F.col("kind").isin(*kinds)).groupBy(*by).agg(F.max(F.struct("n", *values)).alias("last"))
    return last.select(*by, *(f"last.{v}" for v in values))


def objects(rows: DataFrame) -> DataFrame:
    """video, oid, label. rows: standing events, here and below."""
    return _last(rows.where("oid is not null"), ("object",), ["video", "oid"], "label")


def boxes(rows: DataFrame) -> DataFrame:
    """video, frame, oid, box."""
    return _last(rows.where("oid is not null and frame is not null"), ("box",), ["video", "frame", "oid"], "box").where("box is not null")


def ranges(rows: DataFrame) -> DataFrame:
    """video, oid, start, end of ranges out of frame, each once."""
    return rows.where("kind = 'away' and oid is not null and start is not null").select("video", "oid", "start", "end").distinct()


def blurry(rows: DataFrame) -> DataFrame:
    """video, start, end of blurry ranges, each once."""
    return rows.where("kind = 'blurry' and start is not null").select("video", "start", "end").distinct()


def marks(rows: DataFrame) -> DataFrame:
    """video, frame of frames to be reviewed."""
    return _last(rows.where("frame is not null"), ("mark", "unmark"), ["video", "frame"], "kind").where("kind = 'mark'").select("video", "frame")


def states(events: DataFrame, upto: int | None = None) -> DataFrame:
    """video and its state (STATE), a row for each video with an event up to the version. A row is the whole document of a video, as trackers read it."""
    rows = standing(events, upto)
    named = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), value.alias("v")))))
    pair = F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))))
    pairs = F.transform(pair, lambda p: F.array(p.s, p.e))
    per_frame = boxes(rows).groupBy("video", "frame").agg(named("oid", F.col("box")).alias("held"))
    parts = [
        objects(rows).groupBy("video").agg(named("oid", F.struct("label")).alias("objects")),
        per_frame.groupBy("video").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string").alias("k"), F.col("held").alias("v")))).alias("bboxes")),
        ranges(rows).groupBy("video", "oid").agg(pairs.alias("held")).groupBy("video").agg(named("oid", F.col("held")).alias("oof")),
        marks(rows).groupBy("video").agg(F.array_sort(F.collect_list("frame")).alias("review_marks")),
        blurry(rows).groupBy("video").agg(pairs.alias("blurry_ranges")),
        _last(rows, ("span",), ["video"], "start", "end"),
        _last(rows, ("at",), ["video"], "frame").withColumnRenamed("frame", "current_frame"),
    ]
    known = events.where("video is not null and n is not null and kind is not null")
    out = (known if upto is None else known.where(F.col("n") <= upto)).select("video").distinct()
    for p in parts:
        out = out.join(p, "video", "left")
    empty = {"objects": ("{}", _OBJECTS), "bboxes": ("{}", _BOXES), "oof": ("{}", f"map<string,{_RANGES}>"), "review_marks": ("[]", "array<int>"), "blurry_ranges": ("[]", _RANGES)}
    return out.select("video", *(F.coalesce(c, F.from_json(F.lit(text), kind)).alias(c) for c, (text, kind) in empty.items()), "start", "end", F.coalesce("current_frame", F.lit(0)).alias("current_frame"))


def events_of(saved: DataFrame, n: int = 0) -> DataFrame:
    """The events (all of number n) that give these states when replayed: a log goes on from a loaded state. saved: video and STATE."""
    none = {c: F.lit(None) for c in ("oid", "frame", "label", "box", "start", "end")}
    kinds = dict(f.split(" ", 1) for f in EVENTS.split(", "))

    def made(rows: DataFrame, kind: str, **values) -> DataFrame:
        own = {"video": F.col("video"), "n": F.lit(n), "kind": F.lit(kind), **none, **values}
        return rows.select(*(own[c].cast(t).alias(c) for c, t in kinds.items()))

    each = saved.select("video", F.explode("bboxes").alias("f", "held")).select("video", "f", F.explode("held").alias("o", "box"))
    away = saved.select("video", F.explode("oof").alias("o", "held")).select("video", "o", F.explode("held").alias("r"))
    parts = [
        made(saved.select("video", F.explode("objects").alias("o", "v")), "object", oid=F.col("o"), label=F.col("v.label")),
        made(each, "box", oid=F.col("o"), frame=F.col("f"), box=F.col("box")),
        made(away, "away", oid=F.col("o"), start=F.get("r", 0), end=F.get("r", 1)),
        made(saved.select("video", F.explode("review_marks").alias("f")), "mark", frame=F.col("f")),
        made(saved.select("video", F.explode("blurry_ranges").alias("r")), "blurry", start=F.get("r", 0), end=F.get("r", 1)),
        made(saved.where("start is not null or end is not null"), "span", start=F.col("start"), end=F.col("end")),
        made(saved, "at", frame=F.col("current_frame")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
