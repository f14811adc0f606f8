"""The log of edits against a plain replay, and save, load and replay against each other."""

import random

import pytest

from framesift import sinks
from framesift.operators import edits
from framesift.sources import labels

KINDS = ["object", "box", "box", "box", "away", "here", "drop", "mark", "unmark", "blurry", "sharp", "span", "at", "unheard"]


def made(seed, count):
    rng, out = random.Random(seed), []
    for n in range(1, count + 1):
        kind, start = rng.choice(KINDS), rng.randrange(30)
        box = None if rng.random() < 0.2 else [rng.randrange(99) for _ in range(4)]
        out.append((rng.choice(["001", "b/2", "c"]), n, kind, rng.randrange(3), rng.randrange(5), rng.choice("xyz"), box, start, rng.choice([None, start + 4])))
    return out


def replay(events, upto):
    """One event after the other."""
    all_ = {}
    for video, n, kind, oid, frame, label, box, start, end in sorted(events, key=lambda e: e[1]):
        if n > upto:
            break
        s = all_.setdefault(video, {"objects": {}, "boxes": {}, "oof": {}, "marks": set(), "blurry": set(), "span": (None, None), "at": 0})
        if kind == "object":
            s["objects"][oid] = label
        elif kind == "box":
            s["boxes"].pop((frame, oid), None)
            if box is not None:
                s["boxes"][frame, oid] = box
        elif kind == "away":
            s["oof"].setdefault(oid, set()).add((start, end))
        elif kind == "here":
            s["oof"].pop(oid, None)
        elif kind == "drop":
            s["objects"].pop(oid, None)
            s["oof"].pop(oid, None)
            s["boxes"] = {k: v for k, v in s["boxes"].items() if k[1] != oid}
        elif kind == "mark":
            s["marks"].add(frame)
        elif kind == "unmark":
            s["marks"].discard(frame)
        elif kind == "blurry":
            s["blurry"].add((start, end))
        elif kind == "sharp":
            s["blurry"] = set()
        elif kind == "span":
            s["span"] = (start, end)
        elif kind == "at":
            s["at"] = frame
    return all_


def plain(rows):
    out = {}
    for r in rows.collect():
        boxes = {(int(f), int(o)): list(b) for f, held in r.bboxes.items() for o, b in held.items()}
        oof = {int(o): {tuple(x) for x in v} for o, v in r.oof.items()}
        out[r.video] = {"objects": {int(o): v.label for o, v in r.objects.items()}, "boxes": boxes, "oof": oof, "marks": set(r.review_marks), "blurry": {tuple(x) for x in r.blurry_ranges}, "span": (r.start, r.end), "at": r.current_frame}
    return out


@pytest.mark.parametrize("upto", [1, 40, 150])
def test_any_version_is_that_of_a_plain_replay(spark, upto):
    events = made(2, 150)
    rows = spark.createDataFrame(events + events[:30] + [(None, 5, "box", 1, 1, "x", None, 1, 2), ("z", None, "at", 1, 1, "x", None, 1, 2), ("z", 3, None, 1, 1, "x", None, 1, 2)], edits.EVENTS)
    assert plain(edits.states(rows, upto)) == replay(events, upto)


def test_saved_loaded_and_replayed_states_are_the_same(spark, tmp_path):
    events, log, saved = made(3, 200), str(tmp_path / "log"), str(tmp_path / "states")
    sinks.edit_log(spark.createDataFrame(events[:120], edits.EVENTS), log)
    sinks.tracker_states(edits.states(labels.edit_log(spark, log)), saved)
    assert plain(labels.saved_states(spark, saved)) == replay(events, 120)
    # The log goes on, and one video is saved again; the other documents stay.
    sinks.edit_log(spark.createDataFrame(events[120:], edits.EVENTS), log)
    sinks.edit_log(spark.createDataFrame(events[120:140], edits.EVENTS), log)
    now = edits.states(labels.edit_log(spark, log))
    sinks.tracker_states(now.where("video = '001'"), saved)
    old, new = replay(events, 120), replay(events, 200)
    assert plain(labels.saved_states(spark, saved)) == old | {"001": new["001"]}
    # From a loaded state and the events after it, too.
    sinks.tracker_states(edits.states(labels.edit_log(spark, log), 120), saved)
    after = labels.edit_log(spark, log).where("n > 120")
    assert plain(edits.states(edits.events_of(labels.saved_states(spark, saved)).unionByName(after))) == new


def test_saved_states_are_tracker_states(spark, tmp_path):
    events = [("a", 1, "object", 7, None, "Hook", None, None, None), ("a", 2, "box", 7, 4, None, [1, 2, 3, 4], None, None), ("a", 3, "away", 7, None, None, None, 5, None)]
    sinks.tracker_states(edits.states(spark.createDataFrame(events, edits.EVENTS)), str(tmp_path / "s"))
    read = labels.tracker_states(spark, str(tmp_path / "s" / "*" / "*.txt"))
    assert [(r.oid, r.start, r.end) for r in labels.out_of_frame(read).collect()] == [("7", 5, None)]
    assert [(r.frame, r.boxes[0].label, r.boxes[0].box) for r in labels.annotations(read).collect()] == [(4, "Hook", [1, 2, 3, 4])]


def test_no_events(spark):
    assert edits.states(spark.createDataFrame([], edits.EVENTS)).count() == 0
