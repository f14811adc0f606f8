"""Blobs against a flood fill, pixel by pixel."""

import random

import numpy as np

from framesift.operators import blobs


def flood(cells):
    """Blobs of a set of (y, x), in reading order of their first pixel."""
    left, out = set(cells), []
    for first in sorted(cells):
        if first not in left:
            continue
        left.discard(first)
        blob, todo = {first}, [first]
        while todo:
            y, x = todo.pop()
            for near in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if near in left:
                    left.discard(near)
                    blob.add(near)
                    todo.append(near)
        out.append(blob)
    return sorted(out, key=lambda b: (-len(b), min(b)))


def test_blobs_are_those_of_a_flood_fill(spark):
    rng = random.Random(4)
    masks = {f"m{i}": {(rng.randrange(-3, 14), rng.randrange(-5, 20)) for _ in range(k)} for i, k in enumerate((1, 5, 40, 90, 150, 200))}
    # One blob that a row-by-row look joins late: a comb, and a spiral's arm.
    masks["comb"] = {(y, x) for x in range(0, 20, 2) for y in range(9)} | {(9, x) for x in range(19)}
    masks["arm"] = {(0, x) for x in range(9)} | {(y, 8) for y in range(9)} | {(8, x) for x in range(9)} | {(y, 0) for y in range(2, 9)} | {(2, x) for x in range(6)}
    cells = [(m, y, x) for m, held in masks.items() for y, x in held]
    rows = spark.createDataFrame(cells + cells[:50] + [("m0", None, 1), ("none", 1, None)], "mask string, y int, x int")
    found = blobs.blobs(blobs.runs(rows, ["mask"]), ["mask"])
    got = {}
    for r in found.collect():
        got.setdefault((r.mask, r.blob, r.area), set()).update((r.y, x) for x in range(r.x0, r.x1 + 1))
    want = {(m, i, len(b)): b for m, held in masks.items() for i, b in enumerate(flood(held), 1)}
    assert got == want
    boxes = {r.mask: (r.x1, r.y1, r.x2, r.y2) for r in blobs.around(blobs.largest(found, 2), ["mask"]).collect()}
    for m, held in masks.items():
        y, x = np.array(sorted(set().union(*flood(held)[:2]))).T
        assert boxes[m] == (x.min(), y.min(), x.max() + 1, y.max() + 1)
    assert set(boxes) == set(masks)


def test_no_masks(spark):
    none = spark.createDataFrame([], "video string, frame int, y int, x int")
    assert blobs.around(blobs.blobs(blobs.runs(none, ["video", "frame"]), ["video", "frame"]), ["video", "frame"]).count() == 0
