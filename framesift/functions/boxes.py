"""Boxes as four coordinates, and ranges of frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """cx, cy, w, h of a box cut to the image, as shares of its size."""
    cut = lambda v, m: F.greatest(F.lit(0.0), F.least(v.cast("double"), m.cast("double")))
    a, b, c, d = cut(x1, width), cut(y1, height), cut(x2, width), cut(y2, height)
    return [((a + c) / 2 / width).alias("cx"), ((b + d) / 2 / height).alias("cy"), ((c - a) / width).alias("w"), ((d - b) / height).alias("h")]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 if their union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    both = area(a) + area(b) - wide * high
    return F.when(both > 0, wide * high / both).otherwise(0.0)


def in_ranges(ranges: Column, frame: Column, closed: bool = True) -> Column:
    """Whether a frame is in one of the ranges (start, end); a null end is open. closed: the end belongs to the range."""
    inside = lambda r: (r["start"] <= frame) & (r["end"].isNull() | ((frame <= r["end"]) if closed else (frame < r["end"])))
    return F.coalesce(F.exists(ranges, inside), F.lit(False))
