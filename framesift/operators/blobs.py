"""Blobs of masks: runs of pixels joined over eight neighbours, the largest of them, and the box around those.

A mask is known by key columns and may come as cells (y, x) or as runs (y, x0, x1, both ends in). One mask is one group, so a group is
as large as an image has runs, never a table; masks of a video are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, y, x0, x1: neighbouring cells of a row as one run. A cell that is there twice counts once; cells with a null are left out."""
    rows = cells.select(*by, "y", "x").where("y is not null and x is not null").distinct()
    island = F.col("x") - F.row_number().over(Window.partitionBy(*by, "y").orderBy("x"))
    return rows.withColumn("island", island).groupBy(*by, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def roots(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For each run (sorted by y, x0; apart within a row) the first run of its blob."""
    width = int(x1.max() - x0.min()) + 4
    at = (y - y.min()) * width - x0.min() + 1
    # Runs of the row above that reach from the pixel before to the pixel behind.
    lo = np.searchsorted(at + x1, at - width + x0 - 1, "left")
    hi = np.searchsorted(at + x0, at - width + x1 + 1, "right")
    count = np.maximum(hi - lo, 0)
    low = np.repeat(np.arange(len(y)), count)
    up = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(len(y))
    while True:
        a, b = root[low], root[up]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def blobs(masks: DataFrame, by: list[str]) -> DataFrame:
    """masks (runs) with blob (from 1 by falling area, then by the first pixel in reading order) and its area in pixels."""
    kinds = ", ".join(f"`{c}` {masks.schema[c].dataType.simpleString()}" for c in by)

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x0"])
        y, x0, x1 = (frame[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
        first, blob = np.unique(roots(y, x0, x1), return_inverse=True)
        area = np.bincount(blob, x1 - x0 + 1, len(first)).astype(np.int64)
        place = np.empty(len(first), np.int64)
        place[np.lexsort((first, -area))] = np.arange(1, len(first) + 1)
        return frame[[*by, "y", "x0", "x1"]].assign(blob=place[blob], area=area[blob])

    return masks.select(*by, "y", "x0", "x1").groupBy(*by).applyInPandas(look, f"{kinds}, y long, x0 long, x1 long, blob long, area long")


def largest(found: DataFrame, n: int = 1) -> DataFrame:
    """The runs of the n largest blobs of each mask."""
    return found.where(F.col("blob") <= n)


def around(found: DataFrame, by: list[str]) -> DataFrame:
    """by, x1, y1, x2, y2: one box around all runs of a mask; the lower right corner lies outside. A mask without pixels has no row."""
    return found.groupBy(*by).agg(F.min("x0").alias("x1"), F.min("y").alias("y1"), (F.max("x1") + 1).alias("x2"), (F.max("y") + 1).alias("y2"))
