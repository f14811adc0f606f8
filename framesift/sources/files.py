"""Folders of frames and embedding files, by Spark's binary file reader; only paths are read where contents aren't asked for."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of images in any case.
IMAGES = ("jpg", "jpeg", "png", "bmp")


def _parts(root: str) -> Column:
    """The path's parts below the root."""
    plain = root.rstrip("/").split(":")[-1].lstrip("/")
    return F.split(F.regexp_replace("path", r"^[a-z]+:/*\Q" + plain + r"\E/", ""), "/")


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def discover_frames(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), categories: tuple[str, ...] | None = None, videos: tuple[str, ...] | None = None, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """video, category, sample_idx, path of root/video/* and root/category/video/*; other depths and excluded folders are left out.

    video is category/video where there is a category; sample_idx counts the sorted paths of a video from 0."""
    parts = _parts(root)
    files = _files(spark, root).select("path", parts.alias("p")).where(F.size("p").isin(2, 3))
    files = files.where(F.lower(F.element_at(F.split(F.element_at("p", -1), r"\."), -1)).isin(*suffixes))
    folders = F.slice("p", F.lit(1), F.size("p") - 1)
    rows = files.select("path", folders.alias("f"), F.when(F.size("p") == 3, F.get("p", 0)).alias("category"))
    if exclude:
        rows = rows.where(~F.arrays_overlap("f", F.array(*map(F.lit, exclude))))
    if categories is not None:
        rows = rows.where(F.col("category").isin(*categories))
    rows = rows.withColumn("video", F.array_join("f", "/"))
    if videos is not None:
        rows = rows.where(F.element_at("f", -1).isin(*videos) | F.col("video").isin(*videos))
    at = F.row_number().over(Window.partitionBy("video").orderBy("path")) - 1
    return rows.select("video", "category", at.alias("sample_idx"), "path")


def video_keys(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    return discover_frames(spark, root, exclude).select("video").distinct()


def read_embeddings(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), categories: tuple[str, ...] | None = None, videos: tuple[str, ...] | None = None, drop: bool = False) -> DataFrame:
    """video (name of the parent folder), frame (trailing number of the file name), nth, embedding of every .npy file.

    A file that can't be read, or isn't one vector, has a null embedding, or with `drop` no row; a block of vectors gives a row each
    (nth). categories, videos: only these (a category is the folder above a video); contents of other files aren't read."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32))
                    rows += [(path, i, v) for i, v in enumerate(x)] if x.ndim == 2 else [(path, 0, None)]
                except (ValueError, EOFError, OSError):
                    rows.append((path, 0, None))
            yield pd.DataFrame(rows, columns=["path", "nth", "embedding"])

    files = _files(spark, root).where(F.col("path").endswith(".npy"))
    folder = lambda i: F.element_at(F.split("path", "/"), i)
    if exclude:
        files = files.where(~folder(-2).isin(*exclude))
    if categories is not None:
        files = files.where(folder(-3).isin(*categories))
    if videos is not None:
        files = files.where(folder(-2).isin(*videos))
    files = files.select("path", "content")
    got = files.mapInPandas(load, "path string, nth int, embedding array<float>")
    p = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(p, -1), r"\.npy$", "")
    rows = got.select(F.element_at(p, -2).alias("video"), F.regexp_substr(stem, F.lit(r"\d+$")).cast("int").alias("frame"), "nth", "embedding", "path")
    return rows.where("embedding is not null") if drop else rows


def todo(frames: DataFrame, done: DataFrame) -> DataFrame:
    """Frames without an output yet: (video, sample_idx) not in done."""
    return frames.join(done.select("video", "sample_idx"), ["video", "sample_idx"], "left_anti")


def sample_map(videos: DataFrame, sample_fps: float = 1.0) -> DataFrame:
    """video, sample_idx, source_frame: every max(1, round(fps / sample_fps))-th frame. videos: video, total, fps."""
    step = F.greatest(F.lit(1), F.bround(F.col("fps") / F.lit(sample_fps)).cast("int"))
    return videos.where("total > 0").select("video", F.posexplode(F.sequence(F.lit(0), F.col("total").cast("int") - 1, step)).alias("sample_idx", "source_frame"))


def with_motion(frames: DataFrame, motion: DataFrame) -> DataFrame:
    """frames (video, stem) with the `motion` of their map; null where there is none."""
    return frames.join(motion.select("video", "stem", "motion"), ["video", "stem"], "left")


def listed_vectors(listed: DataFrame, vectors: DataFrame) -> DataFrame:
    """Listed paths that exist and can be read, in their order, with their embedding. vectors: as read_embeddings gives them."""
    return listed.join(vectors.where("embedding is not null and nth = 0").select("path", "embedding"), "path").select("nth", "path", "embedding")
