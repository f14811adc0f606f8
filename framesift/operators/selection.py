"""Which videos take part: known, not excluded, by a part of the name, with enough objects, and by a written test list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen_videos(videos: DataFrame, known: DataFrame | None = None, exclude: tuple[str, ...] = (), contains: str | None = None) -> DataFrame:
    """videos (video, parent) that are among the known ones (video), aren't excluded, and whose name or parent's name holds a text in any case.

    An empty text, like none, keeps all. Rows without a video are left out; a null parent holds nothing."""
    rows = videos.where("video is not null")
    if known is not None:
        rows = rows.join(known.select("video").distinct(), "video", "left_semi")
    if exclude:
        rows = rows.where(~F.col("video").isin(*exclude))
    if contains:
        low = F.lit(contains.lower())
        rows = rows.where(F.contains(F.lower("video"), low) | F.coalesce(F.contains(F.lower("parent"), low), F.lit(False)))
    return rows.select(videos.columns)


def enough_objects(annotated: DataFrame, least: int) -> DataFrame:
    """Frames (labels.annotations) with that many boxes or more; all frames with 0."""
    return annotated.where(F.coalesce(F.size("boxes"), F.lit(0)) >= least) if least > 0 else annotated


def with_annotations(videos: DataFrame, annotated: DataFrame) -> DataFrame:
    """Videos with a frame that is annotated; the others are dropped."""
    return videos.join(annotated.select("video").distinct(), "video", "left_semi").select(videos.columns)


def _plain(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit(", "), F.lit("_")), F.lit("/"), F.lit("")), F.lit(" "), F.lit("_"))


def _groups(rows: DataFrame, name: str, same: DataFrame) -> DataFrame:
    """rows with the group of every listed prefix that a name begins with."""
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(F.col(name), F.lit(1), i)))
    return rows.where(F.length(name) > 0).withColumn("prefix", prefix).join(same.select("group", "prefix").distinct(), "prefix").select(*rows.columns, "group").distinct()


def listed_folders(listed: DataFrame, folders: DataFrame, places: DataFrame, same: DataFrame) -> DataFrame:
    """dataset, name, place, folder: what a test list (dataset, name) means among the folders (place, folder), each pair once.

    A name means folders that are its equal, go on from it with an underscore, are its equal without blanks and slashes, or begin like it with
    prefixes of one group. same: group, prefix. places: dataset, place; a dataset without a row is its own place. All are equi
    joins on a place and a key. Listed rows with a null are left out; blanks at the ends don't count."""
    asked = listed.select(F.trim(F.col("dataset").cast("string")).alias("dataset"), F.trim(F.col("name").cast("string")).alias("name")).dropna().distinct()
    asked = asked.join(places.select("dataset", "place").distinct(), "dataset", "left").withColumn("place", F.coalesce("place", "dataset"))
    there = folders.select("place", "folder").dropna().distinct()
    part = F.split("folder", "_")
    begun = there.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, F.lit(1), i), "_"))))
    hits = [
        asked.withColumn("key", F.col("name")).join(begun, ["place", "key"]),
        asked.withColumn("folder", _plain(F.col("name"))).join(there, ["place", "folder"]),
        _groups(asked, "name", same).join(_groups(there, "folder", same), ["place", "group"]),
    ]
    every = [h.select("dataset", "name", "place", "folder") for h in hits]
    return every[0].union(every[1]).union(every[2]).distinct()


def split_by_list(folders: DataFrame, found: DataFrame) -> DataFrame:
    """place, folder, split of every folder: test if a listed name means it, else train. found: as listed_folders gives it."""
    test = found.select("place", "folder").distinct().withColumn("split", F.lit("test"))
    return folders.select("place", "folder").dropna().distinct().join(test, ["place", "folder"], "left").withColumn("split", F.coalesce("split", F.lit("train")))


def unmatched(listed: DataFrame, found: DataFrame) -> DataFrame:
    """dataset, name of listed rows that mean no folder."""
    asked = listed.select(F.trim(F.col("dataset").cast("string")).alias("dataset"), F.trim(F.col("name").cast("string")).alias("name")).dropna().distinct()
    return asked.join(found, ["dataset", "name"], "left_anti")
