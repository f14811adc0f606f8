"""Small operators on lists of files, runs, weights and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators.sampling import seeded


def continuous_numbers(files: DataFrame) -> DataFrame:
    """files (grp, name, n_frames) with `offset`: frames of the group's files before this one, in the order of names."""
    before = Window.partitionBy("grp").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("offset", F.coalesce(F.sum("n_frames").over(before), F.lit(0)))


def strided(frames: DataFrame, stride: int, most: int) -> DataFrame:
    """Every stride-th frame of each video; where more than `most` are left, `most` of them at equal distances, first and last included."""
    place = F.row_number().over(Window.partitionBy("video").orderBy("sample_idx")) - 1
    kept = frames.withColumn("place", place).where(F.col("place") % stride == 0).withColumn("k", F.col("place") / stride)
    n = kept.groupBy("video").agg(F.count("*").alias("n"))
    marks = F.when(F.col("n") <= most, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(1, most - 1))))
    chosen = n.select("video", F.explode(F.array_distinct(marks)).alias("k"))
    return kept.withColumn("k", F.col("k").cast("long")).join(chosen, ["video", "k"], "left_semi").drop("place", "k")


def fingerprint(frames: DataFrame, ends: int = 5) -> DataFrame:
    """video, hash of how many frames there are and of the first and last few: tells whether a cached result is stale."""
    up, down = (F.row_number().over(Window.partitionBy("video").orderBy(o)) for o in (F.asc("sample_idx"), F.desc("sample_idx")))
    held = frames.select("video", "sample_idx", up.alias("up"), down.alias("down"))
    few = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c) <= ends, F.col("sample_idx")))).cast("array<string>"), ",")
    return held.groupBy("video").agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), few("up"), few("down"))).alias("hash"))


def settings_key(settings: DataFrame, name: str = "run") -> DataFrame:
    """run, key: SHA-1 of a run's settings (run, setting, value) as the JSON text of one object, its names in order: {"a": 1, "b": "x"}.

    Null values are JSON's null; of a setting that occurs again each value is in the text. Characters beyond ASCII aren't escaped."""

    def literal(name: str) -> Column:
        text = F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"})
        return F.substr(text, F.lit(6), F.length(text) - 6)

    entry = F.struct("setting", F.concat(literal("setting"), F.lit(": "), literal("value")).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])
    return settings.groupBy(name).agg(F.sha1(F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}"))).alias("key"))


def first_of_each(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The first row of each key in the order of `at`: duplicates go, order stays."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(at)) == 1).where("_first").drop("_first")


def filter_report(rows: DataFrame, distance: str, threshold: float) -> DataFrame:
    """rows with `status`: out under the threshold, else keep (also without a distance)."""
    return rows.withColumn("status", F.when(F.col(distance) < threshold, "out").otherwise("keep"))


def run_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def duration_text(seconds: Column) -> Column:
    """h, m and s of a duration, leading parts only where they count: 1h 2m 3s, 2m 3s, 3s."""
    h, m, s = F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), F.floor(seconds % 60).cast("int")
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def ranked_weights(files: DataFrame) -> DataFrame:
    """files (experiment, run, file) with `rank` in each experiment: newest run first, best before last before others."""
    kind = F.when(F.col("file").startswith("best"), 0).when(F.col("file").startswith("last"), 1).otherwise(2)
    return files.withColumn("rank", F.row_number().over(Window.partitionBy("experiment").orderBy(F.desc("run"), kind, "file")))


def latest(rows: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(value, at).alias(value))


def labelled_sample(frames: DataFrame, label: str, key: str, most: int, hold: float, seed: int) -> DataFrame:
    """At most `most` rows of each label in the order of a seeded hash, the first part `hold` of each for validation (is_val)."""
    order = Window.partitionBy(label).orderBy(seeded(key, seed), key)
    kept = frames.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    n = kept.groupBy(label).agg(F.count("*").alias("n"))
    return kept.join(n, label).withColumn("is_val", F.col("place") <= F.floor(F.col("n") * hold)).drop("place", "n")


def image_paths(features: DataFrame, images: DataFrame, order: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "JPG", "JPEG", "PNG")) -> DataFrame:
    """stem, path of each feature's image, the first suffix in order that exists; else the stem with .jpg. images: stem, suffix."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("suffix"))
    best = images.where(rank > 0).groupBy("stem").agg(F.min_by("suffix", rank).alias("suffix"))
    return features.join(best, "stem", "left").select("stem", F.concat("stem", F.lit("."), F.coalesce("suffix", F.lit("jpg"))).alias("path"))


def at_least(rows: DataFrame, column: str, least: float) -> DataFrame:
    """Rows from a threshold on, in ascending order."""
    return rows.where(F.col(column) >= least).orderBy(column)
