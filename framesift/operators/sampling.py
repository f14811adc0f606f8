"""Random choice by seeded hashes: the same on any cluster, and in any engine that has MD5."""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range of the table in which weights are added up and draws are met.
BLOCK = 1_000_000


def seeded(name: str | Column, seed: int | str) -> Column:
    """MD5 of the value and the seed: rows in this order are shuffled."""
    return F.md5(F.concat(F.col(name).cast("string") if isinstance(name, str) else name.cast("string"), F.lit(f":{seed}")))


def uniform(name: str | Column, seed: int | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the hash."""
    return F.conv(F.substring(seeded(name, seed), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def draws(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "draw")


def weighted_draws(rows: DataFrame, weight: str, key: str, group: str, n: int, seed: int, block: int = BLOCK) -> DataFrame:
    """draw, key: n draws with replacement, each row with a chance by its weight. Rows whose weight is null, not finite or not positive are never
    drawn; without others there are no draws. Rows with equal group and key stand side by side in any order.

    Rows are cut into ranges of about `block` by group and key. Weights are added up in a range and over ranges (a number for each
    range, on the driver), so each range is a piece of the unit interval. Draws go to their piece and take the last row that
    begins before them, in one sorted pass. Where a piece has more draws than rows, its rows are repeated for parts of the draws:
    at most rows + draws in all, however the weights lie. The ranges stay persisted, as the result reads them."""
    spark = rows.sparkSession
    held = rows.where((F.col(weight) > 0) & (F.col(weight) < float("inf"))).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(weight).cast("double").alias("w"))
    pieces = max(1, -(-held.count() // block))
    ranged = held.repartitionByRange(pieces, "g", "k").withColumn("piece", F.spark_partition_id()).persist()
    sums = ranged.groupBy("piece").agg(F.sum("w").alias("t"), F.count("*").alias("n")).orderBy("piece").collect()  # one row a range
    ends = list(accumulate((r.t for r in sums), initial=0.0))
    bounds = [e / ends[-1] for e in ends[:-1]] if sums else []
    parts = [1 + int(n * r.t / ends[-1]) // max(r.n, block) for r in sums]
    begins = dict(zip(bounds, range(len(bounds)), strict=True))  # of pieces with one begin the last
    table = spark.createDataFrame([(r.piece, e, p) for r, e, p in zip(sums, ends, parts, strict=False)], "piece int, base double, parts int")
    past = Window.partitionBy("piece").orderBy("g", "k").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("piece").orderBy("g", "k")
    placed = ranged.withColumns({"own": F.coalesce(F.sum("w").over(past), F.lit(0.0)), "nth": F.row_number().over(order)}).join(F.broadcast(table), "piece")
    all_ = F.lit(ends[-1] or 1.0)
    begin = placed.select("piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), ((F.col("base") + F.col("own")) / all_).alias("at"), "nth", F.struct("k").alias("row"), F.lit(None).cast("long").alias("draw"))
    named = spark.createDataFrame([(float(i), sums[at].piece, parts[at]) for i, at in enumerate(v for _, v in sorted(begins.items()))], "b double, piece int, parts int")
    asked = draws(spark, n if sums else 0).withColumn("at", uniform("draw", seed))
    asked = Bucketizer(splits=[*(sorted(begins) or [0.0]), 2.0, 3.0], inputCol="at", outputCol="b").transform(asked).join(F.broadcast(named), "b")
    asked = asked.select("piece", F.pmod(F.col("draw"), F.col("parts")).cast("int").alias("part"), "at", F.lit(None).cast("int").alias("nth"), F.lit(None).cast(begin.schema["row"].dataType).alias("row"), "draw")
    upto = Window.partitionBy("piece", "part").orderBy("at", F.col("draw").isNotNull(), "nth").rowsBetween(Window.unboundedPreceding, 0)
    met = begin.unionByName(asked).withColumn("row", F.last("row", ignorenulls=True).over(upto))
    return met.where(F.col("draw").isNotNull()).select("draw", F.col("row.k").alias(key))


def sampled_queries(frames: DataFrame, n: int, seed: int) -> DataFrame:
    """draw, video, sample_idx: each draw takes a video of several frames, all equally likely, then one of its frames but the last."""
    videos = frames.groupBy("video").agg(F.count("*").alias("n")).where("n > 1")
    numbered = videos.withColumns({"nth": F.row_number().over(Window.partitionBy().orderBy("video")) - 1, "of": F.count("*").over(Window.partitionBy())})
    pick = draws(frames.sparkSession, n).select("draw", uniform("draw", f"video:{seed}").alias("u"), uniform("draw", f"frame:{seed}").alias("w"))
    asked = pick.join(F.broadcast(videos.agg(F.count("*").alias("of")).where("of > 0"))).withColumn("nth", F.floor(F.col("u") * F.col("of")))
    chosen = asked.join(numbered.select("nth", "video", "n"), "nth").select("draw", "video", F.floor(F.col("w") * (F.col("n") - 1)).alias("place"))
    placed = frames.select("video", "sample_idx", (F.row_number().over(Window.partitionBy("video").orderBy("sample_idx")) - 1).cast("long").alias("place"))
    return chosen.join(placed, ["video", "place"]).select("draw", "video", "sample_idx")
