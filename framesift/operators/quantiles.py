"""Exact percentiles of any number of rows, as a whole or in groups.

Values are counted by ranges, whose edges come from a sketch and so hold about as many rows each. Running counts say in which range a wanted
rank lies, and only the rows of those ranges are looked into: counted by value, so that a value of a third of all rows is one row, and
added up in order. No task holds more than the different values of one range of one group.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values; rows up to which all values are held by one task for each group.
RANGES, FEW = 1024, 1_000_000
_PAST = Window.unboundedPreceding


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Whether the groups are equal; null is a group. With no groups all rows are one."""
    out = F.lit(True)
    for c in by:
        out = out & a[c].eqNullSafe(b[f"{c}__by"])
    return out


def quantiles(rows: DataFrame, value: str, marks: dict[str, float], by: list[str] | None = None, few: int | None = None) -> DataFrame:
    """by, and a column for each mark (name: share): the percentile, linear between the two nearest ranks. Nulls don't count; a group without values has no row.

    Tables of at most `few` rows (which is counted) take Spark's own percentile, with the same result."""
    by = by or []
    # A group of its own column, so that no groups and groups are the same case.
    held = rows.where(F.col(value).isNotNull()).select(*by, F.xxhash64(*by).alias("__g") if by else F.lit(0).cast("long").alias("__g"), F.col(value).cast("double").alias("__x"))
    if held.limit(1 + (FEW if few is None else few)).count() <= (FEW if few is None else few):
        return held.groupBy(*by, "__g").agg(*(F.percentile("__x", F.lit(p)).alias(k) for k, p in marks.items())).drop("__g")
    edges = held.agg(F.percentile_approx("__x", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or [0.0]
    splits = [-float("inf"), *sorted(set(edges)), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="__x", outputCol="__b", handleInvalid="keep").transform(held)
    keys = [*by, "__g"]
    count = placed.groupBy(*keys, "__b").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("__b")
    count = count.withColumns({"before": F.coalesce(F.sum("n").over(order.rowsBetween(_PAST, -1)), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(*keys))})
    place = lambda p: (F.col("all") - 1) * F.lit(p)
    ranks = [F.struct(F.lit(k).alias("name"), F.lit(up).alias("up"), (F.ceil(place(p)) if up else F.floor(place(p))).alias("rank"), (place(p) - F.floor(place(p))).alias("part")) for k, p in marks.items() for up in (False, True)]
    asked = count.withColumn("r", F.explode(F.array(*ranks))).where((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("n")))
    asked = asked.select(*(F.col(c).alias(f"{c}__by") for c in by), F.col("__g").alias("__ag"), F.col("__b").alias("__ab"), (F.col("r.rank") - F.col("before")).alias("rank"), "r.name", "r.up", "r.part")
    ranges = asked.select(*(f"{c}__by" for c in by), "__ag", "__ab").distinct()
    inside = placed.join(ranges, (placed["__g"] == ranges["__ag"]) & (placed["__b"] == ranges["__ab"]) & _same(placed, ranges, by))
    values = inside.groupBy(*keys, "__b", "__x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "__b").orderBy("__x").rowsBetween(_PAST, 0))
    values = values.withColumn("upto", upto)
    found = values.join(asked, (values["__g"] == asked["__ag"]) & (values["__b"] == asked["__ab"]) & (F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto")) & _same(values, asked, by))
    pick = lambda k, up: F.max(F.when((F.col("name") == k) & (F.col("up") == up), F.col("__x")))
    part = lambda k: F.max(F.when(F.col("name") == k, F.col("part")))
    return found.groupBy(*keys).agg(*((pick(k, False) + (pick(k, True) - pick(k, False)) * part(k)).alias(k) for k in marks)).drop("__g")


def with_quantiles(groups: DataFrame, rows: DataFrame, value: str, marks: dict[str, float], by: list[str]) -> DataFrame:
    """groups (one row for each value of by, or one row) with the percentiles of their rows."""
    found = quantiles(rows, value, marks, by)
    if not by:
        return groups.join(found.withColumn("__one", F.lit(1)), F.lit(1) == F.col("__one"), "left").drop("__one") if marks else groups
    found = found.select(*(F.col(c).alias(f"{c}__by") for c in by), *marks)
    return groups.join(found, _same(groups, found, by), "left").select(*groups.columns, *marks)
