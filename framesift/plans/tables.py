"""The driver's tables in the roles of the data model: frames with embeddings, boxes, phase intervals, videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, video, sample_idx, phase, embedding."""
    key = F.concat(F.lit("cat"), (F.col("label") % 3).cast("string"), F.lit("/vid_"), F.lpad(F.col("label").cast("string"), 3, "0"))
    at = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return read(spark, sf_dir, "embeddings").select("vec_id", key.alias("video"), at.cast("long").alias("sample_idx"), (F.col("vec_id") % 3).alias("phase"), "embedding")


FRAMES = """frames as (
  select vec_id, 'cat' || (label % 3) || '/vid_' || lpad(label::varchar, 3, '0') as video,
         row_number() over (partition by label order by vec_id) - 1 as sample_idx, vec_id % 3 as phase, embedding
  from embeddings)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame, oid, label, x1, y1, x2, y2: order lines as boxes, numbered within their frame."""
    order = Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    line = read(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 600).cast("int"), (F.col("l_orderkey") % 400).cast("int")
    w, h = F.col("l_quantity").cast("int") * 2, (F.col("l_discount") * 1000).cast("int") + 5
    return line.select(
        F.col("l_suppkey").alias("video"), F.col("l_orderkey").alias("frame"), F.row_number().over(order).alias("oid"),
        F.concat("l_returnflag", "l_linestatus").alias("label"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
    )


BOXES = """boxes as (
  select l_suppkey as video, l_orderkey as frame,
         row_number() over (partition by l_suppkey, l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax)::int as oid,
         l_returnflag || l_linestatus as label, (l_partkey % 600)::int as x1, (l_orderkey % 400)::int as y1,
         (l_partkey % 600)::int + trunc(l_quantity)::int * 2 as x2, (l_orderkey % 400)::int + trunc(l_discount * 1000)::int + 5 as y2
  from lineitem)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, pos, code, start_s, end_s: each user's events as phases until the next one, in hours of the log."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) - 473352
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", hour.alias("h"))
    return e.select(
        F.col("user_id").alias("video"), (F.row_number().over(order) - 1).alias("pos"), F.col("event_type").alias("code"),
        F.col("h").alias("start_s"), F.lead("h").over(order).alias("end_s"),
    ).where("end_s is not null")


INTERVALS = """ev as (select user_id, event_id, event_type, ts, floor(epoch(ts) / 3600)::bigint - 473352 as h from events),
intervals as (
  select * from (
    select user_id as video, row_number() over w - 1 as pos, event_type as code, h as start_s, lead(h) over w as end_s
    from ev window w as (partition by user_id order by ts, event_id)) where end_s is not null)"""
