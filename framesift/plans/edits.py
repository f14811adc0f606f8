"""Queries on a log of edits (order lines as events) and on blobs of masks (events as cells)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.operators import blobs, edits
from framesift.plans.tables import read
from framesift.registry import query

# Small quantities are the rare kinds; a box of the highest tax is an empty one.
_LOG = """log as (select (l_suppkey % 100)::varchar as video, l_orderkey * 8 + l_linenumber as n, (l_linenumber % 5)::int as oid, (l_partkey % 40)::int as frame,
  case when l_quantity < 2 then 'drop' when l_quantity < 4 then 'here' when l_quantity < 9 then 'away' when l_quantity < 14 then 'object' else 'box' end as kind,
  l_returnflag || l_linestatus as label, case when l_tax < 0.075 then (l_partkey % 600)::int end as x1, trunc(l_quantity)::int as q from lineitem),
drops as (select video, oid, max(n) as gone from log where kind = 'drop' group by all),
left_ as (select log.* from log left join drops using (video, oid) where gone is null or n > gone),
cleared as (select video, oid, max(n) as gone from log where kind in ('drop', 'here') group by all),
objects as (select video, oid, arg_max(label, n) as label from left_ where kind = 'object' group by all),
held as (select video, frame, oid, arg_max(coalesce(x1, -1), n) as x1 from left_ where kind = 'box' group by all having arg_max(coalesce(x1, -1), n) >= 0),
ranges as (select distinct video, oid, frame as start, frame + q as "end" from log left join cleared using (video, oid) where kind = 'away' and (gone is null or n > gone))"""


def _log(spark, sf_dir):
    line, q, x = read(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("int"), (F.col("l_partkey") % 600).cast("int")
    kind = F.when(F.col("l_quantity") < 2, "drop").when(F.col("l_quantity") < 4, "here").when(F.col("l_quantity") < 9, "away").when(F.col("l_quantity") < 14, "object").otherwise("box")
    frame = (F.col("l_partkey") % 40).cast("int")
    return line.select(
        (F.col("l_suppkey") % 100).cast("string").alias("video"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("n"), kind.alias("kind"),
        (F.col("l_linenumber") % 5).cast("int").alias("oid"), frame.alias("frame"), F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.when(F.col("l_tax") < 0.075, F.array(x, x, x + q, x + q)).alias("box"), frame.alias("start"), (frame + q).alias("end"),
    )


@query("replayed_boxes", f"with {_LOG} select video, frame, oid, label, x1 from held left join objects using (video, oid)")
def replayed_boxes(spark, sf_dir):
    """The boxes that stand after all edits, with the labels of their objects."""
    rows = edits.standing(_log(spark, sf_dir))
    return edits.boxes(rows).join(edits.objects(rows), ["video", "oid"], "left").select("video", "frame", "oid", "label", F.get("box", 0).alias("x1"))


@query("replayed_ranges", f'with {_LOG} select video, oid, start, "end" from ranges')
def replayed_ranges(spark, sf_dir):
    """The ranges out of frame that stand after all edits."""
    return edits.ranges(edits.standing(_log(spark, sf_dir)))


@query("replayed_states", f"""with {_LOG}, v as (select distinct video from log), o as (select video, count(*) as n_objects from objects group by 1),
b as (select video, count(distinct frame) as n_frames, count(*) as n_boxes, sum(x1)::bigint as x1 from held group by 1), r as (select video, count(*) as n_ranges from ranges group by 1)
select video, coalesce(n_objects, 0) as n_objects, coalesce(n_frames, 0) as n_frames, coalesce(n_boxes, 0) as n_boxes, coalesce(x1, 0)::bigint as x1, coalesce(n_ranges, 0) as n_ranges
from v left join o using (video) left join b using (video) left join r using (video)""")
def replayed_states(spark, sf_dir):
    """What the state documents of the videos hold, after the way through the events that they give."""
    again = edits.states(edits.events_of(edits.states(_log(spark, sf_dir))))
    held = F.flatten(F.transform(F.map_values("bboxes"), lambda m: F.map_values(m)))
    of = lambda c: F.size(c).cast("long")
    n_ranges = of(F.flatten(F.map_values("oof")))
    return again.select("video", of("objects").alias("n_objects"), of("bboxes").alias("n_frames"), of(held).alias("n_boxes"), F.aggregate(held, F.lit(0).cast("long"), lambda t, b: t + b[0]).alias("x1"), n_ranges.alias("n_ranges"))


# A user's events as the cells of a mask of 16 by 16.
_BLOBS = """with recursive cells as (select distinct user_id as mask, event_id % 256 // 16 as y, event_id % 16 as x from events),
reach as (select mask, y, x, y as ry, x as rx from cells
  union select c.mask, c.y, c.x, r.ry, r.rx from reach r join cells c on c.mask = r.mask and abs(c.y - r.y) <= 1 and abs(c.x - r.x) <= 1),
root as (select mask, y, x, min(ry * 16 + rx) as root from reach group by all),
areas as (select mask, root, count(*) as area, min(x) as x1, min(y) as y1, max(x) + 1 as x2, max(y) + 1 as y2 from root group by all),
placed as (select *, row_number() over (partition by mask order by area desc, root) as blob from areas)"""


def _blobs(spark, sf_dir):
    e = F.col("event_id")
    cells = read(spark, sf_dir, "events").select(F.col("user_id").alias("mask"), F.floor(e % 256 / 16).alias("y"), (e % 16).alias("x"))
    return blobs.blobs(blobs.runs(cells, ["mask"]), ["mask"])


@query("mask_blobs", f"{_BLOBS} select mask, blob, area, x1, y1, x2, y2 from placed")
def mask_blobs(spark, sf_dir):
    """Every blob of every mask with its area and box."""
    found = _blobs(spark, sf_dir)
    return blobs.around(found, ["mask", "blob", "area"])


@query("mask_boxes", f"{_BLOBS} select mask, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from placed where blob <= 3 group by 1")
def mask_boxes(spark, sf_dir):
    """One box for each mask, around its three largest blobs."""
    return blobs.around(blobs.largest(_blobs(spark, sf_dir), 3), ["mask"])
