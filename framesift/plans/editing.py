"""Queries on edited objects, capped durations, sampled queries, masks, block sizes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import names
from framesift.operators import catalog, editing, reduce, sampling, similarity, splits
from framesift.plans.tables import BOXES, FRAMES, boxes, frames, read
from framesift.registry import query
from framesift.sources import files, labels

_EDITS = """edits as (select o_custkey % 100 as video, o_orderkey % 7 + 1 as oid, o_orderkey as nth, o_orderpriority as label from orders)"""
_TRIMS = """trims as (select s_suppkey as video, 1 + s_suppkey % 3 as oid, 1000 + s_suppkey * 7 % 2000 as "at" from supplier)"""


def _edits(spark, sf_dir):
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("video"), (F.col("o_orderkey") % 7 + 1).alias("oid"), F.col("o_orderkey").alias("nth"), F.col("o_orderpriority").alias("label"))


def _trims(spark, sf_dir):
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(s.alias("video"), (1 + s % 3).alias("oid"), (1000 + s * 7 % 2000).alias("at"))


@query("relabelled_objects", f"""with {BOXES}, {_EDITS}, last as (select video, oid, arg_max(label, nth) as new from edits group by all)
select coalesce(new, label) as label, count(*) as n, count(distinct (video, oid)) as n_objects from boxes left join last using (video, oid) group by 1""")
def relabelled_objects(spark, sf_dir):
    got = editing.relabelled(boxes(spark, sf_dir), _edits(spark, sf_dir))
    return got.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("video", "oid").alias("n_objects"))


@query("moved_boxes", f"""with {BOXES}, e as (select l_suppkey as video, l_orderkey as frame, 1 as oid, max(l_linenumber) as nth from lineitem where l_returnflag = 'R' group by all)
select b.video, b.frame, b.oid, case when e.nth is null then x1 else e.nth end::int as x1, case when e.nth is null then y1 else e.nth + 1 end::int as y1, case when e.nth is null then x2 else e.nth + 20 end::int as x2, case when e.nth is null then y2 else e.nth + 30 end::int as y2
from boxes b left join e on b.video = e.video and b.frame = e.frame and b.oid = e.oid""")
def moved_boxes(spark, sf_dir):
    n = F.col("l_linenumber").cast("double")
    e = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("video"), F.col("l_orderkey").alias("frame"), F.lit(1).alias("oid"), F.col("l_linenumber").alias("nth"), F.array(n, n + 1, n + 20, n + 30).alias("box"))
    return editing.moved(boxes(spark, sf_dir), e).select("video", "frame", "oid", "x1", "y1", "x2", "y2")


@query("deleted_objects", f"""with {BOXES}, {_TRIMS}, kept as (select * from boxes where (video, oid) not in (select (video, oid) from trims))
select video, min(frame) as first, max(frame) as last from kept group by video""")
def deleted_objects(spark, sf_dir):
    """Extents of the videos after some objects are deleted."""
    return editing.extents(editing.deleted(boxes(spark, sf_dir), _trims(spark, sf_dir)))


@query("trimmed_boxes", f"""with {BOXES}, {_TRIMS}, t as (select video, oid, min("at") as a from trims group by all)
select video, oid, count(*) as n, max(frame) as last_frame from boxes left join t using (video, oid) where a is null or frame < a group by all""")
def trimmed_boxes(spark, sf_dir):
    got = editing.trimmed(boxes(spark, sf_dir), _trims(spark, sf_dir))
    return got.groupBy("video", "oid").agg(F.count("*").alias("n"), F.max("frame").alias("last_frame"))


_RANGES = """ranges as (select l_suppkey as video, l_linenumber as oid, l_orderkey as start, case when l_quantity < 10 then null else l_orderkey + l_quantity::bigint end as "end" from lineitem)"""


@query("trimmed_ranges", f"""with {_RANGES}, {_TRIMS}, t as (select video, oid, min("at") as a from trims group by all)
select video, oid, start, case when a is null then "end" else least(coalesce("end", a), a) end as "end" from ranges left join t using (video, oid) where a is null or start < a""")
def trimmed_ranges(spark, sf_dir):
    end = F.when(F.col("l_quantity") >= 10, F.col("l_orderkey") + F.col("l_quantity").cast("long"))
    r = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("video"), F.col("l_linenumber").alias("oid"), F.col("l_orderkey").alias("start"), end.alias("end"))
    return editing.trimmed_ranges(r, _trims(spark, sf_dir))


@query("capped_durations", """with clips as (select distinct user_id as video, event_id // 50 * 50 as start, event_id // 50 * 50 + 49 as "end" from events where event_type = 'view'),
m as (select *, max("end") over (partition by video order by start, "end" rows between unbounded preceding and 1 preceding) as reach from clips),
r as (select *, sum(case when start <= reach + 1 then 0 else 1 end) over (partition by video order by start, "end") as run from m),
i as (select video, min(start) as a, max("end") as b from r group by video, run),
s as (select event_id, user_id as video, event_id as start, 120 as duration, 1000000 as total from events)
select event_id, case when b is null or start >= total then duration else least(duration, greatest(1, least(b, total - 1) - start + 1)) end::bigint as capped from s left join i on s.video = i.video and s.start between a and b""")
def capped_durations(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    at = F.floor(F.col("event_id") / 50) * 50
    clips = e.where("event_type = 'view'").select(F.col("user_id").alias("video"), at.alias("start"), (at + 49).alias("end")).distinct()
    starts = e.select("event_id", F.col("user_id").alias("video"), F.col("event_id").alias("start"), F.lit(120).alias("duration"), F.lit(1000000).alias("total"))
    return editing.capped_durations(starts, clips).select("event_id", F.col("capped").cast("long").alias("capped"))


def _u(what: str, seed: str) -> str:
    return f"('0x' || substr(md5({what} || ':{seed}'), 1, 13))::bigint / 4503599627370496.0"


_DRAWN = f"""{FRAMES}, v as (select *, row_number() over (order by video) - 1 as nth from (select video, count(*) as n from frames group by video having count(*) > 1)),
d as (select i as draw, floor({_u('i::varchar', 'video:7')} * (select count(*) from v))::bigint as nth, {_u('i::varchar', 'frame:7')} as w from range(0, 200) t(i)),
drawn as (select draw, video, floor(w * (n - 1))::bigint as sample_idx from d join v using (nth))"""


@query("sampled_queries", f"with {_DRAWN} select * from drawn")
def sampled_queries(spark, sf_dir):
    """200 draws of a video and of one of its frames, never the last."""
    return sampling.sampled_queries(frames(spark, sf_dir), 200, 7)


@query("sampled_matches", f"""with {_DRAWN}, q as (select distinct vec_id, video, embedding from frames join drawn using (video, sample_idx)),
p as (select q.vec_id as query, f.vec_id as match, round(list_cosine_similarity(q.embedding::double[], f.embedding::double[]), 9) as s from q join frames f on f.video <> q.video),
b as (select *, row_number() over (partition by query order by s desc, match) as r from p)
select query, match, round(s, 6) as similarity, round(s, 6) >= 0.3 as is_match from b where r = 1""")
def sampled_matches(spark, sf_dir):
    """The nearest frame of another video for sampled frames only, and whether it passes a threshold."""
    f = frames(spark, sf_dir)
    asked = sampling.sampled_queries(f, 200, 7).join(f, ["video", "sample_idx"]).select("vec_id")
    s = F.round("similarity", 6)
    return similarity.nearest_other(f, queries=asked).select("query", "match", s.alias("similarity"), (s >= 0.3).alias("is_match"))


_CELLS = """cells as (select event_id // 512 as key, (event_id % 512 // 64)::int as t, (event_id % 64)::int as s, value as motion from events),
slots as (select key, t // 2 * (select max(s) + 1 from cells) + s as slot, greatest(avg(motion), 1e-8) as motion from cells where t < 8 group by all),
w as (select key, slot, count(*) over (partition by key) as n, 0.7 * motion ** 2 / sum(motion ** 2) over (partition by key) + 0.3 / count(*) over (partition by key) as weight from slots)"""
_MASKED = f"""{_CELLS}, masked as (select key, slot from (select *, row_number() over (partition by key order by -ln({_u("key || '/' || slot", '7')} + 1.1102230246251565e-16) / weight, slot) as place from w) where place <= floor(n * 0.75))"""


def _masked(spark, sf_dir):
    k = F.col("event_id")
    cells = read(spark, sf_dir, "events").select(F.floor(k / 512).alias("key"), F.floor(k % 512 / 64).cast("int").alias("t"), (k % 64).cast("int").alias("s"), F.col("value").alias("motion"))
    return reduce.masked_slots(reduce.mask_weights(reduce.tube_slots(cells, 8, 2), 2.0), 0.75, 7)


@query("masked_tubes", f"with {_MASKED} select key, slot::bigint as slot from masked")
def masked_tubes(spark, sf_dir):
    """Tubes drawn by motion without replacement, three quarters of each clip's."""
    return _masked(spark, sf_dir).select("key", F.col("slot").cast("long").alias("slot"))


@query("masked_tokens", f"""with {_MASKED}, k as (select distinct key from cells), e as (select key, i as index, i // 64 // 2 * 64 + i % 64 as slot from k, range(0, 512) t(i))
select key, index::int as index, m.slot is not null as is_masked from e left join masked m using (key, slot)""")
def masked_tokens(spark, sf_dir):
    masked = _masked(spark, sf_dir)
    keys = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 512).alias("key"))
    return reduce.token_split(masked, keys, 8, 64, 2)


@query("structure_spread", """with c as (select event_id // 64 as key, event_id % 64 // 8 as y, event_id % 8 as x, value, (event_id * 37 % 101)::double as edge from events),
e as (select key, quantile_cont(value, 0.8) as least, max(edge) as most from c group by key),
h as (select key, y / 8 as y, x / 8 as x, edge / (most + 1e-8) + 0.05 as w from c join e using (key) where value >= least),
m as (select key, sum(w) as s, sum(y * w) / sum(w) as my, sum(x * w) / sum(w) as mx from h group by key)
select key, round(sqrt(sum(w * (y - my) ** 2) / any_value(s)) + sqrt(sum(w * (x - mx) ** 2) / any_value(s)), 6) as spread from h join m using (key) group by key""")
def structure_spread(spark, sf_dir):
    k = F.col("event_id")
    cells = read(spark, sf_dir, "events").select(F.floor(k / 64).alias("key"), F.floor(k % 64 / 8).alias("y"), (k % 8).alias("x"), "value", (k * 37 % 101).cast("double").alias("edge"))
    return reduce.weighted_spread(cells, 8, 8).withColumn("spread", F.round("spread", 6))


_SIGNALS = """s as (select event_id // 240 as key, event_id % 240 // 48 as line, event_id % 48 as i, value from events),
n as (select key, line, count(*) as n, avg(value) as m from s group by all), c as (select key, line, i, n, value - m as v from s join n using (key, line)),
p as (select key, line, sum(v * v) as norm from c group by all),
l as (select a.key, a.line, b.i - a.i as lag, round(sum(a.v * b.v) / any_value(norm), 9) as r from c a join c b on a.key = b.key and a.line = b.line and b.i - a.i between 3 and least(a.n // 3, 80) - 1 join p on a.key = p.key and a.line = p.line where a.n >= 16 and norm >= 1e-10 group by all),
sizes as (select n.key, n.line, coalesce(arg_max(lag, (r, -lag)), 0) as size, coalesce(max(r), 0) as peak from n left join l on n.key = l.key and n.line = l.line group by all)"""


def _sizes(spark, sf_dir):
    k = F.col("event_id")
    held = read(spark, sf_dir, "events").select(F.floor(k / 240).alias("key"), F.floor(k % 240 / 48).alias("line"), F.struct(k, "value").alias("v"))
    return reduce.block_sizes(held.groupBy("key", "line").agg(F.array_sort(F.collect_list("v"))["value"].alias("values")))


@query("autocorrelation_peaks", f"with {_SIGNALS} select key, line, size::int as size, round(peak, 6) as peak from sizes")
def autocorrelation_peaks(spark, sf_dir):
    return _sizes(spark, sf_dir).withColumn("peak", F.round("peak", 6))


@query("usual_block_size", f"with {_SIGNALS} select key, coalesce(arg_max(size, (n, -size)) filter (where size > 0), 0)::int as size from (select key, size, count(*) as n from sizes group by all) group by key")
def usual_block_size(spark, sf_dir):
    return reduce.usual_block_size(_sizes(spark, sf_dir))


@query("frames_to_do", f"with {FRAMES} select video, sample_idx from frames where vec_id % 3 <> 0")
def frames_to_do(spark, sf_dir):
    f = frames(spark, sf_dir).select("video", "sample_idx", "vec_id")
    return files.todo(f, f.where("vec_id % 3 = 0")).select("video", "sample_idx")


@query("listed_and_left", """select (p_partkey % 5 = 0) as listed, count(*) as n, count(distinct p_brand) as n_videos from part group by all""")
def listed_and_left(spark, sf_dir):
    """Rows of a list that are taken away and that stay, and the videos with either."""
    from framesift.sinks import without

    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("video"))
    left, lost = without(rows, rows.where("path % 5 = 0"))
    gone = rows.count() - left.count()
    return left.agg(F.lit(False).alias("listed"), F.count("*").alias("n"), F.count_distinct("video").alias("n_videos")).unionByName(lost.agg(F.lit(True).alias("listed"), F.lit(gone).cast("long").alias("n"), F.count("*").alias("n_videos")))


@query("copied_names", """with r as (select p_brand || '/' || 'img_' || p_size || '.' || case when p_partkey % 2 = 0 then 'jpg' else 'png' end as file, p_partkey, p_retailprice as distance from part),
n as (select *, replace(regexp_replace(file, '\\.[a-z]+$', ''), '/', '_') || '_dist' || printf('%.4f', distance::double) as stem, regexp_extract(file, '\\.[a-z]+$') as suffix, 'root/' || p_partkey || '/' || file as path from r),
k as (select *, row_number() over (partition by stem, suffix order by path) - 1 as nth from n)
select path, stem || case when nth > 0 then '_' || nth else '' end || suffix as name from k""")
def copied_names(spark, sf_dir):
    """Flat names of copies, each once."""
    from framesift.sinks import unique_names

    suffix = F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise(".png")
    path = F.concat(F.lit("root/"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_brand"), F.lit("/img_"), F.col("p_size").cast("string"), suffix)
    return unique_names(read(spark, sf_dir, "part").select(path.alias("path"), F.col("p_retailprice").alias("distance"))).select("path", "name")


@query("filter_report", f"""with {FRAMES}, r as (select vec_id, embedding from frames where vec_id % 50 = 7),
d as (select f.vec_id, round(min(round(1 - list_cosine_similarity(f.embedding::double[], r.embedding::double[]), 9)), 6) as distance from frames f, r where f.vec_id % 50 <> 7 group by all)
select case when distance < 0.8 then 'out' else 'keep' end as status, count(*) as n, max(distance) as farthest from d group by 1""")
def filter_report(spark, sf_dir):
    f = frames(spark, sf_dir)
    near = similarity.against_references(f.where("vec_id % 50 <> 7"), f.where("vec_id % 50 = 7")).withColumn("distance", F.round("distance", 6))
    return catalog.filter_report(near, "distance", 0.8).groupBy("status").agg(F.count("*").alias("n"), F.max("distance").alias("farthest"))


@query("ordered_distinct", "select l_partkey as path, min(l_orderkey * 10 + l_linenumber) as nth from lineitem group by 1")
def ordered_distinct(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nth"))
    return catalog.first_of_each(rows, "path", "nth")


@query("settings_keys", """select user_id as run, sha1('{' || string_agg(to_json(event_type) || ': ' || to_json(n), ', ' order by event_type) || '}') as key from (select user_id, event_type, count(*) as n from events group by all) group by user_id""")
def settings_keys(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("setting")).agg(F.count("*").alias("value"))
    return catalog.settings_key(s)


@query("run_stamps", """select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp, case when s >= 3600 then printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) when s >= 60 then printf('%dm %ds', s // 60, s % 60) else printf('%ds', s) end as took
from (select event_id, ts, event_id * 13 % 9000 as s from events)""")
def run_stamps(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", catalog.run_stamp(F.col("ts")).alias("stamp"), catalog.duration_text(F.col("event_id") * 13 % 9000).alias("took"))


@query("sample_map", "select video, row_number() over (partition by video order by source) - 1 as sample_idx, source as source_frame from (select p_partkey as video, unnest(range(0, p_size * 10, greatest(1, round_even((p_partkey % 60) / 1.0, 0)::bigint))) as source from part)")
def sample_map(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("video"), (F.col("p_size") * 10).alias("total"), (F.col("p_partkey") % 60).cast("double").alias("fps"))
    return files.sample_map(p)


@query("tidy_names", """select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as plain, trim(regexp_replace(p_name || ' é!', '[^A-Za-z0-9.-]+', '_', 'g'), '_') as safe,
'video' || case when p_partkey < 100 then lpad(p_partkey::varchar, 2, '0') else p_partkey::varchar end as named, regexp_replace('clip_' || p_type || '_TITLE_' || p_size, '_TITLE_[0-9]+$', '') as bare, coalesce(try_cast(regexp_extract(p_brand, '[0-9]+') as bigint), 1000000000) as number from part""")
def tidy_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    titled = F.concat(F.lit("clip_"), F.col("p_type"), F.lit("_TITLE_"), F.col("p_size").cast("string"))
    return p.select(
        "p_partkey", names.alphanumeric(F.col("p_name")).alias("plain"), names.sanitised(F.concat("p_name", F.lit(" é!"))).alias("safe"), names.numbered(F.col("p_partkey")).alias("named"),
        names.without_title(titled).alias("bare"), names.sort_number(F.col("p_brand")).alias("number"),
    )


@query("manifest_videos", """select case when lower(v) like 'video%' then case when d = '' then v else 'video' || case when length(d::bigint::varchar) < 2 then lpad(d::bigint::varchar, 2, '0') else d::bigint::varchar end end
else 'video' || case when v::double::bigint < 10 then lpad(v::double::bigint::varchar, 2, '0') else v::double::bigint::varchar end end as video_id, embedding
from (select *, regexp_replace(v, '[^0-9]', '', 'g') as d from (select case when p_partkey % 3 = 0 then 'Video_' || p_partkey when p_partkey % 3 = 1 then p_size || '.0' else 'videoX' end as v, p_name as embedding from part))""")
def manifest_videos(spark, sf_dir):
    k = F.col("p_partkey")
    v = F.when(k % 3 == 0, F.concat(F.lit("Video_"), k.cast("string"))).when(k % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise("videoX")
    return labels.manifest_rows(read(spark, sf_dir, "part").select(v.alias("video_idx"), F.col("p_name").alias("embedding_path")))


@query("motion_joined", f"""with {FRAMES}, m as (select label, vec_id, vec_id * 0.5 as motion from embeddings where vec_id % 4 = 0)
select f.vec_id, m.motion::double as motion from frames f left join m using (vec_id)""")
def motion_joined(spark, sf_dir):
    """Frames with their motion map where there is one."""
    f = frames(spark, sf_dir).withColumn("stem", F.col("vec_id").cast("string"))
    maps = f.where("vec_id % 4 = 0").select("video", "stem", (F.col("vec_id") * 0.5).cast("double").alias("motion"))
    return files.with_motion(f, maps).select("vec_id", "motion")


@query("label_set_check", """with t as (select distinct o_custkey as video, o_orderpriority as label from orders), w as (select label from t where video = (select min(video) from t)),
d as (select v.video, w.label, 'missing' as kind from (select distinct video from t) v, w where not exists (select 1 from t where t.video = v.video and t.label = w.label) union all select video, label, 'unexpected' from t where label not in (select label from w))
select video, coalesce(string_agg(label, ',' order by label) filter (where kind = 'missing'), '') as missing, coalesce(string_agg(label, ',' order by label) filter (where kind = 'unexpected'), '') as unexpected from d group by video""")
def label_set_check(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video"), F.col("o_orderpriority").alias("label"))
    return splits.label_sets(t).select("video", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("missing", "unexpected")))


@query("tool_totals", "select label, sum(v)::double as total from (select 'size' as label, p_size::double as v from part union all select 'brand', try_cast(replace(p_brand, 'Brand#', '') as double) from part union all select 'name', 0 from part) group by label")
def tool_totals(spark, sf_dir):
    """Totals of the cells that are numbers."""
    p = read(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("size"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand"), F.col("p_name").alias("name"))
    return labels.tool_totals(p, ["size", "brand", "name"])


@query("table_cells", """select p_partkey as line, p_name as a, coalesce(nullif(split_part(p_type, ' ', 1), ''), '') as b, case when p_size % 2 = 0 then p_brand else '' end as c from part""")
def table_cells(spark, sf_dir):
    """Lines of cells as columns: short lines are filled, long ones cut."""
    p = read(spark, sf_dir, "part")
    two, kind = F.array("p_name", F.split_part("p_type", F.lit(" "), F.lit(1))), F.col("p_size") % 2 == 0
    cells = F.when(kind, F.concat(two, F.array("p_brand", F.lit("too many")))).otherwise(two)
    head = spark.range(1).select(F.lit(-1).cast("long").alias("line"), F.array(*map(F.lit, "abc")).alias("cells"))
    return labels.table(head.unionByName(p.select(F.col("p_partkey").cast("long").alias("line"), cells.alias("cells"))), ["a", "b", "c"])


@query("out_of_frame_ranges", """select o_custkey as video, k::varchar as oid, min(o_orderkey) filter (where k = 1) as start from (select o_custkey, o_orderkey, 1 as k from orders where o_custkey % 3 = 0) group by all
union all select o_custkey, '2', max(o_orderkey) from orders where o_custkey % 3 = 1 group by all
union all select o_custkey, '5', o_orderkey from orders where o_custkey % 3 = 2""")
def out_of_frame_ranges(spark, sf_dir):
    """The three encodings of ranges out of frame: object to frame, a list of frame and object, object to ranges."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("video")).agg(F.min("o_orderkey").alias("lo"), F.array_sort(F.collect_list("o_orderkey")).alias("all"))
    m = F.col("video") % 3
    single = F.to_json(F.create_map(F.lit("1"), F.col("lo")))
    listed = F.to_json(F.transform("all", lambda x: F.array(x, F.lit(2).cast("long"))))
    ranges = F.to_json(F.create_map(F.lit("5"), F.transform("all", lambda x: F.array(x, x + 3))))
    text = F.when(m == 0, single).when(m == 1, listed).otherwise(ranges)
    return labels.out_of_frame(o.select("video", F.parse_json(text).alias("oof"))).select("video", "oid", F.col("start").cast("long").alias("start"))


@query("metric_by_epoch", "select event_id as epoch, round(value, 6) as value from events union all select -1, null")
def metric_by_epoch(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").alias("epoch"), F.struct(F.struct(F.col("value").alias("train_sws")).alias("similarity")).alias("metrics"))).alias("value"))
    docs = e.unionByName(spark.range(1).select(F.lit('{"epoch": -1, "metrics": {"similarity": {"error": "x"}}}').alias("value")))
    return labels.metric_values(docs, "similarity.train_sws").select(F.col("epoch").cast("long").alias("epoch"), F.round("value", 6).alias("value"))


@query("prediction_rows", "select 'f' || event_id as frame, round(value, 6) as phase_1, round(value * 2, 6) as phase_2, null::double as phase_3 from events where event_type <> 'view'")
def prediction_rows(spark, sf_dir):
    scores = F.when(F.col("event_type") != "view", F.array("value", F.col("value") * 2))
    e = read(spark, sf_dir, "events").select(F.to_json(F.create_map(F.concat(F.lit("f"), F.col("event_id").cast("string")), F.struct(scores.alias("phases_score_dist")))).alias("value"))
    return labels.prediction_rows(e, 3).select("frame", *(F.round(f"phase_{i}", 6).alias(f"phase_{i}") for i in (1, 2, 3)))


@query("detection_rows", """select p_partkey::varchar as file, p_size % 4 as class_id, p_size / 64.0 as cx, 0.25 as cy, 0.5 as w, 0.125 as h from part where p_size % 3 > 0""")
def detection_rows(spark, sf_dir):
    """Detection lines of five numbers; shorter ones and those with other words are skipped."""
    s = F.col("p_size")
    line = F.when(s % 3 > 0, F.concat_ws(" ", (s % 4).cast("string"), (s / F.lit(64.0)).cast("string"), F.lit("0.25 0.5  0.125 extra"))).when(s % 2 == 0, "1 2 3").otherwise("a 0.1 0.2 0.3 0.4")
    return labels.detection_rows(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), line.alias("value")))


@query("record_numbers", """with n as (select c_custkey as k, c_name || '_' || (1000000 + c_custkey % 40) || '_x' as name from customer), r as (select *, 1000000 + k % 40 as record from n),
d as (select s_suppkey as nth, 'd' || s_suppkey || '_' || (1000000 + s_suppkey % 60) as dir, 1000000 + s_suppkey % 60 as record from supplier)
select name, arg_min(dir, nth) as dir from r left join d using (record) group by name""")
def record_numbers(spark, sf_dir):
    """Names that no other rule resolves take the first directory with their record number."""
    from framesift.operators.names import with_record_number

    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    n = c.select(F.concat_ws("_", "c_name", (1000000 + F.col("c_custkey") % 40).cast("string"), F.lit("x")).alias("name")).distinct()
    d = s.select(F.col("s_suppkey").alias("nth"), F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.lit("_"), (1000000 + F.col("s_suppkey") % 60).cast("string")).alias("dir"))
    return with_record_number(n, d, n.select("name", F.lit(None).cast("string").alias("dir")))
