"""Queries on names: keys, resolution, collisions, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import names as fn
from framesift.operators import names as ops
from framesift.operators import selection
from framesift.plans.tables import read
from framesift.registry import query

_NAMES = """names as (select case p_partkey % 5 when 0 then 'RS-' || lpad((p_partkey % 90)::varchar, 3, '0') when 1 then 'MVD_' || lpad((p_partkey % 60)::varchar, 3, '0')
  when 2 then 'ATLR_' || (p_partkey % 40) when 3 then 'atlr_' || ((p_partkey - 1) % 40) || '_left' else 'Case' || p_partkey end as name from part)"""
_DIRS = """dirs as (select case s_suppkey % 4 when 0 then 'TL-' || lpad((s_suppkey % 90)::varchar, 3, '0') || '_tumour' when 1 then 'MVD_' || lpad((s_suppkey % 60)::varchar, 3, '0') || '_run'
  when 2 then 'ATLR_' || (s_suppkey % 40) || '_left' else 'old_case' || s_suppkey || '_x' end as dir, s_suppkey as nth from supplier)"""


def _names(spark, sf_dir):
    k = F.col("p_partkey")
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    m = k % 5
    name = F.when(m == 0, F.concat(F.lit("RS-"), pad(k % 90))).when(m == 1, F.concat(F.lit("MVD_"), pad(k % 60))).when(m == 2, F.concat(F.lit("ATLR_"), (k % 40).cast("string"))).when(m == 3, F.concat(F.lit("atlr_"), ((k - 1) % 40).cast("string"), F.lit("_left"))).otherwise(F.concat(F.lit("Case"), k.cast("string")))
    return read(spark, sf_dir, "part").select(name.alias("name"))


def _dirs(spark, sf_dir):
    k = F.col("s_suppkey")
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    m = k % 4
    name = F.when(m == 0, F.concat(F.lit("TL-"), pad(k % 90), F.lit("_tumour"))).when(m == 1, F.concat(F.lit("MVD_"), pad(k % 60), F.lit("_run"))).when(m == 2, F.concat(F.lit("ATLR_"), (k % 40).cast("string"), F.lit("_left"))).otherwise(F.concat(F.lit("old_case"), k.cast("string"), F.lit("_x")))
    return read(spark, sf_dir, "supplier").select(name.alias("dir"), k.alias("nth"))


_ID = """case when contains(s, '_') and length(split_part(s, '_', 2)) <= 5 then split_part(s, '_', 1) || '_' || split_part(s, '_', 2) when instr(s, '_') > 1 then split_part(s, '_', 1) else s end"""
_RESOLVED = f"""{_NAMES}, {_DIRS}, d as (select distinct name from names),
v as (select name, 0 as v, name as s from d union all select name, 1, case when lower(name[1:2]) = 'rs' then 'TL' else 'RS' end || name[3:] from d where regexp_matches(name, '^(?i)(rs|tl)[-_][0-9]')),
a as (select name, v, lower(s) as spelling, lower({_ID}) as id from v),
f as (select name, dir, nth, v * 2 as rank, 'exact' as rule from a join dirs on lower(dir) = spelling
  union all select name, dir, nth, v * 2 + 1, 'id' from a join dirs on lower(dir) = id or starts_with(lower(dir), id || '_') or starts_with(lower(dir), id || '-')
  union all select name, dir, nth, 100, 'contains' from d join dirs on contains(lower(dir), lower(name))),
b as (select *, row_number() over (partition by name order by rank, nth, dir, rule) as rn from f),
resolved as (select d.name, dir, rule from d left join b on b.name = d.name and rn = 1)"""


@query("name_resolution", f"with {_RESOLVED} select * from resolved")
def name_resolution(spark, sf_dir):
    return ops.resolve(_names(spark, sf_dir), _dirs(spark, sf_dir))


@query("name_collisions", f"with {_RESOLVED} select dir, count(*) as n from resolved where dir is not null group by dir having count(*) > 1")
def name_collisions(spark, sf_dir):
    return ops.collisions(ops.resolve(_names(spark, sf_dir), _dirs(spark, sf_dir)))


@query("name_coverage", f"with {_RESOLVED} select coalesce(rule, 'unmatched') as rule, count(*) as n from resolved group by 1")
def name_coverage(spark, sf_dir):
    return ops.resolve(_names(spark, sf_dir), _dirs(spark, sf_dir)).groupBy(F.coalesce("rule", F.lit("unmatched")).alias("rule")).agg(F.count("*").alias("n"))


@query("name_resolution_by_prefix", f"""with {_NAMES}, {_DIRS}, d as (select distinct name, lower(name) as n, lower(case when instr(name, '_') > 1 then split_part(name, '_', 1) else name end) as p from names),
h as (select name, dir, row_number() over (partition by name order by case when lower(dir) = n then 0 else 1 end, nth) as rn from d join dirs on lower(dir) = n or starts_with(lower(dir), p || '_') or starts_with(lower(dir), p || '-') or contains(lower(dir), n))
select d.name, dir from d left join h on h.name = d.name and rn = 1""")
def name_resolution_by_prefix(spark, sf_dir):
    return ops.resolve_by_prefix(_names(spark, sf_dir), _dirs(spark, sf_dir))


@query("digit_matches", """with c as (select regexp_extract(s_name, '[0-9]+$') as digits, min(s_name) as m from supplier where length(regexp_extract(s_name, '[0-9]+$')) >= 4 group by 1)
select c_name as stem, coalesce(m, c_name) as match from customer left join c on c.digits = regexp_extract(c_name, '[0-9]+$')""")
def digit_matches(spark, sf_dir):
    return ops.match_digits(read(spark, sf_dir, "customer").select(F.col("c_name").alias("stem")), read(spark, sf_dir, "supplier").select(F.col("s_name").alias("candidate")))


@query("extract_ids", f"""with {_NAMES} select name, split_part(name || '/v', '/', 1) as stype, case when instr(name, '_') > 1 then split_part(name, '_', 1) else name end as prefix,
{_ID.replace("(s,", "(name,").replace(" s)", " name)").replace("else s end", "else name end").replace("split_part(s", "split_part(name").replace("instr(s", "instr(name").replace("contains(s", "contains(name")} as video_id,
nullif(regexp_extract(name, '[0-9]+$'), '') as digits, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as plain, coalesce(nullif(regexp_extract(name, '[0-9]+'), '')::bigint, 1000000000) as number from names""")
def extract_ids(spark, sf_dir):
    n = F.col("name")
    return _names(spark, sf_dir).select("name", fn.surgery_type(F.concat(n, F.lit("/v"))).alias("stype"), fn.prefix_key(n).alias("prefix"), fn.video_id(n).alias("video_id"), fn.trailing_digits(n).alias("digits"), fn.alphanumeric(n).alias("plain"), fn.sort_number(n).alias("number"))


@query("test_membership", f"""with {_NAMES}, {_DIRS}, t as (select distinct lower(name) as k from names where name like 'ATLR%')
select dir, exists (select 1 from t where starts_with(lower(dir), k || '_')) as in_test from dirs""")
def test_membership(spark, sf_dir):
    """Directories with a flag: in the test list by id. Train is what is left."""
    test = _names(spark, sf_dir).where(F.col("name").startswith("ATLR")).select(F.lower("name").alias("id")).distinct().withColumn("in_test", F.lit(True))
    d = _dirs(spark, sf_dir).withColumn("id", F.regexp_extract(F.lower("dir"), "^([^_]*_[^_]*)_", 1))
    return d.join(test, "id", "left").select("dir", F.coalesce("in_test", F.lit(False)).alias("in_test"))


@query("train_minus_test", f"with {_NAMES}, {_DIRS} select distinct lower(dir) as dir from dirs except select distinct lower(name) || '_left' from names")
def train_minus_test(spark, sf_dir):
    a = _dirs(spark, sf_dir).select(F.lower("dir").alias("dir")).distinct()
    return a.join(_names(spark, sf_dir).select(F.concat(F.lower("name"), F.lit("_left")).alias("dir")), "dir", "left_anti")


@query("duplicate_names", f"with {_NAMES} select name, count(*) as n from names group by name having count(*) > 1")
def duplicate_names(spark, sf_dir):
    return _names(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


@query("annotated_union", "select user_id as video from events where event_type = 'click' union select o_custkey from orders where o_orderstatus = 'F'")
def annotated_union(spark, sf_dir):
    a = read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("video"))
    return a.union(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")).distinct()


# A written test list: with blanks, as the beginning of a folder, or under another name of one group.
_LISTED = """listed as (select 'D' || (p_partkey % 3) as dataset, case p_partkey % 4 when 0 then 'Case, ' || (p_partkey % 70) when 1 then ' vid' || (p_partkey % 90) when 2 then 'GP' || (p_partkey % 9) || 'x' else 'old/' || p_partkey end as name from part),
folders as (select distinct case c_custkey % 3 when 0 then 'D0' when 1 then 'disk1' else 'disk2' end as place, case c_custkey % 5 when 0 then 'Case_' || (c_custkey % 77) when 1 then 'vid' || (c_custkey % 91) when 2 then 'vid' || (c_custkey % 60) || '_left_' || (c_custkey % 2) when 3 then 'Patient' || (c_custkey % 9) || '_a' else 'old' || c_custkey end as folder from customer),
places as (select * from (values ('D1', 'disk1'), ('D1', 'disk2'), ('D2', 'disk2')) t(dataset, place)),
same as (select g as "group", p || g as prefix from range(0, 9) r(g), (values ('GP'), ('Patient')) t(p)),
asked as (select distinct dataset, trim(name) as name, coalesce(place, dataset) as place from listed left join places using (dataset)),
found as (select distinct dataset, name, place, folder from asked join folders using (place) where name = folder or starts_with(folder, name || '_')
  or replace(replace(replace(name, ', ', '_'), '/', ''), ' ', '_') = folder or exists (select 1 from same a, same b where a."group" = b."group" and starts_with(name, a.prefix) and starts_with(folder, b.prefix)))"""


def _listed(spark, sf_dir):
    """The test list, the folders, and what the list means."""
    k, c = F.col("p_partkey"), F.col("c_custkey")
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    name = F.when(k % 4 == 0, text("Case, ", k % 70)).when(k % 4 == 1, text(" vid", k % 90)).when(k % 4 == 2, text("GP", k % 9, "x")).otherwise(text("old/", k))
    listed = read(spark, sf_dir, "part").select(text("D", k % 3).alias("dataset"), name.alias("name"))
    folder = F.when(c % 5 == 0, text("Case_", c % 77)).when(c % 5 == 1, text("vid", c % 91)).when(c % 5 == 2, text("vid", c % 60, "_left_", c % 2)).when(c % 5 == 3, text("Patient", c % 9, "_a")).otherwise(text("old", c))
    folders = read(spark, sf_dir, "customer").select(F.when(c % 3 == 0, "D0").when(c % 3 == 1, "disk1").otherwise("disk2").alias("place"), folder.alias("folder"))
    places = spark.createDataFrame([("D1", "disk1"), ("D1", "disk2"), ("D2", "disk2")], "dataset string, place string")
    same = spark.createDataFrame([(g, f"{p}{g}") for g in range(9) for p in ("GP", "Patient")], "group int, prefix string")
    return listed, folders, selection.listed_folders(listed, folders, places, same)


@query("test_list_split", f"with {_LISTED} select f.place, f.folder, case when exists (select 1 from found x where x.place = f.place and x.folder = f.folder) then 'test' else 'train' end as split from folders f")
def test_list_split(spark, sf_dir):
    """Every folder in train or test by a written list."""
    _, folders, found = _listed(spark, sf_dir)
    return selection.split_by_list(folders, found)


@query("test_list_unmatched", f"with {_LISTED} select distinct dataset, name from asked a where not exists (select 1 from found f where f.dataset = a.dataset and f.name = a.name)")
def test_list_unmatched(spark, sf_dir):
    """Listed names that mean no folder."""
    listed, _, found = _listed(spark, sf_dir)
    return selection.unmatched(listed, found)


@query("chosen_videos", """select 'nation_' || c_nationkey as parent, c_name as video from customer where c_mktsegment <> 'BUILDING' and c_name <> 'Customer#000000007'
  and (contains(lower(c_name), '12') or contains('nation_' || c_nationkey, '12'))""")
def chosen_videos(spark, sf_dir):
    """Customers as videos in folders of nations: of known segments, but one, with a text in either name."""
    c = read(spark, sf_dir, "customer")
    videos = c.select(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("parent"), F.col("c_name").alias("video"))
    return selection.chosen_videos(videos, c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_name").alias("video")), ("Customer#000000007",), "12")
