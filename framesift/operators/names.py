"""Name resolution: which directory a name means, by rules in order of rank.

Rules are equi joins on derived keys, one for each rule. Containment is one too: a name meets the directories that hold
its rarest part of GRAM characters, and is then looked for in them. So no list is broadcast or compared with all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions import names as fn

#: Characters of the parts of names by which directories that contain them are found; shorter names are a part themselves.
GRAM = 3


def _beginnings(text: Column) -> Column:
    """A directory's name up to each of its dashes and underscores."""
    ends = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)).isin("_", "-"))
    return F.transform(ends, lambda i: F.substring(text, F.lit(1), i - 1))


def _keys(text: Column) -> Column:
    """A directory's name up to each of its dashes and underscores, and the whole name."""
    return F.concat(_beginnings(text), F.array(text))


def _parts(text: Column, k: int) -> Column:
    """All parts of k characters, each once; none of shorter texts."""
    last = F.length(text) - k + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def containing(names: DataFrame, low: DataFrame) -> DataFrame:
    """name, dir, nth of every directory (dir, nth, low: where to look) that contains a name; an empty name has the first one only.
    Case is ignored; null names and directories meet none."""
    asked = names.select("name", F.lower("name").alias("n")).distinct().where("n is not null")
    own = F.when(F.length("n") < GRAM, F.array("n")).otherwise(_parts(F.col("n"), GRAM))
    held = low.select("dir", "nth", "low", F.explode(F.concat(*(_parts(F.col("low"), k) for k in range(1, GRAM + 1)))).alias("part"))
    often = held.groupBy("part").agg(F.count("*").alias("often"))
    each = asked.select("name", "n", F.explode(own).alias("part")).join(often, "part", "left")
    rarest = each.groupBy("name", "n").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "part"))["part"].alias("part"))
    found = rarest.join(held, "part").where(F.contains("low", "n")).select("name", "dir", "nth")
    first = low.where("low is not null").agg(F.min(F.struct("nth", "dir")).alias("d")).where("d is not null")
    return found.unionByName(asked.where("n = ''").join(F.broadcast(first)).select("name", "d.dir", "d.nth"))


def resolve(names: DataFrame, dirs: DataFrame, pair: tuple[str, str] = ("RS", "TL"), contains: bool = True) -> DataFrame:
    """name, dir, rule: for each spelling of the name in turn its equal, then the first directory that is the id or begins with it
    and a dash or underscore; last the first directory that contains the name. Case is ignored; null if nothing fits.

    dirs: dir, nth (their order)."""
    low = dirs.select("dir", "nth", F.lower("dir").alias("low"))
    spelled = names.select("name").distinct().select("name", F.posexplode(fn.id_variants(F.col("name"), pair)).alias("v", "spelling"))
    asked = spelled.select("name", "v", F.lower("spelling").alias("spelling"), F.lower(fn.video_id(F.col("spelling"))).alias("id"))
    exact = asked.join(low, F.col("spelling") == F.col("low")).select("name", "dir", "nth", (F.col("v") * 2).alias("rank"), F.lit("exact").alias("rule"))
    begun = low.select("dir", "nth", F.explode(F.array_distinct(_keys(F.col("low")))).alias("id"))
    by_id = asked.join(begun, "id").select("name", "dir", "nth", (F.col("v") * 2 + 1).alias("rank"), F.lit("id").alias("rule"))
    found = exact.unionByName(by_id)
    if contains:
        held = containing(names, low)
        found = found.unionByName(held.select("name", "dir", "nth", F.lit(100).alias("rank"), F.lit("contains").alias("rule")))
    best = found.groupBy("name").agg(F.min(F.struct("rank", "nth", "dir", "rule")).alias("b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.col("b.dir").alias("dir"), F.col("b.rule").alias("rule"))


def resolve_by_prefix(names: DataFrame, dirs: DataFrame) -> DataFrame:
    """name, dir: the older rules. The equal of the last path part; else the first directory that begins with the name's prefix key
    and a dash or underscore, or contains the name."""
    low = dirs.select("dir", "nth", F.lower(F.substring_index("dir", "/", -1)).alias("low"))
    asked = names.select("name", F.lower("name").alias("n"), F.lower(fn.prefix_key(F.col("name"))).alias("p")).distinct()
    begun = low.select("dir", "nth", F.explode(F.array_distinct(_beginnings(F.col("low")))).alias("p"))
    hits = asked.join(low, F.col("n") == F.col("low")).select("name", F.lit(0).alias("rank"), "nth", "dir")
    for more in (asked.join(begun, "p"), containing(names, low)):
        hits = hits.unionByName(more.select("name", F.lit(1).alias("rank"), "nth", "dir"))
    best = hits.groupBy("name").agg(F.min(F.struct("rank", "nth", "dir"))["dir"].alias("dir"))
    return names.select("name").distinct().join(best, "name", "left")


def match_digits(stems: DataFrame, candidates: DataFrame) -> DataFrame:
    """stem, match: candidates with the same trailing number of four digits or more, the first in alphabetical order; else the stem itself."""
    long_ones = lambda c: F.when(F.length(fn.trailing_digits(c)) >= 4, fn.trailing_digits(c))
    first = candidates.groupBy(long_ones(F.col("candidate")).alias("digits")).agg(F.min("candidate").alias("match")).where("digits is not null")
    return stems.withColumn("digits", long_ones(F.col("stem"))).join(first, "digits", "left").select("stem", F.coalesce("match", "stem").alias("match"))


def collisions(resolved: DataFrame) -> DataFrame:
    """dir, n: directories that several names mean."""
    return resolved.where("dir is not null").groupBy("dir").agg(F.count("*").alias("n")).where("n > 1")


def match_stems(stems: DataFrame, candidates: DataFrame, pair: tuple[str, str] = ("RS", "TL")) -> DataFrame:
    """stem, match, rule: the first candidate (in alphabetical order within a rule) by, in turn, equality, beginning with the stem and a
    dash or underscore, beginning with its prefix key (for names of the pair; a separator must follow), the same trailing number of
    four digits or more, that number as a whole number anywhere; else the stem itself. Case is ignored."""
    s = stems.select("stem").distinct().withColumn("low", F.lower("stem"))
    c = candidates.select("candidate").distinct().withColumn("clow", F.lower("candidate"))
    marked = F.regexp_like("low", F.lit(rf"^({pair[0].lower()}|{pair[1].lower()})[-_]"))
    keys = c.select("candidate", F.explode(F.array_distinct(_keys(F.col("clow")))).alias("key"))
    numbers = c.select("candidate", F.explode(F.array_distinct(F.regexp_extract_all("clow", F.lit(r"(\d+)"), 1))).alias("key"))
    digits = F.when(F.length(fn.trailing_digits(F.col("low"))) >= 4, fn.trailing_digits(F.col("low")))
    s = s.withColumns({"digits": digits, "prefix": F.when(marked, fn.prefix_key(F.col("low")))})
    parts = [
        s.join(c, F.col("low") == F.col("clow")).select("stem", "candidate", F.lit(1).alias("rule")),
        s.join(keys, F.col("low") == F.col("key")).select("stem", "candidate", F.lit(2).alias("rule")),
        s.join(keys, F.col("prefix") == F.col("key")).select("stem", "candidate", F.lit(3).alias("rule")),
        s.join(c.withColumn("end", fn.trailing_digits(F.col("clow"))), F.col("digits") == F.col("end")).select("stem", "candidate", F.lit(4).alias("rule")),
        s.join(numbers, F.col("digits") == F.col("key")).select("stem", "candidate", F.lit(5).alias("rule")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy("stem").agg(F.min(F.struct("rule", "candidate")).alias("b"))
    return s.select("stem").join(best, "stem", "left").select("stem", F.coalesce("b.candidate", "stem").alias("match"), F.coalesce("b.rule", F.lit(0)).alias("rule"))


def with_record_number(names: DataFrame, dirs: DataFrame, resolved: DataFrame) -> DataFrame:
    """name, dir: as resolved; names without a directory take the first one with the same record number. Directories are reduced to the
    first of each number before names meet them, so a name meets one."""
    mine = names.select("name", fn.record_number(F.col("name")).alias("record")).where("record is not null").distinct()
    theirs = dirs.select("dir", "nth", fn.record_number(F.concat("dir", F.lit("/"))).alias("record")).where("record is not null")
    first = theirs.groupBy("record").agg(F.min(F.struct("nth", "dir"))["dir"].alias("d"))
    by_record = mine.join(first, "record").select("name", "d")
    return resolved.join(by_record, "name", "left").select("name", F.coalesce("dir", "d").alias("dir"))
