"""Jaccard join of word-shingle sets by grouped prefixes.

A document is the set of its shingles of three words. Equal sets are one entry from the start. Shingles have one order over all
entries, the rare ones first; two sets of Jaccard likeness t or more share a shingle among the first n - ceil(t n) + 1 of
each, its prefix. Counting every shingle would move the whole corpus, so the order begins with those of a fixed fifth of all hash
values, by their exact number of entries, and a prefix rarely needs others, which follow by hash. A shingle of one entry can't be
shared: it takes its place in the prefix, but is left out of it. So most entries have an empty prefix and go no further.

Entries with one size and one prefix are a group, and what is indexed by prefix shingles are groups. In a shingle's bucket of few
members two groups that pass the filters of size and position are a pair; pairs are expanded to pairs of members, each once,
and verified on whole sets. A bucket of many members (of copies with edits, or a frequent passage that is the whole text of many) isn't
paired (of buckets with the same members one is enough): its members, cut by size into classes and by hash into tiles, meet tile by tile in tasks, where a sparse product
counts what all pairs have in common, each pair in the bucket of its first common shingle only, and only links that join
members still apart leave the task. Links, from both ways, make components.

Defined results: null and empty texts, and those without words, have an empty set and are linked with nothing; fewer than three
words are one shingle; rows of equal ids are told apart by their sets, so each has its own component; a component's id is its least
doc_id (null if none has one); further columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.bytewords import byte_words
from framesift.llm.graph import components
from framesift.llm.storage import map_frames, saved, scratch, unpacked
from framesift.llm.words import blocks, mix, shingles

RUN, LIKE = 3, 90
#: Hash values under this come first in the order, by their counts: a fifth of them all.
COUNTED = 2**64 // 5
#: Members of the largest bucket that is paired; members and shingles of a tile, about; ratio of sizes of a class; shingles of one product.
SMALL, TILE, TILE_SHINGLES, WIDTH = 128, 1000, 500_000, 2048
FAR = 1 << 32


def prefix_length(n: np.ndarray | int, like: int = LIKE):
    """How many of the first shingles of a set of n any set of this likeness (in hundredths) shares one of."""
    return n - (like * n + 99) // 100 + 1


def shingle_sets(texts: list) -> Iterator[np.ndarray]:
    """The sorted hashes of the different shingles of each text."""
    for _, block in blocks(texts):
        w = byte_words(block)
        for a, b in zip(w.bounds, w.bounds[1:], strict=False):
            yield np.unique(shingles(w.hash[a:b], RUN))


def _digests(documents: DataFrame, like: int) -> DataFrame:
    """doc_id, k (of the text), n, s0, s1 (128 bits of the set), tokens: hashes under COUNTED and, if those are fewer than a prefix has, the next ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for x in shingle_sets(frame["text"].tolist()):
                first = max(int(np.searchsorted(x, np.uint64(COUNTED))), int(prefix_length(len(x), like)) if len(x) else 0)
                rows.append((len(x), *(int(np.add.reduce(mix(x, s)).view(np.int64)) if len(x) else 0 for s in (41, 42)), x[:first].view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "s0", "s1", "tokens"])
            out.insert(0, "k", frame["k"].array)
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out

    return map_frames(_keyed(documents), run, "doc_id long, k long, n long, s0 long, s1 long, tokens array<long>")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("k"), "text")


def _counted(token: Column) -> Column:
    """Whether a hash, kept as a signed number, is under COUNTED."""
    return (token >= 0) & (token < COUNTED)


def _prefixes(entries: DataFrame, like: int) -> DataFrame:
    """e, n, alone (prefix shingles that no other entry has), prefix (the others in order) of entries with any."""
    each = entries.select("e", F.explode("tokens").alias("token"))
    count = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    early = _counted(F.col("token"))
    # The order: those under COUNTED by count, then the rest; each by hash as an unsigned number.
    place = F.struct((~early).alias("later"), F.when(early, F.col("df")).otherwise((F.col("token") < 0).cast("long")).alias("by"), "token")
    # Frequent shingles are many rows of one key of this join, which adaptive execution splits.
    own = each.join(count, "token").select("e", place.alias("t")).groupBy("e").agg(F.array_sort(F.collect_list("t")).alias("t"))
    held = entries.select("e", "n", F.size(F.filter("tokens", _counted)).alias("counted")).join(own, "e")
    first, rest = F.filter("t", lambda t: ~t["later"]), F.filter("t", lambda t: t["later"])
    length = (F.col("n") - F.floor((like * F.col("n") + 99) / 100) + 1).cast("int")
    held = held.select("e", "n", "counted", length.alias("length"), first.alias("first"), rest.alias("rest"))
    alone = F.col("counted") - F.size("first")
    kept = F.concat(F.slice("first", F.lit(1), F.greatest(F.col("length") - alone, F.lit(0))), F.col("rest"))
    return held.select("e", "n", F.least(alone, "length").alias("alone"), F.transform(kept, lambda t: t["token"]).alias("prefix")).where(F.size("prefix") > 0)


def _group_pairs(index: DataFrame, like: int) -> DataFrame:
    """g, h: pairs of groups (and groups with themselves) of a small bucket that sizes and places allow."""
    left = index.select("token", F.col("g").alias("g"), F.col("n").alias("n"), F.col("at").alias("at"), "members")
    right = index.select("token", F.col("g").alias("h"), F.col("n").alias("n_h"), F.col("at").alias("at_h"))
    sizes = 100 * F.least("n", "n_h") >= like * F.greatest("n", "n_h")
    # A pair's first common shingle leaves at most so many others in common.
    most = 1 + F.least(F.col("n") - F.col("at"), F.col("n_h") - F.col("at_h"))
    met = left.join(right, "token").where((F.col("g") < F.col("h")) | ((F.col("g") == F.col("h")) & (F.col("members") > 1)))
    return met.where(sizes).groupBy("g", "h").agg(F.max(F.when((100 + like) * most >= like * (F.col("n") + F.col("n_h")), 1).otherwise(0)).alias("ok")).where("ok = 1").select("g", "h")


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, like: int) -> np.ndarray:
    """Whether sets of a and b elements with so many in common are alike enough."""
    return (100 * common >= like * (a + b - common)) & (common > 0)


def _verified(pairs: DataFrame, sets: DataFrame, like: int) -> DataFrame:
    """The pairs (a, b) of entries whose whole sets are alike enough."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = np.zeros(len(frame), bool)
            for i, (x, y) in enumerate(zip(frame["xa"], frame["xb"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                got[i] = linked(np.intersect1d(x, y, assume_unique=True).size, len(x), len(y), like)
            yield frame[["a", "b"]][got]

    both = pairs.join(sets.select(F.col("e").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("e").alias("b"), F.col("x").alias("xb")), "b")
    return map_frames(both.select("a", "b", "xa", "xb"), check, "a long, b long")


def common_counts(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """How many elements each of some sets has in common with each set, by products of bounded width."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[value] > 1
    _, v = np.unique(value[keep], return_inverse=True)
    order = np.argsort(v, kind="stable")
    v, o = v[order], owner[keep][order]
    out = np.zeros((len(some), len(sets)), np.float32)
    for first in range(0, int(v[-1]) + 1 if len(v) else 0, WIDTH):
        lo, hi = np.searchsorted(v, (first, first + WIDTH))
        x = np.zeros((len(sets), int(v[hi - 1]) - first + 1), np.float32)
        x[o[lo:hi], v[lo:hi] - first] = 1
        out += x[some] @ x.T
    return out.astype(np.int64)


def links_within(token: int, e: np.ndarray, side: np.ndarray, label: np.ndarray, prefix: list[np.ndarray], sets: list[np.ndarray], like: int) -> list[tuple[int, int]]:
    """Links that join entries of one or two tiles which are still apart, of all pairs of different sides (if there are two) whose first common prefix shingle is this one."""
    size = np.array([len(x) for x in sets])
    before = [p[: int(np.flatnonzero(p == token)[0])] for p in prefix]
    # Members that share an earlier shingle meet in its bucket; so of two members one lacks the most frequent of these.
    flat = np.concatenate([*before, np.zeros(0, np.int64)])
    kinds, label = np.unique(label, return_inverse=True)
    choices = [np.flatnonzero(label != np.bincount(label).argmax())]
    if len(flat):
        value, n = np.unique(flat, return_counts=True)
        choices.append(np.flatnonzero([value[n.argmax()] not in x for x in before]))
    some = min(choices, key=len)
    if not len(some):
        return []
    good = linked(common_counts(sets, some), size[some][:, None], size[None, :], like) & (label[some][:, None] != label) & (common_counts(before, some) == 0)
    if side.min() != side.max():
        good &= side[some][:, None] != side
    x, y = np.nonzero(good)
    out = []
    for i, j in zip(some[x].tolist(), y.tolist(), strict=True):
        if label[i] != label[j]:
            out.append((int(e[i]), int(e[j])))
            label[label == label[i]] = label[j]
    return out


def _crowd(members: DataFrame, large: DataFrame) -> DataFrame:
    """e, n, prefix of the members of large buckets, with only these buckets' shingles; of buckets of the same members one stays."""
    places = members.select("e", "n", F.posexplode("prefix").alias("nth", "token")).join(large, "token")
    same = places.groupBy("token").agg(F.count("*").alias("all"), F.bit_xor(F.xxhash64("e")).alias("x"), F.bit_xor(F.xxhash64("e", F.lit(1))).alias("y"))
    kept = same.groupBy("all", "x", "y").agg(F.min("token").alias("token")).select("token")
    ordered = F.array_sort(F.collect_list(F.struct("nth", "token")))
    return places.join(kept, "token").groupBy("e", "n").agg(F.transform(ordered, lambda t: t["token"]).alias("prefix"))


def _large_links(members: DataFrame, sets: DataFrame, label: DataFrame, like: int) -> DataFrame:
    """Links (a, b) of entries that share a bucket of many members, tile by tile. members: as _crowd gives."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        got = links_within(
            int(frame["token"].iloc[0]), frame["e"].to_numpy(), frame["tile"].to_numpy(), frame["label"].to_numpy(),
            [np.asarray(x) for x in frame["prefix"]], [np.frombuffer(x, np.uint64) for x in frame["x"]], like,
        )
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    # Sets of one likeness are in one class of sizes or in neighbouring ones; a tile is a number, its class times FAR and its part.
    kind = F.floor(F.ln(F.col("n").cast("double")) / F.lit(-float(np.log(like / 100)) * (1 + 1e-9))).cast("long")
    places = members.select("e", "n", kind.alias("class"), F.explode("prefix").alias("token"))
    parts = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("long")
    tiles = saved(places.groupBy("token", "class").agg(parts.alias("parts")), "tiles")
    beside = lambda step, name: tiles.select("token", (F.col("class") + step).alias("class"), F.col("parts").alias(name))
    around = tiles.join(beside(1, "below"), ["token", "class"], "left").join(beside(-1, "above"), ["token", "class"], "left").fillna(0, ["below", "above"])
    span = lambda step, n: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda p: (F.col("class") + step) * FAR + p)).otherwise(F.array().cast("array<bigint>"))
    tile = F.col("class") * FAR + F.pmod(F.xxhash64("e", "token"), F.col("parts"))
    held = places.join(around, ["token", "class"]).select("e", F.struct("token", tile.alias("tile"), F.concat(span(0, "parts"), span(-1, "below"), span(1, "above")).alias("met")).alias("p"))
    asked = held.groupBy("e").agg(F.collect_list("p").alias("asked"))
    whole = members.select("e", "prefix").join(asked, "e").join(sets, "e").join(label, "e", "left").select("e", "prefix", F.coalesce("label", "e").alias("label"), "x", F.explode("asked").alias("p"))
    spread = whole.select("e", "prefix", "label", "x", "p.token", "p.tile", F.explode("p.met").alias("other")).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    return spread.drop("other").groupBy("token", "lo", "hi").applyInPandas(compare, "a long, b long")


def _sets(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """e, x (the set's sorted hashes as bytes) of these entries, from one row's text each. Texts move compressed, once."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "k": frame["k"], "packed": [c.compress((t or "").encode("utf-8", "replace")) for t in frame["text"]]})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), 100):
                part = frame.iloc[first : first + 100]
                yield pd.DataFrame({"e": part["e"].to_numpy(), "x": [x.tobytes() for x in shingle_sets([unpacked(b).decode() for b in part["packed"]])]})

    texts = map_frames(_keyed(documents), pack, "doc_id long, k long, packed binary")
    own = entries.withColumnRenamed("k", "key")
    met = texts.join(own.hint("merge"), (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return map_frames(met.select("e", "packed").dropDuplicates(["e"]), cut, "e long, x binary")


def jaccard_components(documents: DataFrame, like: int = LIKE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    with scratch(documents.sparkSession) as keep:
        with scratch(documents.sparkSession) as keep_part:  # hashes go when prefixes are there
            digests = saved(_digests(documents, like), "digests")
            one = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k"))  # a row with the least id
            whole = digests.where("n > 0").groupBy("s0", "s1", "n").agg(one.alias("one"), F.first("tokens").alias("tokens"))
            whole = saved(whole.select("s0", "s1", "n", F.col("one.doc_id").alias("id"), "one.k", "tokens").withColumn("e", F.monotonically_increasing_id()), "whole")
            rows, entries = keep_part(digests.drop("tokens", "k"), "rows"), keep_part(whole.drop("tokens"), "entries")
            members = keep_part(_prefixes(whole, like), "prefixes")
        rows = keep(rows, "rows")
        groups = saved(members.groupBy("n", "alone", "prefix").agg(F.min("e").alias("g"), F.count("*").alias("members")), "groups")
        index = groups.select("g", "n", "members", "alone", F.posexplode("prefix").alias("nth", "token")).select("g", "n", "members", (F.col("alone") + F.col("nth") + 1).alias("at"), "token")
        size = saved(index.groupBy("token").agg(F.sum("members").alias("all")).where("all > 1"), "buckets")
        small, large = (size.where(f"all {x} {SMALL}").select("token") for x in ("<=", ">"))
        pairs = saved(_group_pairs(index.join(small, "token"), like), "group-pairs")
        # Groups' members: a pair of different groups gives each two of them, a group with itself each two once.
        named = members.join(groups.select("n", "alone", "prefix", "g"), ["n", "alone", "prefix"]).select("g", "e")
        expanded = pairs.join(named.withColumnRenamed("e", "a"), "g").join(named.select(F.col("g").alias("h"), F.col("e").alias("b")), "h").where("g < h or a < b").select("a", "b")
        expanded = saved(expanded, "pairs")
        crowd = saved(_crowd(members, large), "crowd")
        asked = expanded.select(F.col("a").alias("e")).union(expanded.select("b")).union(crowd.select("e")).distinct()
        sets = saved(_sets(documents, entries.join(asked, "e", "left_semi").select("e", "id", "k")), "sets")
        links = saved(_verified(expanded, sets, like), "links")
        label = components(links).withColumnRenamed("id", "e")
        more = saved(_large_links(crowd, sets, label, like), "large-links")
        label = components(links.unionByName(more)).select(F.col("id").alias("e"), "label")
        own = entries.select("s0", "s1", "n", "e", "id").join(label, "e", "left").withColumn("label", F.coalesce("label", "e"))
        own = saved(own, "labels")
        least = own.groupBy("label").agg(F.min("id").alias("component_id"))
        named = keep(own.join(least, "label").select("s0", "s1", "n", "component_id"), "components")
    return rows.select("doc_id", "n", "s0", "s1").join(named, ["s0", "s1", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Each document's number of shingles and component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as materialized (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from words where len(w) > 0)),
size as materialized (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as materialized (
  select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
arcs as materialized (select a, b from links union select b, a from links),
reach(a, b) as (select a, a from arcs union select r.a, l.b from reach r join arcs l on l.a = r.b)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(m.least, d.doc_id)::bigint as component_id
from documents d left join size s using (doc_id) left join (select a, min(b) as least from reach group by a) m on m.a = d.doc_id
"""
