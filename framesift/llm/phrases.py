"""Collocations: phrases that occur more often than their parts let expect.

Counting is done in tries of three levels: a path of words from the root is a phrase, and a node holds how often it occurs.
Every shard of documents (about SHARD bytes of text) becomes one trie, in numpy arrays in the order of its paths, a word being its
hash together with its language. A trie is serialised in that order (for each node its depth, last word and count, so common
beginnings are stored once) and cut at the same paths as all others: a piece is what a shard has in one range of paths, after
the ancestors of its first path. Each range is merged in a task of its own and holds a bounded part of all tries, whatever
words are frequent, as a range may begin below any node.

Nodes of at least `least` occurrences remain; every part of such a phrase is such a node as well. A walk down the merged
trie gives the counts of the left parts (where an ancestor lies in an earlier range, a join does). A node's suffix link (the
path without its first word) is a join of the remaining nodes with themselves, and gives the right parts. Scores are exact whole numbers of up to 38 digits.

Where ranges are cut comes from a sample of documents; it decides only how evenly work is dealt out.

Defined results: null and empty texts have no words; a null language counts as `und`; repeated rows count as often as they
occur; doc_id and further columns are ignored; no documents give no rows. Two words of one 64-bit hash raise an error; `seed` gives other hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.bytewords import BLANKS, STOPS, ByteWords, byte_words
from framesift.llm.storage import ROWS, saved, scratch
from framesift.llm.words import mix

#: Characters of text of a shard, of a range and of the sample for the cuts, about.
SHARD, RANGE, SAMPLE = 4_000_000, 2_000_000, 4_000_000
#: Words of the longest phrases; least occurrences; phrases of a language; share in hundredths of a phrase's occurrences in a longer one from which it is dropped.
DEPTH, LEAST, KEEP, COVER = 3, 10, 2000, 50
_PIECE = "range int, depth binary, word binary, n binary, words array<string>, langs array<string>"
_NODE = "depth int, h1 long, h2 long, h3 long, f long, l1 long, l2 long, word string, lang string"


def _hashed(texts: list, langs: list, seed: int) -> tuple[np.ndarray, list[np.ndarray], ByteWords]:
    """The hash of each word, those of the words that follow it in its piece (0 beyond the end), and the words."""
    w = byte_words(texts, BLANKS, STOPS)
    kinds = {x: int.from_bytes(blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little") for x in set(langs)}
    own = np.repeat(np.array([kinds[x] for x in langs], np.uint64), np.diff(w.bounds))
    h = np.maximum(mix(w.hash ^ own, seed), np.uint64(1))
    ahead = []
    for k in range(1, DEPTH):
        same = np.zeros(len(h), bool)
        same[:-k] = w.piece[k:] == w.piece[:-k]
        ahead.append(np.where(same, np.roll(h, -k), np.uint64(0)))
    return h, ahead, w


class Trie:
    """Nodes in the order of their paths: h (nodes x DEPTH words, 0 after a path's end), n (occurrences) and depth (words of a path)."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        self.h, self.n = np.asfortranarray(h), n
        self.depth = (self.h != 0).sum(1)

    @classmethod
    def merged(cls, parts: list[np.ndarray], counts: list[np.ndarray]) -> Trie:
        """The trie of sorted runs of paths; counts of equal paths are added up."""
        h, n = np.concatenate(parts), np.concatenate(counts).astype(np.int64)
        if not len(h):
            return cls(h, n)
        order = np.lexsort(h.T[::-1])
        h, n = h[order], n[order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(1)])
        return cls(h[new], np.add.reduceat(n, new))

    @classmethod
    def grown(cls, h: np.ndarray, ahead: list[np.ndarray]) -> Trie:
        """The trie of the phrases that begin at each word. Words are numbered in the order of their hashes, so a path is one number."""
        known, nth = np.unique(h, return_inverse=True)
        base = len(known) + 1
        if base**DEPTH >= 2**63:
            raise ValueError("a shard has too many different words")
        number = [nth.astype(np.int64) + 1, *(np.where(x == 0, 0, np.searchsorted(known, x) + 1) for x in ahead)]
        code, kinds, counts = np.zeros(len(h), np.int64), [], []
        for k, x in enumerate(number):
            code = (code + x * base ** (DEPTH - 1 - k))[x > 0] if k else code + x * base ** (DEPTH - 1)
            number[k + 1 :] = [y[x > 0] for y in number[k + 1 :]]
            kind, n = np.unique(code, return_counts=True)
            kinds.append(kind)
            counts.append(n)
        kinds, counts = np.concatenate(kinds), np.concatenate(counts)
        order = np.argsort(kinds, kind="stable")
        kinds, named = kinds[order], np.r_[np.uint64(0), known]
        return cls(np.stack([named[kinds // base ** (DEPTH - 1 - k) % base] for k in range(DEPTH)], 1), counts[order])

    def find(self, path: tuple) -> int:
        """Place of the first node that isn't before this path, by a walk down."""
        lo, hi = 0, len(self.n)
        for k, x in enumerate(path):
            part = self.h[lo:hi, k]
            a, b = np.searchsorted(part, np.uint64(x)), np.searchsorted(part, np.uint64(x), "right")
            if a == b:
                return lo + int(a)
            lo, hi = lo + int(a), lo + int(b)
        return lo

    def above(self, values: np.ndarray, k: int) -> np.ndarray:
        """For each node the value of its ancestor of k words (itself, if it has k). Every node's ancestors are in the trie."""
        return values[np.maximum.accumulate(np.where(self.depth == k, np.arange(len(self.n)), 0))]

    def dump(self, lo: int, hi: int) -> tuple[bytes, bytes, bytes]:
        """The nodes from lo to hi, after the ancestors of the first one with count 0, as depths, last words and counts."""
        d = self.depth[lo:hi]
        head = np.arange(1, d[0], dtype=d.dtype)
        last = self.h[np.arange(lo, hi), d - 1]
        return np.r_[head, d].astype(np.uint8).tobytes(), np.r_[self.h[lo, : len(head)], last].tobytes(), np.r_[np.zeros(len(head), np.int64), self.n[lo:hi]].astype(np.uint32).tobytes()

    @classmethod
    def load(cls, depth: bytes, word: bytes, n: bytes) -> Trie:
        d, w = np.frombuffer(depth, np.uint8).astype(np.int64), np.frombuffer(word, np.uint64)
        at = np.arange(len(d))
        h = [np.where(d > k, w[np.maximum.accumulate(np.where(d == k + 1, at, 0))], np.uint64(0)) for k in range(DEPTH)]
        return cls(np.stack(h, 1), np.frombuffer(n, np.uint32).astype(np.int64))


def _cuts(texts: DataFrame, size: int, seed: int) -> list[tuple]:
    """Paths that cut the tries into even ranges of about RANGE characters of text, from a sample of documents."""
    ranges = -(-size // RANGE)
    if ranges < 2:
        return []
    one_in = max(1, size // SAMPLE)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                h, ahead, _ = _hashed(part.column(1).to_pylist(), part.column(0).to_pylist(), seed)
                path = [h, *ahead]
                pick = mix(path[0] ^ mix(path[1] ^ mix(path[2], 31), 32), 33) % np.uint64(16) == 0
                yield pa.RecordBatch.from_arrays([pa.array(x[pick].view(np.int64)) for x in path], ["h1", "h2", "h3"])

    sample = texts.where(F.pmod(F.xxhash64("lang", "text"), F.lit(one_in)) == 0)
    got = sample.mapInArrow(some, "h1 long, h2 long, h3 long").distinct().toArrow()
    h = np.stack([got.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in range(DEPTH)], 1)
    h = h[np.lexsort(h.T[::-1])]
    at = np.unique(np.arange(1, ranges) * len(h) // ranges) if len(h) else []
    return [tuple(int(x) for x in h[i]) for i in at]


def _pieces(texts: DataFrame, cuts: list[tuple], seed: int) -> DataFrame:
    """The shards' tries in pieces: a row for each range in which a shard has nodes."""
    kind = pa.schema([("range", pa.int32()), ("depth", pa.binary()), ("word", pa.binary()), ("n", pa.binary()), ("words", pa.list_(pa.string())), ("langs", pa.list_(pa.string()))])

    def shard(held: list, langs: list) -> Iterator[pa.RecordBatch]:
        h, ahead, w = _hashed(held, langs, seed)
        if not len(h):
            return
        t = Trie.grown(h, ahead)
        known, at = np.unique(h, return_index=True)
        named = [w.raw[a:b].tobytes().decode() for a, b in zip(w.start[at], w.end[at], strict=True)]
        spoken = [langs[i] for i in np.searchsorted(w.bounds, at, "right") - 1]
        ends = [0, *(t.find(c) for c in cuts), len(t.n)]
        first = t.depth == 1
        upto = np.r_[0, np.cumsum(first)]  # nodes of one word, each once, in the order of known
        for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            if lo < hi:
                own = slice(int(upto[lo]), int(upto[hi]))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((k, *t.dump(lo, hi), named[own], spoken[own]), kind, strict=True)], schema=kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, langs, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(text)
                langs.append(lang)
                size += len(text)
                if size >= SHARD:
                    yield from shard(held, langs)
                    held, langs, size = [], [], 0
        yield from shard(held, langs)

    return texts.mapInArrow(work, _PIECE)


def _merged(pieces: DataFrame, cuts: list[tuple], least: int) -> DataFrame:
    """Nodes of at least `least` occurrences, with the counts of their left parts (0 where those are in an earlier range); depth 0: the words of a language in a range."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["range"].iloc[0])
        runs = [Trie.load(d, w, n) for d, w, n in zip(frame["depth"], frame["word"], frame["n"], strict=True)]
        t = Trie.merged([r.h for r in runs], [r.n for r in runs])
        # What a shard says of its own nodes of one word, which follow the ancestors of its first node.
        own = [r.h[(r.depth == 1) & (r.n > 0), 0] for r in runs]
        said = pd.DataFrame({"h": np.concatenate(own), "word": np.concatenate([*frame["words"]]), "lang": np.concatenate([*frame["langs"]])}).drop_duplicates()
        if said["h"].duplicated().any():
            raise ValueError("two words have one hash; another seed is needed")
        said = said.sort_values("h")
        one = (t.depth == 1) & (t.n > 0)
        word, lang = np.full(len(t.n), None, object), np.full(len(t.n), None, object)
        word[one], lang[one] = said["word"], said["lang"]
        total = pd.DataFrame({"lang": lang[one], "f": t.n[one]}).groupby("lang", as_index=False)["f"].sum()
        keep = np.flatnonzero(t.n >= least)
        left = [t.above(t.n, j)[keep] for j in (1, 2)]
        out = pd.DataFrame({"depth": t.depth[keep], "f": t.n[keep], "l1": left[0], "l2": np.where(t.depth[keep] < 3, 0, left[1]), "word": t.above(word, 1)[keep], "lang": t.above(lang, 1)[keep]})
        for j in range(DEPTH):
            out[f"h{j + 1}"] = t.h[keep, j].view(np.int64) if len(keep) else np.zeros(0, np.int64)
        zero = total.assign(depth=0, l1=0, l2=0, word=None, h1=0, h2=0, h3=0)
        return pd.concat([out, zero])[["depth", "h1", "h2", "h3", "f", "l1", "l2", "word", "lang"]]

    return pieces.groupBy("range").applyInPandas(merge, _NODE)


def counted(documents: DataFrame, least: int = LEAST, seed: int = 0) -> DataFrame:
    """The merged tries' nodes as a written table: depth, h1, h2, h3, f, l1, l2 (0 where unknown), word and lang of the first word (null where unknown)."""
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = _cuts(texts, texts.agg(F.sum(F.length("text"))).first()[0] or 0, seed)
    return saved(_merged(_pieces(texts, cuts, seed), cuts, least), "nodes")


def _score(a: Column, left: Column, right: Column, k: int) -> Column:
    """The cut after k words; of cuts the least is taken: the lowest score, then the smallest k."""
    big = lambda c: c.cast("decimal(19,0)")
    whole = F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))
    return F.struct(whole.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def collocations(documents: DataFrame, least: int = LEAST, most: int = KEEP, cover: int = COVER, seed: int = 0) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the first `most` phrases of each language."""
    with scratch(documents.sparkSession) as keep:
        nodes = counted(documents, least, seed)
        one = nodes.where("depth = 1").select(F.col("h1").alias("h"), F.col("f").alias("f_h"), F.col("word").alias("word_h"), "lang")
        two, three = nodes.where("depth = 2"), nodes.where("depth = 3")
        # Ancestors in an earlier range: only nodes at the beginnings of ranges.
        known, open_ = nodes.where("depth > 1 and l1 > 0"), nodes.where("depth > 1 and l1 = 0").drop("l1", "word", "lang").withColumnRenamed("h1", "h")
        found = open_.join(one, "h").select("depth", F.col("h").alias("h1"), "h2", "h3", "f", F.col("f_h").alias("l1"), "l2", F.col("word_h").alias("word"), "lang")
        nodes2 = known.select(found.columns).unionByName(found)
        pair = two.select("h1", "h2", F.col("f").alias("f_pair"))
        inner, cut = nodes2.where("depth = 2 or l2 > 0"), nodes2.where("depth = 3 and l2 = 0").drop("l2")
        held = saved(inner.unionByName(cut.join(pair, ["h1", "h2"]).withColumnRenamed("f_pair", "l2")), "left")
        # Suffix links: of two words to the second; of three to the last two, and by that node's own link to the last.
        last = held.where("depth = 2").join(one.select(F.col("h").alias("h2"), F.col("f_h").alias("r1")), "h2")
        two = saved(last.select("h1", "h2", "f", "l1", "r1", "word", "lang"), "two")
        link = two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("f").alias("r1"), F.col("r1").alias("r2"))
        three = saved(held.where("depth = 3").join(link, ["h2", "h3"]).select("h1", "h2", "h3", "f", "l1", "l2", "r1", "r2", "word", "lang"), "three")
        longer = three.select("h1", "h2", "f").unionByName(three.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "f")).groupBy("h1", "h2").agg(F.max("f").alias("longer"))
        alone = two.join(longer, ["h1", "h2"], "left").where(~F.coalesce(100 * F.col("longer") >= cover * F.col("f"), F.lit(False)))
        f = F.col("f")
        cut2 = _score(f, F.col("l1"), F.col("r1"), 1)
        cut3 = F.least(cut2, _score(f, F.col("l2"), F.col("r2"), 2))
        every = alone.select("lang", "word", "h2", F.lit(0).cast("long").alias("h3"), F.col("f").alias("a"), cut2.alias("c")).unionByName(three.select("lang", "word", "h2", "h3", F.col("f").alias("a"), cut3.alias("c")))
        best = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"))
        near = saved(every.withColumn("place", F.rank().over(best)).where(F.col("place") <= most), "best")
        names = lambda c: one.select(F.col("h").alias(c), F.col("word_h").alias(f"w_{c}"))
        pairs = near.where("h3 = 0").join(names("h2"), "h2").select("lang", "a", "c", F.concat_ws(" ", "word", "w_h2").alias("phrase"))
        triples = near.where("h3 <> 0").join(names("h2"), "h2").join(names("h3"), "h3").select("lang", "a", "c", F.concat_ws(" ", "word", "w_h2", "w_h3").alias("phrase"))
        order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
        ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
        n = nodes.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
        return keep(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score"), "collocations")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of the documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
cut as (select row_number() over () as id, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
words as (select id, lang, unnest(w) as x, generate_subscripts(w, 1) as i from cut),
runs as (select lang, x as x1, lead(x) over o as x2, lead(x, 2) over o as x3 from words window o as (partition by id order by i)),
f1 as materialized (select lang, x1, count(*) as f from runs group by all),
f2 as materialized (select lang, x1, x2, count(*) as f from runs where x2 is not null group by all having count(*) >= 10),
f3 as materialized (select lang, x1, x2, x3, count(*) as f from runs where x3 is not null group by all having count(*) >= 10),
n as (select lang, sum(f)::bigint as n from f1 group by lang),
longer as (
  select lang, x1, x2, max(f) as most from (select lang, x1, x2, f from f3 union all select lang, x2, x3, f from f3) group by all),
cuts as (
  select c.lang, c.x1 || ' ' || c.x2 as phrase, c.f as a, 1 as k, l.f as l, r.f as r
  from f2 c join f1 l on l.lang = c.lang and l.x1 = c.x1 join f1 r on r.lang = c.lang and r.x1 = c.x2
       left join longer m on m.lang = c.lang and m.x1 = c.x1 and m.x2 = c.x2
  where not coalesce(100 * m.most >= 50 * c.f, false)
  union all
  select c.lang, c.x1 || ' ' || c.x2 || ' ' || c.x3, c.f, 1, l.f, r.f
  from f3 c join f1 l on l.lang = c.lang and l.x1 = c.x1 join f2 r on r.lang = c.lang and r.x1 = c.x2 and r.x2 = c.x3
  union all
  select c.lang, c.x1 || ' ' || c.x2 || ' ' || c.x3, c.f, 2, l.f, r.f
  from f3 c join f2 l on l.lang = c.lang and l.x1 = c.x1 and l.x2 = c.x2 join f1 r on r.lang = c.lang and r.x1 = c.x3),
scored as (
  select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts
  qualify row_number() over (partition by lang, phrase order by (1000000::hugeint * a * a) // (l::hugeint * r), k) = 1)
select lang, row_number() over w as rank, phrase, a, l, r, n, score from scored join n using (lang)
window w as (partition by lang order by score desc, a desc, phrase)
qualify row_number() over w <= 2000
"""
