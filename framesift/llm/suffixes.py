"""Suffix-array dedup: byte strings of a given length that also start earlier are removed.

Windows of `length` bytes are dealt out by content so that equal windows meet: a window's key is its least 24-byte gram
(leftmost among equals), and neighbouring windows with the same gram at the same place form a region. Equal regions
under one key repeat each other as a whole; the first of each kind stands for it. Where a key has regions of several
kinds, these are compared by the suffixes of the collection: its Burrows-Wheeler transform and common prefixes are built
column by column, one symbol of each region a round from the last one back, each round one sequential pass over what is
there. Suffixes that share `length` bytes are equal windows; all but the earliest are repeats.

Between steps rows are in Parquet tables or shuffles in the cluster's shared folders; a task holds one collection
of BATCH regions (more only if one key has more kinds, up to MOST). The regions of a key with more kinds are dealt out again by
a second key, and then a third: by the part of the window that the gram stands in and the bytes that all windows of that
part have in common. The same is done with those: equal ones repeat each other, kinds are compared as a collection. The
last parts are single windows, of which a key has one kind; so memory is bounded whatever repeats how often.

Defined results: null and empty texts have no bytes; texts shorter than `length` lose nothing; bytes are those of
UTF-8; rows with equal ids count as one document and lose the same places; rows without an id stand nowhere in the order
of documents, so they stay whole and remove nothing elsewhere; an empty table gives an empty one; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from framesift.llm.storage import by_bytes, map_frames, packed, saved, unpacked
from framesift.llm.words import mix

LENGTH, GRAM = 100, 24
#: Regions in one collection; kinds of regions of one key that are still compared as a collection.
BATCH, MOST = 1500, 20_000
#: Parts of the gram's places in a window, of the second key.
PARTS = 4
#: Share of the documents that is looked at for frequent keys, occurrences there that make a key frequent, the most such keys, and tasks over which one kind of such a key is spread. These decide where rows are sorted, never what is found.
SAMPLE, OFTEN, FREQUENT, SALTS = 1 / 64, 8, 10_000, 32
_P = 0x9E3779B97F4A7C15


def _grams(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling."""
    block, size, out, done = raw.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = block, size
            else:
                n = len(raw) - done - size + 1
                out = out[:n] * np.uint64(pow(_P, size, 2**64)) + block[done : done + n]
                done += size
        if size * 2 > k:
            return mix(out, 9)
        block = block[:-size] * np.uint64(pow(_P, size, 2**64)) + block[size:]
        size *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:n], x[width - k : width - k + n]) if k < width else x[:n]


def regions(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, first and last window start and place of the gram of the regions of some texts in one array; bounds: where texts begin and end."""
    if len(raw) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _grams(raw, gram)
    bits = np.uint64(max(21, int(len(raw)).bit_length()))
    place = np.arange(len(h), dtype=np.uint64)
    low = _least(((h >> bits) << bits) | place, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(text[: len(low)] == text[length - 1 : length - 1 + len(low)])  # windows inside one text
    at = low[whole].astype(np.int64)
    new = np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)] if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return h[at[begin]], whole[begin], whole[np.r_[begin[1:], len(at)] - 1] if len(at) else begin, at[begin]


def cores(strings: list[bytes], gram_at: np.ndarray, length: int, parts: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of the gram's possible places in a window: the regions that have windows of it, the first and last of these
    windows, and a hash of the bytes around the gram that any window of the part holds."""
    last, room = np.array([len(b) for b in strings], np.int64) - length, length - gram + 1
    for k in range(parts):
        a, b = room * k // parts, room * (k + 1) // parts - 1
        begin, end = np.maximum(gram_at - b, 0), np.minimum(gram_at - a, last)
        fits = np.flatnonzero(begin <= end)
        left, right = gram_at[fits] - a, gram_at[fits] - b + length
        core = np.array([xxhash.xxh3_64_intdigest(strings[i][x:y], seed=k + 1) for i, x, y in zip(fits.tolist(), left.tolist(), right.tolist(), strict=True)], np.uint64)
        yield fits, begin[fits], end[fits], core


def related(keys: np.ndarray, strings: list[bytes], gram_at: np.ndarray, length: int, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """For each region the first and last of its windows that can equal one of another region of its key; first > last if none can.

    Equal windows have their gram at equal places, so a region has no equal of its windows of a part unless their core
    occurs once more."""
    low, high = np.full(len(strings), length * 9), np.full(len(strings), -1)
    for fits, begin, end, core in cores(strings, gram_at, length, parts):
        both = mix(keys[fits].view(np.uint64) ^ mix(core, 4), 8)
        _, back, count = np.unique(both, return_inverse=True, return_counts=True)
        many = count[back] > 1
        hit = fits[many]
        low[hit], high[hit] = np.minimum(low[hit], begin[many]), np.maximum(high[hit], end[many])
    return low, high


def _blocks(ids: list, texts: list, most: int = 200_000) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    held, size = [], 0
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode("utf-8", "replace")
        if held and size + len(b) > most:
            yield np.array([x for x, _ in held]), b"".join(x for _, x in held), np.cumsum([0] + [len(x) for _, x in held])
            held, size = [], 0
        held.append((i, b))
        size += len(b)
    if held:
        yield np.array([x for x, _ in held]), b"".join(x for _, x in held), np.cumsum([0] + [len(x) for _, x in held])


class Collection:
    """Burrows-Wheeler transform and common prefixes of strings, built one symbol of each string a round.

    bwt: symbol before each suffix in order (0: none, as symbols count from 1); lcp: common prefix with the one before.
    The strings' empty suffixes come first, in the strings' order."""

    def __init__(self, strings: list[bytes]) -> None:
        m = len(strings)
        size = np.array([len(s) for s in strings])
        flat = np.frombuffer(b"".join(strings), np.uint8)
        used = np.unique(flat)
        if len(used) > 255:
            raise ValueError("255 symbols at most; UTF-8 uses fewer")
        code = np.zeros(256, np.uint8)
        code[used] = np.arange(1, len(used) + 1)
        flat, end = code[flat], np.cumsum(size)
        every = np.arange(m)
        self.strings, self.size = m, size
        rounds = int(size.max()) if m else 0
        self.bwt = np.where(size > 0, flat[np.maximum(end - 1, 0)], 0).astype(np.uint8)
        self.lcp = np.zeros(m, np.uint8 if rounds < 255 else np.int32)
        alive, rank = every[size > 0], every[size > 0]
        for r in range(1, rounds + 1):
            keep = size[alive] >= r
            alive, rank = alive[keep], rank[keep]
            n = len(self.bwt)
            order = np.argsort(self.bwt, kind="stable")
            symbol = self.bwt[rank]
            begin = np.r_[0, np.cumsum(np.bincount(self.bwt, minlength=256))]
            none = int(begin[1])
            step = np.empty(len(rank), np.int64)  # in the order of (symbol before, rank)
            for c in np.unique(symbol).tolist():
                own = np.flatnonzero(symbol == c)
                step[own] = begin[c] + np.searchsorted(order[begin[c] : begin[c + 1]], rank[own])
            before, after = order[np.maximum(step - 1, 0)], order[np.minimum(step + 1, n - 1)]
            table = self._table()
            least = np.iinfo(self.lcp.dtype).max
            up = np.where((step > 0) & (self.bwt[before] == symbol), np.minimum(self._range(table, before + 1, rank), least - 1) + 1, 0)
            down = np.where((step < n - 1) & (self.bwt[after] == symbol), np.minimum(self._range(table, rank + 1, after), least - 1) + 1, 0)
            place = m + step - none  # in the new order
            nxt = np.zeros(len(alive), np.uint8)
            more = size[alive] > r
            nxt[more] = flat[end[alive[more]] - r - 1]
            total = n + len(alive)
            old = np.ones(total, bool)
            old[place] = False
            bwt, lcp = np.empty(total, np.uint8), np.empty(total, self.lcp.dtype)
            bwt[old], lcp[old] = self.bwt, self.lcp
            bwt[place] = nxt
            follow = place + 1
            inside = follow < total
            lcp[follow[inside]] = down[inside]  # suffixes that are new themselves are set next
            lcp[place] = up
            self.bwt, self.lcp, rank = bwt, lcp, place
            rank = place

    def _table(self) -> list[np.ndarray]:
        table, k = [self.lcp], 1
        while 2 * k <= len(self.lcp):
            table.append(np.minimum(table[-1][:-k], table[-1][k:]))
            k *= 2
        return table

    @staticmethod
    def _range(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least common prefix over lo..hi, both included; anything where hi < lo."""
        n = len(table[0])
        lo, hi = np.clip(lo, 0, n - 1), np.clip(hi, 0, n - 1)
        width = np.maximum(hi - lo + 1, 1)
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(table[k][lo[at]], table[k][np.maximum(hi[at] - (1 << int(k)) + 1, 0)])
        return out

    def suffixes(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """String and start of each suffix in order, -1 for those of fewer than `least` symbols."""
        n, m = len(self.bwt), self.strings
        order = np.argsort(self.bwt, kind="stable")
        turn = np.empty(n, np.int64)
        turn[order] = np.arange(n)
        none = int(np.count_nonzero(self.bwt == 0))
        owner, start = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        alive = np.arange(m)
        rank = alive.copy()
        for r in range(1, int(self.size.max()) + 1 if m else 1):
            keep = self.size[alive] >= r
            alive, rank = alive[keep], rank[keep]
            rank = m + turn[rank] - none
            if r >= least:
                owner[rank], start[rank] = alive, self.size[alive] - r
        return owner, start


def repeats(strings: list[bytes], ids: np.ndarray, firsts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """ids and places of the windows of these strings that equal an earlier one. firsts: place of each string in its text."""
    held = Collection(strings)
    owner, start = held.suffixes(length)
    group = np.cumsum(held.lcp < length)
    full = owner >= 0
    group, owner, start = group[full], owner[full], start[full]
    count = np.bincount(group)
    many = count[group] > 1
    group, owner, start = group[many], owner[many], start[many]
    doc, place = ids[owner], firsts[owner] + start
    order = np.lexsort((place, doc, group))
    group, doc, place = group[order], doc[order], place[order]
    begin = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(begin, np.arange(len(group)), 0)) if len(group) else np.zeros(0, int)
    later = (doc != doc[lead]) | (place != place[lead])
    return doc[later], place[later]


def _seen_before(value: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which values also stand at an earlier place: a smaller doc, or the same doc and a smaller place."""
    out = np.zeros(len(value), bool)
    if len(value):
        order = np.lexsort((place, doc, value))
        v, d, p = value[order], doc[order], place[order]
        lead = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], np.arange(len(v)), 0))
        out[order] = (d != d[lead]) | (p != p[lead])
    return out


def _ranges(doc: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """Runs of neighbouring places as rows doc_id, first, last."""
    if not len(doc):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "last": np.zeros(0, np.int64)})
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)])
    return pd.DataFrame({"doc_id": doc[new], "first": place[new], "last": place[np.r_[new[1:], len(place)] - 1]})


def repeated_ranges(documents: DataFrame, length: int = LENGTH, most: int = MOST, batch: int = BATCH) -> DataFrame:
    """doc_id, first, last: all starts of windows that also start earlier, as ranges (both ends included; ranges may meet)."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, raw, bounds in _blocks(frame["doc_id"].tolist(), frame["text"].tolist()):
                key, first, last, gram = regions(np.frombuffer(raw, np.uint8), bounds, length)
                text = np.searchsorted(bounds, first, "right") - 1
                kind = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
                doc, place = ids[text] if len(first) else np.zeros(0, np.int64), first - bounds[text]
                again = _seen_before(mix(key ^ mix(kind, 4), 8), doc, place)
                # What repeats a region of its own block is a repeat in any case: it needs no key to meet others, so a key that
                # is everywhere brings a few rows of each block to one place, not all of them.
                key = np.where(again, mix(doc.view(np.uint64) * np.uint64(_P) + place.view(np.uint64), 77), key)
                yield pd.DataFrame({"key": key.view(np.int64), "kind": kind.view(np.int64), "doc_id": doc, "first": place.astype(np.int32), "more": (last - first).astype(np.int32), "gram_at": (gram - first).astype(np.int16), "again": again})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for i, b, wanted in zip(frame["doc_id"], frame["packed"], frame["wanted"], strict=True):
                raw = unpacked(b)
                rows += [(w["key"], i, w["first"], w["gram_at"], raw[w["first"] : w["first"] + w["more"] + length], w["kinds"]) for w in wanted]
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["key", "doc_id", "first", "gram_at", "bytes", "kinds"])
                    rows = []
            yield pd.DataFrame(rows, columns=["key", "doc_id", "first", "gram_at", "bytes", "kinds"])

    def whole_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows, sorted by key, in pieces of about a batch that split no key."""
        rest: list[pd.DataFrame] = []
        for frame in frames:
            for at in range(0, len(frame), batch):
                rest.append(frame.iloc[at : at + batch])
                first, last = rest[0]["key"].iloc[0], rest[-1]["key"].iloc[-1]
                if sum(map(len, rest)) >= batch and first != last:
                    every = pd.concat(rest, ignore_index=True)
                    end = int(np.searchsorted(every["key"].to_numpy(), last))
                    yield every.iloc[:end]
                    rest = [every.iloc[end:]]
        if rest:
            yield pd.concat(rest, ignore_index=True)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def emit(part: pd.DataFrame) -> pd.DataFrame:
            return _ranges(*repeats(part["bytes"].tolist(), part["doc_id"].to_numpy(), part["first"].to_numpy(np.int64), length))

        for frame in whole_keys(frames):
            strings = frame["bytes"].tolist()
            low, high = related(frame["key"].to_numpy(), strings, frame["gram_at"].to_numpy(np.int64), length)
            keep = np.flatnonzero(low <= high)
            if not len(keep):
                continue
            part = frame.iloc[keep]
            held.append(pd.DataFrame({"doc_id": part["doc_id"], "first": part["first"] + low[keep], "bytes": [strings[i][low[i] : high[i] + length] for i in keep.tolist()]}))
            size += len(keep)
            if size >= batch:
                yield emit(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if size:
            yield emit(pd.concat(held, ignore_index=True))

    def finer(parts: int):
        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 100):
                    part, rows = frame.iloc[at : at + 100], []
                    strings = part["bytes"].tolist()
                    for k, begin, end, core in cores(strings, part["gram_at"].to_numpy(np.int64), length, parts):
                        key = mix(part["key"].to_numpy(np.int64)[k].view(np.uint64) ^ mix(core, 4), 8).view(np.int64)
                        rows += [(*x, strings[i][a : b + length]) for *x, i, a, b in zip(key.tolist(), part["doc_id"].iloc[k].tolist(), (part["first"].to_numpy()[k] + begin).tolist(), (part["gram_at"].to_numpy()[k] - begin).tolist(), k.tolist(), begin.tolist(), end.tolist(), strict=True)]
                    out = pd.DataFrame(rows, columns=["key", "doc_id", "first", "gram_at", "bytes"])
                    out.insert(1, "kind", np.array([xxhash.xxh3_64_intdigest(b) for b in out["bytes"]], np.uint64).view(np.int64))
                    yield out

        return split

    documents = documents.select("doc_id", "text").where("doc_id is not null")
    columns = "key long, kind long, doc_id long, first int, more int, gram_at short, again boolean"
    often = map_frames(documents.sample(SAMPLE, seed=7), find, columns).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    frequent = often.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", F.lit(True).alias("hot"))
    # Rows of a frequent key are sorted by kind and salt in many tasks; so what is first there is the first of its salt only.
    salted = F.when(F.col("hot"), F.xxhash64("kind", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))).otherwise(F.lit(0))
    found = map_frames(documents, find, columns).join(F.broadcast(frequent), "key", "left").withColumns({"hot": F.coalesce("hot", F.lit(False)), "slot": salted})
    same, ends = Window.partitionBy("key", "slot", "kind").orderBy("doc_id", "first"), Window.partitionBy("key", "slot")
    ranked = found.repartition("key", "slot").withColumns({"nth": F.rank().over(same), "several": F.col("hot") | (F.min("kind").over(ends) != F.max("kind").over(ends))})
    ranked = saved(ranked.where("several or nth > 1 or again").drop("slot"), "regions")
    span = [F.col("first").cast("long").alias("first"), (F.col("first") + F.col("more")).cast("long").alias("last")]
    candidates = ranked.where("nth = 1 and several and not again").select("hot", "key", "kind", "doc_id", "first", "more", "gram_at")
    of_salts = candidates.where("hot").groupBy("key", "kind").agg(F.sort_array(F.collect_set(F.struct("doc_id", "first", "more", "gram_at"))).alias("held"))  # SALTS at most
    first_ones = candidates.where("not hot").drop("hot").dropDuplicates(["key", "kind"]).unionByName(of_salts.select("key", "kind", F.col("held")[0].alias("h")).select("key", "kind", "h.*"))
    later = of_salts.select(F.explode(F.slice("held", 2, SALTS)).alias("h")).select("h.*")
    whole = ranked.where("nth > 1 or again").select("doc_id", *span).unionByName(later.select("doc_id", *span))
    crowded = first_ones.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most)
    salt, salts = F.pmod(F.xxhash64("kind"), F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    counted = first_ones.select("*", salt).join(crowded.select("*", salts), ["key", "salt"], "left").withColumn("kinds", F.coalesce("kinds", F.lit(0)))
    wanted = counted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "more", "gram_at", "kinds")).alias("wanted"))
    regions_of = map_frames(packed(documents).join(wanted, "doc_id").select("doc_id", "packed", "wanted"), cut, "key long, doc_id long, first int, gram_at short, bytes binary, kinds long")
    heavy, out = counted, whole
    for parts in (PARTS, length - GRAM + 1):
        more = heavy.where(F.col("kinds") > most).limit(1).count() > 0
        if more:
            regions_of = saved(regions_of, "cut")
        some = regions_of.where(F.col("kinds") <= most).repartition("key").sortWithinPartitions("key")
        out = out.unionByName(by_bytes(some).mapInPandas(compare, "doc_id long, first long, last long"))
        if not more:
            return out
        again = map_frames(regions_of.where(F.col("kinds") > most).drop("kinds"), finer(parts), "key long, kind long, doc_id long, first int, gram_at short, bytes binary")
        again = saved(again.withColumn("nth", F.rank().over(Window.partitionBy("key", "kind").orderBy("doc_id", "first"))), "finer")
        out = out.unionByName(again.where("nth > 1").select("doc_id", F.col("first").cast("long").alias("first"), (F.col("first") + F.length("bytes") - length).cast("long").alias("last")))
        one = again.where("nth = 1").dropDuplicates(["key", "kind"]).drop("nth", "kind")
        several = one.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
        regions_of = heavy = saved(one.join(several, "key"), "cut")
    return out  # single windows of one key are all equal: none is left to compare


def _cut(raw: bytes, ranges: list[dict] | np.ndarray | None, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, their maximal runs and what is left of a text, for the ranges of starts of its repeats."""
    if ranges is None or not len(ranges):
        return 0, 0, raw
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, [min(r["first"], len(raw)) for r in ranges], 1)
    np.add.at(edge, [min(r["last"] + length, len(raw)) for r in ranges], -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(np.r_[False, gone].view(np.int8)) == 1))
    return int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _ranges_by_id(documents: DataFrame, length: int) -> DataFrame:
    return repeated_ranges(documents, length).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) of every row."""

    def drop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for b, ranges in zip(frame["packed"], frame["ranges"], strict=True):
                raw = unpacked(b)
                rows.append((len(raw), *_cut(raw, ranges, length)))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out

    every = packed(documents).join(_ranges_by_id(documents, length), "doc_id", "left").select("doc_id", "packed", "ranges")
    return map_frames(every, drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the repeated bytes gone from text and n_chars counted anew, each row once; a character of which a byte is removed goes as a whole.

    A text that loses everything stays as an empty one. Rows with equal ids lose the same places, as in remove_repeats; rows
    without an id stand nowhere in the order, so they all stay and keep their text."""
    named = documents.where("doc_id is not null")
    rest = F.struct(*(c for c in documents.columns if c not in ("text", "n_chars"))).alias("rest")
    slim = named.select(rest, "text")
    row, text = slim.schema["rest"], StructField("text", StringType())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array([c.compress((t or "").encode("utf-8", "replace")) for t in batch.column("text").to_pylist()], pa.binary())], ["rest", "packed"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(unpacked(b), ranges, length)[2].decode("utf-8", "ignore") for b, ranges in zip(batch.column("packed").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], ["rest", "text"])

    moved = by_bytes(slim).mapInArrow(pack, StructType([row, StructField("packed", BinaryType())])).withColumn("doc_id", F.col("rest.doc_id"))
    kept = moved.join(_ranges_by_id(named, length), "doc_id", "left").select("rest", "packed", "ranges").mapInArrow(drop, StructType([row, text]))
    every = kept.unionByName(documents.where("doc_id is null").select(rest, F.coalesce("text", F.lit("")).alias("text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return every.select([new[c].alias(c) if c in new else F.col("rest")[c].alias(c) for c in documents.columns])


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
