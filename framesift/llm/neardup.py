"""MinHash near-dedup by Order MinHash.

A text is its sequence of runs of five words. Each of 32 hash functions picks the two least runs, where a run that
occurs again is another one than before (occurrence labels), and keeps the two in text order; so a sketch tells texts
apart by edits and by order, not only by content. Sketches make 16 bands of two. Texts that share a band are candidates,
and candidates are verified by banded alignment: with n and m runs and D insertions and deletions on a best alignment,
(n + m - D) / (n + m + D) is the similarity; at least 0.8 means D <= (n + m) / 9, so the band of that half width
holds every alignment that counts. Verified links are joined to components; a class is named by its least id.

Scale: equal word sequences are merged before anything is compared, so copies cost one row each. In a band's bucket of
up to SMALL distinct texts all pairs are candidates. In larger ones each text first meets its nearest ones in the order of
the remaining sketches and one pivot; this is repeated in other orders, between different components only, until nothing
new is found, so that most of a bucket of near copies becomes one component by links in proportion to its texts. Then all
pairs of such a bucket that are still in different components are compared, by blocks in tasks: the labelled runs that two
texts have in common bound their similarity from above, so only pairs that this bound admits are aligned, and only links
that join components leave a task. So every pair that shares a band is compared or already in one class. Texts are
moved once and kept as runs.

A pair of similarity 0.8 shares a band with probability 0.9998.

Defined results: null texts count as empty, texts without words form one class of their own; a text of fewer than five
words is one run; rows with equal ids are of one class, whatever their texts; rows without an id link like others, and get no class
(null) where none of theirs has an id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.graph import joined
from framesift.llm.storage import map_frames, packed_by_text, saved, scratch, unpacked
from framesift.llm.words import blocks, mix, shingles, words

SKETCHES, ROWS, RUN, SIMILAR = 32, 2, 5, 0.8
#: Largest bucket of which all pairs are candidates at once; neighbours to each text of a larger one in the rounds before its rest is compared; how often; agreeing sketches that a pair needs in these rounds (a pair of similarity 0.8 has 20 of 32 on average).
SMALL, NEAR, ROUNDS, AGREE = 24, 4, 4, 12
#: Texts that are sorted together in a round, about.
PART = 200
#: Texts and runs of one block of a large bucket, about; occurrences up to which a run's pairs are listed and not multiplied.
BLOCK, BLOCK_RUNS, RARE = 1000, 500_000, 8
_FACTORS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64), 101) | np.uint64(1)


def labelled(runs: np.ndarray) -> np.ndarray:
    """Runs with their occurrence labels: the k-th equal run becomes another value for each k."""
    order = np.argsort(runs, kind="stable")
    held = runs[order]
    new = np.r_[True, held[1:] != held[:-1]]
    if new.all():
        return runs
    at = np.arange(len(held))
    count = np.empty(len(held), np.uint64)
    count[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(count > 0, mix(runs + count * np.uint64(0x9E3779B97F4A7C15), 13), runs)


def sketch(runs: np.ndarray) -> np.ndarray:
    """The 32 ordered sketches of a sequence of runs, as 32-bit numbers."""
    x = labelled(runs)
    if len(x) < 2:
        value = np.broadcast_to(x[0] if len(x) else np.uint64(0), SKETCHES)
        return (mix(value * _FACTORS, 3) >> np.uint64(32)).astype(np.uint32)
    value, place = np.full((SKETCHES, 2), np.uint64(2**64 - 1)), np.zeros((SKETCHES, 2), np.int64)
    every = np.arange(SKETCHES)
    for at in range(0, len(x), 1 << 15):  # long texts part by part
        grid = x[None, at : at + (1 << 15)] * _FACTORS[:, None]
        for _ in range(min(2, grid.shape[1])):
            i = grid.argmin(1)
            got, here = grid[every, i], i + at
            grid[every, i] = np.uint64(2**64 - 1)
            first, second = got < value[:, 0], got < value[:, 1]
            value[:, 1] = np.where(first, value[:, 0], np.where(second, got, value[:, 1]))
            place[:, 1] = np.where(first, place[:, 0], np.where(second, here, place[:, 1]))
            value[:, 0], place[:, 0] = np.where(first, got, value[:, 0]), np.where(first, here, place[:, 0])
    turned = place[:, 0] > place[:, 1]
    a, b = np.where(turned, value[:, 1], value[:, 0]), np.where(turned, value[:, 0], value[:, 1])
    return (mix(a * np.uint64(0x9E3779B97F4A7C15) + b, 3) >> np.uint64(32)).astype(np.uint32)


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, k (a hash of the text), w0, w1 (128 bits of the word sequence), n_runs, bands (array<long>), sketch (array<int>) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = np.arange(SKETCHES // ROWS, dtype=np.uint64)
        for frame in frames:
            for at, block in blocks(frame["text"].tolist()):
                w, rows = words(block), []
                for d in range(len(block)):
                    own = w.hash[w.bounds[d] : w.bounds[d + 1]]
                    runs = shingles(own, RUN)
                    s = sketch(runs)
                    wide = s.astype(np.uint64)
                    keys = mix((wide[0::2] << np.uint64(32)) | wide[1::2], 5) + step * np.uint64(0xD6E8FEB86659FD93)
                    spot = _FACTORS[0] * np.arange(1, len(own) + 1, dtype=np.uint64)
                    both = [int(np.add.reduce(mix(own ^ spot, seed))) for seed in (21, 22)]
                    rows.append((*np.array(both, np.uint64).view(np.int64).tolist(), len(runs), mix(keys, 6).view(np.int64), s.view(np.int32)))
                out = pd.DataFrame(rows, columns=["w0", "w1", "n_runs", "bands", "sketch"])
                out.insert(0, "k", frame["k"].array[at : at + len(block)])
                out.insert(0, "doc_id", frame["doc_id"].array[at : at + len(block)])
                yield out

    return map_frames(documents.select("doc_id", F.xxhash64("text").alias("k"), "text"), run, "doc_id long, k long, w0 long, w1 long, n_runs long, bands array<long>, sketch array<int>")


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], similar: float = SIMILAR, cells: int = 400_000) -> np.ndarray:
    """Similarity of each pair of sequences by banded alignment; 0 where it is under `similar`."""
    out = np.zeros(len(pairs))
    work: list[tuple[int, int, int, np.ndarray, np.ndarray, int]] = []
    for k, (a, b) in enumerate(pairs):
        total = len(a) + len(b)
        width = int(total * (1 - similar) / (1 + similar) + 1e-9)
        if abs(len(a) - len(b)) > width or not len(a) or not len(b):
            out[k] = float(total == 0)
            continue
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if len(differ) else n
        differ = np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])
        tail = int(differ[0]) if len(differ) else n - head
        work.append((len(a) - head - tail, width, k, a[head : len(a) - tail], b[head : len(b) - tail], head + tail))
    work.sort(key=lambda x: (x[0], x[1]))
    at = 0
    while at < len(work):
        last = at + 1
        while last < len(work) and (last - at + 1) * (2 * max(x[1] for x in work[last : last + 1]) + 1) <= cells // 8 and work[last][0] <= 1.3 * work[at][0] + 8:
            last += 1
        part = work[at:last]
        at = last
        rows, width = max(x[0] for x in part), max(x[1] for x in part)
        a = np.full((len(part), rows), -1, np.int64)
        b = np.full((len(part), rows + 2 * width + 1), -2, np.int64)
        for p, (n, _, _, x, y, _) in enumerate(part):
            a[p, :n] = x
            y = y[: rows + width + 1]
            b[p, width : width + len(y)] = y
        best = np.zeros(len(part), np.int32)
        seen = np.zeros((len(part), 2 * width + 2), np.int32)  # offset j - i from -width on; the last stays 0
        for i in range(rows):
            same = b[:, i : i + 2 * width + 1] == a[:, i : i + 1]
            now = np.maximum(seen[:, :-1] + same, seen[:, 1:])
            np.maximum.accumulate(now, 1, out=now)
            seen[:, :-1] = now
            np.maximum(best, now[:, -1], out=best)
        for (_, _, k, x, y, same), more in zip(part, best, strict=True):
            common = same + int(more)
            got = common / (len(x) + len(y) + 2 * same - common)
            out[k] = got if got >= similar - 1e-12 else 0
    return out


def _agree(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _small_pairs(buckets: DataFrame, similar: float) -> DataFrame:
    """All pairs of these buckets whose lengths allow the similarity."""
    left = buckets.select("key", F.col("id").alias("a"), F.col("n_runs").alias("na"))
    right = buckets.select(F.col("key"), F.col("id").alias("b"), F.col("n_runs").alias("nb"))
    return left.join(right, "key").where("a < b").where(F.least("na", "nb") >= F.greatest("na", "nb") * similar - 1e-9).select("a", "b").distinct()


def _start(turn: int) -> int:
    """Place of the sketch that leads the order of a round, from 1."""
    return 1 + (turn * 11) % SKETCHES


def _leads(large: DataFrame) -> DataFrame:
    """turn, key, lead, agree: how many texts of a bucket of over PART agree in the sketch that leads a round, where over PART do."""
    crowded = large.select(F.explode(F.filter("places", lambda p: p["n"] > PART)["key"]).alias("key"), F.array(*(F.element_at("sketch", _start(t)) for t in range(ROUNDS))).alias("leads"))
    return crowded.select("key", F.posexplode("leads").alias("turn", "lead")).groupBy("turn", "key", "lead").agg(F.count("*").alias("agree")).where(F.col("agree") > PART)


def _large_pairs(large: DataFrame, leads: DataFrame, turn: int) -> DataFrame:
    """a, b, la, lb: candidates in large buckets between different labels, and these. large: id, sketch, label, places (key, band and n, the texts of the bucket)."""
    start = _start(turn)
    order = F.concat(F.slice("sketch", start, SKETCHES), F.slice("sketch", 1, start - 1) if start > 1 else F.array().cast("array<int>"))
    me = F.struct("id", "label", "sketch")
    # A bucket of over PART texts is sorted in parts: by the first sketch of the order, and those that agree in it by a hash.
    each = large.select("id", "label", "sketch", F.element_at("sketch", start).alias("lead"), F.explode("places").alias("p")).select("*", "p.key", "p.n").drop("p")
    held = each.join(leads.where(F.col("turn") == turn).drop("turn"), ["key", "lead"], "left")
    some = F.xxhash64("lead", F.pmod(F.xxhash64("id", "key", F.lit(turn)), F.ceil(F.coalesce("agree", F.lit(1)) / PART)))
    held = held.withColumn("part", F.when(F.col("n") > PART, some).otherwise(F.lit(0)))
    parts = Window.partitionBy("key", "part")
    by_order, by_chance = parts.orderBy(order, "id"), parts.orderBy(F.xxhash64("key", "id", F.lit(turn)), "id")
    other = [F.lead(me, k).over(by_order) for k in range(1, NEAR + 1)] + [F.first(me).over(by_chance)]
    own = held.select("id", "label", "sketch", F.array(*other).alias("others"))
    good = F.filter("others", lambda o: o.isNotNull() & (o["label"] != F.col("label")) & (_agree(o["sketch"], F.col("sketch")) >= AGREE))
    # An id meets the same neighbours in many buckets: it has SKETCHES / ROWS of them, so its list is short.
    known = F.transform(good, lambda o: F.struct(o["id"].alias("id"), o["label"].alias("label")))
    met = own.select("id", "label", known.alias("met")).groupBy("id", "label").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    each = met.select(F.struct("id", "label").alias("one"), F.explode("met").alias("other")).select(F.least("one", "other").alias("x"), F.greatest("one", "other").alias("y"))
    return each.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")).distinct()


def _sequences(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """id, runs (32-bit numbers as binary) of these texts (id, doc_id and k of a row). Texts move compressed, once; neither side is ever broadcast, as ids grow with the input."""

    def sequences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), 100):
                part = frame.iloc[first : first + 100]
                for at, block in blocks([unpacked(b).decode() for b in part["packed"]]):
                    w = words(block)
                    runs = [(shingles(w.hash[w.bounds[d] : w.bounds[d + 1]], RUN) >> np.uint64(32)).astype(np.uint32).tobytes() for d in range(len(block))]
                    yield pd.DataFrame({"id": part["id"].iloc[at : at + len(block)].to_numpy(), "runs": runs})

    own = ids.select("id", F.col("doc_id").alias("of"), F.col("k").alias("key"))
    met = packed_by_text(documents).join(own.hint("merge"), (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of")))
    texts = met.select("id", "packed").dropDuplicates(["id"])
    return map_frames(texts.select("id", "packed"), sequences, "id long, runs binary")


def _verified(pairs: DataFrame, runs: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b, and their labels la, lb) whose sequences are similar, with the similarity."""

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = aligned([(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(frame["ra"], frame["rb"], strict=True)], similar)
            yield frame[["a", "b", "la", "lb"]].assign(similarity=got)[got > 0]

    both = pairs.join(runs.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(runs.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    return map_frames(both.select("a", "b", "la", "lb", "ra", "rb"), align, "a long, b long, la long, lb long, similarity double")


def in_common(texts: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """How many labelled runs each of some texts has in common with each text."""
    n = len(texts)
    owner = np.repeat(np.arange(n), [len(x) for x in texts])
    _, value, count = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    out, row = np.zeros((len(some), n), np.float32), np.full(n, -1)
    row[some] = np.arange(len(some))
    rare = (count[value] > 1) & (count[value] <= RARE)
    order = np.argsort(value[rare], kind="stable")
    v, o = value[rare][order], owner[rare][order]
    for k in range(1, RARE):
        at = np.flatnonzero(v[k:] == v[:-k]) if len(v) > k else np.zeros(0, int)
        for a, b in ((o[at], o[at + k]), (o[at + k], o[at])):
            real = row[a] >= 0
            np.add.at(out, (row[a[real]], b[real]), 1)
    hot = count[value] > RARE
    _, v = np.unique(value[hot], return_inverse=True)
    o = owner[hot]
    order = np.argsort(v, kind="stable")
    v, o = v[order], o[order]
    for first in range(0, int(v[-1]) + 1 if len(v) else 0, 4096):
        lo, hi = np.searchsorted(v, (first, first + 4096))
        x = np.zeros((n, 4096), np.float32)
        x[o[lo:hi], v[lo:hi] - first] = 1
        out += x[some] @ x.T
    return out


def links_within(ids: np.ndarray, labels: np.ndarray, side: np.ndarray, sketch: np.ndarray, texts: list[np.ndarray], band: int, similar: float) -> list[tuple[int, int]]:
    """Links that join the labels of texts of one band's bucket, of all pairs of different labels (and of different sides, if there are two) whose first common band this is."""
    kinds, label, count = np.unique(labels, return_inverse=True, return_counts=True)
    some = np.flatnonzero(label != count.argmax())  # of two labels one is not the most frequent
    if not len(some):
        return []
    size = np.array([len(x) for x in texts], np.float32)
    common = in_common([labelled(x.astype(np.uint64)) for x in texts], some)
    bound = common / np.maximum(size[some][:, None] + size - common, 1)
    good = (bound >= similar - 1e-5) & (label[some][:, None] != label)
    if side.min() != side.max():
        good &= side[some][:, None] != side
    x, b = np.nonzero(good)
    a, bound = some[x], bound[x, b]
    same = (sketch[a] == sketch[b]).reshape(len(a), SKETCHES // ROWS, ROWS).all(2)
    keep = (same.argmax(1) == band) & ((label[b] == count.argmax()) | (a < b))
    a, b = a[keep], b[keep]
    order = np.argsort(-bound[keep], kind="stable")
    a, b, out = a[order], b[order], []
    while len(a):
        got = aligned([(texts[i], texts[j]) for i, j in zip(a[:200].tolist(), b[:200].tolist(), strict=True)], similar)
        for i, j in zip(a[:200][got > 0].tolist(), b[:200][got > 0].tolist(), strict=True):
            if label[i] != label[j]:
                out.append((int(ids[i]), int(ids[j])))
                label[label == label[i]] = label[j]
        a, b = a[200:], b[200:]
        still = label[a] != label[b]
        a, b = a[still], b[still]
    return out


def _remaining(large: DataFrame, label: DataFrame, runs: DataFrame, similar: float) -> DataFrame:
    """Links (la, lb) of different labels by texts in large buckets, of all pairs that share one; those that follow from others are left out.

    large: id, n_runs, sketch, places (key, band). A bucket is cut into blocks by a hash of the id, and each two blocks meet in a group of their own."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(x, np.uint32) for x in frame["runs"]]
        got = links_within(frame["id"].to_numpy(), frame["label"].to_numpy(), frame["mine"].to_numpy(), np.array(frame["sketch"].tolist()), texts, int(frame["band"].iloc[0]), similar)
        named = dict(zip(frame["id"].tolist(), frame["label"].tolist(), strict=True))
        return pd.DataFrame([(named[a], named[b]) for a, b in got], columns=["la", "lb"], dtype="int64")

    labelled = large.join(label, "id")
    held = saved(labelled.select("id", "label", "n_runs", F.explode("places").alias("p")).select("id", "label", "n_runs", "p.key", "p.band"), "held")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_runs") / BLOCK_RUNS)).cast("int")
    mixed = held.groupBy("key").agg(parts.alias("parts"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key", "parts")
    mine = F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int").alias("mine")
    asked = held.join(mixed, "key").groupBy("id").agg(F.collect_list(F.struct("key", "band", "parts", mine)).alias("asked"))
    each = labelled.select("id", "label", "sketch").dropDuplicates(["id"]).join(asked, "id")
    spread = each.join(runs, "id").select("id", "label", "sketch", "runs", F.explode("asked").alias("p")).select("id", "label", "sketch", "runs", "p.*")
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = spread.select("key", "band", "mine", "id", "label", "sketch", "runs", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    return met.groupBy("key", "lo", "hi").applyInPandas(compare, "la long, lb long")


def near_duplicates(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id of every row: documents of one class are linked by chains of pairs of at least this similarity."""
    with scratch(documents.sparkSession) as keep:
        all_rows = keep(sketches(documents), "sketches")
        one = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k"))  # a row with the least id
        entries = all_rows.groupBy("w0", "w1").agg(one.alias("one"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_runs").alias("n_runs"))
        # Texts are told apart by their words, not by ids, which several texts may have.
        entries = saved(entries.select("w0", "w1", "one.doc_id", "one.k", "bands", "sketch", "n_runs").withColumn("id", F.monotonically_increasing_id()), "entries")
        each = entries.select("w0", "w1", F.posexplode("bands").alias("band", "key"))
        shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # What a text is compared by stays in one row for each text; its places in buckets are a list, one for each band at most.
        places = each.join(shared, "key").groupBy("w0", "w1").agg(F.collect_list(F.struct("key", "band", "n")).alias("places"))
        held = saved(entries.select("w0", "w1", "id", "doc_id", "k", "sketch", "n_runs").join(places, ["w0", "w1"]).drop("w0", "w1"), "buckets")
        buckets = held.drop("doc_id", "k")
        ids = saved(buckets.select("id"), "ids")
        runs = saved(_sequences(documents, held.select("id", "doc_id", "k")), "runs")
        small = buckets.select("id", "n_runs", F.explode(F.filter("places", lambda p: p["n"] <= SMALL)["key"]).alias("key"))
        tried = saved(_small_pairs(small, similar), "pairs")
        label = joined(ids.withColumn("label", F.col("id")), _verified(tried.withColumns({"la": F.col("a"), "lb": F.col("b")}), runs, similar))
        large = saved(buckets.withColumn("places", F.filter("places", lambda p: p["n"] > SMALL)).where(F.size("places") > 0), "large")
        if large.limit(1).count():
            leads = saved(_leads(large), "leads")
            for turn in range(ROUNDS):
                pairs = saved(_large_pairs(large.join(label, "id"), leads, turn).join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
                new = saved(_verified(pairs, runs, similar), "links")
                if turn >= 2 and not new.limit(1).count():
                    break
                tried, label = tried.unionByName(pairs.select("a", "b")), joined(label, new)
            label = joined(label, saved(_remaining(large, label, runs, similar), "links"))
        named = saved(entries.select("w0", "w1", "id", "doc_id").join(label, "id", "left").withColumn("label", F.coalesce("label", "id")), "labels")
        named = _by_ids(named, all_rows)
        least = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
        named = keep(named.join(least, "label").select("w0", "w1", "class_id"), "classes")
    return all_rows.select("doc_id", "w0", "w1").join(named, ["w0", "w1"]).select("doc_id", "class_id")


def _by_ids(named: DataFrame, rows: DataFrame) -> DataFrame:
    """named (w0, w1, id, doc_id, label) after the labels of all texts that stand beside one doc_id have become one."""
    words_ = F.struct("w0", "w1")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(words_).alias("a"), F.max(words_).alias("b")).where("a <> b").select("doc_id")
    several = saved(several, "several")
    if not several.limit(1).count():
        return named
    owned = saved(rows.select("doc_id", "w0", "w1").join(several, "doc_id").join(named.select("w0", "w1", "label"), ["w0", "w1"]).select("doc_id", "label").distinct(), "owned")
    links = owned.join(owned.groupBy("doc_id").agg(F.min("label").alias("la")), "doc_id").select("la", F.col("label").alias("lb"))
    label = joined(named.select("id", "label"), links)
    return named.drop("label").join(label, "id")


def keep_one(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of one document of each class, the one with the least id; of rows with that id, one text. Rows without an id all stay."""
    kept = near_duplicates(documents, similar).where("doc_id = class_id").select("doc_id").distinct()
    one = documents.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(documents.where("doc_id is null"))


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Each document's class, and whether it is the one that stays."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
