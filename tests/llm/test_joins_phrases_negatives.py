"""Operators 11 to 13 against plain Python over small tables with nulls, ties, repeated rows, long texts and clashing columns."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import hardneg, phrases, setjoin

R = np.random.default_rng(11)
VOCAB = ["".join(R.choice(list("abcdefghijÉß"), R.integers(1, 7))) for _ in range(300)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text(n):
    return " ".join(R.choice(VOCAB, n))


def edited(t, k):
    w = t.split(" ")
    for i in R.choice(len(w), k, replace=False):
        w[i] = "new" + str(R.integers(10**6))
    return " ".join(w)


# Operator 11


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def components_by_hand(docs):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, (d, s) in enumerate(zip([d for d, _ in docs], sets, strict=True))]


def joined_corpus():
    base, long, shared = text(150), text(9000), text(60)
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\x0btwo"), (8, "one two three"), (9, "İ i K k"), (10, "i̇ I k k")]
    docs += [(20 + k, edited(base, k % 5)) for k in range(40)]  # links of some pairs only
    docs += [(100, long), (101, edited(long, 100)), (102, edited(long, 800)), (103, long.upper().replace("É", "É"))]
    docs += [(200 + k, shared + " " + text(int(R.integers(0, 12)))) for k in range(40)]  # a passage that is nearly the whole text
    docs += [(300 + k, text(80)) for k in range(20)] + [(400 + k, "same words here again") for k in range(10)]
    docs += [(500, base), (500, shared), (None, base), (None, text(50)), (None, "same words here again"), (2**60 + 1, docs[15][1])]
    return docs


@pytest.mark.parametrize(("small", "tile"), [(24, 1000), (2, 7), (0, 3), (1000, 1000)])
def test_components_of_the_jaccard_join(spark, monkeypatch, small, tile):
    monkeypatch.setattr(setjoin, "SMALL", small)
    monkeypatch.setattr(setjoin, "TILE", tile)
    docs = joined_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"k": F.lit(1), "e": F.lit("x"), "n": F.lit(None).cast("int"), "label": F.lit(2)}).repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.jaccard_components(df).collect()]
    assert sorted(got, key=str) == sorted(components_by_hand(docs), key=str)


def test_jaccard_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert setjoin.jaccard_components(none).collect() == []
    assert [tuple(r) for r in setjoin.jaccard_components(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


def test_prefixes_share_a_shingle():
    """Any two sets of this likeness share one of their first shingles, whatever the order is."""
    for n in range(1, 60):
        for m in range(1, n + 1):
            for both in range(m + 1):
                if setjoin.linked(np.int64(both), n, m, 90):
                    # The worst case: what they don't share comes first.
                    assert n - both < setjoin.prefix_length(n) and m - both < setjoin.prefix_length(m)


# Operator 12


def collocations_by_hand(docs, least=10, most=2000):
    f, n = Counter(), Counter()
    for lang, t in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        found = []
        for (g, p), a in f.items():
            if g != lang or len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(h == g and len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for (h, q), b in f.items()):
                continue
            cuts = [(10**6 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p))]
            s, _, left, right = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return out


@pytest.mark.parametrize(("shard", "part", "most"), [(6_000_000, 2_000_000, 2000), (2000, 1500, 40), (300, 400, 2000)])
def test_collocations(spark, monkeypatch, shard, part, most):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "RANGE", part)
    words, ends = ["new", "York", "city", "É", "a", "of", "x" * 3000], [" ", " ", " ", "  ", "\t", ".", ", ", "\n"]
    some = lambda n: "".join(w + e for w, e in zip(R.choice(words, n), R.choice(ends, n), strict=True))
    docs = [(lang, some(int(R.integers(0, 40)))) for lang in ("en", "de", None, "und", "") for _ in range(30)] + [("en", None), (None, ""), ("fr", " . "), ("en", "new york " * 500)]
    df = spark.createDataFrame([(i % 7, t, lang, 5, "w") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n int, word string").repartition(4)
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(df, most=most).collect()]
    assert sorted(got) == sorted(collocations_by_hand(docs, most=most))
    assert len(got) > 50


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 3_000_000_019, 4_000_000_007
    r = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right), 1)["score"].alias("s")).first()
    assert r.s == 10**6 * a * a // (left * right)


def test_a_trie_is_read_back_as_written():
    h = R.integers(1, 9, 500).astype(np.uint64)
    end = R.random(500) < 0.2
    one = np.where(end, 0, np.roll(h, -1)).astype(np.uint64)
    two = np.where(end | np.roll(end, -1), 0, np.roll(h, -2)).astype(np.uint64)
    t = phrases.Trie.grown(h, [one, two])
    want = Counter()
    for p in zip(h.tolist(), one.tolist(), two.tolist(), strict=True):
        want.update((*p[:k], *[0] * (3 - k)) for k in (1, 2, 3) if k == 1 or p[k - 1])
    assert dict(zip(map(tuple, t.h.tolist()), t.n.tolist(), strict=True)) == want
    cuts = [0, 3, 7, len(t.n) // 2, len(t.n) - 1, len(t.n)]
    back = [phrases.Trie.load(*t.dump(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    assert np.array_equal(np.concatenate([b.h[b.n > 0] for b in back]), t.h)
    assert all(t.find(tuple(p)) == i for i, p in enumerate(t.h.tolist()))


# Operator 13


def negatives_by_hand(rows, every=50):
    held = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for i, label, v in held:
        if i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, k == label) for j, k, w in held if j != i)
        for s, j, _ in [o for o in others if o[2]][:5]:
            good = [(t, m) for t, m, same in others if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize(("block", "cells"), [(65_536, 2_000_000), (3, 40)])
def test_hard_negatives(spark, monkeypatch, block, cells):
    monkeypatch.setattr(hardneg, "CELLS", cells)
    near = R.normal(size=(3, 4))
    rows = [(i, [float(np.float32(x)) for x in np.round(near[i % 3] + R.normal(size=4) * 0.3, 1)], int(R.integers(0, 4))) for i in range(300)]
    rows += [(350, rows[1][1], 1), (350, rows[2][1], 1), (7, rows[7][1], rows[7][2]), (400, None, 1), (450, [1.0, None, 2.0, 0.0], 1), (500, [1.0, float("nan"), 0.0, 0.0], 2), (550, [float("inf")] * 4, 2), (600, rows[0][1], None), (None, rows[0][1], 1), (650, [1.0, 2.0], 1), (700, [], 2), (750, [0.0] * 4, 3), (-50, rows[9][1], 3), (2**60, rows[4][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"key": F.lit("k"), "score": F.lit(1), "v": F.lit(2)}).repartition(5)
    got = sorted(tuple(r) for r in hardneg.hard_negatives(hardneg.prepared(df), most=block).collect())
    assert got == negatives_by_hand(rows)
    assert len(got) > 50


@pytest.mark.parametrize("size", [2**27 + 12345, 2**40 + 1])
def test_products_beyond_float64_are_exact(spark, size):
    """Beyond 2 ** 53 as they are, beyond 64 bits cut."""
    big = [float(size), float(2**26 + 777)]
    rows = [(0, [x / 256 for x in big], 1)] + [(i, [x * s / 256 for x in big], int(i > 3) + 1) for i, s in ((1, 1.0), (2, 0.5), (3, 0.25), (4, 0.75), (5, 0.9375), (6, 0.5), (8, 0.25))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in hardneg.hard_negatives(hardneg.prepared(df)).collect())
    if size < 2**30:
        assert any(r[4] % 2 for r in got) and max(r[4] for r in got) > 2**53
        assert got == negatives_by_hand(rows)
    else:
        assert all(abs(r[4]) < 2**63 and abs(r[5]) < 2**63 for r in got)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(hardneg.prepared(none)).collect() == []
    alone = spark.createDataFrame([(50, [1.0], 1)], none.schema)
    assert hardneg.hard_negatives(hardneg.prepared(alone)).collect() == []
