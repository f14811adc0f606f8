import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import graph, neardup, suffixes
from framesift.llm.words import shingles, words

R = np.random.default_rng(4)
VOCAB = ["".join(R.choice(list("abcdefghij"), R.integers(2, 9))) for _ in range(500)]


def text(n, rng=R):
    return " ".join(rng.choice(VOCAB, n))


def edit(t, k, rng=R):
    w = t.split()
    for i in rng.choice(len(w), k, replace=False):
        w[i] = "edited" + str(rng.integers(10**6))
    return " ".join(w)


def removed(docs, length):
    """Brute force over all substrings."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        spans = int(np.count_nonzero(np.diff(np.r_[False, gone].view(np.int8)) == 1)) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeated_corpus():
    a, b, c = text(60), text(200), "é" * 180
    return [(1, a), (2, None), (3, ""), (4, "x" * 500), (5, b), (6, edit(b, 3)), (7, text(20) + " " + a + " " + text(20)), (8, a + a), (9, c + "ü" + c), (10, text(5000)), (11, text(30) + b[300:700] + text(30)), (12, "x" * 99), (13, "ab" * 120), (14, "short"), (20, b)]


def test_suffix_dedup_by_brute_force(spark):
    docs = [*repeated_corpus(), (2**60 + 1, text(20)), (2**60 + 3, text(40))]
    docs += [(None, docs[0][1]), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"packed": F.lit(1), "ranges": F.lit(2)}).repartition(5)
    got = sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())) for r in suffixes.remove_repeats(df).collect()), key=str)
    want = [*removed([d for d in docs if d[0] is not None], 100).items(), *((None, removed([(0, x)], 100)[0]) for _, x in docs[-2:])]
    assert got == sorted(want, key=str)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 2])
def test_heavy_keys_are_split(spark, most):
    """Keys of more kinds than `most` are dealt out by second and third keys, with the same result."""
    core = text(14)[:60]
    docs = [*repeated_corpus(), *((100 + k, text(5) + core + text(12)) for k in range(6)), (120, "q" * 30 + core + "r" * 60), (121, "q" * 25 + core + "r" * 70), (122, "q" * 25 + core + "s" * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    places = lambda r: {(x.doc_id, p) for x in r.collect() for p in range(x["first"], x["last"] + 1)}
    assert places(suffixes.repeated_ranges(df, most=most, batch=2)) == places(suffixes.repeated_ranges(df))


@pytest.mark.parametrize("salts", [1, 3])
def test_frequent_keys_are_spread(spark, monkeypatch, salts):
    """Every key that occurs twice counts as frequent, so its rows are sorted by kind and salt, with the same result."""
    monkeypatch.setattr(suffixes, "SAMPLE", 1.0)
    monkeypatch.setattr(suffixes, "OFTEN", 2)
    monkeypatch.setattr(suffixes, "SALTS", salts)
    core = text(40)
    docs = [*repeated_corpus(), *((100 + k, text(9) + core + text(9)) for k in range(8)), *((200 + k, core) for k in range(8))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(df).collect()}
    assert got == removed(docs, 100)


def test_text_form_drops_cut_characters(spark):
    docs = [(1, "é" * 120, 120, "a"), (2, "a" + "é" * 120 + "b", 122, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, lang string")
    got = {r.doc_id: r for r in suffixes.without_repeats(df).collect()}
    assert suffixes.without_repeats(df).columns == df.columns
    assert got[2].text == "ab" and got[2].n_chars == 2 and len(got[1].text) == got[1].n_chars


def test_collection_orders_suffixes():
    rng = np.random.default_rng(3)
    for trial in range(20):
        strings = ["".join(rng.choice(list("abc"), rng.integers(1, 30))).encode() for _ in range(rng.integers(1, 12))]
        strings += strings[: trial % 3]
        c = suffixes.Collection(strings)
        want = sorted((s[p:] + b"\0", i, p) for i, s in enumerate(strings) for p in range(len(s) + 1))
        owner, start = c.suffixes(1)
        full = owner >= 0
        assert [(i, p) for s, i, p in want if len(s) > 1] == list(zip(owner[full].tolist(), start[full].tolist()))
        lcp = [0]
        for (x, _, _), (y, _, _) in zip(want, want[1:]):
            k = 0
            while x[k] == y[k] != 0:
                k += 1
            lcp.append(k)
        assert c.lcp.tolist() == lcp


def runs(t):
    return (shingles(words([t]).hash) >> np.uint64(32)).astype(np.uint32)


def jaccard(a, b):
    from collections import Counter

    x, y = Counter(runs(a).tolist()), Counter(runs(b).tolist())
    m = sum((x & y).values())
    return m / max(1, sum(x.values()) + sum(y.values()) - m)


def test_alignment_is_exact_above_the_threshold():
    pairs = []
    for n in (1, 3, 8, 40, 200):
        for k in (0, 1, 2, 4):
            t = text(n)
            pairs.append((t, edit(t, min(k, n))))
    pairs += [(text(30), text(30)), ("", ""), ("a b c d e f", ""), (text(50), text(51) + " x")]
    got = neardup.aligned([(runs(a), runs(b)) for a, b in pairs])
    for (a, b), g in zip(pairs, got):
        want = jaccard(a, b) if a or b else 1.0
        assert g == pytest.approx(want) if want >= 0.8 else g == 0


def test_occurrence_labels_and_long_texts():
    x = np.array([7, 7, 9, 7], np.uint64)
    y = neardup.labelled(x)
    assert len(set(y.tolist())) == 4 and y[0] == 7
    long = np.random.default_rng(0).integers(0, 2**63, 100_000).astype(np.uint64)
    assert (neardup.sketch(long) == neardup.sketch(long.copy())).all()
    grid = neardup.labelled(long)[None] * neardup._FACTORS[:, None]
    at = np.sort(np.argpartition(grid, 1, axis=1)[:, :2], axis=1)
    a, b = (np.take_along_axis(grid, at[:, i : i + 1], 1)[:, 0] for i in (0, 1))
    assert (neardup.sketch(long) == (neardup.mix(a * np.uint64(0x9E3779B97F4A7C15) + b, 3) >> np.uint64(32)).astype(np.uint32)).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (5, 5)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def classes(docs):
    """Brute force: components of all pairs of similarity 0.8 or more."""
    label = {i: i for i, _ in docs}
    for n, (i, a) in enumerate(docs):
        for j, b in docs[:n]:
            same = runs(a or "").tolist() == runs(b or "").tolist()
            if same or jaccard(a or "", b or "") >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize(("small", "block"), [(24, 1000), (3, 1000), (3, 5)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PART", min(block, neardup.PART))
    base = [text(120) for _ in range(4)]
    docs = [(0, None), (1, ""), (2, "one two three"), (3, "One two, three!"), (4, text(4000))]
    docs += [(10 + 20 * b + k, edit(base[b], k % 3) if k else base[b]) for b in range(4) for k in range(15)]
    docs += [(200 + k, edit(base[0], 30)) for k in range(4)] + [(300, base[1]), (301, text(3900) + " x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit(1), "bands": F.lit(2), "label": F.lit(3)}).repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == classes(docs)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(classes(docs).values())
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_no_link_of_a_large_bucket_is_lost(spark, monkeypatch):
    random = np.random.default_rng(8)
    base, docs = [f"word{k}" for k in range(120)], []
    for i in range(260):  # few pairs reach 0.8: those whose changed words lie close together
        w = list(base)
        for k, place in enumerate(random.choice(120, 3, replace=False)):
            w[place] = f"other{i}x{k}"
        docs.append((i, " ".join(w)))
    have = [set(runs(t).tolist()) for _, t in docs]
    want = {i: i for i, _ in docs}
    for i in range(260):
        for j in range(i):
            same = len(have[i] & have[j])
            if same / (len(have[i]) + len(have[j]) - same) >= 0.8 and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {k: new if v == old else v for k, v in want.items()}
    assert 10 < len(set(want.values())) < 260
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(neardup, "ROUNDS", 0)  # the rounds may find any part of the links, even none
    monkeypatch.setattr(neardup, "BLOCK", 100, raising=False)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want


def test_rows_of_one_id_keep_the_links_of_all_their_texts(spark):
    """An id beside two texts: both texts' copies are of its class, however rows are dealt out; a chain of such ids is one class."""
    a, b, c = text(300), text(300), text(300)
    docs = [(1, a), (1, b), (2, edit(a, 2)), (3, edit(b, 2)), (5, edit(b, 3)), (5, c), (9, edit(c, 2)), (20, text(80)), (None, edit(c, 1)), (None, text(70))]
    for parts in (1, 4, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()), key=str)
        assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (5, 1), (9, 1), (20, 20), (None, 1), (None, None)], key=str)
    kept = sorted((r.doc_id for r in neardup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert kept == [1, 20, None, None]
