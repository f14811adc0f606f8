import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import langid, toxicity
from framesift.llm.words import words

DATA = "/root/testdata/sf0.01"


def test_marginals_against_plain_forward_backward():
    rng = np.random.default_rng(0)
    emit, bounds = np.exp(rng.normal(size=57)), np.array([0, 10, 10, 31, 57])
    move, begin = np.exp(rng.normal(size=(2, 2))), 0.3
    want = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        x = emit[a:b]
        paths = np.zeros((b - a, 2)), np.ones((b - a, 2))
        for t in range(b - a):
            paths[0][t] = (np.array([1, begin]) if t == 0 else paths[0][t - 1] @ move) * [1, x[t]]
        for t in range(b - a - 2, -1, -1):
            paths[1][t] = move @ ([1, x[t + 1]] * paths[1][t + 1])
        p = paths[0] * paths[1]
        want += list(p[:, 1] / p.sum(1))
    assert np.allclose(toxicity.marginals(emit, bounds, move, begin), want)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    n, bounds = 9, np.array([0, 4, 4, 9])
    tag, weight = rng.integers(0, 2, n).astype(bool), np.r_[np.full(4, 3.0), np.ones(5)]
    at = {"word": rng.normal(size=n), "trans": rng.normal(size=(2, 2)), "bias": np.array(-0.4), "begin": np.array(0.7)}

    def likelihood(x):
        """By all taggings of each text."""
        out = 0.0
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a < b:
                weighed = {}
                for tags in itertools.product((0, 1), repeat=int(b - a)):
                    s = x["begin"] * tags[0] + sum((x["word"][a + i] + x["bias"]) * t for i, t in enumerate(tags)) + sum(x["trans"][p, q] for p, q in zip(tags, tags[1:]))
                    weighed[tags] = float(s)
                out += weight[a] * (weighed[tuple(tag[a:b].astype(int))] - np.log(np.sum(np.exp(list(weighed.values())))))
        return out

    got = toxicity.gradient(np.exp(at["word"] + at["bias"]), tag, bounds, at["trans"], float(at["begin"]), weight)
    for name, value in at.items():
        for k in np.ndindex(value.shape):
            step = np.zeros(value.shape)
            step[k] = 1e-5
            slope = (likelihood(at | {name: value + step}) - likelihood(at | {name: value - step})) / 2e-5
            assert np.isclose(np.asarray(getattr(got, name))[k], slope, atol=1e-6), (name, k)


def corpus(rng, n=300):
    plain = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        w = list(rng.choice(plain, rng.integers(10, 60)))
        if i % 3 == 0:
            w[rng.integers(len(w))] = "zork" if i % 2 else "quux" + "".join(rng.choice(list("abcdefgh"), 3))
        texts.append(" ".join(w))
        toxic.append(int(i % 3 == 0))
    return texts, toxic


def test_field_finds_planted_words_and_their_offsets(spark):
    texts, toxic = corpus(np.random.default_rng(1))
    field = toxicity.train(texts, np.array(toxic))
    rows = [(0, "fine words ZORK, here"), (1, "quuxiest stuff"), (2, None), (3, ""), (3, ""), (4, "abc " * 60_000 + "zork"), (5, "…€ 12")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.score(df, field).collect()}
    assert got[0].score > 0.7 and [rows[0][1][s.start : s.end] for s in got[0].spans] == ["ZORK"]
    assert got[1].score > 0.3 and got[4].score > 0.7 and got[2].score == got[3].score == 0 and got[5].score < 0.5
    assert toxicity.score(df, field).count() == 7 and toxicity.score(df.limit(0), field).count() == 0
    assert {r.doc_id for r in toxicity.clean(df, field, 0.7).collect()} >= {2, 3, 5}


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    f = toxicity.fit(docs, none)
    assert toxicity.score(docs, f).first().score < 0.5
    assert toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(1, 1), (1, None)], "doc_id long, toxic int"))).first().score < 0.5


def test_all_labelled_texts_train(spark, monkeypatch):
    texts, toxic = corpus(np.random.default_rng(2))
    whole = toxicity.train(texts, np.array(toxic))
    monkeypatch.setattr(toxicity, "TOP", 2)  # more passes of the cover, the same choice
    docs = spark.createDataFrame([*enumerate(texts), (900, texts[0])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*enumerate(toxic), (900, toxic[0])], "doc_id long, toxic int")
    field = toxicity.fit(docs, labels)
    assert np.allclose(field.weight, whole.weight, atol=1e-3) and np.allclose(field.trans, whole.trans, atol=1e-3)
    # Parts that take turns.
    turns = toxicity.fit(docs, labels, least=15)
    bad = toxicity.score(docs, turns).join(labels, "doc_id")
    assert bad.where("(score >= 0.7) <> (toxic = 1)").count() <= 0.03 * len(texts)


def test_words_of_a_few_of_many_toxic_texts_are_learned(spark):
    plain = [f"{a}{b}{c}" for a in "bcdf" for b in "aeio" for c in "lmnr"]
    ids = [r.id for r in spark.range(1900).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, " ".join([plain[(k * j) % 64] for j in range(1, 9)] + (["zork"] if k < 800 else ["quuxword"] if k < 900 else []))) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = toxicity.fit(docs, spark.createDataFrame([(i, int(k < 900)) for k, i in enumerate(ids)], "doc_id long, toxic int"))
    new = spark.createDataFrame([(1, "bal bem zork bil"), (2, "bal bem quuxword bil"), (3, "bal bem bil")], "doc_id long, text string")
    assert [r.score >= 0.7 for r in toxicity.score(new, field).orderBy("doc_id").collect()] == [True, True, False]


def test_held_out_toxicity(spark):
    rows = toxicity.op1_toxicity_crf(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [r.predicted == r.toxic for r in rows]
    assert np.mean(hit) > 0.95


def test_subwords_stay_in_their_text():
    a, at = langid.subwords(["ab", "", "ab"])
    parts = [sorted(a[x:y][a[x:y] < langid.BUCKETS]) for x, y in zip(at[:-1], at[1:])]
    assert parts[0] == parts[2] and parts[1] == []
    alone, _ = langid.subwords(["ab"])
    assert parts[0] == sorted(alone[alone < langid.BUCKETS])


def test_language_edge_cases(spark):
    model = langid.train(["the cat and the dog"] * 5 + ["der hund und die katze"] * 5, ["en"] * 5 + ["de"] * 5)
    rows = [(0, None), (1, ""), (2, "123 !!"), (3, "the dog and the cat " * 20_000), (4, "die katze und der hund"), (4, "die katze und der hund")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang_pred": F.lit(1), "score": F.lit("x")})
    got = langid.predict(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and [by[i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert by[0].score == 0 and by[0].rejected and all(0 <= r.score <= 1 for r in got)
    assert langid.predict(df, langid.train([], [])).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(df, langid.train(["x"], ["xx"])).where("doc_id = 3").first().lang_pred == "xx"


def test_held_out_language(spark):
    rows = langid.op6_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


@pytest.mark.parametrize("texts", [[], [""], ["", "a"], ["a b", "", "c"]])
def test_words_of_empty_texts(texts):
    w = words(texts)
    assert list(np.diff(w.bounds)) == [len(t.split()) for t in texts]
