import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.01"
TABLES = "documents pages benchmark labels conversations embeddings".split()


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.8 * len(ids), name
        if name == "toxicity":
            assert len(now & toxic) <= 0.3 * len(toxic)  # 34 toxic texts to learn from
        docs, ids = out, now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in last.collect()} == ids
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not [r for r in docs.collect() if any(x in r.text for x in items)]


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 600


def test_empty_tables(spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_run_on_empty_tables(spark, tmp_path):
    from framesift.llm.queries import QUERIES

    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", ["op2_chat_perspectives", "op7_license_scan"])
def test_queries_with_sql(spark, name):
    from framesift.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = con.sql(ORACLE_SQL[name])
    pick = lambda cols, rows: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert pick(df.columns, df.collect()) == pick(want.columns, want.fetchall())


def test_null_columns_everywhere(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "some clean words here", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert 1 in {r.doc_id for r in out.collect()}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.withColumn("x", F.lit(1)), DATA).count() == 2


def test_suffix_dedup_keeps_rows_without_an_id_and_equal_ids_once(spark):
    long = " ".join(f"word{k}" for k in range(60))
    docs = [(None, "no id here", None, 2**60 + 1), (None, None, "b", None), (1, long, "c", 2**60 + 3), (2, f"x {long}", "d", None), (3, "some clean words", "e", 5), (3, "some clean words", "f", 6)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, lang string, more long, n_chars long").repartition(2)
    out = corpus_pipeline.cut_repeats(spark, df, DATA)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.lang, r.more, r.n_chars) for r in out.collect()), key=str)
    want = [(None, "no id here", None, 2**60 + 1, 10), (None, "", "b", None, 0), (1, long, "c", 2**60 + 3, len(long)), (2, "x", "d", None, 1), *((3, "some clean words", x, m, 16) for x, m in (("e", 5), ("f", 6)))]
    assert [g for g in got if g[0] != 2] == sorted((w for w in want if w[0] != 2), key=str)
    assert [(g[0], g[1].strip(), g[2]) for g in got if g[0] == 2] == [(2, "x", "d")]


BIG = [2**60 + 1, None, 2**60 + 3]


def test_large_ids_survive_beside_null_ids(spark):
    from framesift.llm import bpe, langid, leaks, licenses, neardup, simhash, suffixes, toxicity

    texts = ["some clean words of a first text here", "other words", "Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "en", 1, 2**60 + 5) for i, t in zip(BIG, texts)], "doc_id long, text string, lang string, n_chars long, score long").coalesce(1)
    items = spark.createDataFrame([(2**60 + 7, texts[0]), (None, texts[2])], "item_id long, text string")
    field, model = toxicity.train(["a b", "c d"] * 9, [0, 1] * 9), langid.train(["the cat"] * 5 + ["der hund"] * 5, ["en"] * 5 + ["de"] * 5)
    path = bpe.vocabulary_path()
    got = {
        "score": toxicity.score(docs, field), "clean": toxicity.clean(docs, field, 2.0), "language": langid.predict(docs, model), "bpe": bpe.encode(docs, path),
        "decode": bpe.decode(bpe.encode(docs, path), path), "suffix": suffixes.remove_repeats(docs), "text": suffixes.without_repeats(docs), "near": neardup.near_duplicates(docs), "one": neardup.keep_one(docs), "simhash": simhash.compare(docs, 3),
    }
    for name, df in got.items():
        assert sorted((r.doc_id for r in df.collect()), key=str) == sorted(BIG, key=str), name
    assert {r.score for r in got["clean"].collect()} == {2**60 + 5}
    assert [r.doc_id for r in licenses.scan(docs).collect()] == [2**60 + 3]
    assert {(r.doc_id, r.item_id) for r in leaks.contaminated(docs, items).collect()} == {(2**60 + 1, 2**60 + 7), (2**60 + 3, None)}
    assert {r.doc_id for r in leaks.remove_contaminated(docs, items).collect()} == {None}


def test_no_item_is_lost_between_parts(spark):
    from framesift.llm import leaks

    words = [" ".join(f"{a}{k}" for k in range(12)) for a in "abcdef"]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    items = spark.createDataFrame([(7, words[0]), (7, words[1]), (None, words[2]), (None, words[3]), (8, words[4]), (8, words[4])], "item_id long, text string")
    for most in (1, 2, 1500):
        assert {(r.doc_id, r.item_id) for r in leaks.contaminated(docs, items, most).collect()} == {(0, 7), (1, 7), (2, None), (3, None), (4, 8)}


def test_workers_get_batches_of_bounded_bytes(spark):
    import pandas as pd

    from framesift.llm import storage

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(1500).coalesce(1).select(F.col("id").alias("doc_id"), F.rpad(F.lit("a"), 20_000, "b").alias("text"))
    size = lambda frames: (pd.DataFrame({"n": [len(f)], "bytes": [int(f["text"].str.len().sum())]}) for f in frames)
    got = storage.map_frames(docs, size, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 1500 and max(r.bytes for r in got) <= 1.1 * (4 << 20)


def test_scratch_tables_go(spark):
    from pathlib import Path

    from framesift.llm import storage

    df = spark.range(5)
    root = Path(storage.folder(spark), "framesift")
    with storage.scratch(spark) as keep:
        storage.saved(df, "goes")
        kept = keep(df, "stays")
    assert kept.count() == 5 and not list(root.glob("goes-*")) and list(root.glob("stays-*"))
