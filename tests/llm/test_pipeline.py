import random

import corpus_pipeline

from tests.llm import helpers as H
from tests.llm.test_operators import speech


def corpus(tmp_path, spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice([speech(rng, ["en", "de"][i % 2], 1), "w" + str(rng.randrange(5000))]) for _ in range(150)), ["en", "de"][i % 2]))
    passage = " ".join(f"p{rng.randrange(9999)}" for _ in range(70))
    rows.append((60, rows[3][1], "de"))
    rows.append((61, rows[4][1] + " and one more", "en"))
    rows.append((62, rows[5][1][:300] + passage + speech(rng, "de", 120), "de"))
    rows.append((63, speech(rng, "en", 8) + " " + passage + " " + " ".join(f"u{k}" for k in range(200)), "en"))
    rows += [(64, "short", "en"), (65, None, None), (66, "Thor " * 80, "en")]
    docs = H.frame(spark, rows).select("doc_id", "text", "lang").withColumn("source", H_lit("s")).withColumn("n_chars", H_len())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def H_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def H_len():
    from pyspark.sql import functions as F

    return F.length("text").cast("long")


def test_stages_one_by_one(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in seen.items()}
    assert ids["quality_rules"] == set(range(64)) - {i for i, t, _ in rows if i < 64 and H.quality(t)[5]}
    assert {60, 61} & ids["ngram_jaccard"] == set() and {3, 4, 5, 62, 63} <= ids["ngram_jaccard"]
    texts = {r.doc_id: r for r in seen["suffix_dedup"].collect()}
    assert all(r.n_chars == len(r.text) for r in texts.values())
    before = [(r.doc_id, r.text, None) for r in seen["ngram_jaccard"].collect()]
    kept = {d: n - gone for d, n, gone, _, _ in H.removed(before)}
    assert {d: len(r.text.encode()) for d, r in texts.items()} == kept
    assert ids["packing"] == ids["suffix_dedup"]
    run = corpus_pipeline.run(spark, d)
    assert run.count() == seen["packing"].count() and run.columns == seen["packing"].columns


def test_odd_columns_and_an_empty_table(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, speech(rng, ["en", "de"][i % 2], 80), ["en", "de"][i % 2]) for i in range(30)]
    rows += [(30, rows[2][1], "en"), (2, rows[2][1], "en"), (None, speech(rng, "de", 70), "de"), (31, None, None), (32, "", "en"), (33, " ".join(f"{w} w{k}" for k, w in enumerate(speech(rng, "en", 5000).split())), "en")]
    docs = H.frame(spark, rows)
    spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns and {r.gram for r in docs.select("gram").collect()} == {None} and {r.sid for r in docs.select("sid").collect()} == {7}
    assert {r.doc_id for r in docs.collect()} == {*range(30), 33, None}
    spark.createDataFrame([], H.frame(spark, rows).schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
