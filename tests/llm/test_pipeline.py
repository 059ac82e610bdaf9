"""The pipeline's stages in order, on a small corpus: what goes, what stays, and that the packed ids are those of the kept copies."""

import random
import sys

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    letters = {"aa": "abcdefgh", "bb": "ghijklmn"}
    prose = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 8))) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(240):
        lang = "aa" if i % 2 else "bb"
        text = prose(lang, 60)
        if i % 6 == 0:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
        labels.append((i, int(i % 6 > 0), 0))
    rows += [(1000 + k, rows[1][1], "aa", "s1", 1) for k in range(30)] + [(2000, "12 34 !!", None, "s1", 1), (2001, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixture", "packing"]
    assert {2000, 2001}.isdisjoint(kept["language"]) and len(kept["language"]) == 270
    assert {i for i in range(240) if i % 6} <= {*kept["quality"]} and {i for i in range(240) if i % 6 == 0}.isdisjoint(kept["quality"])
    assert sorted(kept["near_duplicates"]) == sorted(i for i in range(240) if i % 6)
    assert {*kept["mixture"]} <= {*kept["near_duplicates"]} and abs(len(kept["mixture"]) / len(kept["near_duplicates"]) - 1) < 0.3
    whole = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("each")).collect()
    copies = {i: kept["mixture"].count(i) for i in {*kept["mixture"]}}
    assert {r["doc_id"]: r["n"] // r["each"] for r in whole} == copies
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert ran.count() == docs.count() and sys.modules["corpus_pipeline"].ORACLE_SQL is None
