import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_on_a_small_corpus(spark, sentences, odd_docs, tmp_path):
    base = sentences(50, 300)
    rows = [(100 + i, sentences(200 + i, 300), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(200, base, "en", "s0", 1), (201, base, "en", "s1", 1), (202, base + " tail", "en", "s2", 1)]
    passage = " ".join(base.split()[:60])
    rows += [(300, sentences(900, 200) + "\n" + passage, "en", "s0", 1), (301, "12 34 ###", "en", "s0", 1)]
    docs = odd_docs.union(spark.createDataFrame(rows, odd_docs.schema))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert found.columns == odd_docs.columns
        found.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r for r in docs.collect()}
    clean = {100 + i for i in range(40)}
    assert clean <= set(left["language_id"]) and not {301, 5, 6, 7} & set(left["language_id"])
    assert clean <= set(left["simhash_near_dedup"]) and not {201, 202} & set(left["simhash_near_dedup"])
    cut = left["substring_dedup"]
    assert clean <= set(cut) and passage not in cut[300].text and cut[300].n_chars == len(cut[300].text)
    assert all(cut[i].text == left["simhash_near_dedup"][i].text for i in clean)
    assert set(left["mixing"]) <= set(cut)
    assert all(r.exact for r in left["byte_bpe"].values()) and set(left["byte_bpe"]) == set(left["mixing"])


def test_run_reads_documents(spark, odd_docs, tmp_path):
    odd_docs.withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where(~F.col("exact")).count() == 0
    odd_docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
