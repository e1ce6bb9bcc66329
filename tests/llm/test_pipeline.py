from __future__ import annotations

import corpus_pipeline
from pointloom.llm import mixing, nearcopies, secretscan, toxicity
from pyspark.sql import functions as F


def test_stages_act_on_what_came_before(spark, docs, labels, tmp_path):
    folder = str(tmp_path)
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    own = spark.read.parquet(f"{folder}/documents.parquet")
    weights = toxicity.train(own, labels)
    want = own.collect()
    want = [r for r in want if toxicity.score_text(r.text, weights.value) < 0.5]
    clean = corpus_pipeline.drop_toxic(spark, own, folder)
    assert sorted(map(str, clean.collect())) == sorted(map(str, want)) and clean.schema == own.schema
    single = corpus_pipeline.drop_near_duplicates(spark, clean, folder)
    assert single.schema == own.schema and single.count() == nearcopies.near_copies(clean).select("root").distinct().count()
    masked = corpus_pipeline.mask_secrets(spark, single, folder)
    assert masked.schema == own.schema and masked.count() == single.count()
    assert not any(k in ("access", "hex") for r in masked.collect() for k, *_ in secretscan.scan(r.text or ""))
    planned = mixing.plan(masked).select(F.sum("copies")).first()[0]
    encoded = corpus_pipeline.run(spark, folder)
    assert encoded.count() == planned and encoded.where("not parity or not decoded_same").count() == 0


def test_empty_tables_and_wordless_texts(spark, no_docs, labels, tmp_path):
    for name, rows in (("none", no_docs), ("wordless", spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string"))):
        folder = f"{tmp_path}/{name}"
        more = rows if "source" in rows.columns else rows.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
        more.write.parquet(f"{folder}/documents.parquet")
        labels.limit(0).write.parquet(f"{folder}/labels.parquet")
        own = spark.read.parquet(f"{folder}/documents.parquet")
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.mask_secrets):
            assert stage(spark, own, folder).count() == own.count()
        assert corpus_pipeline.drop_near_duplicates(spark, own, folder).count() == min(1, own.count())
        assert corpus_pipeline.run(spark, folder).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "secrets", "mixing", "sentencepiece"]
