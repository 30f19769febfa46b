"""The pipeline's toxicity stage keeps the same texts however few entries of the model tasks get."""

from test_toxicity import corpus

import corpus_pipeline
from leadloom.llm import toxicity


def test_toxic_stage_with_a_bounded_model(spark, tmp_path, monkeypatch):
    docs, labels = corpus(120)
    df = spark.createDataFrame([(k, "en", t) for k, t in docs] + [(None, "en", docs[0][1]), (500, None, None)], "doc_id long, lang string, text string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = lambda: sorted(map(repr, corpus_pipeline.toxic(spark, df, str(tmp_path)).collect()))
    want = kept()
    assert 0 < len(want) < df.count()
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    assert kept() == want
