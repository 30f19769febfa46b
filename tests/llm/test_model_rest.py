"""What is beyond the model of the toxicity stage: sums of words for tasks, joins only for the words beyond those."""

from pyspark.sql import functions as F
from test_toxicity import corpus

import corpus_pipeline
from leadloom.llm import toxicity


def test_words_as_texts_have_them(spark):
    """Long runs and runs with other signs: the counted words are those that texts are scored by."""
    texts = ["a" * 60 + "²" + "b" * 60, "c" * 150, "ab²c d_e", "İx ΑΣ", "Ⅷ" + "d" * 70 + "Ⅷ", None, ""]
    found = toxicity.words(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("kind", F.lit(None).cast("int")))
    made = toxicity.Texts(texts)
    want = {made.points[b : b + n].tobytes().decode("utf-32-le") for b, n in zip(made.begins, made.lengths, strict=True)}
    assert {r["word"] for r in found.collect()} == want


def test_toxic_stage_with_sums_of_words(spark, tmp_path, monkeypatch):
    """The same texts stay when the model lacks contexts and tasks get what those add to words; no text is joined."""
    docs, labels = corpus(120)
    df = spark.createDataFrame([(k, "en", t) for k, t in docs] + [(None, "en", docs[0][1]), (500, None, None)], "doc_id long, lang string, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    kept = lambda: sorted(map(repr, corpus_pipeline.toxic(spark, df, str(tmp_path)).collect()))
    want = kept()
    whole = toxicity.train(df, marks)[0].value
    monkeypatch.setattr(toxicity, "MODEL_ROWS", len(whole[0]) + len(whole[2]) - 1)
    model, (rest, _) = toxicity.train(df, marks)
    assert rest is None and len(model.value[2]) < len(whole[2]) and len(model.value[4]) > 0
    assert 0 < len(want) < df.count() and kept() == want
