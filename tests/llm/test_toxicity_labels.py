"""The toxicity stage without labels, and with labels of one class."""

import corpus_pipeline


def test_one_missing_class_does_not_empty_the_corpus(spark, tmp_path):
    rows = [(k, f"nice day {k} " * 5, "en", "s", 1) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, labels in {"none": [], "clean": [(k, 1, 0) for k in range(30)], "toxic": [(k, 1, 1) for k in range(30)]}.items():
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{name}").count() == 30
