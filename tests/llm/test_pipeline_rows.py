"""The pipeline's stages on null ids, repeated ids, repeated rows and nulls."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(900)}" for _ in range(n))


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c, d = (prose(k) for k in range(4))
    rows = [(None, a, "en", "s", 1), (None, b, None, "s", 1), (1, c, "en", "s", 1), (1, c, "en", "s", 1), (1, d, "en", "s", 1), (None, c, "en", "s", 1), (7, None, None, None, None), (8, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
    assert got == sorted(map(str, spark.createDataFrame([rows[k] for k in (0, 1, 2, 4, 6)], SCHEMA).collect()))


def test_decontamination_decides_by_each_row(spark, tmp_path):
    item = " ".join(f"secret{k}" for k in range(14))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, prose(1), "en", "s", 1), (5, prose(2), "en", "s", 1), (5, f"{prose(3)} {item}", "en", "s", 1), (None, f"{item} {prose(4)}", None, "s", 1), (6, None, "en", "s", 1), (9, prose(5), "en", "s", 1), (9, prose(5), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()))
    assert got == sorted(map(str, spark.createDataFrame([rows[k] for k in (0, 1, 4, 5, 6)], SCHEMA).collect()))
