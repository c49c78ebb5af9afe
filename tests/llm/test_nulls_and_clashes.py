"""Columns of documents that are named like inner ones, and null ids where a list or a join could lose them."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from groupwise.llm.decontaminate import decontaminate
from groupwise.llm.topk_codes import search

NAMES = ["score", "predicted", "h1", "h2", "text_key", "base_spans", "all_spans", "id", "rest", "c0", "node", "ws", "item", "evidence", "held_out", "none", "a.b"]


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(900)}" for _ in range(n))


def test_every_stage_with_clashing_columns(spark, tmp_path):
    """Each filtering stage gives its rows with all their columns as they were (null and empty texts are copies of each other)."""
    item = " ".join(f"secret{k}" for k in range(14))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    texts = [prose(1), prose(2), f"{prose(3)} {item}", None, "", prose(4) + " mail me: ann@example.org", prose(1)]
    rows = [(k, t, *[f"{n}{k}" for n in NAMES[:-1]], 7.5) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES[:-1]) + ", `a.b` double"
    docs = spark.createDataFrame(rows, schema)
    kept = {"toxicity": range(7), "near_dedup": [0, 1, 2, 3, 5], "decontamination": [0, 1, 3, 4, 5, 6], "pii": range(7)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {r.doc_id: tuple(r) for r in out.collect()}
        assert set(got) == set(kept[name]), name
        for k, r in got.items():
            assert r[2:] == rows[k][2:]
            if name != "pii":
                assert r == rows[k]
    assert "<email>" in got[5][1] and got[3][1] in (None, "")
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(tmp_path))
    assert packed.count() == 7


def test_item_without_an_id(spark):
    item = " ".join(f"secret{k}" for k in range(12))
    other = " ".join(f"other{k}" for k in range(12))
    items = spark.createDataFrame([(None, item), (4, other), (4, item + " more"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {item} b"), (2, f"{other} and {item}"), (3, "nothing")], "doc_id long, text string")
    for rows in (1_000_000, 0):  # broadcast, and shuffled
        got = {r.id: (r.n_hit, r["items"]) for r in decontaminate(docs, items, broadcast_rows=rows).collect()}
        assert got == {1: (12, ["4"]), 2: (24, ["4"]), 3: (0, [])}
        alone = {r.id: (r.n_hit, r["items"]) for r in decontaminate(docs, items.where("item_id is null"), broadcast_rows=rows).collect()}
        assert alone == {1: (12, []), 2: (12, []), 3: (0, [])}


def test_codes_without_an_id(spark):
    """They take no part; equal ids and codes are found as before."""
    codes = spark.createDataFrame([(1, 0), (2, 1), (None, 0), (None, 3), (3, 7), (3, 7), (4, None)], "id long, code long")
    got = sorted((r.query_id, r["rank"], r.id, r.distance) for r in search(codes, codes.where(F.col("id").isNull() | (F.col("id") == 1)), k=3, bits=8).collect())
    assert got == [(1, 1, 2, 1), (1, 2, 3, 3), (1, 3, 3, 3)]
