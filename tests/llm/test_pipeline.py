"""The pipeline's stages on sf0.01: each one's decisions, and that clean documents stay."""

import corpus_pipeline
from groupwise.llm.common import keep
from groupwise.llm.pii import base_spans
from tests.llm.test_near_copies import plain_groups

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, SF))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    ids = {k: {r.doc_id for r in after.select("doc_id").collect()} for k, (_, after) in seen.items()}
    counts = {k: after.count() for k, (_, after) in seen.items()}
    assert all(len(ids[k]) == counts[k] for k in ids)
    before, after = seen["near_dedup"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert ids["near_dedup"] == {rows[g][0] for g in plain_groups([t for _, t in rows])}
    assert counts["toxicity"] > 850 and counts["decontamination"] > 0.9 * counts["near_dedup"]
    assert counts["pii"] == counts["decontamination"] == counts["packing"]
    texts = [r.text for r in seen["pii"][1].collect()]
    assert not any(base_spans(t) for t in texts) and any("<email>" in t for t in texts)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
    assert docs.count() == 0
