"""Notices, labels and scores against a brute-force version; input columns named like the scan's own stay."""

import math

import pytest
from pyspark.sql import functions as F

from groupwise.llm.license_scan import NOTICES, PHRASES, op8_license_scan, scan
from tests.llm.test_native import plain_words

SHARE = 0.7


def plain(texts):
    """(notices, score) of each text: every start of every notice is compared, one before the text's begin included."""
    words = [plain_words(t) for t in texts]
    vocabulary = {w for t in [*PHRASES, *(t for t, *_ in NOTICES), *(k for _, k, _ in NOTICES)] for w in t.split()}
    low = [set(plain_words((t or "").lower())) for t in texts]
    weight = {w: math.log((len(texts) + 1) / (sum(w in x for x in low) + 1)) + 1e-6 for w in vocabulary}
    out = []
    for ws in words:
        found = []
        for text, key, label in NOTICES:
            t, k = text.split(), key.split()
            at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            full = sum(weight[w] for w in t)
            for start in range(-len(t) + 1, len(ws)):
                same = [0 <= start + j < len(ws) and ws[start + j] == w for j, w in enumerate(t)]
                score = min(1.0, sum(weight[w] for w, m in zip(t, same) if m) / full)
                if all(same[at : at + len(k)]) and score >= SHARE:
                    found.append((label, start, score))
        phrase = any(ws[i : i + len(p.split())] == p.split() for p in PHRASES for i in range(len(ws)))
        out.append((found, 1.0 if phrase else max((s for *_, s in found), default=0.0)))
    return out


def texts():
    full = [t for t, *_ in NOTICES]
    cut = [" ".join(t.split()[2:]) for t in full]  # cut off by the text's begin
    swapped = [" ".join("xx" if i == 1 else w for i, w in enumerate(t.split())) for t in full]
    without_key = [t.replace(k.split()[-1], "zz") for t, k, _ in NOTICES]
    twice = [f"Some Words, {t.title()}. And again: {t.upper()}!" for t in full]
    prose = [f"plain words of text number {k} and the license of a use" for k in range(60)]
    return [*full, *cut, *swapped, *without_key, *twice, *prose, None, "", "license " * 40]


def test_notices_match_brute_force(spark):
    given = texts()
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumns({"_words": F.lit(1), "_hits": F.lit("mine"), "score": F.lit("old")})
    got = {r.doc_id: r for r in scan(docs, share=SHARE).collect()}
    assert all(r._words == 1 and r._hits == "mine" for r in got.values())
    for i, (found, score) in enumerate(plain(given)):
        assert sorted((n.label, n.start) for n in got[i].notices) == sorted((a, b) for a, b, _ in found), given[i]
        assert sorted(n.score for n in got[i].notices) == pytest.approx(sorted(s for *_, s in found))
        assert got[i].score == pytest.approx(score)


def test_labels_hold_the_base_ones(spark):
    rows = op8_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in rows)
    assert any(r.base_labels for r in rows) and all(r.labels == ",".join(sorted(set(r.labels.split(",")))) for r in rows)
