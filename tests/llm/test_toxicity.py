"""Maximal segments against brute force, learning on the labelled rows of sf0.01, and edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groupwise.llm.toxicity import Model, score_texts, segments, solve_lambda, toxicity


def plain_segments(values):
    """Recursively: the best segment (leftmost, then shortest, of the best), then what is left and right of it."""
    best = None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            s = sum(values[i:j])
            if s > 0 and (best is None or s > best[0]):
                best = (s, i, j)
    if best is None:
        return []
    _, i, j = best
    return plain_segments(values[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in plain_segments(values[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 2, 3, 5, -3, -1]), max_size=14))
def test_segments_match_brute_force(values):
    drift = 0.75
    at = np.flatnonzero(values)
    found = segments(at, np.array(values, float)[at], drift)
    plain = plain_segments([v - drift for v in values])
    assert sum(s.score for s in found) == pytest.approx(sum(s for *_, s in plain))
    assert [(s.start, s.end) for s in found] == [(a, b) for a, b, _ in plain]


def test_lambda_solves_the_moment_equation():
    x, w = np.array([-0.25, 4.0]), np.array([1000.0, 2.0])
    assert (w * np.exp(solve_lambda(x, w) * x)).sum() == pytest.approx(w.sum())
    assert solve_lambda(np.zeros(0), np.zeros(0)) == 1.0


def test_held_out_labels_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity(spark, docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in got}
    assert share[1] > 0.85 and share[0] < 0.05


def test_odd_rows(spark):
    rows = [(k, "nice day " * 5 if k % 2 else f"idiot {k} scum", "x") for k in range(60)] + [(100, None, "x"), (101, "", "x"), (None, "idiot", "x"), (3, "nice day", "x"), (3, "nice day", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1, 1 - k % 2) for k in range(60)] + [(0, 1, 1), (7, 1, None), (None, 0, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(spark, docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.text in (None, "")} == {0}
    assert toxicity(spark, docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert score_texts(docs, Model({}, (4,), 0.2)).columns == ["doc_id", "text", "score", "n_passages", "evidence"]


def test_equal_sums_join_to_the_leftmost_segment():
    """3, 0, 0, 0 is worth nothing at a drift of 0.75, so 5 alone is worth as much as all five, which begin further left."""
    for values, expected in (([3, 0, 0, 0, 5], [(0, 5)]), ([3, 0, 0, 0, 3], [(0, 1), (4, 5)]), ([0, 3, 0, 0, 0, 3, 5], [(1, 7)])):
        at = np.flatnonzero(values)
        assert [(s.start, s.end) for s in segments(at, np.array(values, float)[at], 0.75)] == expected == [(a, b) for a, b, _ in plain_segments([v - 0.75 for v in values])]
