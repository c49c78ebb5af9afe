"""Language-model scores against a dictionary-based version."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groupwise.llm.common import LOWER, UPPER
from groupwise.llm.lm_score import lm_scores


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER))) + [None]


def plain(rows, held, order, add, prior):
    grams = [Counter() for _ in range(order)]
    contexts = [Counter() for _ in range(order)]

    def histories(ts):
        for i, t in enumerate(ts):
            for j in range(order):
                yield j, tuple((ts[i - k] if i - k >= 0 else "<") for k in range(j, 0, -1)), t

    for i, text in rows:
        if not held(i):
            for j, h, t in histories(tokens(text)):
                grams[j][h, t] += 1
                contexts[j][h] += 1
    total, types = contexts[0][()], len(grams[0])
    out = []
    for i, text in rows:
        ts = tokens(text)
        base = score = 0.0
        p = None
        for j, h, t in histories(ts):
            p = (grams[0][(), t] + add) / (total + add * (types + 1)) if j == 0 else (grams[j][h, t] + prior * p) / (contexts[j][h] + prior)
            base += math.log10(p) if j == 0 else 0
            score += math.log10(p) if j == order - 1 else 0
        out.append((i, held(i), len(ts), sum(grams[0][(), t] > 0 for t in ts), total, base, score))
    return out


@pytest.mark.parametrize("order,chars", [(1, 10**6), (2, 60), (3, 60), (2, 10**6)])
def test_scores_match_dictionaries(spark, order, chars):
    texts = ["the cat sat", "The cat ran on", None, "", "  ", "the cat sat", "a\tb\nc the cat É é", "the the the", "x" * 300, "b c the cat sat"]
    rows = list(enumerate(texts)) + [(3, ""), (5, "the cat sat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).withColumn("counts", F.lit(1))
    held = lambda i: i % 4 == 1
    got = sorted(tuple(r) for r in lm_scores(df, held_out=F.col("doc_id") % 4 == 1, order=order, prior=1.5, block_chars=chars).collect())
    for g, e in zip(got, sorted(plain(rows, held, order, 0.1, 1.5)), strict=True):
        assert g[:5] == e[:5] and g[5:] == pytest.approx(e[5:])


def test_probabilities_sum_to_one(spark):
    """Over all next tokens, the unknown one included, after a seen context: scores of one-word texts differ by that token alone."""
    df = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "a b c")], "doc_id long, text string")
    probe = df.union(spark.createDataFrame([(10 + k, t) for k, t in enumerate(["", "a", "b", "c", "zz"])], df.schema))
    got = {r.id: r for r in lm_scores(probe, held_out=F.col("doc_id") >= 10, prior=0.7).collect()}
    ends = {k: 10 ** got[10 + k].score for k in range(5)}
    assert got[10].train_tokens == 10 and 0 < sum(ends.values()) < 1


def test_no_rows_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lm_scores(df.limit(0)).count() == 0
    assert {r.n_known for r in lm_scores(df, held_out=F.lit(True)).collect()} == {0}
