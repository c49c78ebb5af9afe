"""A block's texts are scored part by part: the same scores, in memory that follows the part and not the block."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupwise.llm.lm_score import FINAL, counted_keys, distinct, gram_hashes, lm_scores, scored_part, token_parts
from tests.llm.test_lm_score import plain


@pytest.mark.parametrize("order,part", [(1, 1), (2, 4), (3, 7)])
def test_parts_score_like_dictionaries(spark, order, part):
    rows = list(enumerate(["the cat sat", "The cat ran on", None, "", "the cat sat", "a b the cat sat on", "zz the zz"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in lm_scores(df, held_out=F.col("doc_id") % 3 == 1, order=order, prior=1.5, part_tokens=part).collect())
    for g, e in zip(got, sorted(plain(rows, lambda i: i % 3 == 1, order, 0.1, 1.5)), strict=True):
        assert g[:5] == e[:5] and g[5:] == pytest.approx(e[5:])


def test_memory_follows_the_part():
    rng = np.random.default_rng(1)
    tokens, lengths = rng.integers(1, 50_000, 400_000).astype(np.uint64), np.full(4_000, 100)
    tokens[99::100] = FINAL
    lists = [(k := distinct(g), np.ones(len(k), np.int64)) for g in gram_hashes(tokens, lengths, 2)]

    def run(most):
        tracemalloc.start()
        out = [scored_part(t, n, lists, 4_000, 400_000, 50_000, 0.1, 1.5, 4096) for t, n in token_parts(tokens, lengths, most)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return [np.concatenate(c) for c in zip(*out, strict=True)], peak

    (whole, high), (parts, low) = run(400_000), run(40_000)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))
    assert low < high / 4


def test_requests_take_less_than_an_inverse():
    """The keys and training counts of a block in half the memory that np.unique with an inverse takes, and the same."""
    rng = np.random.default_rng(2)
    grams, train = rng.integers(1, 200_000, 400_000).astype(np.uint64), rng.random(400_000) < 0.9

    def by_inverse():
        keys, at = np.unique(grams, return_inverse=True)
        return keys, np.bincount(at, train, len(keys))

    def peak(run):
        tracemalloc.start()
        out = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    (want, high), (got, low) = peak(by_inverse), peak(lambda: counted_keys(grams, train))
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert low < 0.6 * high
    none = counted_keys(grams[:3], np.zeros(3, bool))
    assert len(none[0]) == len(set(grams[:3].tolist())) and not none[1].any()
