"""The automaton state by state against one on dictionaries; probabilities that sum to one; rows linear in the blocks."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groupwise.llm import lm_score
from groupwise.llm.lm_score import Automaton, Grams, gram_hashes, lm_scores, token_hashes
from tests.llm.test_lm_score import plain, tokens

TRAIN = ["a b a b c", "b c a", "", "a a a b", "c c", "b a b c a b"]
OTHER = ["a b zz c", "zz", "b b b a c b", "c a b c zz a"]
ADD, PRIOR = 0.1, 1.5


def machine(order):
    texts = TRAIN + OTHER
    given, lengths = token_hashes(pa.array(texts, pa.large_string()))
    train = np.repeat([True] * len(TRAIN) + [False] * len(OTHER), lengths)
    levels = []
    for grams in gram_hashes(given, lengths, order):
        _, where, at = np.unique(grams, return_index=True, return_inverse=True)
        levels.append(Grams(where, at, np.bincount(at, train, len(where))))
    types, total = int((levels[0].counts > 0).sum()), int(levels[0].counts.sum())
    names = [w for t in texts for w in tokens(t)]
    return Automaton(lengths, levels, len(TRAIN), total, types, ADD, PRIOR), lengths, names, levels


def contexts(order):
    """Seen contexts, as tuples; '<' is the begin of a text."""
    seen = {()}
    for t in TRAIN:
        ts = ["<"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(ts)):
            seen |= {tuple(ts[i - j : i]) for j in range(order)}
    return seen


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_states_match_dictionaries(order):
    auto, lengths, names, _ = machine(order)
    seen = contexts(order)
    assert len(auto.fail) == len(seen)
    # Each state stands for one context: walk all texts side by side.
    means, at = {}, 0
    for n in lengths:
        state, context = np.array([auto.begin]), ("<",) * (order - 1)
        for i in range(at, at + n):
            assert means.setdefault(int(state[0]), context) == context
            shorter = context[1:] if context else context
            assert means.setdefault(int(auto.fail[state[0]]), shorter) == shorter or shorter not in seen
            state, _ = auto.step(state, auto.word[i : i + 1])
            context = (*context, names[i])[-(order - 1) :] if order > 1 else ()
            while context not in seen:
                context = context[1:]
        at += n
    assert len(set(means.values())) == len(means)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_of_each_state_sum_to_one(order):
    auto, _, _, levels = machine(order)
    words = np.arange(auto.n_words)
    unknown = np.flatnonzero(levels[0].counts == 0)
    assert len(unknown) == 1  # zz: the one unknown word is all of the unknown mass
    for state in range(len(auto.fail)):
        _, cost = auto.step(np.full(len(words), state), words)
        assert (10.0**cost).sum() == pytest.approx(1.0)


@pytest.mark.parametrize("order,run", [(2, 1), (2, 3), (3, 2), (3, 100), (4, 3)])
def test_pieces_read_like_one_text(order, run):
    auto, lengths, _, _ = machine(order)
    rows = list(enumerate(TRAIN + OTHER))
    expected = [r[-1] for r in plain(rows, lambda i: i >= len(TRAIN), order, ADD, PRIOR)]
    assert auto.traverse(lengths, run) == pytest.approx(expected)


@pytest.mark.parametrize("chars,fan", [(25, 2), (25, 3), (60, 2)])
def test_the_tree_of_sums_is_exact(spark, chars, fan):
    rows = [(k % 40, f"w{k % 3} w{k % 5} w{k % 7} end{k % 2}") for k in range(90)] + [(None, "w1 w2"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: i is not None and i % 4 == 1
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in lm_scores(df, held_out=F.col("doc_id") % 4 == 1, order=3, prior=1.5, block_chars=chars, fan=fan).collect()), key=key)
    for g, e in zip(got, sorted(plain(rows, held, 3, 0.1, 1.5), key=key), strict=True):
        assert g[:5] == e[:5] and g[5:] == pytest.approx(e[5:])


def test_rows_are_linear_in_the_blocks():
    """Requests of a block, and of a group that passes on: at most `fan` rows a level of n-grams, however many blocks there are."""
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    for fan in (4, 64):
        assert len(lm_score.requests(0, 0, 0, keys, np.ones(len(keys)), fan)) == fan
        for k in (2, 3):
            piece = keys[(keys.astype(object) * fan ** (k - 1) >> 64) == 1]
            out = lm_score.requests(0, 0, 0, piece, np.ones(len(piece)), fan**k)
            assert len(out) <= fan and all(r[2] // fan == 1 for r in out)
    assert math.isclose(sum(len(lm_score.unpacked(r[4])) for r in lm_score.requests(0, 0, 0, keys, np.ones(len(keys)), 64)), len(keys))
