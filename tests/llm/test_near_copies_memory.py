"""Fingerprints of many short texts: weighed shingles are held for a bounded number at a time, and the bits are the same."""

import tracemalloc

import numpy as np

from groupwise.llm.near_copies import mixed, view_fingerprints


def test_weighed_shingles_are_held_in_runs():
    sizes = np.tile([5, 0, 1, 40, 3], 4_000)
    starts = np.append(0, np.cumsum(sizes))
    sets = mixed(np.arange(1, starts[-1] + 1).astype(np.uint64))

    def peak(most):
        tracemalloc.start()
        out = view_fingerprints(starts, sets, 2, 0.45, most=most)
        high = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, high

    (want, whole), (got, low) = peak(1 << 40), peak(1 << 13)
    assert np.array_equal(want, got)
    assert got.shape == (16_000, 2)
    assert low < whole / 4
    assert np.array_equal(view_fingerprints(starts[:6], sets[: starts[5]], 2, 0.45, most=1), want[:4])


def test_texts_without_shingles():
    for sizes in ([], [0], [0, 0, 0]):
        starts = np.append(0, np.cumsum(np.array(sizes, np.int64)))
        assert view_fingerprints(starts, np.zeros(0, np.uint64), 24, 0.45).shape == (0, 24)
