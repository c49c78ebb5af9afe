"""A block holds its tokens and its lists of n-grams; what is made on the way follows a part, and texts are read in any order beside their answers."""

import tracemalloc

import numpy as np
import pyarrow as pa

from groupwise.llm.lm_score import block_keys, block_requests, block_scores, counted_keys, gram_levels

TEXTS = ["the cat sat", "The cat ran on", "", None, "a b the cat sat on", "zz the zz"]


def test_lists_are_made_part_by_part():
    rng = np.random.default_rng(3)
    tokens, lengths, train = rng.integers(1, 500, 400_000).astype(np.uint64), np.full(4_000, 100), rng.random(4_000) < 0.9

    def whole():
        for grams in gram_levels(tokens, lengths, 2):
            pass
        return counted_keys(grams, np.repeat(train, lengths))

    def peak(run):
        tracemalloc.start()
        out = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    (want, high), (got, low) = peak(whole), peak(lambda: block_keys(tokens, lengths, 1, 20_000, train))
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert np.array_equal(want[0], block_keys(tokens, lengths, 1, 20_000)[0])
    assert low < high * 0.7


def test_rows_of_texts_and_answers_in_any_order():
    texts = pa.table({"block": [0] * 6, "id": pa.array([1, 2, None, 4, 5, 6], pa.int64()), "held_out": [False] * 6, "text": TEXTS})
    asked = pa.Table.from_batches(block_requests(iter(texts.to_batches(max_chunksize=2)), 2, 2, 4)).select(["level", "piece", "counts"])

    def scores(rows: pa.Table):
        made = block_scores(iter(rows.to_batches(max_chunksize=3)), 6, 20, 9, 2, 0.1, 1.5, 4096, 4)
        return sorted(pa.Table.from_batches(made).to_pylist(), key=lambda r: r["id"] or 0)

    both = pa.concat_tables([texts, asked], promote_options="default").combine_chunks()
    first = scores(both)
    assert [r["n_tokens"] for r in first] == [1, 4, 5, 1, 7, 4]
    assert scores(both.take(list(range(both.num_rows))[::-1])) == first
