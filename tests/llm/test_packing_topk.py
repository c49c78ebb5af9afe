"""Packing and top-k search against brute-force versions."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groupwise.llm.packing import best_bounds, length_of, pack
from groupwise.llm.topk_codes import changed_values, search, segment_width, sign_code


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_bounds_are_optimal(hist, buckets):
    lengths = np.array(sorted(hist))
    counts = np.array([hist[x] for x in lengths])
    cost = lambda bounds: sum(min(b for b in bounds if b >= x) * c for x, c in zip(lengths, counts, strict=True))
    got = best_bounds(lengths, counts, buckets)
    least = min(cost((*some, lengths[-1])) for n in range(buckets) for some in itertools.combinations(lengths[:-1], n))
    assert len(got) <= buckets and got == sorted(set(got)) and cost(got) == least


def test_batches_keep_the_budget(spark):
    random.seed(1)
    rows = [(k, " ".join("w" * random.choice([0, 1, 2, 5, 9, 40]))) for k in range(300)] + [(7, "x"), (7, "x"), (8, None), (None, "x y"), (9, "x " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    got = pack(df, buckets=4, budget=64, slice_rows=20).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.padded
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        assert len(members) == 1 or sum(m.padded for m in members) <= 64
        assert sorted(m.place for m in members) == list(range(len(members)))
        if (bucket, batch + 1) in batches:
            assert len(members) == max(1, 64 // members[0].padded)
    assert pack(df.limit(0)).count() == 0


def test_lengths(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\n",), ("a b c",)], "text string")
    assert [r[0] for r in df.select(length_of(F.col("text"))).collect()] == [1, 1, 3, 3]


def test_changed_values_are_all_of_a_distance(spark):
    for width, flips in ((5, 0), (5, 2), (8, 3), (4, 4)):
        got = spark.range(6).select("id", changed_values(F.col("id"), width, flips).alias("v")).collect()
        for r in got:
            assert sorted(r.v) == sorted(x for x in range(1 << width) if (x ^ r.id).bit_count() == flips)
    assert [segment_width(n) for n in (2, 10**5, 10**7, 10**9, 10**12)] == [10, 13, 16, 22, 32]


@pytest.mark.parametrize("parts", [None, 8, 3])
def test_topk_matches_brute_force(spark, parts):
    random.seed(parts or 9)
    base = [random.getrandbits(64) for _ in range(40)]
    codes = {i: (base[i % 40] ^ sum(1 << random.randrange(64) for _ in range(i % 4))) % 2**64 for i in range(160)} | {i: base[0] for i in range(200, 260)}
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(i, signed(c)) for i, c in codes.items()] + [(999, None)], "id long, code long")
    got = sorted(map(tuple, search(df, df.where("id % 20 = 0"), 5, parts=parts).collect()))
    plain = []
    for q in codes:
        if q % 20 == 0:
            near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:5]
            plain += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert got == sorted(plain)


def test_topk_of_few_rows(spark):
    df = spark.createDataFrame([(0, 1), (1, -1), (2, 3)], "id long, code long")
    assert sorted(map(tuple, search(df, df.where("id = 0"), 5).collect())) == [(0, 1, 2, 1), (0, 2, 1, 63)]
    assert search(df.limit(0), df.limit(0)).count() == 0
    v = spark.createDataFrame([([1.0, -1.0, 2.0],), (None,), ([0.0] * 63 + [1.0],)], "v array<double>").select(sign_code(F.col("v")).alias("c"))
    assert [r.c for r in v.collect()] == [5, None, -(1 << 63)]
    with pytest.raises(Exception, match="64 bits"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(sign_code(F.col("v"))).collect()
