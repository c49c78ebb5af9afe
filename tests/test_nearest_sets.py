"""Packed sets: the bits and codes are Spark's own, and pairs whose bound is not above the best found are not compared."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groupwise.functions import scalar
from groupwise.operators import nearest_sets as ns


def test_fingerprints_of_odd_texts(spark):
    texts = [None, "", "a", "ab", "abc", "aaaa", "ab\u0000c", "\u0000\u0000", "äöüß x", "\U0001f600\U0001f601\U0001f602\U0001f600", "é é", " \n\t ", "abcabcabd" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    for n, bits in ((3, 1 << 40), (2, 512), (1, 1 << 40)):
        want = {r.id: r.b for r in docs.select("id", scalar.fingerprint(F.col("text"), n, bits).alias("b")).collect()}
        assert {r.id: r.bits for r in ns.fingerprint_sets(docs, "text", n, bits).collect()} == want


def test_codes_are_those_of_spark(spark):
    rnd = random.Random(5)
    sets = [sorted({rnd.randrange(-(1 << 63), 1 << 63) for _ in range(n)}) for n in (1, 2, 50, 7)]
    least = lambda k: F.array_min(F.transform("s", lambda b: F.xxhash64(F.lit(k), b)))
    codes = F.array(*[F.xxhash64(*[least(t * 3 + r) for r in range(3)]) for t in range(5)])
    want = [r.c for r in spark.createDataFrame(list(enumerate(sets)), "id long, s array<long>").select("id", codes.alias("c")).orderBy("id").collect()]
    starts = np.cumsum([0, *map(len, sets)])
    assert ns.minhash_codes(starts, np.concatenate([np.array(s, np.int64) for s in sets]), 5, 3).tolist() == want


def blocks(best):
    """Sets of two kinds that share a few bits, packed by a layout with a cluster for each."""
    rnd = random.Random(7)
    sets = [[sorted({*rnd.sample(range(k * 200, k * 200 + 200), 120), 999}) for _ in range(60)] for k in (0, 1)]
    bits = np.unique(np.concatenate([np.array(s) for kind in sets for s in kind]))
    layout = ns.Layout(bits, np.stack([np.isin(bits, np.concatenate([np.array(s) for s in kind])).astype(float) for kind in sets]))
    made = [pa.concat_tables([pa.table(m) for _, _, m in layout.packed(pa.array(kind, pa.list_(pa.int64())))]) for kind in sets]
    own = [t.append_column("id", pa.array(range(60), pa.int64())).append_column("best", pa.array(np.full(60, best))).combine_chunks() for t in made]
    return sets, own


def test_sets_of_another_kind_are_not_compared(monkeypatch):
    sets, (one, other) = blocks(0.3)
    counted, inner = [], ns._common
    monkeypatch.setattr(ns, "_common", lambda x, y, *more: counted.append(x.num_rows * y.num_rows) or inner(x, y, *more))
    assert ns._better(one, other).num_rows == 0
    assert not counted
    got = ns._better(one, one)
    assert sum(counted) == 60 * 60
    assert got["nearest"].to_pylist() == [1.0] * 60
    _, (one, other) = blocks(0.0)
    want = [max(len({*a} & {*b}) / len({*a} | {*b}) for b in sets[1]) for a in sets[0]]
    assert ns._better(one, other)["nearest"].to_pylist() == pytest.approx(want)


def test_best_that_meets():
    """The best value among those with a code in common, also where more of the largest values meet none than are tried one by one."""
    rnd = np.random.default_rng(3)
    alike, own, other = rnd.random((40, 50)), rnd.integers(0, 40, (40, 2)), rnd.integers(0, 40, (50, 2))
    met = (own[:, None] == other[None]).any(axis=2)
    want = np.where(met, alike, -1.0).max(axis=1)
    got = ns._best_met(alike.copy(), own, other, np.zeros(40))
    assert got.tolist() == want.tolist()
