"""Capped and diverse picks and matched controls against one greedy step at a time over all rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from groupwise.operators import ranking


def similarity(a, b):
    a, b = set(a or []), set(b or [])
    return len(a & b) / max(1, len(a | b))


@pytest.mark.parametrize("seed", range(3))
def test_capped_picks(spark, seed):
    """Most rows share a key, so that very many rows before a pick are closed by the caps."""
    rnd = random.Random(seed)
    rows = [(f"r{i:04}", rnd.choice(["hot"] * 6 + ["b", "c", None]), rnd.choice([1] * 5 + [2, 3, None]), rnd.randrange(40)) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, a string, b int, x int").repartition(4)
    for cap, k, used in ((1, 9, ({}, {})), (2, 8, ({"hot": 1}, {2: 2})), (3, 30, ({}, {1: 2}))):
        one, two, want = dict(used[0]), dict(used[1]), []
        for r in sorted(rows, key=lambda r: (r[3], r[0])):
            if len(want) < k and one.get(r[1], 0) < cap and two.get(r[2], 0) < cap:
                want.append(r[0])
                one[r[1]], two[r[2]] = one.get(r[1], 0) + 1, two.get(r[2], 0) + 1
        got = ranking.capped_picks(df, "id", "a", "b", [F.asc("x"), F.asc("id")], k, cap, used=used).orderBy("pick").collect()
        assert [r.id for r in got] == want and [r.pick for r in got] == list(range(1, len(want) + 1))
    assert ranking.capped_picks(df.where("false"), "id", "a", "b", [F.asc("x")], 3).count() == 0


@pytest.mark.parametrize("candidates", [2, 7, 500])
def test_diverse_picks(spark, candidates):
    rnd = random.Random(8)
    rows = [(i, sorted(rnd.sample(range(30), rnd.randrange(0, 9))) or None, rnd.choice([0.0, 0.25, 0.5])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, bits array<bigint>, near double").repartition(3)
    want, left = [], {i: (b, n) for i, b, n in rows}
    while len(want) < 12:
        score = (lambda i: max(similarity(left[i][0], b) for _, b, _ in want)) if want else (lambda i: left[i][1])
        i = min(left, key=lambda i: (score(i), i))
        want.append((i, left[i][0], score(i) if want else 0.0))
        del left[i]
    got = ranking.diverse_picks(df, "id", "bits", "near", 12, candidates).orderBy("pick").collect()
    assert [(r.id, round(r.top_similarity, 9)) for r in got] == [(i, round(s, 9)) for i, _, s in want]
    assert ranking.diverse_picks(df.where("id < 3"), "id", "bits", "near", 12, candidates).count() == 3
    assert ranking.diverse_picks(df.where("false"), "id", "bits", "near", 2, candidates).count() == 0


def test_matched_controls(spark):
    rnd = random.Random(5)
    rows = [(i, sorted(rnd.sample(range(12), 5)), rnd.choice(["x"] * 5 + ["y", None]), rnd.randrange(3)) for i in range(200)]
    picks = [(1000 + n, sorted(rnd.sample(range(12), 5)), n) for n in range(7)]
    observed = spark.createDataFrame(rows, "id long, bits array<bigint>, a string, b int").repartition(3)
    wanted = spark.createDataFrame(picks, "id long, bits array<bigint>, pick int")
    taken, one, two, want = set(), {}, {}, []
    for name, bits, _ in picks:
        free = [r for r in rows if r[0] not in taken and one.get(r[2], 0) < 2 and two.get(r[3], 0) < 2]
        if not free:
            break
        r = min(free, key=lambda r: (-similarity(bits, r[1]), hashlib.sha256(str(r[0]).encode()).hexdigest()))
        taken.add(r[0])
        one[r[2]], two[r[3]] = one.get(r[2], 0) + 1, two.get(r[3], 0) + 1
        want.append((name, r[0], similarity(bits, r[1])))
    assert [tuple(r) for r in ranking.matched_controls(wanted, observed, "id", "bits", "a", "b").collect()] == want
    assert ranking.matched_controls(wanted.where("false"), observed, "id", "bits", "a", "b").count() == 0
