"""Hard negatives against a plain version over all pairs, and against SQL."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from groupwise.llm.hard_negatives import OP12_SQL, Packed, first, hard_negatives, op12_hard_negatives

SCHEMA = "id long, label int, vector array<float>, score string, row string"


def plain(rows, anchor):
    sound = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for k, (a, label, v) in enumerate(sound):
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for j, (i, lab, w) in enumerate(sound) if j != k]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:5]:
            near = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out.update((a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(near))
    return out


def result(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", "y") for i, label, v in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_random_rows(spark, seed):
    """Few distinct values, so that scores tie; repeated rows; rows that take no part; a label with one row; columns named like inner ones."""
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2, 3]), [rnd.choice([-0.5, -0.25, 0.0, 0.125, 0.4, 0.75]) for _ in range(6)]) for i in range(160)]
    rows += [rows[0], rows[0], rows[7]] + [(i, 1, rows[3][2]) for i in range(160, 200)]
    nan, inf = float("nan"), float("inf")
    rows += [(5, None, [0.5] * 6), (10, 0, None), (None, 0, [0.5] * 6), (15, 0, [nan] + [0.5] * 5), (20, 1, [-inf] + [0.5] * 5), (25, 2, [None] + [0.5] * 5), (1000, 9, [0.5] * 6)]
    df = table(spark, rows)
    found = plain(rows, lambda i: i % 5 == 0)
    assert found and result(hard_negatives(df, F.col("id") % 5 == 0, block_rows=16)) == found
    assert result(hard_negatives(df, F.col("id") % 5 == 0)) == found


def test_negative_scores_and_nothing(spark):
    """A positive below zero has an empty window, one of zero takes zeros; no anchors, no rows."""
    rows = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5]), (3, 1, [0.0]), (4, 2, [0.0])]
    df = table(spark, rows)
    assert result(hard_negatives(df, F.col("id") == 0)) == plain(rows, lambda i: i == 0) == Counter({(0, 3, 1, 4, 0, 0): 1})
    assert hard_negatives(df, F.lit(False)).count() == hard_negatives(df.where("false"), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="unequal"):
        hard_negatives(table(spark, [(0, 1, [1.0]), (1, 1, [1.0, 2.0])]), F.lit(True))


def test_packed_scores_are_exact():
    rng = np.random.default_rng(1)
    for bias, width in ((0, 4), (7, 3), (154, 64), (4000, 64), (1 << 24, 60)):
        rows, anchors = rng.integers(-bias, bias + 1, (50, width)), rng.integers(-bias, bias + 1, (20, width))
        rows[0], rows[1], anchors[0], anchors[1] = bias, -bias, bias, -bias
        pack = Packed(rows, bias)
        for a in anchors:
            assert pack.scores(a).tolist() == [sum(x * y for x, y in zip(a.tolist(), r.tolist(), strict=True)) for r in rows]
    with pytest.raises(ValueError, match="56 bits"):
        Packed(np.full((2, 64), 1 << 26), 1 << 26)


def test_first():
    scores = np.array([3, 5, 5, 1, 5, 3])
    assert first(scores, np.array([0, 1, 2, 4, 5]), 2).tolist() == [1, 2]
    assert first(scores, np.array([0, 3, 5]), 9).tolist() == [0, 5, 3]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    want = duckdb.connect()
    want.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert result(op12_hard_negatives(spark, sf)) == Counter(want.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({OP12_SQL})").fetchall())
