"""Exact quantiles without a task that holds a group, against NumPy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from groupwise.operators import stats


def test_groups_ties_and_nulls(spark):
    """Hot and single groups, null keys in either column, NaN, nulls, infinite values, a group without a value."""
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1, None]), rnd.choice([None, float("nan"), 0.0, -0.0, 1.5, rnd.random(), rnd.randrange(50) * 1.0]), rnd.randrange(9)) for _ in range(3000)]
    rows += [("one", 1, 7.0, 3), ("none", 1, None, None), ("far", 1, float("inf"), 1), ("far", 1, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, h int, x double, k int").repartition(7)
    wanted = {"lo": (F.col("x"), 0.0), "q": (F.col("x"), 0.37), "m": (F.col("x"), 0.5), "hi": (F.col("x"), 1.0), "k90": (F.col("k"), 0.9), "abs": (F.abs(F.col("x") - 1), 0.25)}
    got = {(r.g, r.h): r for r in stats.quantiles(df, wanted, ["g", "h"]).collect()}
    groups = {}
    for g, h, x, k in rows:
        groups.setdefault((g, h), []).append((x, k))
    assert set(got) == {key for key, v in groups.items() if any(k is not None or (x is not None and not math.isnan(x)) for x, k in v)}
    for key, r in got.items():
        x = np.array([v for v, _ in groups[key] if v is not None and not math.isnan(v)])
        k = np.array([v for _, v in groups[key] if v is not None])
        if key[0] != "far":
            assert np.allclose([r.lo, r.q, r.m, r.hi, r["abs"]], [*np.quantile(x, [0, 0.37, 0.5, 1]), np.quantile(np.abs(x - 1), 0.25)])
        assert abs(r.k90 - np.quantile(k, 0.9)) < 1e-12
    assert got["far", 1].lo == 2.0 and got["far", 1].m == got["far", 1].hi == math.inf


def test_no_groups_and_no_rows(spark):
    df = spark.range(0, 1_000_001, numPartitions=8).select(F.pmod(F.col("id") * 7919, F.lit(1_000_001)).cast("double").alias("x"))
    r = stats.quantiles(df, {"a": (F.col("x"), 0.1), "b": (F.col("x"), 0.999999)}).first()
    assert (r.a, r.b) == (100_000.0, 999_999.0)
    nothing = df.where("false")
    assert stats.quantiles(nothing, {"a": (F.col("x"), 0.1)}).count() == 0
    assert stats.summary(nothing, "x").first().asDict() == {"n": 0, **dict.fromkeys(["mean", "std", "min", "p05", "p25", "p50", "p75", "p95", "max"])}


def test_summary_keeps_groups_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("b", None)], "g string, x double")
    got = {r.g: (r.n, r.p50, r.p95) for r in stats.summary(df, "x", ["g"]).collect()}
    assert got == {None: (2, 2.0, 2.9), "b": (0, None, None)}
