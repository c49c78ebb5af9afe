"""Second forms of statistics against plain Python, and the directory sets of an inventory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groupwise.operators import contracts, metrics, models, stats
from groupwise.sources import readers


def weighted_r(x, y, w):
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    return np.sum(w * (x - mx) * (y - my)) / np.sqrt(np.sum(w * (x - mx) ** 2) * np.sum(w * (y - my) ** 2))


def test_weighted_spearman_and_gate(spark):
    drawn = np.random.default_rng(5)
    x = drawn.integers(0, 9, 60).astype(float)
    values = {"a": x, "b": x**3, "c": drawn.normal(size=60), "d": np.ones(60)}
    w = drawn.uniform(0.2, 1, 60)
    rows = [(k, t, None if t == "c" and k % 7 == 0 else float(v[k]), float(w[k])) for t, v in values.items() for k in range(60)]
    long = spark.createDataFrame(rows, "id long, task string, value double, w double")
    got = {(r.task_a, r.task_b): r for r in stats.redundant_pairs(long, "id", "w", 0.9995, 0.9).collect()}
    for (a, b), r in got.items():
        on = np.array([not ("c" in (a, b) and k % 7 == 0) for k in range(60)])
        assert r.n == on.sum()
        if "d" in (a, b):
            assert r.r is None and r.spearman is None and not r.redundant
            continue
        ranks = [pd.Series(values[t][on]).rank().to_numpy() for t in (a, b)]
        assert r.r == pytest.approx(weighted_r(values[a][on], values[b][on], w[on])) and r.spearman == pytest.approx(weighted_r(*ranks, w[on]))
        assert r.redundant == ((a, b) == ("a", "b"))
    assert len(got) == 6


def test_constant_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 4.0), (1.0, None), (1.0, 5.0)], "x double, y double")
    r = stats.correlation(df, "x", "y").first()
    assert (r.n, r.pearson, r.spearman) == (3, None, None)
    assert metrics.complementarity(df, "x", "y", 2.0, 0.5).first().error_corr is None
    assert df.select(F.col("y"), (F.col("y") * 2).alias("z")).agg(stats.pearson("y", "z")).first()[0] == pytest.approx(1)


def test_brief_summary_leaves_out_nan(spark):
    r = stats.brief_summary(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,), (float("nan"),)], "x double"), "x").first()
    assert (r.n, r.min, r.median, r.max, r["mean"]) == (3, 0.0, 1.0, 2.0, 1.0) and (r.q10, r.q90) == pytest.approx((0.2, 1.8))


def test_token_audit_counts_texts_with_unknown_tokens(spark):
    df = spark.createDataFrame([("aa b",), ("x x x",), ("x b",), ("",), (None,)], "text string")
    words = spark.createDataFrame([("aa",), ("b",), (" ",)], "token string")
    r = stats.token_audit(df, "text", words, r"[a-z]+|\s", 4, {"double": "aa|x x"}).first()
    assert (r.sequences, r.empty, r.oov_tokens, r.oov_types, r.oov_sequences, r.n_double, r.over_limit) == (5, 2, 4, 1, 2, 2, 1)


def test_replicates_and_mechanism(spark):
    df = spark.createDataFrame([("g", 0.0, 1.0), ("g", 2.0, 2.0), ("h", 1.0, 4.0), (None, 9.0, 0.0)], "g string, y double, m double")
    disp = metrics.replicate_dispersion(df, "g", ["m"]).first()
    assert (disp.g, disp.y_range, disp.m_range, disp.m_mae) == ("g", 2.0, 1.0, 0.5)
    assert {r.kind: (r.n_records, r.n_groups, r.m_group_mae) for r in metrics.replicate_contrast(df, "g", ["m"]).collect()} == {"replicated": (2, 1, 0.5), "singleton": (1, 1, 3.0)}
    table = spark.range(20).select("id", (F.col("id") / 20).alias("sim"), (10 - F.col("id")).cast("double").alias("d"), F.col("id").cast("double").alias("err"), F.lit(1.0).alias("flat"))
    got = {r.factor: r for r in metrics.mechanism(table, "id", "sim", "d", ["flat"], "err", 10).collect()}
    assert got["sim"].spearman == pytest.approx(-1) and got["flat"].spearman is None
    assert (got["sim"].low_improved, got["sim"].improved, got["sim"].worst_improved) == (0.0, 9 / 20, 9)
    strata = {(r.field, r.stratum): (r.n, r.e_mean) for r in metrics.length_strata(df.select(F.col("y").alias("length"), F.col("m").alias("e")), ["length"], ["e"], 1).collect()}
    assert strata == {("length", "at_most"): (2, 2.5), ("length", "over"): (2, 1.0)}


def test_directory_sets(spark):
    seen = spark.createDataFrame([("a/x", 1, 1), ("a/y", 1, None), ("b/x", 1, 1), ("b/z", None, 4)], "path string, size long, found long")
    got = {r.directory: (r.only_found, r.only_listed, r.in_both, r.equal) for r in readers.directory_sets(seen).collect()}
    assert got == {"a": (0, 1, 1, False), "b": (1, 0, 1, False)}


def test_ensembles_and_matrix_of_both_models(spark):
    rows = [(k, f"g{k % 6}", float(k % 5), float(k % 7) if k % 4 else None, 2.0 * (k % 5) + 0.01 * (k % 3), 1.0, ("train", "val", "test")[k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, y double, w double, part string")
    train, held = df.where("part = 'train'"), df.where("part = 'test'")
    for kind, settings in (("ridge", {"alpha": 0.01}), ("trees", {"iterations": 3, "depth": 2})):
        got = models.bootstrap_ensemble(train, held, "g", "id", ["a", "b"], "y", "w", 2, 42, kind, **settings).toPandas()
        assert sorted(got.member.unique()) == [-1, 0, 1] and len(got) == 60 and got.pred.notna().all()
    with pytest.raises(contracts.ContractError):
        models.bootstrap_ensemble(train.withColumn("w", F.lit(0.0)), held, "g", "id", ["a"], "y", "w", 1).count()
    out = models.train_matrix(df, {"iid": "part"}, {"a": ["a"]}, ["id", "g"], "y", "w", {"ridge": {}, "trees": {"iterations": 3, "depth": 2}})
    assert {(r.arm, r.partition): r["count"] for r in out.groupBy("arm", "partition").count().collect()} == {(a, p): 20 for a in ("a", "a:trees") for p in ("val", "test")}
