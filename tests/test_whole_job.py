"""Operators and registered queries that once left rows out, on all rows."""

import random

import pytest

from groupwise.operators import metrics


def test_kendall_counts_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.randrange(40)) for _ in range(400)] + [(None, 3), (4, None)]
    sign = lambda v: (v > 0) - (v < 0)
    full = [r for r in rows if None not in r]
    pairs = [(a, b) for i, a in enumerate(full) for b in full[:i]]
    nx, ny = sum(a[0] != b[0] for a, b in pairs), sum(a[1] != b[1] for a, b in pairs)
    got = metrics.kendall(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()
    assert got.n_used == 400 and got.tau_b == pytest.approx(sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs) / (nx * ny) ** 0.5)
    empty = metrics.kendall(spark.createDataFrame([], "x int, y int"), "x", "y").first()
    assert empty.tau_b is None and empty.n_used == 0


SF = "/root/testdata/sf0.001"


def test_document_queries_read_texts_of_any_length(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    sets = {k: {t[i : i + 3] for i in range(max(len(t) - 2, 1))} - {""} for k, t in docs.items()}
    assert any(len(t) > 400 for t in docs.values())
    assert {r.doc_id: r.n_grams for r in queries["p27_fingerprint_size"](spark, SF).collect()} == {k: len(s) for k, s in sets.items()}
    train = [s for k, s in sets.items() if k % 3 and s]
    got = {r.doc_id: r.nearest for r in queries["j10_nearest_similarity"](spark, SF).collect()}
    assert got == pytest.approx({k: max((len(s & t) / len(s | t) for t in train), default=0.0) for k, s in sets.items() if k % 3 == 0}, abs=1e-5)


def test_universe_and_points_are_whole(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    got = queries["j9_universe"](spark, SF)
    assert got.count() == read("supplier").count() * read("part").count()
    assert got.where("status = 'observed'").count() == read("lineitem").select("l_suppkey", "l_partkey").distinct().count()
