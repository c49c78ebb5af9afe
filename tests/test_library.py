"""Hand cases, traps of null and NaN, invariance and fail-closed behaviour."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from groupwise.functions import scalar as s
from groupwise.operators import conformal, contracts, geometry, metrics, models, ranking, resample, splits, stats
from groupwise.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_group_macro_hand_cases(spark):
    df = frame(spark, [("A", 0.0, 1.0), ("A", 0.0, 1.0), ("B", 0.0, 4.0)], "g string, y double, pred double")
    r = metrics.macro_metrics(df, "g").first()
    assert (r.mae, r.group_mae, r.r2_reason) == (2.0, 2.5, "CONSTANT_TARGET") and r.r2 is None
    r = metrics.macro_metrics(frame(spark, [("dup", 0.0, 2.0), ("dup", 0.0, 2.0), ("single", 0.0, 0.0), (None, 0.0, 9.0)], "g string, y double, pred double"), "g").first()
    assert r.mae == pytest.approx(4 / 3) and r.group_mae == 1 and r.rmse == pytest.approx((8 / 3) ** 0.5) and r.group_rmse == pytest.approx(2**0.5)


def test_weighted_statistics(spark):
    df = frame(spark, [(1.0, 0.5, float("nan")), (3.0, 0.5, None), (9.0, 1.0, None)], "x double, w double, lost double")
    assert stats.weighted_median(df, ["x"], "w").first().median == 3
    m = {r.feature: r for r in stats.weighted_moments(df, ["x", "lost"], "w").collect()}
    assert m["x"]["mean"] == 5.5 and m["lost"]["mean"] == 0 and m["lost"]["std"] == 1
    u = frame(spark, [("a", 0.0, 0.5), ("a", 0.0, 0.5), ("a", 10.0, 1.0), ("b", 3.0, 1.0)], "u string, y double, w double")
    assert {r.u: r["mean"] for r in stats.weighted_mean(u, "u", "y", "w").collect()} == {"a": 5.0, "b": 3.0}
    p = models.fit_preprocessor(frame(spark, [(0.0, 0.5), (2.0, 0.5), (10.0, 1.0)], "x double, w double"), ["x"], "w").first()
    assert p["mean"] == 5.5


def test_running_sums_and_ranks(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("x"), F.lit(1).cast("long").alias("one"), "id")
    got = {r.id: r.c for r in stats.running_sum(df, [], ["x", "id"], "one", "c").collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(range(100), key=lambda i: (i % 7, i)))}
    ranks = {r.x: r.r for r in stats.average_rank(frame(spark, [(1.0,), (1.0,), (5.0,), (None,)], "x double"), "x", "r").collect()}
    assert ranks == {1.0: 1.5, 5.0: 3.0, None: None}


def test_conformal_ranks(spark):
    df = frame(spark, [(float(i),) for i in range(1, 10)], "s double")
    got = [conformal.finite_quantile(df, "s", x).first() for x in (0.8, 0.9, 0.95)]
    assert [(r.quantile, r.status) for r in got] == [(8.0, "OK"), (9.0, "OK"), (None, "UNATTAINABLE")]


def test_bootstrap(spark):
    df = frame(spark, [("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 4.0, 1.0)], "u string, x double, y double")
    r = resample.paired_difference(df, "u", "x", "y", 50).first()
    assert r.point == 2.5 and r == resample.paired_difference(df.repartition(3), "u", "x", "y", 50).first()
    ones = frame(spark, [(k, 1.0) for k in range(9)], "u long, x double")
    r = resample.population_contrast(ones, ones.withColumn("x", F.lit(2.0)), "u", "x", 20).first()
    assert (r.diff_lo, r.diff_hi, r.ratio_lo, r.ratio_hi) == (-1.0, -1.0, 0.5, 0.5)


def test_masked_loss(spark):
    df = frame(spark, [("t", 0.0, 1.0, True, 0.5), ("t", 1.0, 5.0, True, 0.5), ("u", 1.0, 5.0, False, 1.0)], "task string, y double, pred double, mask boolean, w double")
    assert metrics.masked_loss(df, {"t": 1.0, "u": 1.0}, "mae", weight="w").first().total == 2.5
    assert metrics.masked_loss(df.where("not mask"), {"u": 1.0}).first().total == 0


def test_ranking(spark):
    df = frame(spark, [(1.0, "b"), (1.0, "a"), (0.0, "c")], "pred double, h string")
    assert {r.h: r.percentile for r in ranking.rank_percentile(df, ["pred", "h"]).collect()} == {"b": 1.0, "a": 0.5, "c": 0.0}
    bins = frame(spark, [("a", 2, 9), ("b", 3, 9), ("c", 6, 9), ("d", 1, 1)], "o string, n int, m int")
    assert {r.o: r.block for r in ranking.merge_bins(bins, "o", ("n", "m"), (5, 5)).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    pool = frame(spark, [(k, k % 2, k, float(k)) for k in range(8)], "id long, d long, a long, v double")
    assert [r.id for r in ranking.capped_picks(pool, "id", "d", "a", [F.asc("v")], 6).orderBy("pick").collect()] == [0, 1, 2, 3]


def test_units_are_transitive_and_splits_disjoint(spark):
    rows = [(g, i) for g, i in ((1, "x"), (2, "x"), (2, "y"), (3, "y"), (4, "z"), (5, None))]
    df = frame(spark, rows, "g long, i string").withColumns({"w": F.lit(1.0), "f": F.col("g") == 4})
    got = {r.g: r for r in splits.atomic_units(df, "g", "i", "w", "f").collect()}
    assert got[1].unit == got[2].unit == got[3].unit != got[4].unit != got[5].unit and got[1].n_records == 4 and got[4].forced
    chain = spark.range(200).select(F.explode(F.array(F.struct("id", F.col("id").alias("k")), F.struct("id", (F.col("id") + 1).alias("k")))).alias("e")).select("e.*")
    assert {r.root for r in splits.components(chain, "id", "k").collect()} == {0}


def test_firewall(spark):
    df = spark.range(3).selectExpr("id", "'train' partition", "1.0 tddft_gap")
    with pytest.raises(contracts.ContractError):
        contracts.allowed_columns(df, ["tddft_*"])
    assert contracts.allowed_columns(df, ["tddft_*"], ["id"]).columns == ["id"]
    with pytest.raises(contracts.ContractError):
        contracts.partition_view(df, "buffer")
    with pytest.raises(contracts.ContractError):
        contracts.join_1to1(df.union(df), df.select("id"), ["id"])
    with pytest.raises(contracts.ContractError):
        contracts.require(df, {"none": F.count("*")})


def test_null_and_nan_traps(spark):
    df = frame(spark, [(None, 1.0), ("a", float("nan")), ("a", 2.0)], "g string, x double")
    assert [tuple(r) for r in stats.size_distribution(df, "g").collect()] == [(2, 1)]
    assert {r["column"]: r.n for r in stats.completeness(df, ["x"]).collect()} == {"x": 2}
    assert stats.summary(df, "x").first().n == 2
    got = [r[0] for r in frame(spark, [(0.0,), (1.0,), (2.0,), (None,), (float("nan"),)], "x double").select(s.cut(F.col("x"), [0, 1, 2])).collect()]
    assert got == [None, 0, 1, None, None]


def test_ids_and_reconciliation(spark):
    rows = [("D-007_A12",), ("D7_A-3",), ("x",), (None,)]
    assert [r[0] for r in frame(spark, rows, "s string").select(s.normalize_id(F.col("s"))).collect()] == ["D7_A12", "D7_A3", None, None]
    a, b = frame(spark, [(1, 1.0)], "id long, v double"), frame(spark, [(1, 1.000001)], "id long, v double")
    assert contracts.reconcile(a, b, "id", "v", 2e-6).first().within and not contracts.reconcile(a, b, "id", "v", 1e-9).first().within
    parts = frame(spark, [(1, k, r) for k, r in enumerate(["a", "unknown", "a", "unknown"])], "id long, idx int, role string")
    got = contracts.relabel(parts, frame(spark, [(1, "1;2", "d")], "id long, indices string, new_role string")).orderBy("idx").collect()
    assert [r.role for r in got] == ["a", "d", "d", "unknown"] and [r.violation for r in got] == [False, False, True, False]


def test_radius_graph_is_exact_and_rigid(spark):
    p = frame(spark, [(1, k, k * 0.5 + (k * k * 0.377) % 0.31, (k * k * 0.613) % 1.27, (k * 0.271) % 0.9, "donor") for k in range(12)], "record long, idx long, x double, y double, z double, role string")
    moved = geometry.perturb(p, "record", "idx", "role", "rotate", 0.7)
    edges = [sorted((r.dst, r.src) for r in geometry.radius_graph(d, "record", "idx", 1.1, 3).collect()) for d in (p, moved)]
    assert edges[0] == edges[1] and geometry.distance_rmsd(p, moved, "record", "idx").first().rmsd == pytest.approx(0, abs=1e-12)


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.jsonl").write_text('{"epoch": 1, "mae": 0.5}\nnot json\n')
    rows = readers.scan_jsonl(spark, str(tmp_path / "m"), "epoch int, mae double", ["epoch"]).collect()
    assert sorted((r.epoch, r.malformed) for r in rows if not r.malformed) == [(1, False)] and sum(r.malformed for r in rows) == 1
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.json").write_text('{"atoms": [{"index": 1, "element": "C", "atomic_num": 6, "coords": [1.0, 2.0, 3.0], "type": "donor"}, {"index": 0, "element": "H", "atomic_num": 1, "coords": [0.0, 0.0, 0.0], "type": "donor"}], "bonds": []}')
    atoms = readers.atom_table(readers.scan_structures(spark, str(tmp_path / "s"))).collect()
    assert [(a.record, a.idx, a.element, a.z) for a in atoms] == [("one", 0, "H", 0.0), ("one", 1, "C", 3.0)]
    line = "ATOM      1  C   MOL     1    " + f"{1.5:8.3f}{-2.25:8.3f}{3.0:8.3f}" + " " * 22 + " C"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "two.txt").write_text("HEADER\n" + line + "\nEND\n")
    assert [tuple(r) for r in readers.scan_fixed_width(spark, str(tmp_path / "f")).collect()] == [("two", 0, "C", 1.5, -2.25, 3.0)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "run7.log").write_text("epoch 1 mae 0.5 time 2.0\nnoise\nepoch 2 mae 0.4 time 2.5\n")
    r = readers.log_summary(readers.scan_run_logs(spark, str(tmp_path / "l"))).first()
    assert (r.run, r.best_epoch, r.last_mae, r.seconds) == ("run7", 2, 0.4, 4.5)
    manifest = frame(spark, [("m/a.jsonl", 1), ("m/gone", 5)], "path string, size long")
    assert {r.path: r.state for r in readers.file_inventory(spark, str(tmp_path / "m"), manifest).collect()} == {"m/a.jsonl": "size_mismatch", "m/gone": "missing"}
    edges = frame(spark, [(1, 0, 1, 0.5)], "record long, dst long, src long, dist double")
    assert readers.write_edge_store(edges, str(tmp_path / "e"), "record", 2).first().n == 1
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_once(edges, str(tmp_path / "e"), ["record"])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
