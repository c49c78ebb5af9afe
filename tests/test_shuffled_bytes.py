"""What queries shuffle: bytes a row of the input at sf0.001, where the forms before took more; and the packed forms against plain ones."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from groupwise.operators import candidates, resample, stats
from groupwise.plans import bindings

SF = "/root/testdata/sf0.001"


def shuffled_bytes(spark, run):
    store = spark._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: store.stageList(None, False, False, none, None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    out, after = run(), stages()
    return out, sum(after.apply(i).shuffleWriteBytes() for i in range(after.size()) if after.apply(i).stageId() not in before)


@pytest.mark.parametrize(("name", "most"), [("d5_shortlist_checks", 180), ("r5_record_bootstrap", 450), ("x7_verify", 230), ("a16_redundant_pairs", 250)])
def test_bytes_a_line(spark, name, most):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    _, moved = shuffled_bytes(spark, lambda: __spark_entry__.queries()[name](spark, SF).collect())
    assert moved < most * lines


def test_a_pair_travels_as_three_numbers(spark):
    side = lambda c, n: spark.range(n).select(F.col("id").alias(c)).repartition(2).cache()
    seen = spark.createDataFrame([(1, 2), (1, 2), (3, None)], "a long, b long")
    run = lambda: candidates.universe(side("a", 300), side("b", 400), seen, "a", "b", (F.col("a") * F.col("b")).cast("string"), 1).groupBy("status").agg(F.count("*"), F.sum("support_a"), F.sum("support_b")).collect()
    got, moved = shuffled_bytes(spark, run)
    assert {r[0] for r in got} == {"observed", "known_product", "collision", "low_support"}
    assert sum(r[1] for r in got) == 120_000
    assert (sum(r[2] for r in got), sum(r[3] for r in got)) == (2 * 400 + 400, 2 * 300)
    assert moved < 12 * 120_000


@pytest.mark.parametrize("width", [1 << 16, 7, 1])
def test_packed_draws(spark, width):
    units = spark.createDataFrame([(f"k{i:03}", float(i * i % 17)) for i in range(50)], "k string, v double").repartition(3)
    m = resample.multiplicities(units, "k", 9, 5).join(units, "k").groupBy("b").agg((F.sum(F.col("m") * F.col("v")) / F.sum("m")).alias("stat"))
    got = {r.b: r.stat for r in resample.drawn_means(units, "k", "v", 9, 5, width).collect()}
    assert got == pytest.approx({r.b: r.stat for r in m.collect()})
    assert resample.drawn_means(units.where("false"), "k", "v", 9, 5).count() == 0


def test_copies_of_a_line_are_numbered(spark, tmp_path):
    line, part = (spark.read.parquet(f"{SF}/{t}.parquet").limit(n) for t, n in (("lineitem", 40), ("part", 1000)))
    line.union(line.limit(10).withColumn("l_tax", F.lit(0.5))).union(line.limit(3)).write.parquet(f"{tmp_path}/lineitem.parquet")
    part.write.parquet(f"{tmp_path}/part.parquet")
    r = bindings.records(spark, str(tmp_path)).select("record", "tax").collect()
    assert len({x.record for x in r}) == len(r)
    late = [x.record.rsplit("-", 1)[1] for x in r if x.tax == 0.5]
    assert late and set(late) <= {"2", "3"}


def test_ranks_with_and_without_a_shuffle(spark):
    rows = spark.createDataFrame([(g, float(x % 5), float(x % 3)) for g in "ab" for x in range(40)] + [("a", None, 1.0)], "g string, x double, y double")
    few, many = (sorted(map(str, stats.average_ranks(rows, {"x": "rx", "y": "ry"}, ["g"], few=n).collect())) for n in (1000, 0))
    assert few == many
