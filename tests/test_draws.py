"""Bootstrap draws at size."""

from groupwise.operators.resample import multiplicities


def test_draws_are_rows_and_not_one_array(spark):
    """The draws were an array of all slots, made in the driver: 288 MB for 36 million units."""
    drawn = multiplicities(spark.range(1000).withColumnRenamed("id", "k"), "k", 3, 7)
    assert "Generate" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.b, r.n) for r in drawn.groupBy("b").agg({"m": "sum"}).withColumnRenamed("sum(m)", "n").collect()} == {(b, 1000) for b in range(3)}
