"""Work that one task would hold whole before is dealt over tasks."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from groupwise.plans import catalog
from groupwise.sources.readers import write_edge_store


def test_a_shard_has_files_by_its_edges(spark, tmp_path):
    edges = spark.range(2000).select((F.col("id") % 400).alias("record"), F.col("id").alias("dst"), (-F.col("id")).alias("src"), F.lit(1.0).alias("dist"))
    stats = write_edge_store(edges, str(tmp_path / "e"), "record", 2, file_rows=250)
    assert stats.count() == 2 and stats.agg(F.sum("n")).first()[0] == 2000
    seen = []
    for path in (tmp_path / "e").rglob("*.parquet"):
        table = pq.ParquetFile(path).read().to_pydict()
        rows = list(zip(table["record"], table["dst"], table["src"], strict=True))
        assert rows == sorted(rows) and len(rows) <= 500
        seen += set(table["record"])
    assert len(seen) == len(set(seen)) == 400


def test_quartiles_of_a_model_are_in_no_single_task(spark):
    plan = catalog.QUERIES["a41_skill"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
