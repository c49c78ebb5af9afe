"""Bounds for texts of more than 4096 tokens."""

from groupwise.llm.packing import best_bounds, pack
from pyspark.sql import functions as F
import numpy as np


def test_long_lengths_are_not_rounded(spark):
    lengths = [4097, 4099, 5001, 5003, 9001, 9001, 20021, 20021, 20021, 7]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    got = pack(docs, length=F.col("n"), buckets=4).collect()
    values, counts = np.unique(lengths, return_counts=True)
    assert sorted({r.padded for r in got}) == best_bounds(values, counts, 4)
    assert max(r.padded for r in got) == 20021
