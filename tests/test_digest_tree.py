"""The exact digest against its SQL where the buckets need a tree of more than one level."""

import duckdb
import pytest

from groupwise.operators.contracts import bucketed_digest
from groupwise.plans.bindings import records
from groupwise.plans.q_contracts import _digest_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bucket_rows", [100, 5, 0.05])
def test_digest_matches_sql_at_each_height(spark, bucket_rows):
    """6,000 rows: one level, two and three."""
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = bucketed_digest(records(spark, SF).select("record", "flag"), "record", ["record", "flag"], bucket_rows).first().digest
    assert found == con.execute(_digest_sql(bucket_rows)).fetchone()[0]
