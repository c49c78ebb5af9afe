"""The given tables as records, predictions, points and the like; the same bindings in SQL for the checks.

record: a line of lineitem with its part. group: supplier:part. identity keys: supplier (donor) and part (acceptor).
y: the extended price in thousands. m1, m2: two deterministic predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS_SQL = """
lines AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(l_extendedprice * 100 AS BIGINT) AS record0, *, l_suppkey || ':' || l_partkey AS grp
  FROM lineitem
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY record0 ORDER BY l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS copy FROM lines
), records AS (
  SELECT record0 || '-' || copy AS record, grp, l_suppkey AS donor, l_partkey AS acceptor, l_orderkey AS orderkey, l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status, l_quantity AS qty, l_discount AS discount, l_tax AS tax,
    l_extendedprice / 1000 AS y, l_quantity * p_retailprice / 1000 AS m1, l_extendedprice / 1000 * (1 - l_discount) AS m2, p_size AS psize, p_retailprice AS price, p_brand AS brand,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS aux
  FROM numbered JOIN part ON l_partkey = p_partkey
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part. The copies of an id are numbered; whether any id has two is counted first, by a hash of the id alone, and where
    none has, no row is shuffled for it."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    from pyspark.sql import Window as W

    named = [F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")]
    line = line.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    once = line.groupBy(F.xxhash64(*named, "cents").alias("h")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    # lines of one part are together after the join, so the copies of an id are numbered there without a second shuffle
    copy = F.row_number().over(W.partitionBy(*named, "cents").orderBy("l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"))
    rows = rows.withColumn("copy", F.lit(1) if once else copy)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cents", "copy").alias("record"), F.concat_ws(":", "l_suppkey", "l_partkey").alias("grp"), F.col("l_suppkey").alias("donor"), F.col("l_partkey").alias("acceptor"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("m1"), (F.col("l_extendedprice") / 1000 * (1 - F.col("l_discount"))).alias("m2"), F.col("p_size").alias("psize"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("aux"),
    )


PREDICTIONS_SQL = RECORDS_SQL + """, predictions AS (
  SELECT record, grp, donor, acceptor, qty, psize, line, flag, aux, discount, 'm1' AS model, y, m1 AS pred, m1 - y AS err, abs(m1 - y) AS abs_err FROM records
  UNION ALL SELECT record, grp, donor, acceptor, qty, psize, line, flag, aux, discount, 'm2', y, m2, m2 - y, abs(m2 - y) FROM records
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["record", "grp", "donor", "acceptor", "qty", "psize", "line", "flag", "aux", "discount", "y"]
    r = records(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in ("m1", "m2")])
    return r.select(*keys, F.inline(pairs)).withColumns({"err": F.col("pred") - F.col("y"), "abs_err": F.abs(F.col("pred") - F.col("y"))})


POINTS_SQL = """points AS (
  SELECT label AS record, vec_id AS idx, CAST(embedding[1] AS DOUBLE) * 4 AS x, CAST(embedding[2] AS DOUBLE) * 4 AS y, CAST(embedding[3] AS DOUBLE) * 4 AS z,
    CASE vec_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'donor' WHEN 2 THEN 'donor' ELSE 'acceptor' END AS role
  FROM embeddings
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.get("embedding", F.lit(k)).cast("double") * 4
    m = F.col("vec_id") % 5
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("record"), F.col("vec_id").alias("idx"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.when(m == 0, "unknown").when(m <= 2, "donor").otherwise("acceptor").alias("role"))
