"""Hard negatives by exact integer inner products, many at once in one wide integer.

Vectors become whole numbers, floor(scale * x). The candidates of a block are packed by component: each one's component, biased to be no
less than zero, lies in a field of its own of one wide integer, as wide as the largest sum that can arise there. So an anchor's
component times that integer is that component times all candidates' ones; the products are summed over the components, and each field
then holds one candidate's sum, from which the biases are taken off: exact scores, 64 multiplications of wide integers for 64 components.

Rows and anchors are dealt into blocks, and each task takes a pair of blocks. The first pass finds each anchor's positives among the block's
rows of its label alone; their scores make the windows in which the second pass looks for negatives of other labels. Either
pass returns no more than the first few of each block, and these are ranked per anchor; that is all a list of the first few can need.
Which blocks there are changes nothing in the result.

Rows with a null id, label or vector or with a null or non-finite component take no part. Repeated rows are rows of their own. Ties go to the
smaller id. Vectors of unequal lengths, or so large that a score takes over 56 bits, raise an error. No valid rows or anchors: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep

MET = pa.schema([("a", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
MET_SQL = "a long, anchor_id long, positive_id long, positive_score long, place int, id long, score long"


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)


class Packed:
    """The rows of a matrix of whole numbers from -bias to bias, packed by component."""

    def __init__(self, rows: np.ndarray, bias: int):
        width = rows.shape[1]
        most = width * (2 * bias) ** 2
        if most >= 1 << 56:
            raise ValueError("scores of these vectors take over 56 bits")
        self.bias, self.n = bias, len(rows)
        self.field = np.dtype("<u4" if most < 1 << 32 else "<u8")
        self.wide = [int.from_bytes((rows[:, i] + bias).astype(self.field).tobytes(), "little") for i in range(width)]
        self.taken_off = bias * rows.sum(axis=1) + width * bias * bias

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products of all rows with the anchor."""
        total = 0
        for component, wide in zip((anchor + self.bias).tolist(), self.wide, strict=True):
            total += component * wide
        fields = np.frombuffer(total.to_bytes(self.n * self.field.itemsize, "little"), self.field).astype(np.int64)
        return fields - self.taken_off - self.bias * int(anchor.sum())


def first(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores among the given places, largest first, earlier places first at ties."""
    if len(among) > k:
        own = -scores[among]
        among = among[own <= np.partition(own, k - 1)[k - 1]]
    return among[np.argsort(-scores[among], kind="stable")][:k]


def _rows(found: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * len(MET), MET.types, strict=True)], schema=MET)


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("label", "ascending"), ("id", "ascending"), ("row", "ascending")])


def positives_of_block(anchors: pa.Table, rows: pa.Table, width: int, bias: int, k: int) -> pa.Table:
    """For each anchor the first k other rows of its label in this block."""
    rows, found = _sorted(rows), []
    labels, ids, own = rows["label"].to_numpy(), rows["id"].to_numpy(), rows["row"].to_numpy()
    values, of_anchor = matrix(rows["v"], width), matrix(anchors["v"], width)
    packs: dict[str, tuple[int, Packed]] = {}
    for a, id_, label, v in zip(anchors["row"].to_pylist(), anchors["id"].to_pylist(), anchors["label"].to_pylist(), of_anchor, strict=True):
        if label not in packs:
            start, end = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
            packs[label] = start, Packed(values[start:end], bias)
        start, pack = packs[label]
        scores = pack.scores(v) if pack.n else np.zeros(0, np.int64)
        best = first(scores, np.flatnonzero(own[start : start + pack.n] != a), k)
        found += [(a, id_, None, None, None, int(ids[start + i]), int(scores[i])) for i in best]
    return _rows(found)


def negatives_of_block(anchors: pa.Table, rows: pa.Table, width: int, bias: int, k: int) -> pa.Table:
    """For each anchor and positive the first k rows of other labels in this block whose scores lie in the positive's window."""
    rows, found = rows.sort_by([("id", "ascending"), ("row", "ascending")]), []
    labels, ids, pack = rows["label"].to_numpy(), rows["id"].to_numpy(), Packed(matrix(rows["v"], width), bias)
    other = {label: labels != label for label in set(anchors["label"].to_pylist())}
    for a, id_, label, windows, v in zip(anchors["row"].to_pylist(), anchors["id"].to_pylist(), anchors["label"].to_pylist(), anchors["windows"].to_pylist(), matrix(anchors["v"], width), strict=True):
        scores, best = pack.scores(v), {}
        for w in windows:
            span = w["low"], w["high"]
            if span not in best:
                best[span] = first(scores, np.flatnonzero((scores >= span[0]) & (scores <= span[1]) & other[label]), k)
            found += [(a, id_, w["positive_id"], w["positive_score"], w["place"], int(ids[i]), int(scores[i])) for i in best[span]]
    return _rows(found)


def _in_blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, most: int, f) -> DataFrame:
    """f over every pair of a block of anchors and a block of rows, each pair a task's work of bounded size."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    high, wide = math.ceil(n_anchors / most), max(partitions, math.ceil(n_rows / most))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"_a": F.pmod(F.xxhash64("row"), F.lit(high)).cast("int"), "_b": every(wide)})
    fresh = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own, as anchors may come from the same table
    right = fresh.withColumns({"_a": every(high), "_b": F.pmod(F.xxhash64("row"), F.lit(wide)).cast("int")})
    both = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b"))
    return both.applyInArrow(lambda x, y: f(x, y) if x.num_rows and y.num_rows else MET.empty_table(), MET_SQL)


def hard_negatives(
    rows: DataFrame, anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = 8192,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, vector); `anchor` is a condition on id.

    A row's score is its inner product with the anchor, both as floor(scale * x). An anchor's positives are the first `n_positives` other
    rows of its label. For each: the first `n_negatives` rows of other labels whose score is `low` to `high` percent of the positive's."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    of_doubles = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    valid = of_doubles.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    whole = keep(valid.select("id", "label", F.transform("vector", lambda x: F.floor(scale * x)).alias("v"), F.monotonically_increasing_id().alias("row")))
    largest = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))
    size = whole.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("width"), largest.alias("bias"), F.count_if(anchor).alias("anchors")).first()
    if size.least != size.width:
        raise ValueError("vectors are of unequal lengths")
    if not size.anchors:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width, bias = size.width, int(size.bias)
    chosen = whole.where(anchor)
    met = _in_blocks(chosen, whole, size.anchors, size.n, block_rows, lambda x, y: positives_of_block(x, y, width, bias, n_positives))
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "id"))
    positive = met.withColumn("place", place).where(F.col("place") <= n_positives)
    exact = lambda percent, up: F.expr(f"(score * {percent} - pmod(score * {percent}, 100L)) div 100" + (f" + if(pmod(score * {percent}, 100L) > 0, 1L, 0L)" if up else ""))
    window = F.struct("place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), exact(low, True).alias("low"), exact(high, False).alias("high"))
    windows = keep(positive.groupBy(F.col("a").alias("row")).agg(F.collect_list(window).alias("windows")))
    searching = chosen.join(windows.hint("shuffle_hash"), "row")
    met = _in_blocks(searching, whole, size.anchors, size.n, block_rows, lambda x, y: negatives_of_block(x, y, width, bias, n_negatives))
    rank = F.row_number().over(W.partitionBy("a", "place").orderBy(F.desc("score"), "id"))
    ranked = met.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(given.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


OP12_SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM sound a JOIN sound r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 10
"""
