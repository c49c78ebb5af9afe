"""Packing into optimal length buckets.

The global histogram of lengths decides the buckets: dynamic programming picks at most `buckets` upper bounds so that padding
every text to its bucket's bound wastes the fewest tokens in all. Inside a bucket a batch holds as many texts as fit `budget`
padded tokens (one at least), so a text's batch follows from its rank alone. Ranks come from slices of the ids' hash: rows are
numbered inside a slice, and a slice begins where the counts of the slices before it end; no bucket is sorted in one task.

The histogram has one bar per distinct length, so the bounds are best among all. D distinct lengths take D * D / 2 tokens at least:
a corpus of 10^12 tokens has under 1.5 million bars.

Null or empty text: length 0 plus the end token. Repeated rows are packed each; rows with the same hash are ordered by id and length.
A text longer than the budget is a batch of its own. Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep

#: A word is a run of anything but these (as \\x20 and \\x09 to \\x0D); one end token is added.
SPACE = r"[\x20\x09-\x0D]+"


def length_of(text: Column) -> Column:
    """Words and one end token."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long") + 1


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The bounds, rising, with the least sum of bound times texts; lengths rise and are distinct. Fewer bounds win a tie.

    best[j] is the least cost of the first j lengths. The best last cut never moves back as j grows, so each further bucket is
    solved by halving: the middle's cut bounds the cuts on either side.
    """
    n = len(lengths)
    if not n:
        return []
    below = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    best = lengths.astype(np.int64) * below[1:]
    cuts = [np.zeros(n, np.int64)]
    best = np.concatenate([[0], best])
    for _ in range(1, min(buckets, n)):
        new, cut = best.copy(), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            ks = np.arange(a, min(mid - 1, b) + 1)
            cost = best[ks] + lengths[mid - 1] * (below[mid] - below[ks])
            k = int(np.argmin(cost))
            new[mid], cut[mid] = cost[k], ks[k]
            todo += [(lo, mid - 1, a, int(ks[k])), (mid + 1, hi, int(ks[k]), b)]
        cuts.append(cut[1:])
        if new[n] >= best[n]:
            cuts.pop()
            break
        best = new
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j - 1])
        if not j:
            break
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", buckets: int = 16, budget: int = 65_536, slice_rows: int = 20_000) -> DataFrame:
    """(id, n_tokens, bucket, padded, batch, place): bucket numbers rise with length, batch counts in its bucket, place in its batch."""
    length = length_of(F.col(text_col).cast("string")) if length is None else length
    place0 = F.monotonically_increasing_id().alias("place0")  # written with the row; it only deals rows without an id to the slices
    rows = keep(docs.select(F.col(id_col).cast("long").alias("id"), length.alias("n_tokens"), place0))
    hist = rows.groupBy(F.col("n_tokens").alias("top")).count().orderBy("top").collect()  # bounded, see above
    bounds = best_bounds(np.array([r.top for r in hist], np.int64), np.array([r["count"] for r in hist], np.int64), buckets)
    total = sum(r["count"] for r in hist)
    if not bounds:
        bounds = [1]
    tops = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    slices = max(1, math.ceil(total / slice_rows))
    placed = rows.withColumn("bucket", F.size(F.filter(tops, lambda b: b < F.col("n_tokens")))).withColumn("slice", F.pmod(F.xxhash64(F.coalesce("id", "place0"), "n_tokens"), F.lit(slices)))
    sizes = placed.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    begins = keep(sizes.withColumn("begin", F.sum("n").over(W.partitionBy("bucket").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).select("bucket", "slice", F.coalesce("begin", F.lit(0)).alias("begin")))
    inside = F.row_number().over(W.partitionBy("bucket", "slice").orderBy(F.xxhash64(F.lit(1), "id"), "id", "n_tokens")) - 1
    padded = F.element_at(tops, F.col("bucket") + 1)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / padded)).cast("long")
    ranked = placed.withColumn("inside", inside).join(begins.hint("shuffle_merge"), ["bucket", "slice"]).withColumn("rank", F.col("begin") + F.col("inside"))
    return ranked.select("id", "n_tokens", "bucket", padded.alias("padded"), F.floor(F.col("rank") / per).cast("long").alias("batch"), (F.col("rank") % per).alias("place"))


def op5_length_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
