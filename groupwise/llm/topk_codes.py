"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into `parts` segments. Round s looks up every segment value at exactly s changed bits of the query's. A code at
Hamming distance below parts * (s + 1) has a segment with at most s changed bits, so after round s all codes that near have been
seen. A query is done when its k-th verified distance is covered; only the others take part in the next round, so the search is exact.
A code farther than the k-th distance found so far is dropped inside the join, as it cannot be among the nearest.

Equal codes are searched once: the index holds each distinct code with its smallest k + 1 ids, which are all a top-k list can need.
A pair is verified once, by the first segment with the fewest changed bits; nothing is deduplicated by a shuffle.

Null vectors have no code and no neighbours; rows with a null id take no part, as they can neither be named nor told from the query's own row; vectors of over 64 elements are an error. Repeated ids are separate rows with equal id. Ties go to the smaller id. A query never finds its
own row's id. Fewer than k other rows: all of them. Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep


def sign_code(vector: Column) -> Column:
    """Bit i is 1 if element i is above 0. A vector of over 64 elements has no such code and raises an error."""
    fits = F.when(F.size(vector) <= 64, vector).when(F.size(vector) > 64, F.raise_error(F.lit("a code has 64 bits at most")).cast("array<double>"))
    bits = F.transform(fits.cast("array<double>"), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segment_bounds(bits: int, parts: int) -> list[tuple[int, int]]:
    cuts = [bits * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def segment_width(n: int) -> int:
    """Bits of a segment for n distinct codes: somewhat below log2 n, so that most probed values are in use, in steps, so that tables of like size are searched alike."""
    return next(w for w, most in ((10, 12), (13, 18), (16, 24), (22, 30), (32, 64)) if math.log2(max(n, 2)) <= most)


def changed_values(value: Column, width: int, flips: int) -> Column:
    """All values that differ from `value` in exactly `flips` of its `width` bits: bits are flipped one at a time, each above the last one."""
    begin = F.array(F.struct(value.alias("v"), F.lit(0).alias("next")))
    places = F.array(*map(F.lit, range(width)))
    flip = lambda m: F.transform(F.slice(places, m["next"] + 1, width), lambda b: F.struct(m["v"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias("v"), (b + 1).alias("next")))
    for _ in range(flips):
        begin = F.flatten(F.transform(begin, flip))
    return F.transform(begin, lambda m: m["v"])


def search(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, parts: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) for queries (id, code) among codes (id, code)."""
    sound = "code is not null and id is not null"
    codes, queries = codes.select("id", "code").where(sound), keep(queries.where(sound).select(F.col("id").alias("query_id"), F.col("code").alias("q")))
    index = _bounded(codes, k)
    n = index.count()
    parts = parts or math.ceil(bits / segment_width(n))
    if not math.ceil(bits / 32) <= parts <= bits:
        raise ValueError("segments have 1 to 32 bits")
    cuts = segment_bounds(bits, parts)
    piece = lambda c, a, b: F.shiftrightunsigned(F.col(c), a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))
    segment = lambda c: F.array(*[F.struct(F.lit(j).alias("part"), piece(c, a, b).alias("value")) for j, (a, b) in enumerate(cuts)])
    posted = keep(index.select("code", "ids", F.inline(segment("code"))))
    left = keep(queries.select("q").distinct().withColumn("far", F.lit(bits)))  # far: nothing beyond it can be among the nearest
    best = None  # the k + 1 nearest ids so far of each query code
    done = []
    for s in range(max(b - a for a, b in cuts) + 1):
        of_part = lambda j, a, b: F.transform(changed_values(piece("q", a, b), b - a, s), lambda v: F.struct(F.lit(j).alias("part"), v.alias("value")))
        changed = F.concat(*[of_part(j, a, b) for j, (a, b) in enumerate(cuts) if b - a >= s])
        probes = left.select("q", "far", F.inline(changed))
        apart = [F.bit_count(piece("q", a, b).bitwiseXOR(piece("code", a, b))) for a, b in cuts]
        first = F.lit(True)
        for j, d in enumerate(apart):  # no segment is nearer, and no earlier one as near
            first = first & F.when(F.col("part") > j, d > s).otherwise(d >= s)
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = probes.join(posted.hint("shuffle_merge"), ["part", "value"]).where((distance <= F.col("far")) & first).select("q", "ids", distance.alias("distance"))
        met = met.select("q", "distance", F.explode("ids").alias("id"))
        if best is not None:
            met = met.unionAll(best)
        best = keep(met.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).where(F.col("r") <= k + 1).drop("r"))
        # The k + 1 nearest are final if the last of them is covered; otherwise the code goes on. Every code within the bound has been seen.
        reach = keep(best.groupBy("q").agg(F.max("distance").alias("far"), F.count("*").alias("n")).where(F.col("n") > k).select("q", "far"))
        covered = keep(reach.where(F.col("far") < parts * (s + 1)).select("q"))
        done.append(best.join(covered.hint("shuffle_merge"), "q", "left_semi"))
        best = keep(best.join(covered.hint("shuffle_merge"), "q", "left_anti"))
        left = keep(left.select("q").join(covered.hint("shuffle_merge"), "q", "left_anti").join(reach.hint("shuffle_merge"), "q", "left").select("q", F.coalesce("far", F.lit(bits)).alias("far")))
        if left.isEmpty():
            break
    found = best
    for d in done:
        found = found.unionAll(d)
    paired = queries.join(found.hint("shuffle_merge"), "q").where("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy("distance", "id"))
    return paired.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _bounded(codes: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k + 1 smallest ids of each code; numbered in 64 salts first, so that no task sorts all rows of a code."""
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(W.partitionBy("code", "salt").orderBy("id"))).where(F.col("r") <= k + 1).select("code", "id")
    few = some.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    return keep(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))


def op7_exact_topk_codes(spark, sf_dir: str) -> DataFrame:
    codes = keep(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")))
    found = search(codes, codes.where("id % 20 = 0"))
    return found.select(F.col("query_id"), "rank", F.col("id").alias("vec_id"), "distance")


OP7_SQL = """
WITH codes AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
