"""Bootstrap inference with draws that any engine can repeat.

Units are numbered once; replicate b draws unit index hash(seed, b, slot) mod n. What is joined are units and replicates, not
records: statistics are summed per unit first, so the work is units times replicates whatever the number of records. For many units,
`poisson_weights` gives each (replicate, unit) its own Poisson(1) multiplicity from its hash, with no join at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.functions.scalar import draw, uniform
from groupwise.storage import stored

from .stats import running_sum


def numbered(units: DataFrame, key: str) -> DataFrame:
    """Units with `idx` from 0 in the order of the key; two-level, no global sort in one task."""
    return running_sum(units.withColumn("_one", F.lit(1).cast("long")), [], [key], "_one", "idx").withColumn("idx", F.col("idx") - 1).drop("_one")


def multiplicities(units: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(b, key, m) for the units drawn at least once; n draws a replicate. The draws are made in the tasks, a row each, and meet the units by the one
    shuffle that counts them."""
    named = stored(numbered(units.select(key).distinct(), key))
    n = named.count()
    if not n:
        return named.select(F.lit(0).cast("long").alias("b"), key, F.lit(0).cast("long").alias("m"))
    tasks = max(named.sparkSession.sparkContext.defaultParallelism, -(-replicates * n // 2_000_000))
    slots = named.sparkSession.range(0, replicates * n, 1, tasks).select(F.expr(f"id div {n}").alias("b"), F.expr(f"id % {n}").alias("slot"))
    drawn = slots.select("b", draw(F.lit(n), seed, F.col("b"), F.col("slot")).alias("idx")).repartition("idx").groupBy("b", "idx").agg(F.count("*").alias("m"))
    return drawn.join(named.hint("shuffle_hash"), "idx").select("b", key, "m")


def poisson_weights(units: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """R0, large n: Poisson(1) multiplicity by inversion, cut at 12 (its tail is below 1e-10)."""
    p, terms = 0.36787944117144233, []
    total = 0.0
    for k in range(12):
        total += p
        terms.append(total)
        p /= k + 1
    rows = units.select(key).distinct().withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    u = uniform(seed, F.col("b"), F.col(key))
    return rows.withColumn("m", F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: t < u)).cast("long")).where("m > 0").select("b", key, "m")


def unit_means(df: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """(key, v): mean per unit, weighted if asked."""
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    mean = F.sum(F.col(weight) * F.col(value)) / F.sum(weight) if weight else F.avg(value)
    return rows.groupBy(key).agg(mean.alias("v"))


def interval(stats: DataFrame, value: str = "stat", level: float = 0.95) -> DataFrame:
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return stats.agg(F.percentile(value, F.array(F.lit(lo), F.lit(hi))).alias("_q"), F.count(value).alias("n_replicates")).select(F.get("_q", 0).alias("lo"), F.get("_q", 1).alias("hi"), "n_replicates")


def drawn_means(units: DataFrame, key: str, value: str, replicates: int, seed: int, width: int = 1 << 16) -> DataFrame:
    """(b, stat): the mean over the units of each replicate's n draws (R0); units: one row a key.

    The units are cut by number into ranges of at most `width`. A task packs its draws as two bytes each, a list for every replicate and range, and a
    range's lists meet its values once, so neither draws nor keys are shuffled as rows."""
    named = stored(numbered(units.select(key, F.col(value).cast("double").alias("v")), key).select("idx", "v"))
    n = named.count()
    width = max(1, min(width, 1 << 16, (1 << 23) // max(1, replicates)))
    tasks = max(named.sparkSession.sparkContext.defaultParallelism, -(-replicates * n // 2_000_000))
    slots = named.sparkSession.range(0, replicates * n, 1, tasks).select(F.expr(f"id div {max(n, 1)}").alias("b"), F.expr(f"id % {max(n, 1)}").alias("slot"))
    draws = slots.select("b", draw(F.lit(n), seed, F.col("b"), F.col("slot")).alias("idx"))

    def lists(b: np.ndarray, idx: np.ndarray) -> pa.RecordBatch:
        part, at = idx // width, (idx % width).astype(np.uint16)
        order = np.lexsort((part, b))
        b, part, at = b[order], part[order], at[order]
        first = np.flatnonzero(np.append(True, (np.diff(b) != 0) | (np.diff(part) != 0)))
        held = [x.tobytes() for x in np.split(at, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(b[first]), pa.array(held, pa.binary())], names=["part", "b", "drawn"])

    def packed(batches):
        held, many = [], 0
        for batch in batches:
            held.append((batch["b"].to_numpy(), batch["idx"].to_numpy()))
            many += batch.num_rows
            if many >= 1 << 21:
                yield lists(*map(np.concatenate, zip(*held, strict=True)))
                held, many = [], 0
        if many:
            yield lists(*map(np.concatenate, zip(*held, strict=True)))

    def summed(drawn: pa.Table, own: pa.Table) -> pa.Table:
        v = np.zeros(width)
        there = np.zeros(width, bool)
        v[own["at"].to_numpy()] = pc.fill_null(own["v"], 0.0).to_numpy()
        there[own["at"].to_numpy()] = pc.is_valid(own["v"]).to_numpy()
        total = np.zeros((2, replicates))
        for b, x in zip(drawn["b"].to_pylist(), drawn["drawn"], strict=True):
            at = np.frombuffer(x.as_buffer(), np.uint16)
            total[0, b] += v[at].sum()
            total[1, b] += there[at].sum()
        return pa.table([pa.array(np.arange(replicates)), pa.array(total[0]), pa.array(total[1])], names=["b", "s", "n"])

    own = named.select(F.expr(f"idx div {width}").alias("part"), F.expr(f"int(idx % {width})").alias("at"), "v")
    met = draws.mapInArrow(packed, "part long, b long, drawn binary").groupBy("part").cogroup(own.groupBy("part")).applyInArrow(summed, "b long, s double, n double")
    return met.groupBy("b").agg((F.sum("s") / F.sum("n")).alias("stat")).where("stat is not null")


def replicate_means(units: DataFrame, key: str, value: str, replicates: int, seed: int, poisson: bool = False) -> DataFrame:
    """(b, stat): the mean over drawn units."""
    if not poisson:
        return drawn_means(units, key, value, replicates, seed)
    m = poisson_weights(units, key, replicates, seed)
    return m.join(units.select(key, value).hint("shuffle_hash"), key).groupBy("b").agg((F.sum(F.col("m") * F.col(value)) / F.sum("m")).alias("stat"))


def cluster_interval(df: DataFrame, key: str, value: str, replicates: int = 1000, seed: int = 42, weight: str | None = None, poisson: bool = False) -> DataFrame:
    """R1 (R5 with a record key, R7 with a weight): point, lo, hi of the macro mean over clusters."""
    units = stored(unit_means(df, key, value, weight))
    point = units.agg(F.avg("v").alias("point"), F.count("*").alias("n_units"))
    return point.crossJoin(interval(replicate_means(units, key, "v", replicates, seed, poisson)))  # one row each


def paired_difference(df: DataFrame, key: str, first: str, second: str, replicates: int = 1000, seed: int = 42, weight: str | None = None) -> DataFrame:
    """R2: mean cluster difference first - second, its interval and whether that excludes 0."""
    out = cluster_interval(df.withColumn("_d", F.col(first) - F.col(second)), key, "_d", replicates, seed, weight)
    return out.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def population_contrast(a: DataFrame, b: DataFrame, key: str, value: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Difference and ratio of two independent macro means, a against b, drawn apart."""
    ua, ub = stored(unit_means(a, key, value)), stored(unit_means(b, key, value))
    both = replicate_means(ua, key, "v", replicates, seed).withColumnRenamed("stat", "x").join(replicate_means(ub, key, "v", replicates, seed + 1).withColumnRenamed("stat", "y").hint("shuffle_merge"), "b")
    diff = interval(both.withColumn("stat", F.col("x") - F.col("y"))).select(F.col("lo").alias("diff_lo"), F.col("hi").alias("diff_hi"))
    ratio = interval(both.withColumn("stat", F.col("x") / F.nullif(F.col("y"), F.lit(0.0)))).select(F.col("lo").alias("ratio_lo"), F.col("hi").alias("ratio_hi"))
    point = ua.agg(F.avg("v").alias("mean_a")).crossJoin(ub.agg(F.avg("v").alias("mean_b")))
    return point.withColumns({"diff": F.col("mean_a") - F.col("mean_b"), "ratio": F.col("mean_a") / F.nullif(F.col("mean_b"), F.lit(0.0))}).crossJoin(diff).crossJoin(ratio)


def multiplicity_arrays(units: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(key, drawn): for each unit drawn at all its multiplicity in every replicate, two bytes each."""
    long = multiplicities(units, key, replicates, seed)
    kind = long.schema[key].dataType.simpleString()

    def packed(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                b, m = part["b"], part["m"]
                drawn = np.zeros((part.num_rows, replicates), np.uint16)
                drawn[np.repeat(np.arange(part.num_rows), b.value_lengths().to_numpy()), b.flatten().to_numpy()] = m.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([part["key"], pa.array([row.tobytes() for row in drawn], pa.binary())], names=["key", "drawn"])

    listed = long.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("b", "m")).alias("x"))  # at most an entry for each replicate
    return listed.select("key", "x.b", "x.m").mapInArrow(packed, f"key {kind}, drawn binary").withColumnRenamed("key", key)


def crossed_interval(df: DataFrame, first: str, second: str, value: str, replicates: int = 200, seed: int = 42, redraws: int = 20) -> DataFrame:
    """Two-way pigeonhole bootstrap: a record weighs the product of its two keys' multiplicities. Replicates whose total is 0 are drawn again
    under a new salt. Records are summed per key pair first. Each pair of keys meets the arrays of its keys' multiplicities, so there is one row a
    pair and not one for each replicate; each task adds up all replicates' sums, two numbers a replicate."""
    cells = stored(df.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(value).isNotNull()).groupBy(first, second).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n")))
    point = cells.agg((F.sum("s") / F.sum("n")).alias("point"))

    def run(count: int, salt: int) -> DataFrame:
        m1 = multiplicity_arrays(cells, first, count, seed + 1000 * salt).withColumnRenamed("drawn", "m1")
        m2 = multiplicity_arrays(cells, second, count, seed + 1 + 1000 * salt).withColumnRenamed("drawn", "m2")
        met = cells.join(m1.hint("shuffle_merge"), first).join(m2.hint("shuffle_merge"), second).select("s", "n", "m1", "m2")

        def summed(batches):
            total = np.zeros((2, count))
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    part = batch.slice(k, 1024)
                    one, two = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint16).reshape(-1, count).astype(np.float64) for c in ("m1", "m2"))
                    total += np.stack([part["s"].to_numpy(), part["n"].to_numpy().astype(np.float64)]) @ (one * two)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(count)), pa.array(total[0]), pa.array(total[1])], names=["b", "s", "n"])

        added = met.mapInArrow(summed, "b long, s double, n double").groupBy("b").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
        return added.select((F.col("s") / F.col("n")).alias("stat"))

    out, left = None, replicates
    for salt in range(redraws):
        one = stored(run(left, salt))
        out = one if out is None else out.unionAll(one)
        left = replicates - out.count()
        if left <= 0:
            break
    return point.join(interval(out).hint("broadcast"), F.lit(True))  # one row each


def bootstrap_weights(df: DataFrame, key: str, weight: str, replicates: int, seed: int = 42) -> DataFrame:
    """(b, rows of df, boot_weight = weight times multiplicity) for training."""
    return df.join(multiplicities(df, key, replicates, seed).hint("shuffle_hash"), key).withColumn("boot_weight", F.col(weight) * F.col("m")).drop("m")


def weight_sums(boot: DataFrame) -> DataFrame:
    """Each replicate's total weight, to check."""
    return boot.groupBy("b").agg(F.sum("boot_weight").alias("weight"), F.count("*").alias("n"))


def excludes(lo: Column, hi: Column, value: float = 0.0) -> Column:
    return (lo > value) | (hi < value)
