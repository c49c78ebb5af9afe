"""Ranking, quotas, capped and diverse picks, bin merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from groupwise.storage import stored

from .stats import running_sum, running_sums


def rank_percentile(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "percentile") -> DataFrame:
    """Rank / (n - 1) from 0 to 1 in a total order (value, then hash); one row has 0. Ranks by range partitions."""
    run = running_sums(df.withColumn("_one", F.lit(1).cast("long")), by, order, {"_one": "_c"}, whole={"_one": "_n"}).drop("_one")
    return run.withColumn(out, F.coalesce((F.col("_c") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)), F.lit(0.0))).drop("_c", "_n")


def keep_first(df: DataFrame, key: Sequence[str], priority: Sequence[Column]) -> DataFrame:
    """The first row per key; Spark keeps one row per key in each task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*priority))).where("_r = 1").drop("_r")


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows of a total order."""
    return df.orderBy(*order).limit(k)


def quota_sample(df: DataFrame, stratum: str, key: str, quota: int, total: int) -> DataFrame:
    """The `quota` rows with the smallest hash of each stratum, filled up to `total` with the smallest of the rest."""
    h = F.sha2(F.col(key).cast("string"), 256)
    rows = df.withColumn("_h", h)
    first = stored(rows.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy("_h", key))).where(F.col("_r") <= quota).drop("_r"))
    have = first.count()
    rest = rows.join(first.select(key), key, "left_anti").orderBy("_h", key).limit(max(0, total - have))
    return first.unionByName(rest).orderBy("_h", key).limit(total).drop("_h")


def nearest_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def inclusion_frequency(df: DataFrame, model: str, key: str, order: Sequence[str], share: float) -> DataFrame:
    """How often each id is in the lowest and in the highest share of the models' rankings."""
    ranked = rank_percentile(df, order, [model], "_p")
    return ranked.groupBy(key).agg(F.count("*").alias("n_models"), F.avg((F.col("_p") <= share).cast("double")).alias("low_frequency"), F.avg((F.col("_p") >= 1 - share).cast("double")).alias("high_frequency"))


def _can_be_picked(rows: DataFrame, by: Sequence[str], first: str, second: str, order: Sequence[Column], k: int, cap: int) -> DataFrame:
    """The rows of each group `by` that k picks in order, at most `cap` per value of either key, can take: a bounded number, found by rank.

    Before a pick, in order: of its pair of keys, picks alone, below cap; of either key of it, picks (below cap) and at most cap rows
    for each of the at most k - 1 full values of the other key; of all, k - 1 picks and the rows of the at most k - 1 full values of each key."""
    for keys, most in (([first, second], cap), ([first], k * cap), ([second], k * cap), ([], k + 2 * (k - 1) * k * cap)):
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(*by, *keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r") if keys or by else rows.orderBy(*order).limit(most)
    return rows


def capped_picks(pool: DataFrame, key: str, first: str, second: str, order: Sequence[Column], k: int, cap: int = 2, least: Column | None = None, used: tuple[Mapping, Mapping] = ({}, {}), keep: Sequence[str] = ()) -> DataFrame:
    """(key, pick, keep): up to k rows in order, at most `cap` per value of either key, counting earlier picks in `used`; fewer rather than more than the caps.

    One pass: the rows that any such picks can take number below k + 2 k^2 cap, and the picks are made among them."""
    one, two, picked = dict(used[0]), dict(used[1]), []
    rows = pool if least is None else pool.where(least)
    for c, counts in ((first, one), (second, two)):
        if full := [x for x, n in counts.items() if n >= cap]:
            rows = rows.where(~F.coalesce(F.col(c).isin(full), F.lit(False)))
    for row in _can_be_picked(rows, [], first, second, order, k, cap).orderBy(*order).collect() if k > 0 else []:
        if one.get(row[first], 0) < cap and two.get(row[second], 0) < cap and len(picked) < k and row[key] not in [p[0] for p in picked]:
            picked.append((row[key], len(picked) + 1, *(row[c] for c in keep)))
            one[row[first]], two[row[second]] = one.get(row[first], 0) + 1, two.get(row[second], 0) + 1
    kind = dict(pool.dtypes)
    return pool.sparkSession.createDataFrame(picked, ", ".join([f"{key} {kind[key]}", "pick int", *(f"{c} {kind[c]}" for c in keep)]))


def _similarities(rows: DataFrame, key: str, bits: str, keep: Sequence[str], against: Sequence[Sequence[int]]) -> DataFrame:
    """(key, keep, s): Tanimoto similarities of each row's set to a few given ones, in their order; the sets go out with the tasks."""
    others = [np.unique(np.array(x if x is not None else [], np.int64)) for x in against]
    kept = rows.select(key, *keep, F.col(bits).alias("_bits"))
    names = [key, *keep]

    def run(batches):
        for batch in batches:
            found = []
            for own in batch["_bits"].to_pylist():
                own = np.unique(np.array(own if own is not None else [], np.int64))
                common = [len(np.intersect1d(own, o, assume_unique=True)) for o in others]
                found.append([c / max(1, len(own) + len(o) - c) for c, o in zip(common, others, strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(found, pa.list_(pa.float64()))], names=[*names, "_s"])

    return kept.mapInArrow(run, StructType([kept.schema[n] for n in names]).add("_s", ArrayType(DoubleType())))


def diverse_picks(pool: DataFrame, key: str, bits: str, nearest: str, k: int, candidates: int = 64) -> DataFrame:
    """First the row with the lowest similarity to what is known, then each time the lowest largest similarity to the picks so far; ties by key.

    A row's largest similarity to the picks never falls. So a pass over the pool keeps its `candidates` lowest rows, and picks are made among
    these (their sets come to the driver) for as long as the lowest of them comes before the last row kept; only then is another pass
    needed, with the picks of all before. Fewer passes than picks, and the same picks as by one pass each."""
    rows, picked, sets = stored(pool.select(key, bits, F.coalesce(F.col(nearest).cast("double"), F.lit(0.0)).alias("_near"))), [], []
    while len(picked) < k:
        at_once = F.array_max("_s") if sets else F.col("_near")
        seen = _similarities(rows, key, bits, [bits, "_near"], sets or [[]]).withColumn("_top", at_once)
        left = seen.where(~F.col(key).isin([p[0] for p in picked])) if picked else seen
        some = [[r["_top"], r[key], r[bits]] for r in left.orderBy("_top", key).limit(candidates).collect()]
        last = some[-1][:2] if len(some) == candidates else None
        if not some:
            break
        while some and len(picked) < k:
            top, name, own = min(some, key=lambda r: r[:2])
            if last is not None and [top, name] > last:
                break
            first = not picked
            picked.append((name, len(picked) + 1, 0.0 if first else float(top)))
            sets.append(own)
            own = set(own or [])
            some = [[max(0.0 if first else t, _tanimoto(own, set(b or []))), n, b] for t, n, b in some if n != name]
            if first:
                break  # the first pick goes by another measure, so the pool has to be read again
    return pool.sparkSession.createDataFrame(picked, f"{key} {dict(pool.dtypes)[key]}, pick int, top_similarity double")


def _tanimoto(a: set, b: set) -> float:
    common = len(a & b)
    return common / max(1, len(a) + len(b) - common)


def matched_controls(picks: DataFrame, observed: DataFrame, key: str, bits: str, first: str, second: str, cap: int = 2) -> DataFrame:
    """For each pick (a few, see W8 and W9), in order, the most similar observed row that is not taken and keeps the caps; ties by the hash of the key.

    One pass over the observed rows gives for every pick the rows that it can take, a bounded number."""
    wanted = [(p[key], p[bits]) for p in picks.orderBy("pick").collect()]
    taken, one, two, out = set(), {}, {}, []
    kind = dict(observed.dtypes)[key]
    if wanted:
        like = _similarities(observed, key, bits, [first, second], [b for _, b in wanted]).select(key, first, second, F.posexplode("_s").alias("_pick", "_like"))
        order = [F.desc("_like"), F.sha2(F.col(key).cast("string"), 256), F.col(key)]
        found: dict[int, list] = {}
        for r in _can_be_picked(like, ["_pick"], first, second, order, len(wanted), cap).orderBy("_pick", *order).collect():
            found.setdefault(r["_pick"], []).append(r)
        for n, (name, _) in enumerate(wanted):
            row = next((r for r in found.get(n, []) if r[key] not in taken and one.get(r[first], 0) < cap and two.get(r[second], 0) < cap), None)
            if row is None:
                break
            taken.add(row[key])
            one[row[first]], two[row[second]] = one.get(row[first], 0) + 1, two.get(row[second], 0) + 1
            out.append((name, row[key], float(row["_like"])))
    return picks.sparkSession.createDataFrame(out, f"{key} {dict(picks.dtypes)[key]}, control {kind}, similarity double")


def merge_bins(bins: DataFrame, order: str, counts: tuple[str, str], least: tuple[int, int]) -> DataFrame:
    """(order, block): adjacent bins are joined until both minima are met; a remainder joins the block before. Bins are few."""
    a, b = counts
    state = F.struct(F.lit(0).alias("block"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.array().cast("array<int>").alias("blocks"))

    def step(s: Column, r: Column) -> Column:
        x, y = s["x"] + r["a"], s["y"] + r["b"]
        full = (x >= least[0]) & (y >= least[1])
        return F.struct(F.when(full, s["block"] + 1).otherwise(s["block"]).alias("block"), F.when(full, 0).otherwise(x).cast("long").alias("x"), F.when(full, 0).otherwise(y).cast("long").alias("y"), F.concat(s["blocks"], F.array(s["block"])).alias("blocks"))

    listed = bins.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")))).alias("l"))
    done = listed.withColumn("s", F.aggregate("l", state, step))
    last = F.greatest(F.lit(0), F.col("s.block") - 1)
    pairs = F.transform("l", lambda r, i: F.struct(r["o"].alias(order), F.least(F.get(F.col("s.blocks"), i), last).alias("block")))
    return done.select(F.inline(pairs))


def round_robin(df: DataFrame, bin_col: str, key: str, k: int, out: str = "fold", seed: str = "") -> DataFrame:
    """Inside each bin, in hash order, 0, 1, ... k - 1, 0, ..."""
    rows = df.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).withColumn("_one", F.lit(1).cast("long"))
    return running_sum(rows, [bin_col], ["_h", key], "_one", "_c").withColumn(out, ((F.col("_c") - 1) % k).cast("int")).drop("_h", "_one", "_c")
