"""Leakage-safe splits and their verification.

Atomic units are connected components of groups that share an identity. All groups of an identity are linked to its smallest
group, and the links shrink to stars: every round is a pair of grouped minima, written out, and the rounds grow with the logarithm of
the longest chain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groupwise.storage import stored

from .graph import join_counted, star_components
from .ranking import round_robin
from .stats import qcut, running_sum, weighted_mean

PARTS = ("train", "val", "test")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, root): the smallest a reachable from each a over shared values of b.

    Where no a has two values of b, the values are the components and no round of linking is needed."""
    pairs = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct())
    hubs = stored(pairs.groupBy("b").agg(F.min("a").alias("dst"), F.count("*").alias("n")))
    joined = join_counted(pairs, hubs, "b", "n")
    if pairs.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return joined.select(F.col("a").alias(a), F.col("dst").alias("root"))
    found = star_components(joined.select(F.col("a").alias("src"), "dst"))
    alone = pairs.select("a").distinct().join(found.withColumnRenamed("node", "a").hint("shuffle_merge"), "a", "left")
    return alone.select(F.col("a").alias(a), F.coalesce("root", "a").alias("root"))


def atomic_units(df: DataFrame, group: str, identity: str, weight: str | None = None, forced: str | None = None) -> DataFrame:
    """(group, unit, ...): units with their records, weight and forced flag; one row per group.

    A unit's id is a hash of its members that needs no order and no list: their number and two sums over their SHA-256.
    """
    roots = components(df, group, identity)
    w = F.sum(weight) if weight else F.count("*").cast("double")
    stats = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), w.alias("w"), (F.bool_or(forced) if forced else F.lit(False)).alias("f"))
    digest = F.sha2(F.col(group).cast("string"), 256)
    half = lambda k: F.sum(F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    placed = stored(stats.join(roots.hint("shuffle_merge"), group, "left").withColumn("root", F.coalesce("root", F.col(group))))
    unit = F.sha2(F.concat_ws(":", F.count("*").cast("string"), half(1), half(16)), 256)
    totals = [F.sum("n").alias("n_records"), F.sum("w").alias("unit_weight"), F.bool_or("f").alias("forced")]
    units = stored(placed.groupBy("root").agg(unit.alias("unit"), F.count("*").alias("n_groups"), *totals))
    return join_counted(placed.select(group, "root"), units.withColumn("_n", F.col("n_groups")), "root", "_n").drop("root", "_n")


def units_only(assigned: DataFrame) -> DataFrame:
    return assigned.select("unit", "n_groups", "n_records", "unit_weight", "forced").distinct()


def _cuts(units: DataFrame, seeds: Sequence[int], shares: Sequence[float]) -> list[Row]:
    """(seed, train_end, val_end): hashes at which train and val end in the order of the salted hash, one row a seed, for stored units.

    Units are not put in order: their records are summed by the first four digits of the hash, and only the units of the two ranges in which the
    shares fall are summed one by one. Where a range has no unit beyond the share, it ends with the range; null: no unit lies beyond."""
    free = units.where(~F.col("forced")).select("unit", "n_records", F.explode(F.array(*map(F.lit, seeds))).alias("seed")).withColumn("_h", _order("seed", "unit"))
    totals = units.agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("all_"), F.coalesce(F.sum(F.when(F.col("forced"), F.col("n_records"))), F.lit(0)).alias("forced_"))
    total = F.col("all_").cast("double")
    train = F.greatest(F.lit(0.0), shares[0] * total - F.col("forced_"))
    rest = F.greatest(total - F.col("forced_") - train, F.lit(0.0))
    ends = totals.select(F.inline(F.array(F.struct(F.lit("train_end").alias("end"), train.alias("at")), F.struct(F.lit("val_end").alias("end"), (train + rest * (shares[1] / (shares[1] + shares[2]))).alias("at")))))
    ranges = free.groupBy("seed", F.substring("_h", 1, 4).alias("_r")).agg(F.sum("n_records").alias("n"))
    ranges = ranges.withColumn("_to", F.sum("n").over(W.partitionBy("seed").orderBy("_r")))  # at most 65,536 rows a seed
    where = ranges.join(F.broadcast(ends)).where(F.col("_to") >= F.col("at")).groupBy("seed", "end", "at").agg(F.min_by(F.struct("_r", (F.col("_to") - F.col("n")).alias("before")), "_r").alias("x")).select("seed", "end", "at", "x._r", "x.before")
    inside = free.withColumn("_r", F.substring("_h", 1, 4)).join(F.broadcast(where), ["seed", "_r"])  # two rows a seed
    run = F.col("before") + F.sum("n_records").over(W.partitionBy("seed", "end").orderBy("_h"))
    beyond = F.when(run - F.col("n_records") / 2 >= F.col("at"), F.col("_h"))
    found = inside.select("seed", "end", "_r", beyond.alias("_h")).groupBy("seed", "end").agg(F.coalesce(F.min("_h"), F.concat(F.max("_r"), F.lit("g"))).alias("cut"))
    return found.groupBy("seed").agg(*[F.max(F.when(F.col("end") == e, F.col("cut"))).alias(e) for e in ("train_end", "val_end")]).collect()


def _order(seed: str | Column, unit: str) -> Column:
    return F.sha2(F.concat_ws(":", (F.col(seed) if isinstance(seed, str) else seed).cast("string"), unit), 256)


def _where(hashed: Column, train_end: Column, val_end: Column) -> Column:
    return F.when(F.coalesce(hashed < train_end, F.lit(True)), "train").when(F.coalesce(hashed < val_end, F.lit(True)), "val").otherwise("test")


def balance_units(units: DataFrame, seeds: Sequence[int], shares: Sequence[float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(seed, unit, partition) for every seed in one job. Free units are put in order of a salted hash; each goes where its midpoint falls in
    the cumulative shares, train's share first lessened by the forced mass. The record error of a partition is at most one largest unit.

    Along that order midpoints never fall, so two hashes a seed decide every unit (see _cuts): no unit is sorted or shuffled."""
    units = stored(units.select("unit", "n_records", "unit_weight", "forced"))
    cuts = _cuts(units, seeds, shares)
    ends = {r.seed: r for r in cuts}
    listed = units.sparkSession.createDataFrame([(s, *((ends[s].train_end, ends[s].val_end) if s in ends else (None, None))) for s in seeds], "seed int, train_end string, val_end string")
    rows = units.join(F.broadcast(listed))  # one row a seed
    where = F.when(F.col("forced"), "train").otherwise(_where(_order("seed", "unit"), F.col("train_end"), F.col("val_end")))
    return rows.select("seed", "unit", "n_records", "unit_weight", where.alias("partition"))


def sweep(balanced: DataFrame, shares: Sequence[float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(seed, record_l1, weight_l1) of each seed; the best is the least by (record_l1, weight_l1, seed)."""
    per = balanced.groupBy("seed").agg(F.sum("n_records").alias("N"), F.sum("unit_weight").alias("V"), *[F.coalesce(F.sum(F.when(F.col("partition") == p, F.col(c))), F.lit(0)).alias(f"{c}_{p}") for p in PARTS for c in ("n_records", "unit_weight")])
    gap = lambda c, t: sum((F.abs(F.col(f"{c}_{p}") / F.col(t) - s) for p, s in zip(PARTS, shares, strict=True)), F.lit(0.0))
    return per.select("seed", F.round(gap("n_records", "N"), 12).alias("record_l1"), F.round(gap("unit_weight", "V"), 12).alias("weight_l1"))


def best_split(balanced: DataFrame, shares: Sequence[float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(unit, partition, seed) of the best seed."""
    best = sweep(balanced, shares).agg(F.min_by("seed", F.struct("record_l1", "weight_l1", "seed")).alias("seed"))
    return balanced.join(F.broadcast(best), "seed").select("unit", "partition", "seed")  # one row


def assign(df: DataFrame, assigned: DataFrame, split: DataFrame, group: str) -> DataFrame:
    """Rows with unit and partition. Groups meet the split first, one row each, so the rows are shuffled once and without the names of units."""
    placed = assigned.select(group, "unit").join(split.select("unit", "partition").hint("shuffle_merge"), "unit")
    return df.join(placed.hint("shuffle_merge"), group)


def repair_support(rows: DataFrame, keys: Sequence[str], unit: str = "unit", least: int = 5) -> DataFrame:
    """Val and test rows with a key of fewer than `least` train rows send their whole unit to train.

    Moves only add train rows, so a key that has enough never loses them, and after one step no unit with a weak key is left
    outside train: one step is the fixpoint, whatever the rows."""
    rows = stored(rows)
    held, weak = rows.where(F.col("partition").isin("val", "test")), []
    for k in keys:
        support = rows.groupBy(k).agg(F.count_if(F.col("partition") == "train").alias("_s")).where(F.col("_s") < least).select(k)
        weak.append(held.join(support.hint("shuffle_merge"), k, "left_semi").select(unit))
    moved = stored(reduce(DataFrame.union, weak).distinct()).withColumn("_w", F.lit(True))
    return rows.join(moved.hint("shuffle_merge"), unit, "left").withColumn("partition", F.when(F.col("_w"), "train").otherwise(F.col("partition"))).drop("_w")


def pair_cold(rows: DataFrame, units: DataFrame, keys: Sequence[str], seeds: Sequence[int], record: str, shares: Sequence[float] = (0.7, 0.15, 0.15), least: int = 5) -> DataFrame:
    """(record, partition, seed) of the best seed. rows: with record, unit and keys; units: as of units_only, over the key pairs.

    Each seed's balanced split is repaired (see repair_support); the seed whose repaired record shares are nearest to `shares` wins, the smaller
    one in a tie. Seeds go through the same joins as bits of one number, 60 at a time, so there is one row a record or key and not one for each seed. A unit's partitions follow from its hash (see balance_units); only units that a weak key moves are joined."""
    units = stored(units.select("unit", "n_records", "forced"))
    found = [x for k in range(0, len(seeds), 60) for x in _repaired(rows, units, keys, seeds[k : k + 60], shares, least)]
    _, best, placed = min(found, key=lambda x: x[:2])
    return placed(rows.select(record, "unit")).select(record, "partition", F.lit(best).alias("seed"))


def _repaired(rows: DataFrame, units: DataFrame, keys: Sequence[str], seeds: Sequence[int], shares: Sequence[float], least: int) -> list[tuple]:
    """(gap, seed, function that gives rows with a unit their partition) of each seed; at most 60 seeds."""
    ends = {r.seed: r for r in _cuts(units, seeds, shares)}
    at = lambda s, e: F.lit(ends[s][e] if s in ends else None).cast("string")
    part = {s: _where(_order(F.lit(s), "unit"), at(s, "train_end"), at(s, "val_end")) for s in seeds}
    bits = lambda of: sum((F.when(of(s), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, s in enumerate(seeds)), F.lit(0).cast("long"))
    every = (1 << len(seeds)) - 1
    forced = units.where("forced").select("unit").distinct()
    sizes = rows.groupBy("unit").agg(F.count("*").alias("n_rows"))
    base = rows.select("unit", *keys)
    train = bits(lambda s: part[s] == "train")
    any_forced = not forced.isEmpty()
    if not any_forced:
        base = base.withColumn("_in", train)
    else:
        base = base.join(forced.withColumn("_f", F.lit(True)).hint("shuffle_merge"), "unit", "left").withColumn("_in", F.when(F.col("_f"), F.lit(every).cast("long")).otherwise(train)).drop("_f")
    base, moved = stored(base), []
    for k in keys:
        own = base.where(F.col(k).isNotNull())
        support = own.groupBy(k).agg(*[F.count_if(F.col("_in").bitwiseAND(F.lit(1 << i)) != 0).alias(f"_s{i}") for i in range(len(seeds))])
        weak = sum((F.when(F.col(f"_s{i}") < least, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(len(seeds))), F.lit(0).cast("long"))
        weak = support.select(k, weak.alias("_weak")).where("_weak <> 0")
        hit = F.col("_weak").bitwiseAND(F.bitwise_not("_in"))
        moved.append(own.where(F.col("_in") != every).select("unit", k, "_in").join(weak.hint("shuffle_hash"), k).select("unit", hit.alias("_to")).where("_to <> 0"))
    moved = stored(reduce(DataFrame.unionAll, moved).groupBy("unit").agg(F.bit_or("_to").alias("_to")))

    def final(i: int, s: int) -> Column:
        return F.when(F.col("_all").bitwiseAND(F.lit(1 << i)) != 0, "train").otherwise(part[s])

    def settled(d: DataFrame) -> DataFrame:
        """Rows with `_all`: the seeds that place the unit in train whatever its hash says."""
        out = d.join(moved.hint("shuffle_merge"), "unit", "left").withColumn("_all", F.coalesce("_to", F.lit(0).cast("long"))).drop("_to")
        if not any_forced:
            return out
        return out.join(forced.withColumn("_f", F.lit(True)).hint("shuffle_merge"), "unit", "left").withColumn("_all", F.when(F.col("_f"), F.lit(every).cast("long")).otherwise(F.col("_all"))).drop("_f")

    each = settled(sizes).agg(F.sum("n_rows").alias("total"), *[F.coalesce(F.sum(F.when(final(i, s) == p, F.col("n_rows"))), F.lit(0)).alias(f"{p}{i}") for i, s in enumerate(seeds) for p in PARTS])
    gap = lambda i: F.round(sum((F.abs(F.col(f"{p}{i}") / F.col("total") - x) for p, x in zip(PARTS, shares, strict=True)), F.lit(0.0)), 12)
    gaps = each.select(*[gap(i).alias(f"g{i}") for i in range(len(seeds))]).first()  # one number a seed
    return [(g, s, lambda d, i=i, s=s: settled(d).withColumn("partition", final(i, s)).drop("_all")) for i, (g, s) in enumerate(zip(gaps, seeds, strict=True))]


def _salted(seed: str, name: str, key: str) -> Column:
    return F.sha2(F.concat_ws(":", F.col(seed).cast("string"), F.lit(name), F.col(key).cast("string")), 256)


def both_cold(
    df: DataFrame,
    first: str,
    second: str,
    group: str,
    record: str,
    k_first: Sequence[int],
    k_second: Sequence[int],
    seeds: Sequence[int],
    forced: str | None = None,
    power: Mapping[str, int] | None = None,
    band: tuple[float, float, float] = (0.05, 0.075, 0.10),
    core_shares: tuple[float, float] = (0.85, 0.15),
    least_split: Mapping[str, int] | None = None,
) -> DataFrame:
    """(record, partition): test rows have both keys held out, buffer rows one; a group whose rows fall apart is buffer as a whole.

    A candidate (seed, kf, ks) begins with the ks second keys of smallest salted hash, then four times takes the kf first keys with the
    most rows among them and the ks second keys with the most rows among those, ties by salted hash. Keys of rows marked
    `forced` are never held out. Best is, in this order: enough power (`power`: least test_records, test_groups, test_first,
    test_second, core_records), the most core records, the fewest buffer records, a test share inside `band`, the nearest to its
    middle, and the smallest seed, kf and ks. Without a candidate of enough power, or with fewer rows in a part than
    `least_split` (train, val) after the core's split, a ValueError is raised. The core is split by whole groups (X2).

    Candidates are rows beside the table of key pairs with counts; what is chosen has at most the sum of all kf and ks rows, which bounds the broadcasts.
    """
    power, least_split = dict(power or {}), dict(least_split or {})
    name = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("record:"), F.col(record).cast("string")))
    locked = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    rows = stored(df.select(record, F.col(first).alias("a"), F.col(second).alias("b"), name.alias("g"), locked.alias("locked")))
    pairs = stored(rows.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n")))
    free = {k: stored(rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.bool_or("locked").alias("x")).where("not x").select(k)) for k in "ab"}
    spark, most = df.sparkSession, {"a": max(k_first), "b": max(k_second)}
    cand = stored(spark.createDataFrame([(s, f, t) for s in seeds for f in k_first for t in k_second], "seed int, ka int, kb int"))
    seed_rows = spark.createDataFrame([(s,) for s in seeds], "seed int")
    cand_key = ["seed", "ka", "kb"]

    def by_hash(key: str, salt: str) -> DataFrame:
        """(seed, key, place): the keys of smallest hash, twice as many as are ever taken, so that some are left where none has rows."""
        spread = free[key].join(F.broadcast(seed_rows)).withColumn("h", _salted("seed", salt, key))
        place = F.row_number().over(W.partitionBy("seed").orderBy("h"))
        return stored(spread.withColumn("place", place).where(F.col("place") <= 2 * most[key]).select("seed", key, "place"))

    def with_most_rows(key: str, other: str, held: DataFrame, salt: str, first_ones: DataFrame) -> DataFrame:
        scored = pairs.join(F.broadcast(held), other).groupBy(*cand_key, key).agg(F.sum("n").alias("n")).join(free[key].hint("shuffle_hash"), key, "left_semi")
        none = F.broadcast(cand).join(first_ones.select("seed", key), "seed").select(*cand_key, key, F.lit(0).cast("long").alias("n"))
        summed = scored.select(*cand_key, key, "n").union(none).groupBy(*cand_key, key).agg(F.sum("n").alias("n"))
        place = F.row_number().over(W.partitionBy(*cand_key).orderBy(F.desc("n"), _salted("seed", salt, key)))
        return stored(summed.withColumn("place", place).where(F.col("place") <= most[key]).where(F.col("place") <= F.col(f"k{key}")).select(*cand_key, key))

    start, ties = by_hash("b", "B"), {"a": by_hash("a", "A"), "b": by_hash("b", "B2")}
    twos = stored(F.broadcast(cand).join(start, "seed").where(F.col("place") <= F.col("kb")).select(*cand_key, "b"))
    for _ in range(4):
        ones = with_most_rows("a", "b", twos, "A", ties["a"])
        twos = with_most_rows("b", "a", ones, "B2", ties["b"])

    # Rows that a candidate touches, by group; all others are core.
    held = stored(rows.groupBy("g", "a", "b").agg(F.count("*").alias("n")))
    groups = stored(held.groupBy("g").agg(F.sum("n").alias("all_")))
    flag = lambda k, taken: held.join(F.broadcast(taken), k).select(*cand_key, "g", "a", "b", "n", F.lit(k == "a").alias("ina"), F.lit(k == "b").alias("inb"))
    touched = flag("a", ones).union(flag("b", twos)).groupBy(*cand_key, "g", "a", "b", "n").agg(F.bool_or("ina").alias("ina"), F.bool_or("inb").alias("inb"))
    touched = touched.withColumn("test", F.col("ina") & F.col("inb"))
    by_group = touched.groupBy(*cand_key, "g").agg(F.sum("n").alias("seen"), F.coalesce(F.sum(F.when(F.col("test"), F.col("n"))), F.lit(0)).alias("n_test"))
    by_group = stored(by_group.join(groups.hint("shuffle_hash"), "g").withColumn("part", F.when(F.col("n_test") == F.col("all_"), "test").otherwise("buffer")))
    in_test = touched.join(by_group.where("part = 'test'").select(*cand_key, "g").hint("shuffle_hash"), [*cand_key, "g"], "left_semi")
    keys_in = in_test.groupBy(*cand_key).agg(F.count_distinct("a").alias("test_first"), F.count_distinct("b").alias("test_second"))
    total = rows.count()
    when = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("all_"))), F.lit(0))
    sums = by_group.groupBy(*cand_key).agg(when("test").alias("test_records"), when("buffer").alias("buffer_records"), F.count_if(F.col("part") == "test").alias("test_groups"))
    scored = cand.join(sums, cand_key, "left").join(keys_in, cand_key, "left").na.fill(0)
    scored = scored.withColumn("core_records", F.lit(total) - F.col("test_records") - F.col("buffer_records")).withColumn("share", F.col("test_records") / F.lit(float(max(total, 1))))
    weak = F.lit(False)
    for k, v in power.items():
        weak = weak | (F.col(k) < v)
    order = [weak, -F.col("core_records"), F.col("buffer_records"), ~F.col("share").between(band[0], band[2]), F.round(F.abs(F.col("share") - band[1]), 12), *map(F.col, cand_key)]
    best = scored.orderBy(*order).select(*cand_key, weak.alias("weak")).first()
    if best is None or best.weak:
        raise ValueError("no candidate has enough power")
    chosen = " and ".join(f"{k} = {best[k]}" for k in cand_key)
    outside = stored(by_group.where(chosen).select("g", "part"))
    core = groups.join(outside.hint("shuffle_hash"), "g", "left_anti")
    units = core.select(F.col("g").alias("unit"), F.lit(1).cast("long").alias("n_groups"), F.col("all_").alias("n_records"), F.lit(1.0).alias("unit_weight"), F.lit(False).alias("forced"))
    if forced:
        units = units.drop("forced").join(rows.groupBy(F.col("g").alias("unit")).agg(F.bool_or("locked").alias("forced")), "unit").select("unit", "n_groups", "n_records", "unit_weight", "forced")
    inner = balance_units(units, [best.seed], (*core_shares, 0.0)).select(F.col("unit").alias("g"), F.col("partition").alias("part"))
    parts = stored(outside.union(inner))
    out = stored(rows.join(parts.hint("shuffle_hash"), "g").select(record, F.col("part").alias("partition")))
    if least_split:
        counts = {r.partition: r["count"] for r in out.groupBy("partition").count().collect()}  # four numbers
        if any(counts.get(p, 0) < n for p, n in least_split.items()):
            raise ValueError("too few rows in train or val after the core's split")
    return out


def override(rows: DataFrame, quarantine: DataFrame, forced: DataFrame, group: str) -> DataFrame:
    """Quarantined groups leave the split, forced ones go to train with their reason. Columns of forced: group, reason."""
    q = quarantine.select(group, F.lit(True).alias("_q")).distinct()
    f = forced.groupBy(group).agg(F.min("reason").alias("forced_train_reason"))
    joined = rows.join(q, group, "left").join(f, group, "left")
    return joined.withColumn("partition", F.when(F.col("_q"), "historical_quarantine").when(F.col("forced_train_reason").isNotNull(), "train").otherwise(F.col("partition"))).drop("_q")


def verify(rows: DataFrame, record: str, group: str, identities: Sequence[str], weight: str, expected: int, least_power: int = 30, support: Sequence[str] = (), least_support: int = 5, targets: Sequence[str] = ()) -> DataFrame:
    """(check, observed, passed); observed counts faults."""
    ok = ("train", "val", "test", "buffer", "historical_quarantine")
    visible = rows.where(F.col("partition").isin(*PARTS))
    ends, several = [F.min("partition").alias("lo"), F.max("partition").alias("hi")], F.col("lo") != F.col("hi")
    groups = rows.where(F.col(group).isNotNull()).groupBy(group).agg(*ends, F.sum(weight).alias("s")).agg(F.count_if(several).alias("p"), F.count_if(F.abs(F.col("s") - 1) > 1e-9).alias("w"))
    both = F.array(*[F.struct(F.lit(name).alias("check"), F.col(c).alias("observed"), (F.col(c) == 0).alias("passed")) for name, c in (("one_partition_per_group", "p"), ("weights_sum_to_one", "w"))])
    checks = [
        ("unique_records", rows.agg((F.count("*") - F.count_distinct(record)).alias("x"))),
        ("coverage", rows.agg(F.abs(F.count("*") - F.lit(expected)).alias("x"))),
        ("domain", rows.agg(F.count_if(~F.coalesce(F.col("partition").isin(*ok), F.lit(False))).alias("x"))),
        ("power", visible.agg(F.count_if(F.col("partition") == "val").alias("v"), F.count_if(F.col("partition") == "test").alias("t")).select(((F.col("v") < least_power).cast("int") + (F.col("t") < least_power).cast("int")).alias("x"))),
        ("no_target_columns", rows.limit(1).agg(F.lit(len([t for t in targets if t in rows.columns])).alias("x"))),
        *[(f"disjoint_{k}", visible.where(F.col(k).isNotNull()).groupBy(k).agg(*ends).agg(F.count_if(several).alias("x"))) for k in identities],
        *[(f"support_{k}", visible.groupBy(k).agg(F.count_if(F.col("partition") == "train").alias("s"), F.count_if(F.col("partition") != "train").alias("o")).agg(F.count_if((F.col("o") > 0) & (F.col("s") < least_support)).alias("x"))) for k in support],
    ]
    out = groups.select(F.inline(both))  # one pass over the groups for both
    for name, one in checks:
        out = out.union(one.select(F.lit(name).alias("check"), F.col("x").cast("long").alias("observed"), (F.col("x") == 0).alias("passed")))
    return out


def inner_holdout(rows: DataFrame, unit: str, value: str, weight: str, share: float = 0.15, bins: int = 10, forced: str | None = None) -> DataFrame:
    """(unit, inner): in each decile of the units' weighted means, the first share by hash is held out (one at least); forced units never are."""
    means = qcut(weighted_mean(rows, unit, value, weight), "mean", bins, "bin")
    free = means if forced is None else means.join(rows.where(F.col(forced)).select(unit).distinct(), unit, "left_anti")
    n = free.groupBy("bin").agg(F.count("*").alias("_n"))
    ordered = running_sum(free.withColumns({"_h": F.sha2(F.col(unit).cast("string"), 256), "_one": F.lit(1).cast("long")}), ["bin"], ["_h", unit], "_one", "_c").join(F.broadcast(n), "bin")  # one row a bin
    held = ordered.where(F.col("_c") <= F.greatest(F.lit(1), F.round(share * F.col("_n")))).select(unit, F.lit("val").alias("_v"))
    return means.select(unit).join(held, unit, "left").select(unit, F.coalesce("_v", F.lit("train")).alias("inner"))


def unit_folds(rows: DataFrame, unit: str, value: str, weight: str, k: int = 5, bins: int = 10, forced: str | None = None) -> DataFrame:
    """(unit, fold): round robin by hash inside target bins; forced units have -1, always train."""
    means = qcut(weighted_mean(rows, unit, value, weight), "mean", bins, "bin").select(unit, "bin")
    if forced is None:
        return round_robin(means, "bin", unit, k).select(unit, "fold")
    locked = rows.where(F.col(forced)).select(unit).distinct()
    return round_robin(means.join(locked, unit, "left_anti"), "bin", unit, k).select(unit, "fold").union(locked.select(unit, F.lit(-1)))


def split_changes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """X11: rows that two assignments place apart."""
    joined = a.select(key, F.col("partition").alias("_a")).join(b.select(key, F.col("partition").alias("_b")), key, "full_outer")
    moved = ~F.col("_a").eqNullSafe(F.col("_b"))
    return joined.agg(F.count("*").alias("n"), F.count_if(moved).alias("changed"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_b").isNull()).alias("only_a"))


def train_overlap(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(partition, type, n_keys, in_train): how many distinct keys of val and test train has too."""
    long = rows.select("partition", *[F.col(k).cast("string").alias(k) for k in keys]).unpivot(["partition"], list(keys), "type", "key").where("key is not null")
    per = long.groupBy("type", "key").agg(F.array_sort(F.collect_set("partition")).alias("p"))
    return per.select("type", F.explode("p").alias("partition"), F.array_contains("p", "train").alias("t")).where("partition in ('val', 'test')").groupBy("partition", "type").agg(F.count("*").alias("n_keys"), F.count_if("t").alias("in_train"))


def historical_actions(groups: DataFrame, selection: DataFrame, training: DataFrame, group: str) -> DataFrame:
    """(group, action): used for selection before: quarantine; for training: force_train; else none."""
    s, t = selection.select(group, F.lit(True).alias("_s")).distinct(), training.select(group, F.lit(True).alias("_t")).distinct()
    return groups.select(group).distinct().join(s, group, "left").join(t, group, "left").select(group, F.when(F.col("_s"), "quarantine").when(F.col("_t"), "force_train").otherwise("none").alias("action"))


def replicate_policy(dispersion: DataFrame, representatives: DataFrame, group: str) -> DataFrame:
    """How many groups suit each policy: single, representative (no meaningful spread), weighted (eligible), aggregate."""
    worst = dispersion.groupBy(group).agg(F.bool_or("meaningful").alias("_m"))
    policy = F.when(F.col("n") == 1, "single").when(~F.coalesce("_m", F.lit(False)), "representative").when(F.col("eligible"), "weighted").otherwise("aggregate")
    return representatives.join(worst, group, "left").groupBy(policy.alias("policy")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_records"))


def invariance(build, df: DataFrame, digest) -> DataFrame:
    """One row (n, invariant): whether the same comes out of the rows as they are and dealt out anew, by an order-free digest."""
    first, second = digest(build(df)), digest(build(df.repartition(7)))
    both = first.select(F.col("n"), F.struct("*").alias("x")).join(F.broadcast(second.select(F.struct("*").alias("y"))))  # one row each
    return both.select("n", F.col("x").eqNullSafe(F.col("y")).alias("invariant"))
