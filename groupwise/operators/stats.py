"""Counts, moments, ranks, quantiles and shifts.

pandas and NumPy semantics where they differ from Spark's: null keys are dropped unless asked for, NaN counts as missing, std is
named sample or population, quantiles interpolate, ranks average over ties. Windows are never over a whole unpartitioned column:
values are counted first, and running sums over them are taken by `running_sum` in range partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groupwise.storage import stored

Q5 = [0.05, 0.25, 0.5, 0.75, 0.95]


def group_weights(df: DataFrame, key: str) -> DataFrame:
    """A1: each row's group_size and group_weight = 1 / size. The sizes are aggregated first, so a hot group is no single task."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("group_size"))
    return df.join(sizes, key, "left").withColumn("group_weight", 1.0 / F.col("group_size"))


def size_distribution(df: DataFrame, key: str) -> DataFrame:
    """A1: (group_size, n_groups)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("n_groups"))


def partition_counts(df: DataFrame, by: str, keys: Sequence[str], weight: str | None = None, approximate: bool = False) -> DataFrame:
    """A2: rows, distinct keys and weight of each partition."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    extra = [F.sum(weight).alias("weight")] if weight else []
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), *[count(k).alias(f"n_{k}") for k in keys], *extra)


def dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """A3: whether a determines b and b determines a."""
    pairs = df.select(a, b).dropna().distinct()
    one = lambda x, y, name: pairs.groupBy(x).agg(F.count(y).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias(name))
    return one(a, b, "most_b_per_a").crossJoin(one(b, a, "most_a_per_b")).withColumns({"a_determines_b": F.col("most_b_per_a") <= 1, "b_determines_a": F.col("most_a_per_b") <= 1})


def aliases(df: DataFrame, component: str, name: str, identity: str) -> DataFrame:
    """A4: per component its names and identities: n_alias names for one identity, conflict if it has several identities."""
    return df.where(F.col(component).isNotNull()).groupBy(component).agg(F.count_distinct(name).alias("n_names"), F.count_distinct(identity).alias("n_identities")).withColumn("conflict", F.col("n_identities") > 1)


def frequencies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A5: (type, key, n)."""
    return df.select(*[F.col(k).cast("string").alias(k) for k in keys]).unpivot([], list(keys), "type", "key").where("key is not null").groupBy("type", "key").agg(F.count("*").alias("n"))


def long_tail(freq: DataFrame) -> DataFrame:
    """A5: per type: entities, singletons, at most 5, median, p95, max."""
    one = freq.groupBy("type").agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") <= 5).alias("at_most_5"), F.max("n").alias("largest"))
    return with_quantiles(one, freq, {"median": (F.col("n"), 0.5), "p95": (F.col("n"), 0.95)}, ["type"])


def dispersion(df: DataFrame, group: str, targets: Mapping[str, float]) -> DataFrame:
    """Per group and target: n, min, max, range, mean, population std, max abs deviation, exact, within the target's tolerance."""
    x = F.col("value")
    long = df.where(F.col(group).isNotNull()).select(group, *[F.nanvl(F.col(t).cast("double"), F.lit(None)).alias(t) for t in targets]).unpivot([group], list(targets), "target", "value").where(x.isNotNull())
    per = long.groupBy(group, "target").agg(F.count("*").alias("n"), F.min(x).alias("lowest"), F.max(x).alias("highest"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    tolerance = F.create_map(*[F.lit(v) for kv in targets.items() for v in kv])[F.col("target")]
    spread = F.col("highest") - F.col("lowest")
    return per.withColumns({"spread": spread, "max_dev": F.greatest(F.col("highest") - F.col("mean"), F.col("mean") - F.col("lowest")), "exact": spread == 0, "within": spread <= tolerance, "meaningful": spread > tolerance})


def decade_histogram(df: DataFrame, x: Column, lowest: int = -6, highest: int = 2) -> DataFrame:
    """Counts by power of ten, 0 apart."""
    decade = F.when(x == 0, F.lit(None)).otherwise(F.greatest(F.lit(lowest), F.least(F.lit(highest), F.floor(F.log10(F.abs(x))).cast("int"))))
    return df.where(x.isNotNull()).groupBy(decade.alias("decade")).agg(F.count("*").alias("n"))


def representatives(df: DataFrame, group: str, key: Column, flags: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest key of each group, and whether all consistency flags hold in all its rows."""
    strict = [F.bool_and(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags]
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(key).alias("representative"), F.count("*").alias("n"), *strict)
    eligible = F.lit(True)
    for f in flags:
        eligible = eligible & F.col(f)
    return per.withColumn("eligible", eligible)


def summary(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """N, mean, sample std, min, p05, p25, p50, p75, p95, max."""
    v = F.nanvl(F.col(x).cast("double"), F.lit(None))
    one = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    named = {f"p{round(p * 100):02d}": (F.col(x), p) for p in Q5}
    return with_quantiles(one, df, named, by).select(*by, "n", "mean", "std", "min", *named, "max")


def brief_summary(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """A9, the short form: n, min, q10, median, q90, max, mean."""
    v = F.nanvl(F.col(x).cast("double"), F.lit(None))
    one = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    named = {name: (F.col(x), p) for name, p in (("q10", 0.1), ("median", 0.5), ("q90", 0.9))}
    return with_quantiles(one, df, named, by).select(*by, "n", "min", *named, "max", "mean")


def completeness(df: DataFrame, columns: Sequence[str], group: str | None = None, weight: str | None = None) -> DataFrame:
    """A10: per column non-null count and fraction, weighted fraction, groups with a value."""
    keep = [c for c in (group, weight) if c]
    long = df.select(*keep, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"v_{c}") for c in columns]).unpivot(keep, [f"v_{c}" for c in columns], "column", "value")
    there = F.col("value").isNotNull()
    extra = ([F.count_distinct(F.when(there, F.col(group))).alias("n_groups")] if group else []) + ([(F.coalesce(F.sum(F.when(there, F.col(weight))), F.lit(0.0)) / F.sum(weight)).alias("weighted_fraction")] if weight else [])
    return long.groupBy(F.substring("column", 3, 1000).alias("column")).agg(F.count("value").alias("n"), (F.count("value") / F.count("*")).alias("fraction"), *extra)


def weighted_moments(df: DataFrame, columns: Sequence[str], weight: str, tiny: float = 1e-8, least: int = 1) -> DataFrame:
    """(feature, n, weight, mean, std, fallback) over finite values of finite weights above 0. Two passes, centred.

    Below `least` of them: mean 0, std 1, INSUFFICIENT_VALID_DATA. With a variance of at most tiny^2: std 1, ZERO_OR_TINY_STD. Otherwise no fallback."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    w, v = F.col("_w"), F.col("value")
    long = df.select(finite(F.col(weight).cast("double")).alias("_w"), *[finite(F.col(c).cast("double")).alias(c) for c in columns]).unpivot(["_w"], list(columns), "feature", "value")
    long = long.select("feature", F.when(w > 0, w).alias("_w"), F.when(w > 0, v).alias("value")).select("feature", F.when(v.isNotNull(), w).alias("_w"), "value")
    means = long.groupBy("feature").agg(F.count(v).alias("n"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"), (F.sum(w * v) / F.sum(w)).alias("mean"))
    centred = long.join(F.broadcast(means), "feature")  # one row a feature
    var = F.sum(w * (v - F.col("mean")) ** 2) / F.first("weight")
    few = (F.first("n") < least) | F.first("mean").isNull()
    narrow = F.coalesce(var <= tiny * tiny, F.lit(True))
    fallback = F.when(few, "INSUFFICIENT_VALID_DATA").when(narrow, "ZERO_OR_TINY_STD")
    moments = [F.when(few, 0.0).otherwise(F.first("mean")).alias("mean"), F.when(few | narrow, 1.0).otherwise(F.sqrt(var)).alias("std"), fallback.alias("fallback")]
    return centred.groupBy("feature").agg(F.first("n").alias("n"), F.first("weight").alias("weight"), *moments)


def running_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, str], ahead: str | None = None, parts: int | None = None, whole: dict[str, str] | None = None,
) -> DataFrame:
    """Running sums in order per group `by`: sums maps a value column to the column of its sum up to and including each row.

    `ahead` names a column for the next value of order[-1], null for the last row; `whole` maps value columns to columns of the group's sum. No task holds a group: the rows are cut into ranges
    of (by, order), each range is summed inside, and the totals of the ranges before it are added. There are as many ranges as
    shuffle partitions (`parts`), so that a range stays as small as any other partition of the session.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id())
    cut = stored(cut)  # the ranges are drawn from a sample; both uses must see the same ones
    named = list(enumerate(sums.items()))
    totals = cut.groupBy(*by, "_part").agg(F.min(order[-1]).alias("_first"), *[F.sum(value).alias(f"_t{k}") for k, (value, _) in named])
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    group_sums = {whole[value]: F.sum(f"_t{k}").over(W.partitionBy(*by)) for k, (value, _) in named if whole and value in whole}
    before = totals.withColumns({f"_b{k}": F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)) for k, _ in named} | group_sums)
    if ahead:
        before = before.withColumn("_after", F.lead("_first").over(W.partitionBy(*by).orderBy("_part")))
    before = before.drop("_first", *[f"_t{k}" for k, _ in named])
    inside = W.partitionBy(*by, "_part").orderBy(*order)
    rows = cut.withColumns({f"_i{k}": F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0)) for k, (value, _) in named})
    if ahead:
        rows = rows.withColumn("_next", F.lead(order[-1]).over(inside))
    joined = rows.join(before.hint("shuffle_hash" if by else "broadcast"), [*by, "_part"])  # without groups one row a range
    out = joined.withColumns({name: F.col(f"_i{k}") + F.col(f"_b{k}") for k, (_, name) in named} | ({ahead: F.coalesce("_next", "_after")} if ahead else {}))
    return out.drop("_part", "_next", "_after", *[f"_{c}{k}" for c in "ib" for k, _ in named])


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Sum of value up to and including each row, in order, per group `by`; see running_sums."""
    return running_sums(df, by, order, {value: out}, parts=parts)


def quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, one column a name of `wanted`): exact quantiles of (value, probability) with linear interpolation, over non-null values that are not NaN.

    No task holds a group: equal values are counted first, and a running count over range partitions finds the values on either side of each
    quantile, for all columns and probabilities in one pass. Groups whose keys are null are groups too; a group without a value is left out."""
    columns: dict[str, tuple[str, Column]] = {}
    for value, _ in wanted.values():
        columns.setdefault(str(value), (f"v{len(columns)}", F.nanvl(value.cast("double"), F.lit(None))))
    pairs = F.array(*[F.struct(F.lit(of).alias("_of"), value.alias("_v")) for of, value in columns.values()])
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("none"))
    per = df.select(key.alias("_g"), F.inline(pairs)).where("_v is not null").groupBy("_g", "_of", "_v").agg(F.count("*").alias("_n"))
    run = running_sums(per, ["_g", "_of"], ["_v"], {"_n": "_c"}, ahead="_following", whole={"_n": "_all"})

    def at(of: str, p: float) -> Column:
        place = F.lit(p) * (F.col("_all") - 1)
        low = F.floor(place + 1e-9)  # a place that is whole but for rounding is whole
        part = F.greatest(place - low, F.lit(0.0))
        here = (F.col("_of") == of) & (F.col("_c") - F.col("_n") <= low) & (low < F.col("_c"))
        onward = F.when(low + 1 < F.col("_c"), F.col("_v")).otherwise(F.coalesce("_following", "_v"))
        return F.max(F.when(here, F.when(part > 0, F.col("_v") + part * (onward - F.col("_v"))).otherwise(F.col("_v"))))

    found = run.groupBy("_g").agg(*[at(columns[str(value)][0], p).alias(name) for name, (value, p) in wanted.items()])
    return found.select(*[F.col(f"_g.{c}").alias(c) for c in by], *wanted)


def with_quantiles(groups: DataFrame, df: DataFrame, wanted: Mapping[str, tuple[Column, float]], by: Sequence[str] = ()) -> DataFrame:
    """The rows of groups (one for each key `by`, or one) with the quantiles of df's rows of that key."""
    found = quantiles(df, wanted, by)
    if not by:
        return groups.join(found.hint("broadcast"), F.lit(True), "left")  # one row each
    renamed = found.withColumnsRenamed({c: f"_k{k}" for k, c in enumerate(by)})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(by)])
    return groups.join(renamed.hint("shuffle_merge"), same, "left").drop(*[f"_k{k}" for k in range(len(by))])


def weighted_median(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """(feature, median): the smallest value whose cumulative weight reaches half. Equal values are summed first."""
    long = df.select(F.col(weight).alias("_w"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]).unpivot(["_w"], list(columns), "feature", "value").where("value is not null")
    per = long.groupBy("feature", "value").agg(F.sum("_w").alias("w"))
    total = per.groupBy("feature").agg(F.sum("w").alias("total"))
    run = running_sum(per, ["feature"], ["value"], "w", "cum").join(F.broadcast(total), "feature")
    return run.where(F.col("cum") >= 0.5 * F.col("total") * (1 - 1e-12)).groupBy("feature").agg(F.min("value").alias("median"))


def weighted_mean(df: DataFrame, unit: str, value: str, weight: str) -> DataFrame:
    """(unit, mean, plain_mean); the plain mean is there to guard against mixing them up."""
    return df.where(F.col(value).isNotNull()).groupBy(unit).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"), F.avg(value).alias("plain_mean"))


def outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the rates beyond 1.5 and 3 IQR and the unbiased skewness."""
    long = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where("value is not null")
    x = F.col("value")
    q = quantiles(long, {"q1": (x, 0.25), "q3": (x, 0.75)}, ["column"])
    iqr = F.col("q3") - F.col("q1")
    far = lambda k: F.avg(((x < F.col("q1") - k * iqr) | (x > F.col("q3") + k * iqr)).cast("double"))
    n = F.count(x).cast("double")
    return long.join(F.broadcast(q), "column").groupBy("column").agg(F.count(x).alias("n"), far(1.5).alias("beyond_1_5"), far(3.0).alias("beyond_3"), F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))


def average_rank(df: DataFrame, x: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Average ranks over ties, from counts of distinct values."""
    per = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    ranked = running_sum(per, list(by), [x], "_n", "_c").withColumn(out, F.col("_c") - (F.col("_n") - 1) / 2).select(*by, x, out)
    return df.join(ranked, [*by, x], "left")


def average_ranks(df: DataFrame, columns: dict[str, str], by: Sequence[str] = (), few: int = 200_000) -> DataFrame:
    """Average ranks of several columns (column to rank column) in one pass over their distinct values. Where a column has at most `few` of them, counted,
    they go to every task; else the rows are shuffled by value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_of"), F.col(c).cast("double").alias("_v")) for c in columns])
    per = df.select(*by, F.inline(pairs)).where("_v is not null").groupBy(*by, "_of", "_v").agg(F.count("*").alias("_n"))
    ranked = stored(running_sum(per, [*by, "_of"], ["_v"], "_n", "_c").withColumn("_r", F.col("_c") - (F.col("_n") - 1) / 2).select(*by, "_of", "_v", "_r"))
    many = {r["_of"]: r["count"] for r in ranked.groupBy("_of").count().collect()}  # one row a column
    for c, out in columns.items():
        one = ranked.where(F.col("_of") == c).select(*by, F.col("_v").alias(c), F.col("_r").alias(out))
        df = df.join(one.hint("broadcast" if many.get(c, 0) <= few else "shuffle_merge"), [*by, c], "left")
    return df


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson r over rows that have both, as one aggregate; null for a constant, where F.corr divides by zero."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """N, Pearson, Spearman; null below `least` rows or for a constant."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    rows = stored(df.select(*by, number(x).alias("_x"), number(y).alias("_y")).where("_x is not null and _y is not null"))
    ranked = average_ranks(rows, {"_x": "_rx", "_y": "_ry"}, by)
    flat = (F.count("*") < least) | (F.max("_x") == F.min("_x")) | (F.max("_y") == F.min("_y"))
    measures = [F.when(~flat, pearson(a, b)).alias(n) for a, b, n in (("_x", "_y", "pearson"), ("_rx", "_ry", "spearman"))]
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), *measures)


def weighted_correlation(x: str, y: str, weight: str) -> Column:
    """Weighted Pearson r as one aggregate; null for a constant."""
    w = F.col(weight)
    mean = lambda c: F.sum(w * c) / F.sum(w)
    a, b = F.col(x), F.col(y)
    va, vb = mean(a * a) - mean(a) ** 2, mean(b * b) - mean(b) ** 2
    r = (mean(a * b) - mean(a) * mean(b)) / F.sqrt(F.nullif(F.greatest(va * vb, F.lit(0.0)), F.lit(0.0)))
    return F.when((F.min(a) != F.max(a)) & (F.min(b) != F.max(b)), r)  # rounding leaves a constant a tiny variance


def task_pairs(long: DataFrame, key: str, weight: str) -> DataFrame:
    """Every two tasks of a key with values of both: (task_a, task_b, x, y, w). A key's values are brought together by one shuffle and meet there."""
    one = long.where(F.col(key).isNotNull() & F.col("value").isNotNull()).groupBy(key).agg(F.collect_list(F.struct("task", "value", F.col(weight).alias("w"))).alias("_k"))
    a = one.select(F.explode("_k").alias("a"), "_k").select("a", F.explode("_k").alias("b")).where("a.task < b.task")
    return a.select(F.col("a.task").alias("task_a"), F.col("b.task").alias("task_b"), F.col("a.value").alias("x"), F.col("b.value").alias("y"), "a.w")


def pair_relations(long: DataFrame, key: str, weight: str) -> DataFrame:
    """Per pair of tasks (key, task, value, weight): n, weighted Pearson r, and the residual RMSE sqrt(1 - r^2) of a standardized line."""
    m = task_pairs(long, key, weight).groupBy("task_a", "task_b").agg(F.count("*").alias("n"), weighted_correlation("x", "y", "w").alias("r"))
    return m.withColumn("residual_rmse", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r") ** 2)))


def redundant_pairs(long: DataFrame, key: str, weight: str, least_spearman: float = 0.9995, most_residual: float = 0.001) -> DataFrame:
    """pair_relations with the weighted Spearman (average ranks among the pair's rows) and the redundancy gate over it and the residual.

    Values are counted per pair and ranked in ranges, so no task ranks a whole column."""
    by = ["task_a", "task_b"]
    pairs = stored(task_pairs(long, key, weight))
    ranked = average_ranks(pairs, {"x": "rx", "y": "ry"}, by).groupBy(*by).agg(weighted_correlation("rx", "ry", "w").alias("spearman"))
    m = pairs.groupBy(*by).agg(F.count("*").alias("n"), weighted_correlation("x", "y", "w").alias("r")).join(ranked, by)  # x and y go no further than their ranks
    out = m.withColumn("residual_rmse", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r") ** 2)))
    gate = (F.abs("spearman") >= least_spearman) & (F.col("residual_rmse") <= most_residual)
    return out.withColumn("redundant", F.coalesce(gate, F.lit(False)))


def effective_tasks(relations: DataFrame, n_tasks: int) -> DataFrame:
    """tr^2 / sum of squared eigenvalues of the correlation matrix, from its entries alone."""
    return relations.agg((F.lit(float(n_tasks * n_tasks)) / (n_tasks + 2 * F.sum(F.col("r") ** 2))).alias("effective_tasks"))


def slope(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope of y on x."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def shift(a: DataFrame, b: DataFrame, columns: Sequence[str], least_smd: float = 0.25, least_w1: float = 0.1, least_out: float = 0.05) -> DataFrame:
    """Per column, b against a: standardized and pooled mean difference, Wasserstein-1, fraction of b outside a's range, and whether two of three are large.

    Wasserstein-1 is in units of a's std: the sum of the gap between both cumulative shares times the step to the next value."""
    long = lambda d, k: d.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where("value is not null").withColumn("side", F.lit(k))
    both = long(a, 0).union(long(b, 1))
    in_a, in_b, v = F.col("side") == 0, F.col("side") == 1, F.col("value")
    m = both.groupBy("column").agg(*[f(F.when(s, v)).alias(n + t) for s, t in ((in_a, "_a"), (in_b, "_b")) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "lo"), (F.max, "hi"))])
    outside = both.join(F.broadcast(m), "column").groupBy("column").agg((F.count_if(in_b & ((v < F.col("lo_a")) | (v > F.col("hi_a")))) / F.first("n_b")).alias("outside"))
    steps = both.groupBy("column", "value").agg(F.count_if(in_a).alias("ka"), F.count_if(in_b).alias("kb"))
    cum = running_sums(steps, ["column"], ["value"], {"ka": "ca", "kb": "cb"}, ahead="next")
    w1 = cum.join(F.broadcast(m), "column").groupBy("column").agg(F.coalesce(F.sum(F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b")) * (F.col("next") - F.col("value"))), F.lit(0.0)).alias("w1_raw"))
    unit = F.nullif(F.col("std_a"), F.lit(0.0))
    out = m.join(outside, "column").join(w1, "column").select("column", ((F.col("mean_b") - F.col("mean_a")) / unit).alias("smd"), ((F.col("mean_b") - F.col("mean_a")) / F.nullif(F.sqrt((F.col("std_a") ** 2 + F.col("std_b") ** 2) / 2), F.lit(0.0))).alias("pooled_smd"), (F.col("w1_raw") / unit).alias("w1"), "outside")
    votes = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.abs("smd") >= least_smd, F.col("w1") >= least_w1, F.col("outside") >= least_out)), F.lit(0))
    return out.withColumn("shifted", votes >= 2)


def collisions(df: DataFrame, group: str, values: str) -> DataFrame:
    """Distinct groups less distinct arrays."""
    return df.agg((F.count_distinct(group) - F.count_distinct(F.sha2(F.array_join(values, ","), 256))).alias("collisions"))


def signed_rank(df: DataFrame, diff: str) -> DataFrame:
    """Wilcoxon signed-rank: n without zeros, W+, W-, z with tie correction, two-sided normal p (erf by a polynomial good to 1.5e-7)."""
    rows = df.where((F.col(diff).isNotNull()) & (F.col(diff) != 0)).select(F.col(diff).alias("d"), F.abs(diff).alias("_a"))
    ranked = average_rank(rows, "_a", "_r")
    ties = rows.groupBy("_a").agg(F.count("*").alias("t")).agg(F.coalesce(F.sum(F.col("t").cast("double") ** 3 - F.col("t")), F.lit(0.0)).alias("tie"))
    s = ranked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("_r"))), F.lit(0.0)).alias("w_minus")).crossJoin(ties)
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(F.nullif(var, F.lit(0.0)))
    x = F.abs("z") / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return s.withColumn("z", z).select("n", "w_plus", "w_minus", "z", F.coalesce(tail, F.lit(1.0)).alias("p"))


def label_counts(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """(label, n) over lists in strings."""
    return df.select(F.explode(F.split(column, f"[{sep}]")).alias("label")).where("label <> ''").groupBy("label").agg(F.count("*").alias("n"))


def consistency(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Per group the number of distinct values of each column and whether all are 1."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.col(f"n_{c}") <= 1)
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns]).withColumn("consistent", ok)


def role_counts(parts: DataFrame, id_col: str, role: str, roles: Sequence[str]) -> DataFrame:
    """Per record the number, fraction and presence of each role."""
    per = parts.groupBy(id_col).agg(F.count("*").alias("n"), *[F.count_if(F.col(role) == r).alias(f"n_{r}") for r in roles])
    return per.withColumns({f"f_{r}": F.col(f"n_{r}") / F.col("n") for r in roles} | {f"has_{r}": F.col(f"n_{r}") > 0 for r in roles})


def role_equality(a: DataFrame, b: DataFrame, id_col: str, index: str, role: str) -> DataFrame:
    """Per record whether both role vectors are the same, length included."""
    x, y = a.select(id_col, index, F.col(role).alias("_x")), b.select(id_col, index, F.col(role).alias("_y"))
    return x.join(y, [id_col, index], "full_outer").groupBy(id_col).agg(F.bool_and(F.col("_x").eqNullSafe(F.col("_y"))).alias("equal"))


def rank_feasible(df: DataFrame, unit: str, components: int) -> DataFrame:
    """Whether units - 1 allow the asked number of components."""
    return df.agg(F.count_distinct(unit).alias("n_units")).withColumns({"most": F.col("n_units") - 1, "feasible": F.col("n_units") - 1 >= components})


def qcut(df: DataFrame, x: str, q: int, out: str, fit: DataFrame | None = None) -> DataFrame:
    """P10: quantile bin from 0, right-closed, edges from `fit` (default: df) by linear interpolation; the lowest value is in bin 0, values beyond the edges in the end bins."""
    named = {f"_e{k}": (F.col(x), k / q) for k in range(1, q)}
    rows = fit if fit is not None else df
    edges = with_quantiles(rows.agg(F.count("*").alias("_rows")), rows, named).select(F.filter(F.array(*named), lambda e: e.isNotNull()).alias("_e"))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(x).isNotNull(), F.size(F.filter("_e", lambda e: e < F.col(x))))).drop("_e")  # one row


def empirical_percentile(rows: DataFrame, reference: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, feature, value, percentile): share of reference values at or below. Both sides are merged in value order and carry the running count."""
    long = lambda d, extra: d.select(*extra, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(extra), list(columns), "feature", "value").where("value is not null")
    ref = long(reference, []).groupBy("feature", "value").agg(F.count("*").alias("k"))
    asked = long(rows, [key])
    values = asked.select("feature", "value").distinct().join(ref, ["feature", "value"], "full_outer").withColumn("k", F.coalesce("k", F.lit(0)))
    total = ref.groupBy("feature").agg(F.sum("k").alias("total"))
    at = running_sum(values, ["feature"], ["value"], "k", "c").join(F.broadcast(total), "feature").select("feature", "value", (F.col("c") / F.col("total")).alias("percentile"))
    return asked.join(at, ["feature", "value"]).select(key, "feature", "value", "percentile")


def extreme_count(percentiles: DataFrame, key: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per row the number of features outside the 1 to 99 % range."""
    return percentiles.groupBy(key).agg(F.count_if((F.col("percentile") < low) | (F.col("percentile") > high)).alias("n_extreme"))


def trusted_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per candidate time field: non-null, parsed and distinct counts."""
    long = df.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], list(fields), "field", "value")
    return long.groupBy("field").agg(F.count("value").alias("n"), F.count(F.try_to_timestamp("value")).alias("n_parsed"), F.count_distinct("value").alias("n_distinct"))


def token_audit(df: DataFrame, text: str, vocabulary: DataFrame, pattern: str, limit: int, special: Mapping[str, str] | None = None, salts: int = 16) -> DataFrame:
    """Sequences, empty, lossless, over the limit, lengths; tokens, types and sequences outside the vocabulary (column token).

    special maps a name to a pattern: n_<name> counts the texts that hold it. Unknown tokens are found by type first; the texts
    that hold one are then found over salts, so a common unknown token is no single task."""
    rows = df.select(F.monotonically_increasing_id().alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("tokens", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))
    n = F.size("tokens")
    held = [F.count_if(F.col("t").rlike(p)).alias(f"n_{name}") for name, p in (special or {}).items()]
    whole = rows.agg(
        F.count("*").alias("sequences"), F.count_if(n == 0).alias("empty"), F.count_if(F.array_join("tokens", "") == F.col("t")).alias("lossless"), F.count_if(n > limit).alias("over_limit"),
        F.min(n).alias("shortest"), F.max(n).alias("longest"), *held,
    )
    whole = with_quantiles(whole, rows, {"median": (n, 0.5), "p95": (n, 0.95)})
    used = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    unknown = stored(used.join(vocabulary.select("token").distinct().hint("shuffle_hash"), "token", "left_anti"))
    counts = unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("oov_tokens"), F.count("*").alias("oov_types"))
    salted = unknown.select("token", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    types = rows.select("_id", F.explode(F.array_distinct("tokens")).alias("token"), F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("salt"))
    holders = types.join(salted.hint("shuffle_hash"), ["token", "salt"], "left_semi").agg(F.count_distinct("_id").alias("oov_sequences"))
    return whole.crossJoin(counts).crossJoin(holders)  # one row each


def unmatched_characters(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """(character, n) of what the token pattern leaves over."""
    rest = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), pattern, "")
    return df.select(F.explode(F.split(rest, "")).alias("character")).where("character <> ''").groupBy("character").agg(F.count("*").alias("n"))
