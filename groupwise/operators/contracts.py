"""Column, partition and row contracts, set operations and digests."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import with_quantiles

VISIBLE = ("train", "val", "test")


class ContractError(ValueError):
    """A named failure with its evidence."""


def allowed_columns(df: DataFrame, deny: Sequence[str], keep: Sequence[str] | None = None, tier: Mapping[str, int] | None = None, most: int | None = None) -> DataFrame:
    """P5: df.select of the asked columns; raises if one matches a deny glob or lies above the tier."""
    names = list(keep or df.columns)
    bad = [c for c in names if any(fnmatch.fnmatchcase(c.lower(), p.lower()) for p in deny)]
    if tier is not None and most is not None:
        bad += [c for c in names if tier.get(c, most + 1) > most]
    if missing := [c for c in names if c not in df.columns]:
        raise ContractError(f"no such columns: {missing}")
    if bad:
        raise ContractError(f"columns not allowed as inputs: {sorted(set(bad))}")
    return df.select(names)


def partition_view(df: DataFrame, name: str, column: str = "partition", visible: Sequence[str] = VISIBLE) -> DataFrame:
    """The rows of one partition; a hidden one (buffer, quarantine) raises. The filter reaches the scan."""
    if name not in visible:
        raise ContractError(f"partition {name} is not visible")
    return df.where(F.col(column) == name)


def identity_residual(df: DataFrame, name: str, left: Column, right: Column, tolerance: float) -> DataFrame:
    """(identity, n, max_abs, p99_abs, holds) of left = right."""
    gap = F.abs(left - right)
    one = df.agg(F.count(gap).alias("n"), F.max(gap).alias("max_abs"), F.coalesce(F.max(gap) <= tolerance, F.lit(True)).alias("holds"))
    return with_quantiles(one, df, {"p99_abs": (gap, 0.99)}).select(F.lit(name).alias("identity"), "*")


def hash_sample(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """The n rows with the smallest SHA-256 of the key; a partial top-n in each task, then one of n rows each."""
    return df.orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), key).limit(n)


def arm(df: DataFrame, keys: Sequence[str], arms: Mapping[str, Sequence[str]], name: str, dimensions: int | None = None, forbidden: Sequence[str] = ()) -> DataFrame:
    """Keys and the columns of a named feature arm; checks the dimension and forbidden columns."""
    columns = list(arms[name])
    if dimensions is not None and len(columns) != dimensions:
        raise ContractError(f"arm {name} has {len(columns)} columns, not {dimensions}")
    return allowed_columns(df, list(forbidden), [*keys, *columns])


def long_targets(df: DataFrame, keys: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(keys, task, value, mask); mask is false where the value is null or NaN."""
    clean = df.select(*keys, *[F.nanvl(F.col(t).cast("double"), F.lit(None)).alias(t) for t in targets])
    return clean.unpivot(list(keys), list(targets), "task", "value").withColumn("mask", F.col("value").isNotNull())


def relabel(parts: DataFrame, edits: DataFrame, id_col: str = "id", index: str = "idx", role: str = "role", listed: str = "indices", new: str = "new_role", unknown: str = "unknown") -> DataFrame:
    """Parts with roles replaced at the listed indices (`1;3`), and `violation` where a listed part was not unknown."""
    one = edits.select(F.col(id_col), F.explode(F.split(listed, ";").cast("array<int>")).alias(index), F.col(new).alias("_new")).dropDuplicates([id_col, index])
    joined = parts.join(one.hint("shuffle_merge"), [id_col, index], "left")
    return joined.withColumns({"changed": F.col("_new").isNotNull() & (F.col("_new") != F.col(role)), "violation": F.col("_new").isNotNull() & (F.col(role) != unknown), role: F.coalesce("_new", role)}).drop("_new")


def first_truth(ids: DataFrame, sources: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """P25: (key, value, source) from the first source, in order, that has a value; T3 can check that none is null."""
    out = ids
    for name, source in sources.items():
        out = out.join(source.select(key, F.col(value).alias(f"_{name}")), key, "left")
    picks = [F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in sources]
    return out.withColumns({value: F.coalesce(*[F.col(f"_{n}") for n in sources]), "source": F.coalesce(*picks)}).drop(*[f"_{n}" for n in sources])


def key_faults(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row (rows, keys, null_keys): unique and complete if rows = keys and null_keys = 0."""
    null = F.expr(" or ".join(f"`{c}` is null" for c in on))
    per = df.groupBy(*on).agg(F.count("*").alias("n"), F.first(null).alias("_null"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.count_if("_null").alias("null_keys"))


def check_unique(df: DataFrame, on: Sequence[str], name: str) -> None:
    r = key_faults(df, on).first()
    if r.rows != r["keys"] or r.null_keys:
        raise ContractError(f"{name}: {r.rows} rows, {r['keys']} keys {list(on)}, {r.null_keys} null keys")


def join_1to1(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner", required: Sequence[str] = ()) -> DataFrame:
    """Both sides unique on the key, no row of a lost, required columns present; raises otherwise."""
    on = list(on)
    check_unique(a, on, "left side")
    check_unique(b, on, "right side")
    out = a.join(b, on, how)
    faults = a.join(b, on, "left").agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
    missing = a.join(b, on, "left_anti").count() if how == "inner" else 0
    if missing or any(faults[c] for c in required):
        raise ContractError(f"join on {on}: {missing} rows of the left side lost, nulls {[(c, faults[c]) for c in required]}")
    return out


def join_many_to_one(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """The right side is unique; Spark picks the strategy from its real size."""
    check_unique(b, list(on), "right side")
    return a.join(b, list(on), how)


def coverage(eligible: DataFrame, have: DataFrame, on: str) -> DataFrame:
    """(eligible, covered, missing, extra), by one full outer join of distinct keys."""
    a, b = eligible.select(on).distinct().withColumn("_a", F.lit(1)), have.select(on).distinct().withColumn("_b", F.lit(1))
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return a.join(b, on, "full_outer").agg(F.count_if(in_a).alias("eligible"), F.count_if(in_a & in_b).alias("covered"), F.count_if(in_a & ~in_b).alias("missing"), F.count_if(in_b & ~in_a).alias("extra"))


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the set."""
    return df.join(ids.select(on), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in the set; null keys stay."""
    return df.join(ids.select(on), on, "left_anti")


def overlap_counts(sets: DataFrame, name: str = "set", key: str = "key") -> DataFrame:
    """(set_a, set_b, overlap) over a long table of set members; set_a < set_b. Sets are few, members are many: each key lists its
    sets once, so the work is keys times squared number of sets and no key is joined with itself."""
    per = sets.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("set_a"), b.alias("set_b")))))
    return per.select(F.inline(pairs)).groupBy("set_a", "set_b").agg(F.count("*").alias("overlap"))


def membership(rows: DataFrame, others: Mapping[str, DataFrame], keys: Sequence[str], redact: Sequence[str] = ()) -> DataFrame:
    """Rows with, for each other set, in_<set> (any key matches) and `reasons` (`set:key`, joined by ;); of a sealed set only the flag shows.
    One left join per key instead of an OR join."""
    reasons = []
    for name, other in others.items():
        for k in keys:
            rows = rows.join(other.select(F.col(k), F.lit(True).alias(f"_{name}_{k}")).where(F.col(k).isNotNull()).distinct(), k, "left")
        hits = [F.coalesce(F.col(f"_{name}_{k}"), F.lit(False)) for k in keys]
        flag = hits[0]
        for h in hits[1:]:
            flag = flag | h
        rows = rows.withColumn(f"in_{name}", flag)
        if name not in redact:
            reasons += [F.when(h, F.lit(f"{name}:{k}")) for k, h in zip(keys, hits, strict=True)]
    return rows.withColumn("reasons", F.concat_ws(";", *reasons)).drop(*[f"_{n}_{k}" for n in others for k in keys])


def registry_lookup(rows: DataFrame, registry: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row binds exactly one entry; raises with the number that do not."""
    check_unique(registry, list(on), "registry")
    lost = rows.join(registry, list(on), "left_anti").count()
    if lost:
        raise ContractError(f"{lost} rows have no entry in the registry")
    return rows.join(registry, list(on))


def reconcile(a: DataFrame, b: DataFrame, on: str, value: str, tolerance: float) -> DataFrame:
    """One row: ids in both, only in one, max abs delta, exactly equal, within tolerance."""
    x, y = a.select(on, F.col(value).alias("_x"), F.lit(1).alias("_a")), b.select(on, F.col(value).alias("_y"), F.lit(1).alias("_b"))
    gap = F.max(F.abs(F.col("_x") - F.col("_y")))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    one = x.join(y, on, "full_outer").agg(F.count_if(both).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), gap.alias("max_abs_delta"), F.coalesce(F.bool_and(F.col("_x").eqNullSafe(F.col("_y"))), F.lit(True)).alias("equal"))
    return one.withColumn("within", (F.col("only_a") + F.col("only_b") == 0) & F.coalesce(F.col("max_abs_delta") <= tolerance, F.lit(True)))


def assemble(sources: Sequence[DataFrame], key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """(key, value, source_rank, n_sources, conflict): the value of the first source that has one; conflict if the sources' spread exceeds the tolerance."""
    ranked = None
    for k, s in enumerate(sources):
        one = s.select(key, F.col(value).cast("double").alias(value), F.lit(k).alias("source_rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    per = ranked.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, "source_rank").alias(value), F.min("source_rank").alias("source_rank"), F.count_distinct("source_rank").alias("n_sources"), (F.max(value) - F.min(value)).alias("_spread"))
    return per.withColumn("conflict", F.col("_spread") > tolerance).drop("_spread")


def with_group_statistic(rows: DataFrame, stats: DataFrame, on: str, column: str, default: object = 0) -> DataFrame:
    """A group's statistic on each row, with a default for unknown groups."""
    return rows.join(stats.select(on, column), on, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def wide(predictions: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per key, one column per model."""
    return predictions.groupBy(key).pivot(name, list(names)).agg(F.first(value))


def digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(n, xor, total) over two salted row hashes: equal for equal bags of rows, in any order and partitioning."""
    cols = [F.col(c) for c in (columns or df.columns)]
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(17), *cols)).alias("xor"), F.sum(F.xxhash64(F.lit(29), *cols).cast("decimal(20,0)")).alias("total"))


def bucketed_digest(df: DataFrame, key: str, columns: Sequence[str], bucket_rows: int = 10_000) -> DataFrame:
    """A35, exact: SHA-256 over the sorted row strings of each hash bucket, then, up a tree of 256, over the buckets.

    The buckets are a power of 256 (up to 256^4), so many that each has about `bucket_rows` rows or less. key tells the rows apart."""
    rows, levels = df.count(), 1
    while 256**levels * bucket_rows < rows and levels < 4:
        levels += 1
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    bucket = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % 256**levels
    part = df.select(bucket.alias("b"), row.alias("r")).groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), "\n"), 256).alias("h"))
    for _ in range(levels - 1):
        above = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256)
        part = part.groupBy(F.floor(F.col("b") / 256).alias("b")).agg(above.alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))


def set_operation(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """Union, intersection, difference or symmetric difference of distinct rows."""
    if kind == "union":
        return a.union(b).distinct()
    if kind == "intersection":
        return a.intersect(b)
    if kind == "difference":
        return a.subtract(b)
    if kind == "symmetric":
        return a.subtract(b).union(b.subtract(a))
    raise ValueError(kind)


def partition_overlap(assigned: DataFrame, key: str, partition: str = "partition") -> DataFrame:
    """Keys that stand in more than one partition."""
    return assigned.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(partition).alias("n_partitions")).where("n_partitions > 1")


def stack(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Row union with a label column."""
    out = None
    for name, df in frames.items():
        one = df.withColumn(label, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def expect(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check, passed, observed): each rule is an aggregate that counts faults; all in one pass."""
    counts = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "check", "observed").select("check", (F.col("observed") == 0).alias("passed"), "observed")


def require(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Raises with the failed checks."""
    failed = [(r.check, r.observed) for r in expect(df, rules).where(~F.col("passed")).collect()]
    if failed:
        raise ContractError(f"failed: {failed}")


def once_each(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(expected, once, repeated, missing, foreign) of a key's rows against a set of ids."""
    a = ids.select(key).distinct().withColumn("_a", F.lit(1))
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    known = F.col("_a").isNotNull()
    return a.join(n, key, "full_outer").agg(F.count_if(known).alias("expected"), F.count_if(known & (F.col("_n") == 1)).alias("once"), F.count_if(known & (F.col("_n") > 1)).alias("repeated"), F.count_if(known & F.col("_n").isNull()).alias("missing"), F.count_if(~known).alias("foreign"))


def protocol_labels(labels: DataFrame, manifests: DataFrame, key: str, forbidden: Iterable[str] = ("buffer", "historical_quarantine")) -> DataFrame:
    """T4: labels of each protocol's visible rows, to write partitionBy("split_name", "partition")."""
    return manifests.where(~F.col("partition").isin(list(forbidden))).select(key, "split_name", "partition").join(labels, key)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """T5: distinct non-null combinations."""
    return df.select(*columns).dropna().distinct()
