"""Conformal and selective prediction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groupwise.storage import stored

from .metrics import auc, worst_decile
from .resample import cluster_interval
from .stats import correlation, running_sum, running_sums, with_quantiles


def value_at_rank(df: DataFrame, value: str, rank: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, v): the value of a 1-based rank that may use n; null if the rank is over n. Ranks come from counts of distinct values."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    total = per.groupBy(*by).agg(F.sum("k").alias("n"))
    run = running_sum(per, by, [value], "k", "c")
    run = run.join(total, list(by)) if by else run.crossJoin(F.broadcast(total))
    return run.groupBy(*by, "n").agg(F.min(F.when(F.col("c") >= rank, F.col(value))).alias("v"))


def finite_quantile(df: DataFrame, score: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """The score of rank ceil((n + 1) level); status UNATTAINABLE if that is over n."""
    rank = F.ceil((F.col("n") + 1) * F.lit(level) - 1e-12)
    return value_at_rank(df, score, rank, by).select(*by, "n", F.lit(level).alias("level"), F.col("v").alias("quantile"), F.when(F.col("v").isNull(), "UNATTAINABLE").otherwise("OK").alias("status"))


def score_sets(df: DataFrame, residual: str, record: str, keys: Mapping[str, str]) -> DataFrame:
    """(method, unit, score): records as they are, and the largest absolute residual of each structure, identity and the like."""
    a = F.abs(residual)
    out = df.select(F.lit("record").alias("method"), F.col(record).cast("string").alias("unit"), a.alias("score"))
    for method, key in keys.items():
        out = out.union(df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("unit")).agg(F.max(a).alias("score")).select(F.lit(method), "unit", "score"))
    return out


def coverage(df: DataFrame, residual: str, half_width: float, group: str, identity: str, scale: float = 1.0, level: float | None = None, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Coverage by record, by group (mean, and all rows of the group at once) and by identity (mean, all at once, the 0.1 quantile).

    With the bootstrap interval of the identity mean, the gap to the nominal `level`, the interval's width, the width in units of
    `scale`, and the rank correlation of an identity's coverage with its size."""
    hit = (F.abs(residual) <= half_width).cast("double")
    rows = stored(df.select(group, identity, hit.alias("hit")))
    record = rows.agg(F.count("*").alias("n"), F.avg("hit").alias("record"))
    per_group = rows.groupBy(group).agg(F.avg("hit").alias("h"), F.min("hit").alias("all_"))
    groups = per_group.agg(F.avg("h").alias("group_macro"), F.avg("all_").alias("simultaneous"))
    per_identity = stored(rows.groupBy(identity).agg(F.avg("hit").alias("h"), F.min("hit").alias("all_"), F.count("*").alias("size")))
    ids = per_identity.agg(F.avg("h").alias("identity_macro"), F.avg("all_").alias("identity_simultaneous"), F.count("*").alias("n_identities"))
    ids = with_quantiles(ids, per_identity, {"worst_decile": (F.col("h"), 0.1)})
    span = cluster_interval(rows, identity, "hit", replicates, seed).select(F.col("lo").alias("identity_lo"), F.col("hi").alias("identity_hi"))
    size = correlation(per_identity, "size", "h").select(F.col("spearman").alias("size_spearman"))
    out = record.crossJoin(groups).crossJoin(ids).crossJoin(span).crossJoin(size)  # one row each
    gap = F.col("identity_macro") - F.lit(level) if level is not None else F.lit(None).cast("double")
    return out.withColumns({"gap": gap, "width": F.lit(2.0 * half_width), "normalized_width": F.lit(2.0 * half_width / scale)})


def applicability(df: DataFrame, views: Sequence[str]) -> DataFrame:
    """U4: the score is the least of the views."""
    return df.withColumn("applicability", F.least(*views) if len(views) > 1 else F.col(views[0]))


def retained_thresholds(df: DataFrame, score: str, fractions: Sequence[float]) -> DataFrame:
    """U4: for each retained fraction the score quantile at 1 - fraction, taken at the higher value: rank ceil((n - 1) q) + 1."""
    df, out = stored(df.select(score)), None
    for f in fractions:
        one = value_at_rank(df, score, F.ceil((F.col("n") - 1) * F.lit(1 - f) - 1e-12) + 1).select(F.lit(f).alias("fraction"), F.col("v").alias("threshold"))
        out = one if out is None else out.union(one)
    return out


def selective_risk(df: DataFrame, score: str, error: str, thresholds: DataFrame) -> DataFrame:
    """(fraction, threshold, n_kept, coverage, risk) at fixed thresholds."""
    joined = df.select(score, error).crossJoin(F.broadcast(thresholds))  # a few thresholds
    kept = F.col(score) >= F.col("threshold")
    return joined.groupBy("fraction", "threshold").agg(F.count_if(kept).alias("n_kept"), F.avg(kept.cast("double")).alias("coverage"), F.avg(F.when(kept, F.col(error))).alias("risk"))


def risk_coverage(df: DataFrame, score: str, error: str, key: str) -> DataFrame:
    """(key, rank, coverage, risk): running mean error from the most applicable row on, ties by key."""
    rows = df.where(F.col(score).isNotNull() & F.col(error).isNotNull()).select(key, (-F.col(score)).alias("_o"), F.col(error).alias("_e"), F.lit(1).cast("long").alias("_one"))
    n = rows.agg(F.count("*").alias("n"))
    run = running_sums(rows, [], ["_o", key], {"_one": "rank", "_e": "_s"})
    return run.crossJoin(F.broadcast(n)).select(key, "rank", (F.col("rank") / F.col("n")).alias("coverage"), (F.col("_s") / F.col("rank")).alias("risk"))


def selective_summary(df: DataFrame, score: str, error: str, key: str, high: float) -> DataFrame:
    """AURC, Spearman of score and error, AUC of a high error against a low score."""
    aurc = risk_coverage(df, score, error, key).agg(F.avg("risk").alias("aurc"))
    s = correlation(df, score, error).select("n", "spearman")
    a = auc(df.withColumn("_neg", -F.col(score)), "_neg", F.col(error) > high).select("auc")
    return aurc.crossJoin(s).crossJoin(a)


def exchangeability(df: DataFrame, by: str, cluster: str, levels: Sequence[float]) -> DataFrame:
    """Per protocol the clusters, the highest attainable level n / (n + 1), and whether each level is attainable."""
    one = df.groupBy(by).agg(F.count_distinct(cluster).alias("n_clusters")).withColumn("max_level", F.col("n_clusters") / (F.col("n_clusters") + 1))
    missing = F.size(F.filter(F.array(*map(F.lit, levels)), lambda x: F.ceil((F.col("n_clusters") + 1) * x - 1e-12) > F.col("n_clusters")))
    return one.withColumn("status", F.when(missing == 0, "ATTAINABLE").when(missing == len(levels), "UNATTAINABLE").otherwise("PARTLY"))


def cumulative_mean(df: DataFrame, by: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """W5 inside groups that are bounded by nature, such as the epochs of a run."""
    return df.withColumn(out, F.avg(value).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
