"""Evaluation of predictions in long form: (id, group, model, y, pred)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groupwise.storage import stored

from .stats import average_rank, correlation, pearson, running_sum, with_quantiles


def with_errors(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Signed and absolute error."""
    return df.withColumns({"err": F.col(pred) - F.col(y), "abs_err": F.abs(F.col(pred) - F.col(y))})


def macro_metrics(df: DataFrame, group: str, by: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Record MAE, RMSE, R2, and the same over groups: each record weighs 1 / its group's size. R2 is null with r2_reason for a constant target.

    Two levels of partial sums: first per group, then over groups. Rows without target, prediction or group are left out.
    """
    e, t = F.col(pred) - F.col(y), F.col(y).cast("double")
    rows = df.where(F.col(group).isNotNull() & F.col(y).isNotNull() & F.col(pred).isNotNull())
    per = rows.groupBy(*by, group).agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("s"), F.sum(t).alias("t"), F.sum(t * t).alias("tt"), F.min(t).alias("lo"), F.max(t).alias("hi"))
    n, g = F.sum("n"), F.count("*")
    one = per.groupBy(*by).agg(n.alias("n_records"), g.alias("n_groups"), F.sum("a").alias("A"), F.sum("s").alias("S"), F.sum("t").alias("T"), F.sum("tt").alias("TT"), F.sum(F.col("a") / F.col("n")).alias("gA"), F.sum(F.col("s") / F.col("n")).alias("gS"), F.sum(F.col("t") / F.col("n")).alias("gT"), F.sum(F.col("tt") / F.col("n")).alias("gTT"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    r2 = lambda s, t, tt, n: F.when(F.col("lo") != F.col("hi"), 1 - s / (tt - t * t / n))
    N, G = F.col("n_records"), F.col("n_groups")
    return one.select(
        *by, "n_records", "n_groups", (F.col("A") / N).alias("mae"), F.sqrt(F.col("S") / N).alias("rmse"), r2(F.col("S"), F.col("T"), F.col("TT"), N).alias("r2"),
        (F.col("gA") / G).alias("group_mae"), F.sqrt(F.col("gS") / G).alias("group_rmse"), r2(F.col("gS"), F.col("gT"), F.col("gTT"), G).alias("group_r2"),
        F.when(F.col("lo") == F.col("hi"), "CONSTANT_TARGET").alias("r2_reason"),
    )


def worst_decile(df: DataFrame, by: Sequence[str], value: str = "abs_err", key: str = "id", share: float = 0.1) -> DataFrame:
    """Mean of the ceil(share n) largest values. The cut value comes from counts of distinct values, ties beyond the cut are weighed, so no row is ranked."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k")).withColumn("neg", -F.col(value))
    take = F.ceil(F.col("n") * share - 1e-9)
    total = per.groupBy(*by).agg(F.sum("k").alias("n"))
    run = running_sum(per, by, ["neg"], "k", "c")
    run = run.join(total, list(by)) if by else run.crossJoin(F.broadcast(total))
    used = F.greatest(F.lit(0), F.least(F.col("k"), take - (F.col("c") - F.col("k"))))
    return run.withColumn("used", used).groupBy(*by).agg((F.sum(F.col("used") * F.col(value)) / F.sum("used")).alias("worst_decile"), F.max(value).alias("worst"))


def per_key_mae(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, type, key, n, mae) of each donor, acceptor and the like."""
    long = df.select(*by, "abs_err", *[F.col(k).cast("string").alias(k) for k in keys]).unpivot([*by, "abs_err"], list(keys), "type", "key").where("key is not null")
    return long.groupBy(*by, "type", "key").agg(F.count("*").alias("n"), F.avg("abs_err").alias("mae"))


def identity_table(df: DataFrame, cluster: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Per held-out identity records, groups, errors and target statistics."""
    return df.where(F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"), F.avg("abs_err").alias("mae"), F.avg(F.col("err") ** 2).alias("mse"), F.avg("err").alias("bias"), F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_sd"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def identity_bundle(table: DataFrame, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Macro MAE over identities, normalized by the IQR of their target means, size quantiles, p90 and worst-decile error."""
    named = {"_lo": ("y_mean", 0.25), "_hi": ("y_mean", 0.75), "n_q25": ("n", 0.25), "n_median": ("n", 0.5), "n_q75": ("n", 0.75), "mae_p90": ("mae", 0.9)}
    one = with_quantiles(table.groupBy(*by).agg(F.count("*").alias("n_identities"), F.avg("mae").alias("macro_mae")), table, {k: (F.col(c), p) for k, (c, p) in named.items()}, by)
    one = one.withColumn("macro_mae_iqr", F.col("macro_mae") / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")
    worst = worst_decile(table, by, "mae", cluster)
    return one.join(worst, list(by)) if by else one.crossJoin(worst)


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b over all pairs of rows, exactly; rows without x or y are left out, n_used counts the others.

    Equal (x, y) are counted first and x becomes its rank. Two ranks differ first in one bit: for each bit, cells with the same higher bits
    meet, those with the bit 0 against those with 1, and running sums along y count the pairs in and out of order. No pair is made."""

    cells = stored(df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n")))
    ranks = stored(running_sum(cells.select("x").distinct().withColumn("one", F.lit(1)), [], ["x"], "one", "r").select("x", (F.col("r") - 1).alias("r")))
    levels = max(1, ranks.count().bit_length())
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    ranked = cells.join(ranks.hint("shuffle_hash"), "x").select("r", "y", "n", level)
    bit = F.expr("shiftright(r, level) & 1")
    sides = ranked.withColumn("prefix", F.expr("shiftright(r, level + 1)")).groupBy("level", "prefix", "y").agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("n1"))
    run = running_sum(sides, ["level", "prefix"], ["y"], "n0", "c0")
    total = sides.groupBy("level", "prefix").agg(F.sum("n0").alias("t0"))
    signed = (F.col("n1") * (2 * F.col("c0") - F.col("n0") - F.col("t0"))).cast("decimal(20,0)")
    num = run.join(total.hint("shuffle_hash"), ["level", "prefix"]).agg(F.sum(signed).cast("double").alias("num"))
    squares = lambda c: cells.groupBy(c).agg(F.sum("n").alias("k")).agg(F.sum(F.col("k").cast("decimal(19,0)") * F.col("k").cast("decimal(19,0)")).alias(f"t{c}"), F.sum("k").alias(f"n{c}"))
    one = num.crossJoin(squares("x")).crossJoin(squares("y"))
    n2 = F.col("nx").cast("decimal(19,0)") * F.col("nx").cast("decimal(19,0)")
    free = lambda c: ((n2 - F.col(f"t{c}")) / 2).cast("double")
    return one.select((F.col("num") / F.nullif(F.sqrt(free("x") * free("y")), F.lit(0.0))).alias("tau_b"), F.coalesce("nx", F.lit(0).cast("long")).alias("n_used"))


def strata_metrics(df: DataFrame, strata: Mapping[str, Column], group: str, by: Sequence[str] = (), least_records: int = 50, least_groups: int = 30) -> DataFrame:
    """(dimension, stratum, by, n_records, n_groups, mae, group_mae, powered); null strata are their own row."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("stratum")) for k, c in strata.items()])
    rows = df.select(*by, group, "abs_err", F.inline(pairs))
    per = rows.groupBy("dimension", "stratum", *by, group).agg(F.count("*").alias("n"), F.avg("abs_err").alias("m"))
    one = per.groupBy("dimension", "stratum", *by).agg(F.sum("n").alias("n_records"), F.count("*").alias("n_groups"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mae"), F.avg("m").alias("group_mae"))
    return one.withColumn("powered", (F.col("n_records") >= least_records) & (F.col("n_groups") >= least_groups))


def complementarity(wide: DataFrame, a: str, b: str, threshold: float, margin: float) -> DataFrame:
    """Over absolute errors of two models per row: both, either and only one right, unique advantage, correlation, oracle MAE and gain."""
    x, y = F.col(a), F.col(b)
    share = lambda c: F.avg(c.cast("double"))
    one = wide.where(x.isNotNull() & y.isNotNull()).agg(
        F.count("*").alias("n"), share((x <= threshold) & (y <= threshold)).alias("both"), share((x <= threshold) | (y <= threshold)).alias("either"), share((x <= threshold) & (y > threshold)).alias("only_a"), share((y <= threshold) & (x > threshold)).alias("only_b"),
        share(x < y - margin).alias("a_ahead"), share(y < x - margin).alias("b_ahead"), pearson(x, y).alias("error_corr"), F.avg(F.least(x, y)).alias("oracle_mae"), F.least(F.avg(x), F.avg(y)).alias("best_mae"),
    )
    return one.withColumn("oracle_gain", F.col("best_mae") - F.col("oracle_mae"))


def sign_agreement(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows on which all columns have the same sign."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.signum(c) == F.signum(columns[0]))
    return wide.agg(F.avg(same.cast("double")).alias("agreement"), F.count("*").alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts; missing cells are 0."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def ensemble(df: DataFrame, key: str, pred: str = "pred") -> DataFrame:
    """Per id the members' mean, median, q10, q90, sample std."""
    q = F.percentile(pred, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return df.groupBy(key).agg(F.count(pred).alias("n_members"), F.avg(pred).alias("mean"), q.alias("_q"), F.stddev_samp(pred).alias("std")).select(key, "n_members", "mean", F.get("_q", 0).alias("q10"), F.get("_q", 1).alias("median"), F.get("_q", 2).alias("q90"), "std")


def seed_summary(df: DataFrame, by: Sequence[str], metric: str, most_cv: float = 0.05) -> DataFrame:
    """Mean and sample std over seeds; stable if std / |mean| stays below most_cv."""
    return df.groupBy(*by).agg(F.count(metric).alias("n_seeds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")).withColumn("stable", F.coalesce(F.col("std") <= most_cv * F.abs("mean"), F.lit(False)))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC from average ranks; null if a class is missing."""
    rows = average_rank(df.select(F.col(score).alias("_s"), positive.alias("_p")).where("_s is not null and _p is not null"), "_s", "_r")
    one = rows.agg(F.count_if("_p").alias("n_pos"), F.count_if(~F.col("_p")).alias("n_neg"), F.sum(F.when(F.col("_p"), F.col("_r"))).alias("r"))
    p = F.col("n_pos").cast("double")
    return one.select("n_pos", "n_neg", ((F.col("r") - p * (p + 1) / 2) / F.nullif(p * F.col("n_neg"), F.lit(0.0))).alias("auc"))


def masked_loss(long: DataFrame, weights: Mapping[str, float], kind: str = "mae", report_only: Sequence[str] = (), weight: str | None = None, beta: float = 1.0) -> DataFrame:
    """(total): sum over tasks of task weight times the weighted mean loss of unmasked rows; report-only tasks do not count; nothing left: 0. Columns: task, y, pred, mask."""
    e = F.abs(F.col("pred") - F.col("y"))
    loss = {"mae": e, "mse": e * e, "smooth_l1": F.when(e < beta, 0.5 * e * e / beta).otherwise(e - 0.5 * beta)}[kind]
    w = F.col(weight) if weight else F.lit(1.0)
    used = long.where(F.col("mask") & ~F.col("task").isin(list(report_only)) & F.col("task").isin(list(weights)))
    per = used.groupBy("task").agg((F.sum(w * loss) / F.sum(w)).alias("loss"))
    task_weight = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[F.col("task")]
    return per.agg(F.coalesce(F.sum(task_weight * F.col("loss")), F.lit(0.0)).alias("total"))


def curve_summary(curves: DataFrame, run: str, epoch: str, metric: str, tail: int = 5, noise: int = 10) -> DataFrame:
    """Best epoch (earliest on ties) and value, last, drop after the best, slope of the last epochs, std of the last, and a verdict. A run's epochs are few."""
    w = W.partitionBy(run).orderBy(F.desc(epoch))
    rows = curves.where(F.col(metric).isNotNull()).withColumn("_k", F.row_number().over(w))
    near = lambda c: F.when(F.col("_k") <= tail, F.col(c).cast("double"))
    one = rows.groupBy(run).agg(
        F.count("*").alias("n_epochs"), F.min_by(epoch, F.struct(metric, epoch)).alias("best_epoch"), F.min(metric).alias("best"), F.max_by(metric, epoch).alias("last"), F.regr_slope(near(metric), near(epoch)).alias("tail_slope"), F.stddev_samp(F.when(F.col("_k") <= noise, F.col(metric))).alias("tail_sd"), F.max(epoch).alias("last_epoch"),
    )
    verdict = F.when(F.col("best_epoch") == F.col("last_epoch"), "underfit").when(F.col("last") > 1.05 * F.col("best"), "overfit").when(F.col("tail_sd") > 0.1 * F.abs("best"), "unstable").otherwise("settled")
    return one.withColumns({"post_best_drop": F.col("last") - F.col("best"), "verdict": verdict})


def replicate_dispersion(df: DataFrame, group: str, models: Sequence[str], y: str = "y") -> DataFrame:
    """Per group with replicates the range of the target, and of each model its range and mean absolute error."""
    per_model = [c for m in models for c in ((F.max(m) - F.min(m)).alias(f"{m}_range"), F.avg(F.abs(F.col(m) - F.col(y))).alias(f"{m}_mae"))]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), (F.max(y) - F.min(y)).alias("y_range"), *per_model).where("n > 1")


def dispersion_correlations(table: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per model the correlation of the groups' target range with the model's range and with its error: (model, against, n, pearson, spearman)."""
    sides = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("against"), F.col("y_range").alias("x"), F.col(f"{m}_{k}").alias("v")) for m in models for k in ("range", "mae")])
    return correlation(table.select(F.inline(sides)), "x", "v", ["model", "against"])


def replicate_contrast(df: DataFrame, group: str, models: Sequence[str], y: str = "y") -> DataFrame:
    """Singleton groups against groups with replicates: records, groups and each model's group-macro MAE."""
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col(m) - F.col(y))).alias(m) for m in models])
    kind = F.when(F.col("n") == 1, "singleton").otherwise("replicated").alias("kind")
    return per.groupBy(kind).agg(F.sum("n").alias("n_records"), F.count("*").alias("n_groups"), *[F.avg(m).alias(f"{m}_group_mae") for m in models])


def length_strata(df: DataFrame, lengths: Sequence[str], errors: Sequence[str], limit: int = 202) -> DataFrame:
    """Per length column, rows at most `limit` and over it, and their mean of each error column; a null length is in neither."""
    rows = df.select(*errors, *[F.col(c).cast("long").alias(c) for c in lengths])
    long = rows.unpivot(list(errors), list(lengths), "field", "length").where("length is not null")
    stratum = F.when(F.col("length") <= limit, "at_most").otherwise("over").alias("stratum")
    return long.groupBy("field", stratum).agg(F.count("*").alias("n"), *[F.avg(e).alias(f"{e}_mean") for e in errors])


def delta_summary(df: DataFrame, delta: Column, by: Sequence[str] = (), thresholds: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """Signed and absolute quantiles of a change, shares above thresholds, and counts improved (below 0), worsened and unchanged."""
    d = delta.cast("double")
    rows = df.where(d.isNotNull())
    one = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean"), F.max(F.abs(d)).alias("abs_max"),
        *[F.avg((F.abs(d) > t).cast("double")).alias(f"above_{k}") for k, t in enumerate(thresholds)], F.count_if(d < 0).alias("improved"), F.count_if(d > 0).alias("worsened"), F.count_if(d == 0).alias("unchanged"),
    )
    return with_quantiles(one, rows, {"median": (d, 0.5), "abs_median": (F.abs(d), 0.5), "abs_p90": (F.abs(d), 0.9), "abs_p95": (F.abs(d), 0.95)}, by)


def block_importance(importance: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, gain, fraction) from (feature, gain) and (feature, block)."""
    per = importance.join(blocks, "feature", "left").groupBy(F.coalesce("block", F.lit("other")).alias("block")).agg(F.sum("gain").alias("gain"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("gain").alias("_t")))).select("block", "gain", (F.col("gain") / F.nullif(F.col("_t"), F.lit(0.0))).alias("fraction"))  # one row


def skill(metrics: DataFrame, model: str, baseline: str, metric: str, by: Sequence[str] = (), iqr: str | None = None) -> DataFrame:
    """1 - metric / baseline's, the absolute and relative degradation, and the metric in units of the targets' IQR (a column) if one is given."""
    base = metrics.where(F.col(model) == baseline).select(*by, F.col(metric).alias("_b"))
    joined = metrics.join(base, list(by)) if by else metrics.crossJoin(F.broadcast(base))
    scaled = [(F.col(metric) / F.nullif(F.col(iqr).cast("double"), F.lit(0.0))).alias("iqr_normalized")] if iqr else []
    return joined.select(*by, model, metric, (1 - F.col(metric) / F.col("_b")).alias("skill"), (F.col(metric) - F.col("_b")).alias("degradation"), (F.col(metric) / F.col("_b")).alias("ratio"), *scaled)


def mechanism(table: DataFrame, identity: str, similarity: str, delta: str, against: Sequence[str] = (), error: str | None = None, worst: int = 10) -> DataFrame:
    """Per factor (similarity and each of `against`) the correlation of the error change with it; on each row also the mean change and
    improved share in the lowest similarity quartile, the improved share of all, and (with `error`) how many of the worst identities improved."""
    factors = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x"), F.col(delta).cast("double").alias("d")) for c in (similarity, *against)])
    better = (F.col(delta) < 0).cast("double")
    edge = with_quantiles(table.agg(F.count("*").alias("_rows")), table, {"_e": (F.col(similarity), 0.25)}).select("_e")
    low = F.col(similarity) <= F.col("_e")
    whole = table.crossJoin(F.broadcast(edge)).agg(F.avg(F.when(low, F.col(delta))).alias("low_mean"), F.avg(F.when(low, better)).alias("low_improved"), F.avg(better).alias("improved"))
    if error:
        top = table.orderBy(F.desc(error), identity).limit(worst).agg(F.count_if(F.col(delta) < 0).alias("worst_improved"))
        whole = whole.crossJoin(top)
    return correlation(table.select(F.inline(factors)), "x", "d", ["factor"]).crossJoin(F.broadcast(whole))  # one row


def worst_identities(table: DataFrame, identity: str, error: str, columns: Sequence[str], worst: int = 10) -> DataFrame:
    """The identities with the largest error, and what is known of them."""
    return table.orderBy(F.desc(error), identity).limit(worst).select(identity, error, *columns)


def run_totals(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best epochs in run order, total seconds, peak memory. Columns run, best_epoch, seconds, memory."""
    return runs.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "best_epoch"))), lambda r: r["best_epoch"]).alias("best_epochs"), F.sum("seconds").alias("seconds"), F.max("memory").alias("memory"))


def label_contrast(df: DataFrame, label: str, stratum: str, by: Sequence[str] = ()) -> DataFrame:
    """Errors where an auxiliary label is there or missing, by stratum."""
    state = F.when(F.col(label).isNotNull(), "observed").otherwise("missing")
    return df.groupBy(*by, stratum, state.alias("auxiliary")).agg(F.count("*").alias("n"), F.avg("abs_err").alias("mae"))
