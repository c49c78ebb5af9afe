"""Queries of the metrics, bootstrap, conformal and model operators."""

from pyspark.sql import functions as F

from groupwise.operators import candidates, conformal, metrics, models, resample, stats
from groupwise.storage import stored

from .bindings import PREDICTIONS_SQL, RECORDS_SQL, predictions, records, table
from .registry import EDGE, registry

QUERIES, ORACLE, add = registry()
R = "WITH " + RECORDS_SQL
P = "WITH " + PREDICTIONS_SQL


@add("a18_group_macro", P + """, g AS (SELECT model, grp, count(*) AS n, avg(abs_err) AS a, avg(err * err) AS s, avg(y) AS t, avg(y * y) AS tt FROM predictions GROUP BY model, grp),
r AS (SELECT model, count(*) AS n_records, avg(abs_err) AS mae, sqrt(avg(err * err)) AS rmse, 1 - sum(err * err) / (var_pop(y) * count(*)) AS r2 FROM predictions GROUP BY model)
SELECT model, n_records, count(*) AS n_groups, mae, rmse, r2, avg(a) AS group_mae, sqrt(avg(s)) AS group_rmse, 1 - avg(s) / (avg(tt) - avg(t) * avg(t)) AS group_r2, NULL::VARCHAR AS r2_reason FROM g JOIN r USING (model) GROUP BY model, n_records, mae, rmse, r2""", "mae rmse r2 group_mae group_rmse group_r2")
def _(spark, sf):
    return metrics.macro_metrics(predictions(spark, sf), "grp", ["model"])


@add("a19_worst_decile", P + ", k AS (SELECT model, abs_err, row_number() OVER (PARTITION BY model ORDER BY abs_err DESC) AS r, count(*) OVER (PARTITION BY model) AS n FROM predictions) SELECT model, avg(abs_err) FILTER (WHERE r <= ceil(n * 0.1 - 1e-9)) AS worst_decile, max(abs_err) AS worst FROM k GROUP BY model", "worst_decile worst")
def _(spark, sf):
    return metrics.worst_decile(predictions(spark, sf).select("model", "record", "abs_err"), ["model"], key="record")


@add("a19_per_key", P + " SELECT model, 'donor' AS type, CAST(donor AS VARCHAR) AS key, count(*) AS n, avg(abs_err) AS mae FROM predictions GROUP BY model, donor UNION ALL SELECT model, 'acceptor', CAST(acceptor AS VARCHAR), count(*), avg(abs_err) FROM predictions GROUP BY model, acceptor", "mae")
def _(spark, sf):
    return metrics.per_key_mae(predictions(spark, sf), ["donor", "acceptor"], ["model"])


IDS = P + ", ids AS (SELECT model, donor, count(*) AS n, count(DISTINCT grp) AS n_groups, avg(abs_err) AS mae, avg(err * err) AS mse, avg(err) AS bias, avg(y) AS y_mean, stddev_pop(y) AS y_sd, min(y) AS y_min, max(y) AS y_max FROM predictions GROUP BY model, donor)"


@add("a20_identity_table", IDS + " SELECT * FROM ids", "mae mse bias y_mean y_sd")
def _(spark, sf):
    return metrics.identity_table(predictions(spark, sf), "donor", "grp", ["model"])


@add("a20_identity_bundle", IDS + """, k AS (SELECT model, mae, row_number() OVER (PARTITION BY model ORDER BY mae DESC) AS r, count(*) OVER (PARTITION BY model) AS c FROM ids), w AS (SELECT model, avg(mae) FILTER (WHERE r <= ceil(c * 0.1 - 1e-9)) AS worst_decile, max(mae) AS worst FROM k GROUP BY model)
SELECT model, count(*) AS n_identities, avg(mae) AS macro_mae, avg(mae) / (quantile_cont(y_mean, 0.75) - quantile_cont(y_mean, 0.25)) AS macro_mae_iqr, quantile_cont(n, 0.25) AS n_q25, quantile_cont(n, 0.5) AS n_median, quantile_cont(n, 0.75) AS n_q75, quantile_cont(mae, 0.9) AS mae_p90, any_value(worst_decile) AS worst_decile, any_value(worst) AS worst FROM ids JOIN w USING (model) GROUP BY model""", "macro_mae macro_mae_iqr n_q25 n_median n_q75 mae_p90 worst_decile worst")
def _(spark, sf):
    return metrics.identity_bundle(metrics.identity_table(predictions(spark, sf), "donor", "grp", ["model"]), "donor", ["model"])


@add("a21_kendall", R + """, c AS (SELECT qty AS x, y, count(*) AS n FROM records WHERE qty IS NOT NULL AND y IS NOT NULL GROUP BY qty, y), t AS (SELECT DISTINCT x FROM c),
w AS (SELECT t.x, c.y, coalesce(sum(n) FILTER (c.x = t.x), 0) AS n1, coalesce(sum(n) FILTER (c.x < t.x), 0) AS n0 FROM c JOIN t ON c.x <= t.x GROUP BY t.x, c.y),
r AS (SELECT *, sum(n0) OVER (PARTITION BY x ORDER BY y) AS c0, sum(n0) OVER (PARTITION BY x) AS t0 FROM w),
kx AS (SELECT sum(n) AS k FROM c GROUP BY x), ky AS (SELECT sum(n) AS k FROM c GROUP BY y), m AS (SELECT sum(n) AS k FROM c)
SELECT CAST((SELECT sum(n1 * (2 * c0 - n0 - t0)) FROM r) AS DOUBLE) / sqrt(CAST(k * k - (SELECT sum(k * k) FROM kx) AS DOUBLE) / 2 * CAST(k * k - (SELECT sum(k * k) FROM ky) AS DOUBLE) / 2) AS tau_b, k::BIGINT AS n_used FROM m""", "tau_b")
def _(spark, sf):
    return metrics.kendall(records(spark, sf), "qty", "y")


@add("a23_strata", P + """, l AS (SELECT 'flag' AS dimension, flag AS stratum, model, grp, abs_err FROM predictions UNION ALL SELECT 'line', CAST(line AS VARCHAR), model, grp, abs_err FROM predictions), g AS (SELECT dimension, stratum, model, grp, count(*) AS n, avg(abs_err) AS m FROM l GROUP BY ALL)
SELECT dimension, stratum, model, sum(n)::BIGINT AS n_records, count(*) AS n_groups, sum(m * n) / sum(n) AS mae, avg(m) AS group_mae, sum(n) >= 50 AND count(*) >= 30 AS powered FROM g GROUP BY dimension, stratum, model""", "mae group_mae")
def _(spark, sf):
    return metrics.strata_metrics(predictions(spark, sf), {"flag": F.col("flag"), "line": F.col("line")}, "grp", ["model"])


@add("a24_complementarity", R + """, e AS (SELECT abs(m1 - y) AS a, abs(m2 - y) AS b FROM records) SELECT count(*) AS n, avg((a <= 1 AND b <= 1)::INT) AS "both", avg((a <= 1 OR b <= 1)::INT) AS either, avg((a <= 1 AND b > 1)::INT) AS only_a, avg((b <= 1 AND a > 1)::INT) AS only_b, avg((a < b - 0.5)::INT) AS a_ahead, avg((b < a - 0.5)::INT) AS b_ahead, corr(a, b) AS error_corr, avg(least(a, b)) AS oracle_mae, least(avg(a), avg(b)) AS best_mae, least(avg(a), avg(b)) - avg(least(a, b)) AS oracle_gain FROM e""", "either only_a only_b a_ahead b_ahead error_corr oracle_mae best_mae oracle_gain")
def _(spark, sf):
    wide = records(spark, sf).select(F.abs(F.col("m1") - F.col("y")).alias("a"), F.abs(F.col("m2") - F.col("y")).alias("b"))
    return metrics.complementarity(wide, "a", "b", 1.0, 0.5).withColumn("both", F.col("both"))


@add("a25_crosstab", R + " SELECT line, count(*) FILTER (WHERE flag = 'A') AS A, count(*) FILTER (WHERE flag = 'N') AS N, count(*) FILTER (WHERE flag = 'R') AS R FROM records GROUP BY line")
def _(spark, sf):
    return metrics.crosstab(records(spark, sf), "line", "flag", ["A", "N", "R"])


@add("a25_sign_agreement", R + " SELECT avg((sign(m1 - y) = sign(m2 - y))::INT) AS agreement, count(*) AS n FROM records", "agreement")
def _(spark, sf):
    return metrics.sign_agreement(records(spark, sf).select((F.col("m1") - F.col("y")).alias("a"), (F.col("m2") - F.col("y")).alias("b")), ["a", "b"])


@add("a26_ensemble", P + " SELECT grp, count(pred) AS n_members, avg(pred) AS mean, quantile_cont(pred, 0.1) AS q10, quantile_cont(pred, 0.5) AS median, quantile_cont(pred, 0.9) AS q90, stddev_samp(pred) AS std FROM predictions GROUP BY grp", "mean q10 median q90 std")
def _(spark, sf):
    return metrics.ensemble(predictions(spark, sf), "grp")


@add("a27_seed_summary", P + ", s AS (SELECT model, line AS seed, avg(abs_err) AS mae FROM predictions GROUP BY model, line) SELECT model, count(*) AS n_seeds, avg(mae) AS mean, stddev_samp(mae) AS std, stddev_samp(mae) <= 0.05 * avg(mae) AS stable FROM s GROUP BY model", "mean std")
def _(spark, sf):
    per = predictions(spark, sf).groupBy("model", F.col("line").alias("seed")).agg(F.avg("abs_err").alias("mae"))
    return metrics.seed_summary(per, ["model"], "mae")


@add("a30_auc", R + ", k AS (SELECT qty, abs(m2 - y) > 2 AS p, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS r FROM records), s AS (SELECT count(*) FILTER (WHERE p) AS n_pos, count(*) FILTER (WHERE NOT p) AS n_neg, sum(r) FILTER (WHERE p) AS r FROM k) SELECT n_pos, n_neg, (r - CAST(n_pos AS DOUBLE) * (n_pos + 1) / 2) / (CAST(n_pos AS DOUBLE) * n_neg) AS auc FROM s", "auc")
def _(spark, sf):
    return metrics.auc(records(spark, sf), "qty", F.abs(F.col("m2") - F.col("y")) > 2)


@add("a31_masked_loss", R + " SELECT 1.0 * (SELECT sum(qty * abs(m1 - y)) / sum(qty) FROM records) + 0.5 * (SELECT sum(qty * abs(0.05 - aux)) / sum(qty) FROM records WHERE aux IS NOT NULL) AS total", "total")
def _(spark, sf):
    rows = F.array(*[F.struct(F.lit(n).alias("task"), t.alias("t"), p.alias("pred")) for n, t, p in (("main", F.col("y"), F.col("m1")), ("aux", F.col("aux"), F.lit(0.05)), ("report", F.col("y"), F.lit(0.0)))])
    long = records(spark, sf).select("qty", F.inline(rows)).withColumnRenamed("t", "y").withColumn("mask", F.col("y").isNotNull())
    return metrics.masked_loss(long, {"main": 1.0, "aux": 0.5, "report": 9.0}, "mae", ["report"], "qty")


@add("a32_masked_metrics", R + ", l AS (SELECT grp, 'aux' AS task, aux AS y, 0.05 AS pred FROM records WHERE aux IS NOT NULL UNION ALL SELECT grp, 'y', y, m1 FROM records), g AS (SELECT task, grp, count(*) AS n, avg(abs(pred - y)) AS a FROM l GROUP BY task, grp) SELECT task, sum(n)::BIGINT AS n_records, count(*) AS n_groups, sum(a * n) / sum(n) AS mae, avg(a) AS group_mae FROM g GROUP BY task", "mae group_mae")
def _(spark, sf):
    rows = F.array(*[F.struct(F.lit(n).alias("task"), t.alias("t"), p.alias("pred")) for n, t, p in (("aux", F.col("aux"), F.lit(0.05)), ("y", F.col("y"), F.col("m1")))])
    long = records(spark, sf).select("grp", F.inline(rows)).withColumnRenamed("t", "y")
    return metrics.macro_metrics(long, "grp", ["task"]).select("task", "n_records", "n_groups", "mae", "group_mae")


EPOCHS = "WITH e AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS epoch, value AS metric FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS k FROM e)"


def _epochs(spark, sf):
    from pyspark.sql import Window as W

    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("epoch"), F.col("value").alias("metric"))


@add("a33_curve_summary", EPOCHS + """, s AS (SELECT run, count(*) AS n_epochs, arg_min(epoch, (metric, epoch)) AS best_epoch, min(metric) AS best, arg_max(metric, epoch) AS last, regr_slope(metric, epoch) FILTER (WHERE k <= 5) AS tail_slope, stddev_samp(metric) FILTER (WHERE k <= 10) AS tail_sd, max(epoch) AS last_epoch FROM k GROUP BY run)
SELECT *, last - best AS post_best_drop, CASE WHEN best_epoch = last_epoch THEN 'underfit' WHEN last > 1.05 * best THEN 'overfit' WHEN tail_sd > 0.1 * abs(best) THEN 'unstable' ELSE 'settled' END AS verdict FROM s""", "tail_slope tail_sd post_best_drop")
def _(spark, sf):
    return metrics.curve_summary(_epochs(spark, sf), "run", "epoch", "metric")


@add("w12_best_epoch", EPOCHS + " SELECT run, arg_min(epoch, (metric, epoch)) AS best_epoch FROM e GROUP BY run")
def _(spark, sf):
    return metrics.curve_summary(_epochs(spark, sf), "run", "epoch", "metric").select("run", "best_epoch")


@add("w5_cumulative_mean", EPOCHS + " SELECT run, epoch, avg(metric) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS mean FROM e", "mean")
def _(spark, sf):
    return conformal.cumulative_mean(_epochs(spark, sf), "run", ["epoch"], "metric", "mean").select("run", "epoch", "mean")


A38 = R + ", disp AS (SELECT grp, count(*) AS n, max(y) - min(y) AS y_range, max(m1) - min(m1) AS m1_range, avg(abs(m1 - y)) AS m1_mae, max(m2) - min(m2) AS m2_range, avg(abs(m2 - y)) AS m2_mae FROM records GROUP BY grp HAVING count(*) > 1)"


@add("a38_replicate_dispersion", A38 + " SELECT * FROM disp", "y_range m1_range m1_mae m2_range m2_mae")
def _(spark, sf):
    return metrics.replicate_dispersion(records(spark, sf), "grp", ["m1", "m2"])


A38_SIDES = " UNION ALL ".join(f"SELECT '{m}' AS model, '{k}' AS against, y_range AS x, {m}_{k} AS v FROM rounded" for m in ("m1", "m2") for k in ("range", "mae"))
A38_ROUNDED = ", rounded AS (SELECT " + ", ".join(f"round({c} + 1.2345678912e-7, 6) AS {c}" for c in ("y_range", "m1_range", "m1_mae", "m2_range", "m2_mae")) + " FROM disp)"


@add("a38_dispersion_correlations", A38 + A38_ROUNDED + f", l AS ({A38_SIDES}), k AS (SELECT model, against, x, v, rank() OVER (PARTITION BY model, against ORDER BY x) + (count(*) OVER (PARTITION BY model, against, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY model, against ORDER BY v) + (count(*) OVER (PARTITION BY model, against, v) - 1) / 2 AS rv FROM l) SELECT model, against, count(*) AS n, corr(x, v) AS pearson, corr(rx, rv) AS spearman FROM k GROUP BY model, against", "pearson spearman")
def _(spark, sf):
    """Ranges and errors are rounded first: ties between them would otherwise hang on the last bit."""
    disp = metrics.replicate_dispersion(records(spark, sf), "grp", ["m1", "m2"])
    rounded = disp.withColumns({c: F.round(F.col(c) + EDGE, 6) for c in ("y_range", "m1_range", "m1_mae", "m2_range", "m2_mae")})
    return metrics.dispersion_correlations(rounded, ["m1", "m2"])


@add("a38_replicate_contrast", R + ", g AS (SELECT grp, count(*) AS n, avg(abs(m1 - y)) AS m1, avg(abs(m2 - y)) AS m2 FROM records GROUP BY grp) SELECT CASE WHEN n = 1 THEN 'singleton' ELSE 'replicated' END AS kind, sum(n)::BIGINT AS n_records, count(*) AS n_groups, avg(m1) AS m1_group_mae, avg(m2) AS m2_group_mae FROM g GROUP BY 1", "m1_group_mae m2_group_mae")
def _(spark, sf):
    return metrics.replicate_contrast(records(spark, sf), "grp", ["m1", "m2"])


@add("p30_length_strata", R + ", e AS (SELECT abs(m1 - y) AS e1, abs(m2 - y) AS e2, psize, qty FROM records), l AS (SELECT 'psize' AS field, psize::BIGINT AS length, e1, e2 FROM e UNION ALL SELECT 'qty', trunc(qty)::BIGINT, e1, e2 FROM e) SELECT field, CASE WHEN length <= 20 THEN 'at_most' ELSE 'over' END AS stratum, count(*) AS n, avg(e1) AS e1_mean, avg(e2) AS e2_mean FROM l WHERE length IS NOT NULL GROUP BY 1, 2", "e1_mean e2_mean")
def _(spark, sf):
    r = records(spark, sf).withColumns({"e1": F.abs(F.col("m1") - F.col("y")), "e2": F.abs(F.col("m2") - F.col("y"))})
    return metrics.length_strata(r, ["psize", "qty"], ["e1", "e2"], 20)


@add("a39_delta_summary", R + ", d AS (SELECT flag, m2 - m1 AS d FROM records) SELECT flag, count(*) AS n, avg(d) AS mean, quantile_cont(d, 0.5) AS median, quantile_cont(abs(d), 0.5) AS abs_median, quantile_cont(abs(d), 0.9) AS abs_p90, quantile_cont(abs(d), 0.95) AS abs_p95, max(abs(d)) AS abs_max, avg((abs(d) > 1)::INT) AS above_0, avg((abs(d) > 3)::INT) AS above_1, count(*) FILTER (WHERE d < 0) AS improved, count(*) FILTER (WHERE d > 0) AS worsened, count(*) FILTER (WHERE d = 0) AS unchanged FROM d GROUP BY flag", "mean median abs_median abs_p90 abs_p95 abs_max above_0 above_1")
def _(spark, sf):
    return metrics.delta_summary(records(spark, sf), F.col("m2") - F.col("m1"), ["flag"], [1.0, 3.0])


@add("a41_skill", P + ", m AS (SELECT model, avg(abs_err) AS mae, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM predictions GROUP BY model) SELECT a.model, a.mae, 1 - a.mae / b.mae AS skill, a.mae - b.mae AS degradation, a.mae / b.mae AS ratio, a.mae / a.iqr AS iqr_normalized FROM m a, m b WHERE b.model = 'm2'", "mae skill degradation ratio iqr_normalized")
def _(spark, sf):
    p = predictions(spark, sf)
    m = stats.with_quantiles(p.groupBy("model").agg(F.avg("abs_err").alias("mae")), p, {"_lo": (F.col("y"), 0.25), "_hi": (F.col("y"), 0.75)}, ["model"])
    return metrics.skill(m.withColumn("iqr", F.col("_hi") - F.col("_lo")), "model", "m2", "mae", iqr="iqr")


A46 = IDS + ", t AS (SELECT a.donor, a.n AS sim, a.n_groups AS size, round(a.y_max - a.y_min + 1.2345678912e-7, 6) AS target_range, round(b.mae + 1.2345678912e-7, 6) AS mae, round(a.mae - b.mae + 1.2345678912e-7, 6) AS d FROM ids a JOIN ids b ON a.donor = b.donor AND a.model = 'm2' AND b.model = 'm1')"


def _mechanism(spark, sf):
    ids = metrics.identity_table(predictions(spark, sf), "donor", "grp", ["model"])
    a = ids.where("model = 'm2'").select("donor", F.col("n").alias("sim"), F.col("n_groups").alias("size"), F.round(F.col("y_max") - F.col("y_min") + EDGE, 6).alias("target_range"), F.col("mae").alias("a"))
    b = ids.where("model = 'm1'").select("donor", F.col("mae").alias("b"))
    return a.join(b.hint("shuffle_hash"), "donor").withColumns({"d": F.round(F.col("a") - F.col("b") + EDGE, 6), "mae": F.round(F.col("b") + EDGE, 6)})


@add("a46_mechanism", A46 + """, l AS (SELECT 'sim' AS factor, sim::DOUBLE AS x, d FROM t UNION ALL SELECT 'size', size, d FROM t UNION ALL SELECT 'target_range', target_range, d FROM t),
k AS (SELECT factor, x, d, rank() OVER (PARTITION BY factor ORDER BY x) + (count(*) OVER (PARTITION BY factor, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY factor ORDER BY d) + (count(*) OVER (PARTITION BY factor, d) - 1) / 2 AS ry FROM l),
e AS (SELECT quantile_cont(sim, 0.25) AS e FROM t), w AS (SELECT count(*) FILTER (WHERE d < 0) AS worst_improved FROM (SELECT d FROM t ORDER BY mae DESC, donor LIMIT 10))
SELECT * FROM (SELECT factor, count(*) AS n, corr(x, d) AS pearson, corr(rx, ry) AS spearman FROM k GROUP BY factor), (SELECT avg(d) FILTER (WHERE sim <= e) AS low_mean, avg((d < 0)::INT) FILTER (WHERE sim <= e) AS low_improved, avg((d < 0)::INT) AS improved FROM t, e), w""", "pearson spearman low_mean low_improved improved")
def _(spark, sf):
    return metrics.mechanism(stored(_mechanism(spark, sf)), "donor", "sim", "d", ["size", "target_range"], "mae")


@add("a46_worst_identities", A46 + " SELECT donor, mae, d, sim, size, target_range FROM t ORDER BY mae DESC, donor LIMIT 10")
def _(spark, sf):
    return metrics.worst_identities(_mechanism(spark, sf), "donor", "mae", ["d", "sim", "size", "target_range"])


@add("a47_run_totals", EPOCHS + ", s AS (SELECT run, arg_min(epoch, (metric, epoch)) AS best_epoch, count(*) AS seconds, max(metric) AS memory FROM e GROUP BY run) SELECT run % 3 AS arm, list_aggregate(list_transform(list(best_epoch ORDER BY run), lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS best_epochs, sum(seconds)::BIGINT AS seconds, max(memory) AS memory FROM s GROUP BY arm")
def _(spark, sf):
    per = _epochs(spark, sf).groupBy("run").agg(F.min_by("epoch", F.struct("metric", "epoch")).alias("best_epoch"), F.count("*").alias("seconds"), F.max("metric").alias("memory")).withColumn("arm", F.col("run") % 3)
    return metrics.run_totals(per, ["arm"]).withColumn("best_epochs", F.array_join("best_epochs", ","))


@add("a48_label_contrast", P + " SELECT model, flag, CASE WHEN aux IS NULL THEN 'missing' ELSE 'observed' END AS auxiliary, count(*) AS n, avg(abs_err) AS mae FROM predictions GROUP BY ALL", "mae")
def _(spark, sf):
    return metrics.label_contrast(predictions(spark, sf), "aux", "flag", ["model"])


def boot(key: str, values: str, seed: int, b: int, name: str = "", shift: int = 0) -> str:
    """SQL of the same draws: u has (key, v) of each unit."""
    n = name
    return f"""u{n} AS ({values}), i{n} AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS idx FROM u{n}), c{n} AS (SELECT count(*) AS n FROM u{n}),
d{n} AS (SELECT b, CAST('0x' || substr(sha256('{seed}:' || b || ':' || slot), 1, 8) AS BIGINT) % n AS idx FROM (SELECT unnest(range({b})) AS b), (SELECT unnest(range(n)) AS slot, n FROM c{n})),
s{n} AS (SELECT b, avg(v) AS stat FROM d{n} JOIN i{n} USING (idx) GROUP BY b)"""


@add("r1_cluster_bootstrap", R + ", " + boot("donor", "SELECT donor, avg(abs(m1 - y)) AS v FROM records GROUP BY donor", 42, 200) + " SELECT (SELECT avg(v) FROM u) AS point, (SELECT count(*) FROM u) AS n_units, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi, count(*) AS n_replicates FROM s", "point lo hi")
def _(spark, sf):
    return resample.cluster_interval(records(spark, sf).withColumn("e", F.abs(F.col("m1") - F.col("y"))), "donor", "e", 200)


@add("r2_paired_difference", R + ", " + boot("donor", "SELECT donor, avg(abs(m1 - y) - abs(m2 - y)) AS v FROM records GROUP BY donor", 42, 200) + ", q AS (SELECT quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi, count(*) AS n_replicates FROM s) SELECT (SELECT avg(v) FROM u) AS point, (SELECT count(*) FROM u) AS n_units, lo, hi, n_replicates, lo > 0 OR hi < 0 AS excludes_zero FROM q", "point lo hi")
def _(spark, sf):
    r = records(spark, sf).withColumns({"a": F.abs(F.col("m1") - F.col("y")), "b": F.abs(F.col("m2") - F.col("y"))})
    return resample.paired_difference(r, "donor", "a", "b", 200)


@add("r3_population_contrast", R + ", " + boot("donor", "SELECT donor, avg(y) AS v FROM records WHERE flag = 'A' GROUP BY donor", 42, 100, "a") + ", " + boot("donor", "SELECT donor, avg(y) AS v FROM records WHERE flag = 'R' GROUP BY donor", 43, 100, "b") + " SELECT any_value(ma) AS mean_a, any_value(mb) AS mean_b, any_value(ma - mb) AS diff, any_value(ma / mb) AS ratio, quantile_cont(sa.stat - sb.stat, 0.025) AS diff_lo, quantile_cont(sa.stat - sb.stat, 0.975) AS diff_hi, quantile_cont(sa.stat / sb.stat, 0.025) AS ratio_lo, quantile_cont(sa.stat / sb.stat, 0.975) AS ratio_hi FROM sa JOIN sb USING (b), (SELECT avg(v) AS ma FROM ua), (SELECT avg(v) AS mb FROM ub)", "mean_a mean_b diff ratio diff_lo diff_hi ratio_lo ratio_hi")
def _(spark, sf):
    r = records(spark, sf)
    return resample.population_contrast(r.where("flag = 'A'"), r.where("flag = 'R'"), "donor", "y", 100)


@add("r4_crossed_bootstrap", R + """, cells AS (SELECT donor, acceptor, sum(abs(m1 - y)) AS s, count(*) AS n FROM records GROUP BY donor, acceptor),
xa AS (SELECT donor, row_number() OVER (ORDER BY donor) - 1 AS idx FROM (SELECT DISTINCT donor FROM cells)), xb AS (SELECT acceptor, row_number() OVER (ORDER BY acceptor) - 1 AS idx FROM (SELECT DISTINCT acceptor FROM cells)),
da AS (SELECT b, CAST('0x' || substr(sha256('42:' || b || ':' || slot), 1, 8) AS BIGINT) % n AS idx FROM (SELECT unnest(range(200)) AS b), (SELECT unnest(range((SELECT count(*) FROM xa))) AS slot, (SELECT count(*) FROM xa) AS n)),
db AS (SELECT b, CAST('0x' || substr(sha256('43:' || b || ':' || slot), 1, 8) AS BIGINT) % n AS idx FROM (SELECT unnest(range(200)) AS b), (SELECT unnest(range((SELECT count(*) FROM xb))) AS slot, (SELECT count(*) FROM xb) AS n)),
ma AS (SELECT b, donor, count(*) AS m1 FROM da JOIN xa USING (idx) GROUP BY b, donor), mb AS (SELECT b, acceptor, count(*) AS m2 FROM db JOIN xb USING (idx) GROUP BY b, acceptor),
st AS (SELECT b, sum(m1 * m2 * s) / sum(m1 * m2 * n) AS stat FROM cells JOIN ma USING (donor) JOIN mb USING (b, acceptor) GROUP BY b)
SELECT (SELECT sum(s) / sum(n) FROM cells) AS point, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi, count(*) AS n_replicates FROM st""", "point lo hi")
def _(spark, sf):
    return resample.crossed_interval(records(spark, sf).withColumn("e", F.abs(F.col("m1") - F.col("y"))), "donor", "acceptor", "e", 200)


@add("r6_bootstrap_weights", R + """, x AS (SELECT donor, row_number() OVER (ORDER BY donor) - 1 AS idx FROM (SELECT DISTINCT donor FROM records)), d AS (SELECT b, CAST('0x' || substr(sha256('42:' || b || ':' || slot), 1, 8) AS BIGINT) % n AS idx FROM (SELECT unnest(range(3)) AS b), (SELECT unnest(range((SELECT count(*) FROM x))) AS slot, (SELECT count(*) FROM x) AS n)),
m AS (SELECT b, donor, count(*) AS m FROM d JOIN x USING (idx) GROUP BY b, donor) SELECT b, sum(qty * m) AS weight, count(*) AS n FROM records JOIN m USING (donor) GROUP BY b""", "weight", 3)
def _(spark, sf):
    return resample.weight_sums(resample.bootstrap_weights(records(spark, sf).select("record", "donor", "qty"), "donor", "qty", 3))


@add("r7_weighted_cluster", R + ", " + boot("donor", "SELECT donor, sum(qty * (abs(m1 - y) - abs(m2 - y))) / sum(qty) AS v FROM records GROUP BY donor", 42, 100) + " SELECT (SELECT avg(v) FROM u) AS point, (SELECT count(*) FROM u) AS n_units, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi, count(*) AS n_replicates FROM s", "point lo hi")
def _(spark, sf):
    r = records(spark, sf).withColumns({"a": F.abs(F.col("m1") - F.col("y")), "b": F.abs(F.col("m2") - F.col("y"))})
    return resample.paired_difference(r, "donor", "a", "b", 100, weight="qty").drop("excludes_zero")


def _poisson_sql(replicates: int) -> str:
    p, total, terms = 0.36787944117144233, 0.0, []
    for k in range(12):
        total += p
        terms.append(f"{total!r}::DOUBLE")
        p /= k + 1
    u = "(CAST('0x' || substr(sha256('42:' || b || ':' || acceptor), 1, 8) AS BIGINT) + 0.5) / 4294967296"
    return R + f""", un AS (SELECT acceptor, avg(abs(m1 - y)) AS v FROM records GROUP BY acceptor),
m AS (SELECT b, v, len(list_filter([{', '.join(terms)}], lambda t: t < {u})) AS m FROM un, (SELECT unnest(range({replicates})) AS b)),
st AS (SELECT sum(m * v) / sum(m) AS stat FROM m WHERE m > 0 GROUP BY b)
SELECT (SELECT avg(v) FROM un) AS point, (SELECT count(*) FROM un) AS n_units, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi, count(*) AS n_replicates FROM st"""


@add("r1_poisson_bootstrap", _poisson_sql(50), "point lo hi")
def _(spark, sf):
    return resample.cluster_interval(records(spark, sf).withColumn("e", F.abs(F.col("m1") - F.col("y"))), "acceptor", "e", 50, poisson=True)


@add("u1_finite_quantile", R + ", k AS (SELECT line, abs(m1 - y) AS s, row_number() OVER (PARTITION BY line ORDER BY abs(m1 - y)) AS r, count(*) OVER (PARTITION BY line) AS n FROM records) SELECT line, n, 0.9::DOUBLE AS level, max(s) FILTER (WHERE r = ceil((n + 1) * 0.9 - 1e-12)) AS quantile, 'OK' AS status FROM k GROUP BY line, n", "quantile")
def _(spark, sf):
    return conformal.finite_quantile(records(spark, sf).withColumn("s", F.abs(F.col("m1") - F.col("y"))), "s", 0.9, ["line"])


@add("u2_score_sets", R + ", e AS (SELECT record, grp, donor, abs(m1 - y) AS s FROM records) SELECT method, count(*) AS n, max(score) AS top, avg(score) AS mean FROM (SELECT 'record' AS method, s AS score FROM e UNION ALL SELECT 'structure', max(s) FROM e GROUP BY grp UNION ALL SELECT 'donor', max(s) FROM e GROUP BY donor) GROUP BY method", "top mean")
def _(spark, sf):
    rows = conformal.score_sets(records(spark, sf).withColumn("res", F.col("m1") - F.col("y")), "res", "record", {"structure": "grp", "donor": "donor"})
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.avg("score").alias("mean"))


U3_SQL = R + ", h AS (SELECT grp, donor, CASE WHEN abs(m1 - y) <= 1.0 THEN 1.0::DOUBLE ELSE 0 END AS hit FROM records), " + boot("donor", "SELECT donor, avg(hit) AS v FROM h GROUP BY donor", 42, 100) + """,
ids AS (SELECT donor, avg(hit) AS c, min(hit) AS a, count(*) AS size FROM h GROUP BY donor),
rk AS (SELECT rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2 AS rc, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2 AS rs FROM ids)
SELECT (SELECT count(*) FROM h) AS n, (SELECT avg(hit) FROM h) AS record, (SELECT avg(x) FROM (SELECT avg(hit) AS x FROM h GROUP BY grp)) AS group_macro, (SELECT avg(x) FROM (SELECT min(hit) AS x FROM h GROUP BY grp)) AS simultaneous,
 avg(c) AS identity_macro, avg(a) AS identity_simultaneous, count(*) AS n_identities, quantile_cont(c, 0.1) AS worst_decile, (SELECT quantile_cont(stat, 0.025) FROM s) AS identity_lo, (SELECT quantile_cont(stat, 0.975) FROM s) AS identity_hi,
 (SELECT corr(rc, rs) FROM rk) AS size_spearman, avg(c) - 0.9 AS gap, 2.0::DOUBLE AS width, 1.0::DOUBLE AS normalized_width FROM ids"""


@add("u3_coverage", U3_SQL, "record group_macro simultaneous identity_macro identity_simultaneous worst_decile identity_lo identity_hi size_spearman gap width normalized_width")
def _(spark, sf):
    return conformal.coverage(records(spark, sf).withColumn("res", F.col("m1") - F.col("y")), "res", 1.0, "grp", "donor", 2.0, 0.9, 100)


@add("r5_record_bootstrap", R + ", " + boot("record", "SELECT record, abs(m1 - y) AS v FROM records", 7, 20) + " SELECT (SELECT avg(v) FROM u) AS point, (SELECT count(*) FROM u) AS n_units, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi, count(*) AS n_replicates FROM s", "point lo hi")
def _(spark, sf):
    """The record is the unit."""
    return resample.cluster_interval(records(spark, sf).withColumn("e", F.abs(F.col("m1") - F.col("y"))), "record", "e", 20, 7)


A = R + ", s AS (SELECT record, least(qty, price / 50) AS sc, abs(m2 - y) AS e FROM records), k AS (SELECT sc, row_number() OVER (ORDER BY sc) AS r, count(*) OVER () AS n FROM s), th AS (SELECT f AS fraction, max(sc) AS threshold FROM k, (SELECT unnest([0.9::DOUBLE, 0.5]) AS f) WHERE r = ceil((n - 1) * (1 - f) - 1e-12) + 1 GROUP BY f)"


def _scored(spark, sf):
    return conformal.applicability(records(spark, sf).withColumns({"a": F.col("qty"), "b": F.col("price") / 50, "e": F.abs(F.col("m2") - F.col("y"))}), ["a", "b"]).select("record", "applicability", "e")


@add("u4_thresholds", A + " SELECT * FROM th", "threshold")
def _(spark, sf):
    return conformal.retained_thresholds(_scored(spark, sf), "applicability", [0.9, 0.5])


@add("u5_selective_risk", A + " SELECT fraction, threshold, count(*) FILTER (WHERE sc >= threshold) AS n_kept, avg((sc >= threshold)::INT) AS coverage, avg(e) FILTER (WHERE sc >= threshold) AS risk FROM s, th GROUP BY fraction, threshold", "threshold coverage risk")
def _(spark, sf):
    x = _scored(spark, sf)
    return conformal.selective_risk(x, "applicability", "e", conformal.retained_thresholds(x, "applicability", [0.9, 0.5]))


@add("u5_selective_summary", A + """, r AS (SELECT *, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2 AS rs, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2 AS re, rank() OVER (ORDER BY -sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2 AS rn,
avg(e) OVER (ORDER BY sc DESC, record ROWS UNBOUNDED PRECEDING) AS risk FROM s)
SELECT avg(risk) AS aurc, count(*) AS n, corr(rs, re) AS spearman, (sum(rn) FILTER (WHERE e > 2) - count(*) FILTER (WHERE e > 2) * (count(*) FILTER (WHERE e > 2) + 1) / 2) / (count(*) FILTER (WHERE e > 2) * count(*) FILTER (WHERE e <= 2)) AS auc FROM r""", "aurc spearman auc")
def _(spark, sf):
    return conformal.selective_summary(_scored(spark, sf), "applicability", "e", "record", 2.0)


@add("u5_risk_coverage", A + " SELECT record, row_number() OVER w AS rank, (row_number() OVER w) / count(*) OVER () AS coverage, avg(e) OVER (ORDER BY sc DESC, record ROWS UNBOUNDED PRECEDING) AS risk FROM s WINDOW w AS (ORDER BY sc DESC, record)", "coverage risk")
def _(spark, sf):
    return conformal.risk_coverage(_scored(spark, sf), "applicability", "e", "record")


@add("u6_exchangeability", R + " SELECT flag, count(DISTINCT donor) AS n_clusters, count(DISTINCT donor) / (count(DISTINCT donor) + 1) AS max_level, CASE WHEN ceil((count(DISTINCT donor) + 1) * 0.9 - 1e-12) > count(DISTINCT donor) THEN 'UNATTAINABLE' WHEN ceil((count(DISTINCT donor) + 1) * 0.999 - 1e-12) > count(DISTINCT donor) THEN 'PARTLY' ELSE 'ATTAINABLE' END AS status FROM records GROUP BY flag", "max_level")
def _(spark, sf):
    return conformal.exchangeability(records(spark, sf), "flag", "donor", [0.9, 0.999])


@add("m1_constant_baseline", R + """, v AS (SELECT y, sum(qty) AS w FROM records WHERE flag = 'A' GROUP BY y), c AS (SELECT y, sum(w) OVER (ORDER BY y) AS cum, sum(w) OVER () AS total FROM v) SELECT record, (SELECT min(y) FROM c WHERE cum >= 0.5 * total) AS pred FROM records WHERE flag = 'R'""")
def _(spark, sf):
    r = records(spark, sf)
    return models.constant_baseline(r.where("flag = 'A'"), r.where("flag = 'R'"), "y", "qty").select("record", "pred")


@add("m2_preprocessor", R + """, a AS (SELECT * FROM records WHERE flag = 'A'), v AS (SELECT aux, sum(qty) AS w FROM a WHERE aux IS NOT NULL GROUP BY aux), c AS (SELECT aux, sum(w) OVER (ORDER BY aux) AS cum, sum(w) OVER () AS total FROM v), m AS (SELECT min(aux) AS fill FROM c WHERE cum >= 0.5 * total),
x AS (SELECT qty AS w, coalesce(aux, fill) AS v, fill FROM a, m) SELECT 'aux' AS feature, any_value(fill) AS fill, sum(w * v) / sum(w) AS mean, sqrt(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2) AS scale FROM x""", "fill mean scale")
def _(spark, sf):
    return models.fit_preprocessor(records(spark, sf).where("flag = 'A'"), ["aux"], "qty").select("feature", "fill", "mean", "scale")


M9_SQL = R + ", " + boot("donor", "SELECT donor, avg(abs(m2 - y) - abs(m1 - y)) AS v FROM records GROUP BY donor", 42, 50) + ", q AS (SELECT quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM s) SELECT 'm2' AS arm, (SELECT avg(v) FROM u) AS point, lo, hi, lo > 0 OR hi < 0 AS excludes_zero FROM q"


@add("m9_arm_contrasts", M9_SQL, "point lo hi")
def _(spark, sf):
    p = predictions(spark, sf).withColumn("arm", F.col("model"))
    return models.arm_contrasts(p, "record", "donor", "m1", ["m2"], 50)


@add("m10_evaluate", P + """, g AS (SELECT model, line % 2 AS side, grp, count(*) AS n, avg(abs_err) AS a FROM predictions GROUP BY ALL), m AS (SELECT CASE WHEN side = 0 THEN 'test' ELSE 'val' END AS partition, model AS arm, sum(n)::BIGINT AS n_records, count(*) AS n_groups, sum(a * n) / sum(n) AS mae, avg(a) AS group_mae FROM g GROUP BY ALL)
SELECT 'iid' AS protocol, m.partition, m.arm, m.n_records, m.n_groups, m.mae, m.group_mae, m.group_mae - v.group_mae AS degradation, m.group_mae / v.group_mae AS ratio FROM m JOIN m v ON m.arm = v.arm AND v.partition = 'val'""", "mae group_mae degradation ratio")
def _(spark, sf):
    """Frozen predictions: odd line numbers stand for val, even ones for test."""
    p = predictions(spark, sf).select(F.lit("iid").alias("protocol"), F.when(F.col("line") % 2 == 0, "test").otherwise("val").alias("partition"), F.col("model").alias("arm"), "grp", "y", "pred")
    return models.evaluate(p, "grp").select("protocol", "partition", "arm", "n_records", "n_groups", "mae", "group_mae", "degradation", "ratio")


def _d1_sql() -> str:
    """The change of each model by donor with its interval, on all records and, as the protocol that must not be harmed, on returned ones."""
    parts, out = [], R
    for name, better, worse in (("a", "m2", "m1"), ("b", "m1", "m2"), ("c", "m1", "m1")):
        for kind, where in (("", ""), ("h", " WHERE flag = 'R'")):
            out += ", " + boot("donor", f"SELECT donor, avg(abs({better} - y) - abs({worse} - y)) AS v FROM records{where} GROUP BY donor", 42, 100, name + kind)
        parts.append(f"SELECT '{better} for {worse}' AS change, (SELECT avg(v) FROM u{name}) AS point, (SELECT quantile_cont(stat, 0.975) FROM s{name}) AS hi, (SELECT quantile_cont(stat, 0.975) FROM s{name}h) AS harm")
    return out + f", e AS ({' UNION ALL '.join(parts)}) SELECT change, CASE WHEN point <= -0.001 AND hi < 0 AND harm <= 0.01 THEN 'ADMIT' WHEN point <= 0 THEN 'HOLD' ELSE 'REJECT' END AS label, point, hi, harm FROM e"


@add("d1_admission", _d1_sql(), "point hi harm")
def _(spark, sf):
    """Admission by point, interval and non-inferiority elsewhere: one change that is admitted, one that is rejected, one that changes nothing."""
    r, out = records(spark, sf), []
    for better, worse in (("m2", "m1"), ("m1", "m2"), ("m1", "m1")):
        e = r.withColumns({"e1": F.abs(F.col(better) - F.col("y")), "e2": F.abs(F.col(worse) - F.col("y"))})
        change = resample.paired_difference(e, "donor", "e1", "e2", 100).select("point", "hi")
        harm = resample.paired_difference(e.where("flag = 'R'"), "donor", "e1", "e2", 100).select(F.col("hi").alias("harm"))
        evidence = change.join(harm.hint("broadcast"), F.lit(True))  # one row each
        admitted = candidates.admission(F.col("point"), F.col("hi"), -0.001, 0.0, F.col("harm"), 0.01)
        label = candidates.decide(evidence, [(admitted, "ADMIT"), (F.col("point") <= 0, "HOLD")], "REJECT")
        facts = F.from_json("evidence", "point double, hi double, harm double")
        out.append(label.select(F.lit(f"{better} for {worse}").alias("change"), "label", facts.alias("f")).select("change", "label", "f.point", "f.hi", "f.harm"))
    return out[0].union(out[1]).union(out[2])
