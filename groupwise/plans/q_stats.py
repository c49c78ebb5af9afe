"""Queries of the statistics operators."""

from pyspark.sql import functions as F

from groupwise.functions import scalar as s
from groupwise.operators import ranking, stats

from .bindings import PREDICTIONS_SQL, RECORDS_SQL, predictions, records, table
from .registry import registry

QUERIES, ORACLE, add = registry()
R = "WITH " + RECORDS_SQL
P = "WITH " + PREDICTIONS_SQL


@add("a1_group_weights", R + " SELECT record, grp, count(*) OVER (PARTITION BY grp) AS group_size, 1.0::DOUBLE / count(*) OVER (PARTITION BY grp) AS group_weight FROM records", "group_weight")
def _(spark, sf):
    return stats.group_weights(records(spark, sf), "grp").select("record", "grp", "group_size", "group_weight")


@add("a1_size_distribution", R + " SELECT group_size, count(*) AS n_groups FROM (SELECT grp, count(*) AS group_size FROM records GROUP BY grp) GROUP BY group_size")
def _(spark, sf):
    return stats.size_distribution(records(spark, sf), "grp")


@add("a2_partition_counts", R + " SELECT flag, count(*) AS n_rows, count(DISTINCT grp) AS n_grp, count(DISTINCT donor) AS n_donor, count(DISTINCT acceptor) AS n_acceptor, sum(qty) AS weight FROM records GROUP BY flag", "weight")
def _(spark, sf):
    return stats.partition_counts(records(spark, sf), "flag", ["grp", "donor", "acceptor"], "qty")


@add("a3_dependency", R + ", pairs AS (SELECT DISTINCT acceptor, brand FROM records) SELECT *, most_b_per_a <= 1 AS a_determines_b, most_a_per_b <= 1 AS b_determines_a FROM (SELECT max(n) AS most_b_per_a FROM (SELECT count(*) AS n FROM pairs GROUP BY acceptor)), (SELECT max(n) AS most_a_per_b FROM (SELECT count(*) AS n FROM pairs GROUP BY brand))")
def _(spark, sf):
    return stats.dependency(records(spark, sf), "acceptor", "brand")


@add("a4_aliases", R + " SELECT donor, count(DISTINCT brand) AS n_names, count(DISTINCT flag) AS n_identities, count(DISTINCT flag) > 1 AS conflict FROM records GROUP BY donor")
def _(spark, sf):
    return stats.aliases(records(spark, sf), "donor", "brand", "flag")


A5 = R + ", freq AS (SELECT 'donor' AS type, CAST(donor AS VARCHAR) AS key, count(*) AS n FROM records GROUP BY donor UNION ALL SELECT 'acceptor', CAST(acceptor AS VARCHAR), count(*) FROM records GROUP BY acceptor)"


@add("a5_frequencies", A5 + " SELECT type, key, n FROM freq")
def _(spark, sf):
    return stats.frequencies(records(spark, sf), ["donor", "acceptor"])


@add("a5_long_tail", A5 + " SELECT type, count(*) AS n_keys, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n <= 5) AS at_most_5, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, max(n) AS largest FROM freq GROUP BY type", "median p95")
def _(spark, sf):
    return stats.long_tail(stats.frequencies(records(spark, sf), ["donor", "acceptor"]))


A6 = R + """, long AS (SELECT grp, 'y' AS target, y AS value FROM records UNION ALL SELECT grp, 'm1', m1 FROM records), disp AS (
SELECT grp, target, count(*) AS n, min(value) AS lowest, max(value) AS highest, avg(value) AS mean, stddev_pop(value) AS std FROM long GROUP BY grp, target)"""


@add("a6_dispersion", A6 + " SELECT *, highest - lowest AS spread, greatest(highest - mean, mean - lowest) AS max_dev, highest - lowest = 0 AS exact, highest - lowest <= CASE target WHEN 'y' THEN 1.0 ELSE 0.5 END AS within, highest - lowest > CASE target WHEN 'y' THEN 1.0 ELSE 0.5 END AS meaningful FROM disp", "mean std spread max_dev")
def _(spark, sf):
    return stats.dispersion(records(spark, sf), "grp", {"y": 1.0, "m1": 0.5})


@add("a7_decade_histogram", A6 + " SELECT CASE WHEN highest - lowest = 0 THEN NULL ELSE greatest(-6, least(2, CAST(floor(log10(highest - lowest)) AS INTEGER))) END AS decade, count(*) AS n FROM disp GROUP BY decade")
def _(spark, sf):
    return stats.decade_histogram(stats.dispersion(records(spark, sf), "grp", {"y": 1.0, "m1": 0.5}), F.col("spread"))


@add("a8_representatives", R + " SELECT grp, min(record) AS representative, count(*) AS n, bool_and(qty < 45) AS small, bool_and(qty < 45) AS eligible FROM records GROUP BY grp")
def _(spark, sf):
    return stats.representatives(records(spark, sf).withColumn("small", F.col("qty") < 45), "grp", F.col("record"), ["small"])


@add("a9_summary", R + " SELECT flag, count(y) AS n, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS min, quantile_cont(y, 0.05) AS p05, quantile_cont(y, 0.25) AS p25, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.75) AS p75, quantile_cont(y, 0.95) AS p95, max(y) AS max FROM records GROUP BY flag", "mean std p05 p25 p50 p75 p95")
def _(spark, sf):
    return stats.summary(records(spark, sf), "y", ["flag"])


@add("a9_brief_summary", R + " SELECT flag, count(y) AS n, min(y) AS min, quantile_cont(y, 0.1) AS q10, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.9) AS q90, max(y) AS max, avg(y) AS mean FROM records GROUP BY flag", "q10 median q90 mean")
def _(spark, sf):
    return stats.brief_summary(records(spark, sf), "y", ["flag"])


@add("a10_completeness", R + """ SELECT * FROM (SELECT 'aux' AS "column", count(aux) AS n, count(aux) / count(*) AS fraction, count(DISTINCT CASE WHEN aux IS NOT NULL THEN grp END) AS n_groups, coalesce(sum(CASE WHEN aux IS NOT NULL THEN qty END), 0) / sum(qty) AS weighted_fraction FROM records
UNION ALL SELECT 'y', count(y), count(y) / count(*), count(DISTINCT CASE WHEN y IS NOT NULL THEN grp END), coalesce(sum(CASE WHEN y IS NOT NULL THEN qty END), 0) / sum(qty) FROM records)""", "fraction weighted_fraction")
def _(spark, sf):
    return stats.completeness(records(spark, sf), ["aux", "y"], "grp", "qty")


A11 = R + """, long AS (SELECT feature, weight, value FROM (
  SELECT 'aux' AS feature, qty AS weight, CAST(aux AS DOUBLE) AS value FROM records UNION ALL SELECT 'y', qty, y FROM records
  UNION ALL SELECT 'part', CASE line WHEN 1 THEN 0 WHEN 2 THEN -qty WHEN 4 THEN NULL ELSE qty END, CASE line WHEN 5 THEN CAST('inf' AS DOUBLE) WHEN 6 THEN CAST('nan' AS DOUBLE) ELSE y END FROM records
  UNION ALL SELECT 'same', qty, 2.5 FROM records UNION ALL SELECT 'none', qty, CAST('-inf' AS DOUBLE) FROM records)),
ok AS (SELECT * FROM long WHERE isfinite(value) AND weight > 0), mu AS (SELECT feature, sum(weight * value) / sum(weight) AS mean FROM ok GROUP BY feature),
v AS (SELECT feature, count(*) AS n, sum(weight) AS weight, any_value(mean) AS mean, sum(weight * (value - mean) ** 2) / sum(weight) AS var FROM ok JOIN mu USING (feature) GROUP BY feature)
SELECT feature, n, CAST(weight AS DOUBLE) AS weight, mean, CASE WHEN var <= 1e-16 THEN 1 ELSE sqrt(var) END AS std, CASE WHEN var <= 1e-16 THEN 'ZERO_OR_TINY_STD' END AS fallback FROM v
UNION ALL SELECT 'none', 0, 0.0, 0.0, 1.0, 'INSUFFICIENT_VALID_DATA'"""


@add("a11_weighted_moments", A11, "weight mean std")
def _(spark, sf):
    """Also a column with bad weights and infinities in some lines, a constant and one without a finite value."""
    r = records(spark, sf).withColumn("weight", F.col("qty").cast("double"))
    at = lambda n, x, other: F.when(F.col("line") == n, F.lit(x).cast("double") if not hasattr(x, "cast") else x).otherwise(other)
    bad = r.select(at(1, 0.0, at(2, -F.col("weight"), at(4, None, F.col("weight")))).alias("weight"), at(5, float("inf"), at(6, float("nan"), F.col("y"))).alias("part"))
    good = r.select("weight", "aux", "y", F.lit(2.5).alias("same"), F.lit(float("-inf")).alias("none"))
    return stats.weighted_moments(good, ["aux", "y", "same", "none"], "weight").union(stats.weighted_moments(bad, ["part"], "weight"))


@add("a12_weighted_median", R + """, v AS (SELECT feature, value, sum(qty) AS w FROM (SELECT 'tax' AS feature, tax AS value, qty FROM records UNION ALL SELECT 'y', y, qty FROM records) GROUP BY feature, value),
c AS (SELECT *, sum(w) OVER (PARTITION BY feature ORDER BY value) AS cum, sum(w) OVER (PARTITION BY feature) AS total FROM v) SELECT feature, min(value) AS median FROM c WHERE cum >= 0.5 * total GROUP BY feature""")
def _(spark, sf):
    return stats.weighted_median(records(spark, sf), ["tax", "y"], "qty")


@add("a13_weighted_mean", R + " SELECT donor, sum(qty * y) / sum(qty) AS mean, avg(y) AS plain_mean FROM records GROUP BY donor", "mean plain_mean")
def _(spark, sf):
    return stats.weighted_mean(records(spark, sf), "donor", "y", "qty")


@add("a14_outliers", R + """, l AS (SELECT 'y' AS "column", y AS value FROM records UNION ALL SELECT 'price', price FROM records), q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY "column")
SELECT "column", count(*) AS n, avg(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1.0::DOUBLE ELSE 0 END) AS beyond_1_5, avg(CASE WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) THEN 1.0::DOUBLE ELSE 0 END) AS beyond_3, skewness(value) AS skew FROM l JOIN q USING ("column") GROUP BY "column" """, "beyond_1_5 beyond_3 skew")
def _(spark, sf):
    return stats.outliers(records(spark, sf), ["y", "price"])


@add("a15_correlation", R + """, k AS (SELECT flag, qty AS x, y, rank() OVER (PARTITION BY flag ORDER BY qty) + (count(*) OVER (PARTITION BY flag, qty) - 1) / 2 AS rx, rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2 AS ry FROM records)
SELECT flag, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM k GROUP BY flag""", "pearson spearman")
def _(spark, sf):
    return stats.correlation(records(spark, sf), "qty", "y", ["flag"])


A16 = R + """, long AS (SELECT record, qty AS w, 'y' AS task, y AS value FROM records UNION ALL SELECT record, qty, 'm1', m1 FROM records UNION ALL SELECT record, qty, 'aux', aux FROM records),
m AS (SELECT a.task AS task_a, b.task AS task_b, count(*) AS n, sum(a.w) AS sw, sum(a.w * a.value) / sum(a.w) AS mx, sum(a.w * b.value) / sum(a.w) AS my, sum(a.w * a.value * a.value) / sum(a.w) AS xx, sum(a.w * b.value * b.value) / sum(a.w) AS yy, sum(a.w * a.value * b.value) / sum(a.w) AS xy
FROM long a JOIN long b ON a.record = b.record AND a.task < b.task AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.task, b.task),
rel AS (SELECT task_a, task_b, n, (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) AS r FROM m)"""


def _tasks(spark, sf):
    pairs = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("value")) for t in ("y", "m1", "aux")])
    return records(spark, sf).select("record", F.col("qty").alias("w"), F.inline(pairs))


def _relations(spark, sf):
    return stats.pair_relations(_tasks(spark, sf), "record", "w")


REDUNDANT = A16 + """, p AS (SELECT a.task AS task_a, b.task AS task_b, a.w, a.value AS x, b.value AS y FROM long a JOIN long b ON a.record = b.record AND a.task < b.task AND a.value IS NOT NULL AND b.value IS NOT NULL),
k AS (SELECT task_a, task_b, w, rank() OVER (PARTITION BY task_a, task_b ORDER BY x) + (count(*) OVER (PARTITION BY task_a, task_b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY task_a, task_b ORDER BY y) + (count(*) OVER (PARTITION BY task_a, task_b, y) - 1) / 2 AS ry FROM p),
mk AS (SELECT task_a, task_b, sum(w * rx) / sum(w) AS mx, sum(w * ry) / sum(w) AS my, sum(w * rx * rx) / sum(w) AS xx, sum(w * ry * ry) / sum(w) AS yy, sum(w * rx * ry) / sum(w) AS xy FROM k GROUP BY task_a, task_b),
both_r AS (SELECT task_a, task_b, n, r, (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) AS spearman, sqrt(greatest(0, 1 - r * r)) AS residual_rmse FROM rel JOIN mk USING (task_a, task_b))
SELECT *, abs(spearman) >= 0.9 AND residual_rmse <= 0.4 AS redundant FROM both_r"""


@add("a16_redundant_pairs", REDUNDANT, "r spearman residual_rmse")
def _(spark, sf):
    return stats.redundant_pairs(_tasks(spark, sf), "record", "w", 0.9, 0.4)


@add("a16_task_relations", A16 + " SELECT *, sqrt(greatest(0, 1 - r * r)) AS residual_rmse FROM rel", "r residual_rmse")
def _(spark, sf):
    return _relations(spark, sf)


@add("a17_effective_tasks", A16 + " SELECT 9.0::DOUBLE / (3 + 2 * sum(r * r)) AS effective_tasks FROM rel", "effective_tasks")
def _(spark, sf):
    return stats.effective_tasks(_relations(spark, sf), 3)


@add("a22_slope", P + " SELECT model, regr_slope(pred, y) AS slope, regr_intercept(pred, y) AS intercept, CAST(regr_count(pred, y) AS BIGINT) AS n FROM predictions GROUP BY model", "slope intercept")
def _(spark, sf):
    return stats.slope(predictions(spark, sf), "pred", "y", ["model"]).withColumn("n", F.col("n").cast("long"))


@add("a28_shift", R + """, v AS (SELECT 'y' AS "column", y AS value, flag = 'R' AS b FROM records WHERE flag IN ('A', 'R') UNION ALL SELECT 'qty', qty, flag = 'R' FROM records WHERE flag IN ('A', 'R')),
m AS (SELECT "column", avg(value) FILTER (WHERE NOT b) AS ma, avg(value) FILTER (WHERE b) AS mb, stddev_pop(value) FILTER (WHERE NOT b) AS sa, stddev_pop(value) FILTER (WHERE b) AS sb, min(value) FILTER (WHERE NOT b) AS lo, max(value) FILTER (WHERE NOT b) AS hi, count(*) FILTER (WHERE NOT b) AS na, count(*) FILTER (WHERE b) AS nb FROM v GROUP BY "column"),
st AS (SELECT "column", value, count(*) FILTER (WHERE NOT b) AS ka, count(*) FILTER (WHERE b) AS kb FROM v GROUP BY "column", value),
cu AS (SELECT "column", value, sum(ka) OVER w AS ca, sum(kb) OVER w AS cb, lead(value) OVER w AS nx FROM st WINDOW w AS (PARTITION BY "column" ORDER BY value)),
w1 AS (SELECT "column", sum(abs(ca / na - cb / nb) * (nx - value)) AS raw FROM cu JOIN m USING ("column") GROUP BY "column"),
o AS (SELECT "column", count(*) FILTER (WHERE b AND (value < lo OR value > hi)) / any_value(nb) AS outside FROM v JOIN m USING ("column") GROUP BY "column")
SELECT "column", (mb - ma) / sa AS smd, (mb - ma) / sqrt((sa * sa + sb * sb) / 2) AS pooled_smd, raw / sa AS w1, outside,
  (abs((mb - ma) / sa) >= 0.25)::INT + (raw / sa >= 0.1)::INT + (outside >= 0.05)::INT >= 2 AS shifted FROM m JOIN w1 USING ("column") JOIN o USING ("column")""", "smd pooled_smd w1 outside")
def _(spark, sf):
    r = records(spark, sf)
    return stats.shift(r.where("flag = 'A'"), r.where("flag = 'R'"), ["y", "qty"])


@add("a29_collisions", "SELECT count(DISTINCT vec_id) - count(DISTINCT embedding) AS collisions FROM embeddings")
def _(spark, sf):
    return stats.collisions(table(spark, sf, "embeddings"), "vec_id", "embedding")


@add("a34_signed_rank", R + """, d AS (SELECT abs(m1 - y) - abs(m2 - y) AS d FROM records), z AS (SELECT d, abs(d) AS a FROM d WHERE d <> 0),
k AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS r FROM z), t AS (SELECT coalesce(sum(n * n * n - n), 0) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM z GROUP BY a)),
s AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus, any_value(tie) AS tie FROM k, t),
q AS (SELECT n, w_plus, w_minus, (least(w_plus, w_minus) - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM s),
u AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM q)
SELECT n, w_plus, w_minus, z, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS p FROM u""", "w_plus w_minus z p", 3)
def _(spark, sf):
    return stats.signed_rank(records(spark, sf).withColumn("d", F.abs(F.col("m1") - F.col("y")) - F.abs(F.col("m2") - F.col("y"))), "d")


@add("a36_label_counts", "SELECT label, count(*) AS n FROM (SELECT unnest(string_split(p_type || ';' || p_brand, ';')) AS label FROM part) GROUP BY label")
def _(spark, sf):
    return stats.label_counts(table(spark, sf, "part").withColumn("l", F.concat_ws(";", "p_type", "p_brand")), "l")


@add("a37_consistency", R + " SELECT grp, count(DISTINCT price) AS n_price, count(DISTINCT qty) AS n_qty, count(DISTINCT price) <= 1 AND count(DISTINCT qty) <= 1 AS consistent FROM records GROUP BY grp")
def _(spark, sf):
    return stats.consistency(records(spark, sf), "grp", ["price", "qty"])


@add("a45_rank_feasible", R + " SELECT count(DISTINCT donor) AS n_units, count(DISTINCT donor) - 1 AS most, count(DISTINCT donor) - 1 >= 64 AS feasible FROM records")
def _(spark, sf):
    return stats.rank_feasible(records(spark, sf), "donor", 64)


@add("p9_cut", R + " SELECT bin, count(*) AS n FROM (SELECT CASE WHEN y > 0 AND y <= 20 THEN 'low' WHEN y > 20 AND y <= 60 THEN 'mid' WHEN y > 60 AND y <= 200 THEN 'high' END AS bin FROM records) GROUP BY bin")
def _(spark, sf):
    return records(spark, sf).groupBy(s.cut(F.col("y"), [0, 20, 60, 200], labels=["low", "mid", "high"]).alias("bin")).agg(F.count("*").alias("n"))


@add("p10_qcut", R + ", e AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c FROM records WHERE flag = 'N') SELECT bin, count(*) AS n FROM (SELECT (y > a)::INT + (y > b)::INT + (y > c)::INT AS bin FROM records, e) GROUP BY bin")
def _(spark, sf):
    r = records(spark, sf)
    return stats.qcut(r, "y", 4, "bin", r.where("flag = 'N'")).groupBy("bin").agg(F.count("*").alias("n"))


@add("p12_token_audit", r"""WITH t AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|\s+|[^A-Za-z0-9\s]') AS tokens FROM documents),
v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]|\s+|[^A-Za-z0-9\s]')) AS token FROM benchmark), u AS (SELECT i, unnest(tokens) AS token FROM t), x AS (SELECT * FROM u WHERE token NOT IN (SELECT token FROM v))
SELECT * FROM (SELECT count(*) AS sequences, count(*) FILTER (WHERE len(tokens) = 0) AS empty, count(*) FILTER (WHERE array_to_string(tokens, '') = t) AS lossless, count(*) FILTER (WHERE len(tokens) > 512) AS over_limit, min(len(tokens))::INT AS shortest, quantile_cont(len(tokens), 0.5) AS median, quantile_cont(len(tokens), 0.95) AS p95, max(len(tokens))::INT AS longest,
 count(*) FILTER (WHERE regexp_matches(t, '[0-9]{4}')) AS n_number, count(*) FILTER (WHERE regexp_matches(t, '[A-Za-z]@[A-Za-z]')) AS n_address FROM t),
(SELECT count(*) AS oov_tokens, count(DISTINCT token) AS oov_types, count(DISTINCT i) AS oov_sequences FROM x)""", "median p95")
def _(spark, sf):
    pattern = r"[A-Za-z]+|[0-9]|\s+|[^A-Za-z0-9\s]"
    vocabulary = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("token"))
    return stats.token_audit(table(spark, sf, "documents"), "text", vocabulary, pattern, 512, {"number": "[0-9]{4}", "address": "[A-Za-z]@[A-Za-z]"})


@add("p12_unmatched", r"SELECT character, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(coalesce(text, ''), '[A-Za-z0-9\s]+', '', 'g'), '')) AS character FROM documents) WHERE character <> '' GROUP BY character")
def _(spark, sf):
    return stats.unmatched_characters(table(spark, sf, "documents"), "text", r"[A-Za-z0-9\s]+")


@add("p17_empirical_percentile", R + """, ref AS (SELECT y FROM records WHERE flag = 'N'), n AS (SELECT count(*) AS n FROM ref), k AS (SELECT y, sum(c) OVER (ORDER BY y) AS cum FROM (SELECT y, count(*) AS c FROM ref GROUP BY y))
SELECT record, 'y' AS feature, r.y AS value, coalesce(cum, 0) / n AS percentile FROM records r ASOF LEFT JOIN k ON r.y >= k.y, n WHERE flag = 'A'""", "percentile")
def _(spark, sf):
    r = records(spark, sf)
    return stats.empirical_percentile(r.where("flag = 'A'"), r.where("flag = 'N'"), "record", ["y"])


@add("p17_extreme_count", R + """, q AS (SELECT record, (SELECT count(*) FROM (SELECT 1)) AS one, flag, y, qty FROM records), n AS (SELECT count(*) AS n FROM records WHERE flag = 'N'),
a AS (SELECT y AS v, sum(c) OVER (ORDER BY y) AS cum FROM (SELECT y, count(*) AS c FROM records WHERE flag = 'N' GROUP BY y)), b AS (SELECT qty AS v, sum(c) OVER (ORDER BY qty) AS cum FROM (SELECT qty, count(*) AS c FROM records WHERE flag = 'N' GROUP BY qty)),
x AS (SELECT record, coalesce(cum, 0) / n AS p FROM q ASOF LEFT JOIN a ON q.y >= a.v, n WHERE flag = 'A'), z AS (SELECT record, coalesce(cum, 0) / n AS p FROM q ASOF LEFT JOIN b ON q.qty >= b.v, n WHERE flag = 'A')
SELECT record, count(*) FILTER (WHERE p < 0.01 OR p > 0.99) AS n_extreme FROM (SELECT * FROM x UNION ALL SELECT * FROM z) GROUP BY record""")
def _(spark, sf):
    r = records(spark, sf)
    return stats.extreme_count(stats.empirical_percentile(r.where("flag = 'A'"), r.where("flag = 'N'"), "record", ["y", "qty"]), "record")


@add("p28_trusted_fields", """SELECT field, count(value) AS n, count(TRY_CAST(value AS TIMESTAMP)) AS n_parsed, count(DISTINCT value) AS n_distinct FROM (
SELECT 'ts' AS field, CAST(ts AS VARCHAR) AS value FROM events UNION ALL SELECT 'event_type', event_type FROM events) GROUP BY field""")
def _(spark, sf):
    return stats.trusted_fields(table(spark, sf, "events"), ["ts", "event_type"])


@add("p28_wall_seconds", "SELECT user_id, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM events GROUP BY user_id", "seconds", 3)
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", s.wall_seconds(F.col("a"), F.col("b")).alias("seconds"))


@add("w1_rank_percentile", P + " SELECT model, record, pred, percent_rank() OVER (PARTITION BY model ORDER BY pred, record) AS percentile FROM predictions", "percentile")
def _(spark, sf):
    return ranking.rank_percentile(predictions(spark, sf).select("model", "record", "pred"), ["pred", "record"], ["model"])


@add("w2_keep_first", R + " SELECT grp, record FROM (SELECT grp, record, row_number() OVER (PARTITION BY grp ORDER BY qty DESC, record) AS r FROM records) WHERE r = 1")
def _(spark, sf):
    return ranking.keep_first(records(spark, sf), ["grp"], [F.desc("qty"), F.asc("record")]).select("grp", "record")


@add("w3_worst_groups", P + " SELECT model, grp, n, mae FROM (SELECT model, grp, count(*) AS n, avg(abs_err) AS mae FROM predictions GROUP BY model, grp HAVING model = 'm1') ORDER BY round(mae, 6) DESC, grp LIMIT 10", "mae")
def _(spark, sf):
    per = predictions(spark, sf).where("model = 'm1'").groupBy("model", "grp").agg(F.count("*").alias("n"), F.avg("abs_err").alias("mae"))
    return ranking.top_k(per, 10, [F.desc(F.round("mae", 6)), F.asc("grp")])


@add("w4_quota_sample", R + """, h AS (SELECT record, flag, sha256(record) AS h FROM records), a AS (SELECT record, flag, h FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY h) AS r FROM h) WHERE r <= 20),
b AS (SELECT * FROM h WHERE record NOT IN (SELECT record FROM a) ORDER BY h LIMIT 40) SELECT record, flag FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def _(spark, sf):
    return ranking.quota_sample(records(spark, sf).select("record", "flag"), "flag", "record", 20, 100)


@add("w6_nearest_per_group", R + " SELECT donor, record FROM (SELECT donor, record, row_number() OVER (PARTITION BY donor ORDER BY y, record) AS r FROM records) WHERE r <= 3")
def _(spark, sf):
    return ranking.nearest_per(records(spark, sf), ["donor"], [F.asc("y"), F.asc("record")], 3).select("donor", "record")


@add("w7_inclusion_frequency", P + ", k AS (SELECT model, record, percent_rank() OVER (PARTITION BY model ORDER BY pred, record) AS p FROM predictions) SELECT record, count(*) AS n_models, avg((p <= 0.05)::INT) AS low_frequency, avg((p >= 0.95)::INT) AS high_frequency FROM k GROUP BY record", "low_frequency high_frequency")
def _(spark, sf):
    return ranking.inclusion_frequency(predictions(spark, sf).select("model", "record", "pred"), "model", "record", ["pred", "record"], 0.05)


@add("w13_round_robin", R + " SELECT record, CAST((row_number() OVER (PARTITION BY line ORDER BY sha256(record)) - 1) % 5 AS INTEGER) AS fold FROM records")
def _(spark, sf):
    return ranking.round_robin(records(spark, sf).select("record", "line"), "line", "record", 5).select("record", "fold")


W11_SQL = R.replace("WITH ", "WITH RECURSIVE ", 1) + """, bins AS MATERIALIZED (SELECT psize, count(*) AS n, count(DISTINCT donor) AS d, row_number() OVER (ORDER BY psize) AS i FROM records GROUP BY psize),
walk(i, psize, block, x, y) AS (
  SELECT i, psize, 0, n, d FROM bins WHERE i = 1
  UNION ALL
  SELECT b.i, b.psize, CASE WHEN x >= 3000 AND y >= 90 THEN block + 1 ELSE block END, CASE WHEN x >= 3000 AND y >= 90 THEN b.n ELSE x + b.n END, CASE WHEN x >= 3000 AND y >= 90 THEN b.d ELSE y + b.d END
  FROM walk w JOIN bins b ON b.i = w.i + 1
), ends AS (SELECT max(block) - CASE WHEN bool_or(i = (SELECT max(i) FROM bins) AND (x < 3000 OR y < 90)) THEN 1 ELSE 0 END AS last FROM walk)
SELECT psize, greatest(0, least(block, last))::INTEGER AS block FROM walk, ends"""


@add("w11_merge_bins", W11_SQL)
def _(spark, sf):
    bins = records(spark, sf).groupBy("psize").agg(F.count("*").alias("n"), F.count_distinct("donor").alias("d"))
    return ranking.merge_bins(bins, "psize", ("n", "d"), (3000, 90))


W8_SQL = R.replace("WITH ", "WITH RECURSIVE ", 1) + """, ordered AS MATERIALIZED (SELECT record, donor, acceptor, row_number() OVER (ORDER BY m1, record) AS r FROM records),
picks(r, record, ds, accs, n) AS (
  SELECT r, record, [donor], [acceptor], 1 FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.r, o.record, list_append(ds, donor), list_append(accs, acceptor), n + 1 FROM picks p, LATERAL (
    SELECT * FROM ordered o WHERE o.r > p.r AND len(list_filter(p.ds, lambda x: x = o.donor)) < 2 AND len(list_filter(p.accs, lambda x: x = o.acceptor)) < 2 ORDER BY o.r LIMIT 1) o WHERE n < 8
) SELECT record, n AS pick FROM picks"""


@add("w8_capped_picks", W8_SQL)
def _(spark, sf):
    return ranking.capped_picks(records(spark, sf), "record", "donor", "acceptor", [F.asc("m1"), F.asc("record")], 8)
