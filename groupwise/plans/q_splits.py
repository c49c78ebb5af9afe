"""Queries of the split operators."""

from pyspark.sql import functions as F

from groupwise.operators import geometry, splits, stats
from groupwise.operators.contracts import digest
from groupwise.functions import scalar as s
from groupwise.storage import stored

from .bindings import RECORDS_SQL, records, table
from .q_geometry import NEAREST
from .registry import registry

QUERIES, ORACLE, add = registry()
R = "WITH " + RECORDS_SQL
#: With identity = supplier a unit is all groups of a supplier, so plain SQL can find the components.
UNITS = R + """, g AS (SELECT grp, donor, count(*) AS n, sum(1 / gs)::DOUBLE AS w FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS gs FROM records) GROUP BY grp, donor),
u AS (SELECT donor, sha256(count(*) || ':' || sum(CAST('0x' || substr(sha256(grp), 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(sha256(grp), 16, 15) AS BIGINT))) AS unit, count(*) AS n_groups, sum(n)::BIGINT AS n_records, sum(w) AS unit_weight, donor = 3 AS forced FROM g GROUP BY donor)"""
BAL = UNITS + """, t AS (SELECT sum(n_records) AS total, coalesce(sum(n_records) FILTER (WHERE forced), 0) AS f FROM u),
o AS (SELECT seed, unit, n_records, unit_weight, sum(n_records) OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || unit)) - n_records / 2 AS mid FROM u, (SELECT unnest([1, 2, 3]) AS seed) WHERE NOT forced),
b AS (SELECT seed, unit, n_records, unit_weight, CASE WHEN mid < greatest(0, 0.7 * total - f) THEN 'train' WHEN mid < greatest(0, 0.7 * total - f) + greatest(total - f - greatest(0, 0.7 * total - f), 0) * 0.5 THEN 'val' ELSE 'test' END AS partition FROM o, t UNION ALL SELECT seed, unit, n_records, unit_weight, 'train' FROM u, (SELECT unnest([1, 2, 3]) AS seed) WHERE forced),
l AS (SELECT seed, round(abs(sum(n_records) FILTER (WHERE partition = 'train') / sum(n_records) - 0.7) + abs(coalesce(sum(n_records) FILTER (WHERE partition = 'val'), 0) / sum(n_records) - 0.15) + abs(coalesce(sum(n_records) FILTER (WHERE partition = 'test'), 0) / sum(n_records) - 0.15), 12) AS record_l1,
 round(abs(sum(unit_weight) FILTER (WHERE partition = 'train') / sum(unit_weight) - 0.7) + abs(coalesce(sum(unit_weight) FILTER (WHERE partition = 'val'), 0) / sum(unit_weight) - 0.15) + abs(coalesce(sum(unit_weight) FILTER (WHERE partition = 'test'), 0) / sum(unit_weight) - 0.15), 12) AS weight_l1 FROM b GROUP BY seed)"""


def _rows(spark, sf):
    return stats.group_weights(records(spark, sf), "grp").withColumn("forced", F.col("donor") == 3)


def _units(spark, sf):
    return stored(splits.atomic_units(_rows(spark, sf), "grp", "donor", "group_weight", "forced"))


def _split(spark, sf):
    units = _units(spark, sf)
    return units, splits.best_split(splits.balance_units(splits.units_only(units), [1, 2, 3]))


@add("x1_atomic_units", UNITS + " SELECT grp, unit, n_groups, n_records, unit_weight, forced FROM g JOIN u USING (donor)", "unit_weight")
def _(spark, sf):
    return _units(spark, sf).select("grp", "unit", "n_groups", "n_records", "unit_weight", "forced")


@add("x1_transitive_units")
def _(spark, sf):
    """Texts that share a word of ten letters or more, transitively."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{10,}"), F.lit(0))).alias("w"))
    return splits.components(words, "doc_id", "w")


@add("x2_balance_units", BAL + " SELECT seed, unit, n_records, unit_weight, partition FROM b", "unit_weight")
def _(spark, sf):
    return splits.balance_units(splits.units_only(_units(spark, sf)), [1, 2, 3])


@add("x3_seed_sweep", BAL + " SELECT seed, record_l1, weight_l1 FROM l", "record_l1 weight_l1")
def _(spark, sf):
    return splits.sweep(splits.balance_units(splits.units_only(_units(spark, sf)), [1, 2, 3]))


@add("x3_best_split", BAL + ", best AS (SELECT seed FROM l ORDER BY record_l1, weight_l1, seed LIMIT 1) SELECT unit, partition, seed FROM b WHERE seed = (SELECT seed FROM best)")
def _(spark, sf):
    return _split(spark, sf)[1]


def _x4_sql(rounds: int = 6) -> str:
    """Support repair unrolled; a round that finds nothing changes nothing."""
    draw = "CAST('0x' || substr(sha256('1:' || grp), 1, 8) AS BIGINT) % 100"
    out = R + f", p0 AS MATERIALIZED (SELECT record, grp, donor, acceptor, CASE WHEN {draw} < 70 THEN 'train' WHEN {draw} < 85 THEN 'val' ELSE 'test' END AS part FROM records)"
    for k in range(rounds):
        few = [f"{key} IN (SELECT {key} FROM p{k} GROUP BY {key} HAVING count(*) FILTER (WHERE part = 'train') < 5)" for key in ("donor", "acceptor")]
        weak = f"SELECT grp FROM p{k} WHERE part <> 'train' AND ({' OR '.join(few)})"
        out += f", p{k + 1} AS MATERIALIZED (SELECT record, grp, donor, acceptor, CASE WHEN grp IN ({weak}) THEN 'train' ELSE part END AS part FROM p{k})"
    return out + f" SELECT record, part AS partition FROM p{rounds}"


@add("x4_pair_cold_repair", _x4_sql())
def _(spark, sf):
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit("1:"), "grp"), 256), 1, 8), 16, 10).cast("long") % 100
    r = _rows(spark, sf).withColumn("unit", F.col("grp")).withColumn("partition", F.when(hashed < 70, "train").when(hashed < 85, "val").otherwise("test"))
    return splits.repair_support(r.select("record", "unit", "donor", "acceptor", "partition"), ["donor", "acceptor"]).select("record", "partition")


X4_SWEEP = R + """, u AS (SELECT grp, count(*) AS n FROM records GROUP BY grp),
o AS (SELECT seed, grp, n, sum(n) OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || grp)) - n / 2 AS mid, sum(n) OVER (PARTITION BY seed) AS total FROM u, (SELECT unnest([1, 2, 3]) AS seed)),
b AS (SELECT seed, grp, CASE WHEN mid < 0.7 * total THEN 'train' WHEN mid < 0.7 * total + (total - 0.7 * total) * 0.5 THEN 'val' ELSE 'test' END AS part FROM o),
p AS (SELECT seed, part, record, grp, donor, acceptor FROM records JOIN b USING (grp)),
wd AS (SELECT seed, donor FROM p GROUP BY ALL HAVING count(*) FILTER (WHERE part = 'train') < 5), wa AS (SELECT seed, acceptor FROM p GROUP BY ALL HAVING count(*) FILTER (WHERE part = 'train') < 5),
w AS (SELECT seed, grp FROM p JOIN wd USING (seed, donor) UNION SELECT seed, grp FROM p JOIN wa USING (seed, acceptor)),
f AS (SELECT p.seed, record, CASE WHEN w.grp IS NOT NULL THEN 'train' ELSE part END AS partition FROM p LEFT JOIN w ON p.seed = w.seed AND p.grp = w.grp),
l AS (SELECT seed, round(abs(count(*) FILTER (WHERE partition = 'train') / count(*) - 0.7) + abs(count(*) FILTER (WHERE partition = 'val') / count(*) - 0.15) + abs(count(*) FILTER (WHERE partition = 'test') / count(*) - 0.15), 12) AS gap FROM f GROUP BY seed)
SELECT record, partition, seed FROM f WHERE seed = (SELECT seed FROM l ORDER BY gap, seed LIMIT 1)"""


@add("x4_pair_cold", X4_SWEEP)
def _(spark, sf):
    """Pair-cold split over a seed sweep: units are the key pairs."""
    r = stored(records(spark, sf).select("record", F.col("grp").alias("unit"), "donor", "acceptor"))
    units = r.groupBy("unit").agg(F.count("*").alias("n_records"), F.lit(False).alias("forced"))
    return splits.pair_cold(r, units, ["donor", "acceptor"], [1, 2, 3], "record").select("record", "partition", "seed")


#: Numbers of held-out keys and seeds of the registered query, and its gates (the test tables are small).
X5_KA, X5_KB, X5_SEEDS, X5_POWER = [3, 6, 10], [40, 80], [1, 2, 3], {"test_records": 20, "test_groups": 20, "core_records": 1000}


def _x5_sql() -> str:
    cand = f"cand AS (SELECT seed, ka, kb FROM (SELECT unnest({X5_SEEDS}) AS seed), (SELECT unnest({X5_KA}) AS ka), (SELECT unnest({X5_KB}) AS kb))"
    out = R + f", rws AS MATERIALIZED (SELECT record, donor AS a, acceptor AS b, grp AS g, donor = 3 AS locked FROM records), {cand}"
    for k in "ab":
        out += f", free{k} AS MATERIALIZED (SELECT {k} FROM rws GROUP BY {k} HAVING NOT bool_or(locked))"
    out += ", pairs AS MATERIALIZED (SELECT a, b, count(*) AS n FROM rws GROUP BY a, b)"
    out += ", b0 AS MATERIALIZED (SELECT seed, ka, kb, b FROM cand, freeb QUALIFY row_number() OVER (PARTITION BY seed, ka, kb ORDER BY sha256(seed || ':B:' || b)) <= kb)"
    step = ", {new} AS MATERIALIZED (SELECT seed, ka, kb, {k} FROM (SELECT seed, ka, kb, f.{k}, coalesce(n, 0) AS n FROM cand CROSS JOIN free{k} f LEFT JOIN (SELECT seed, ka, kb, {k}, sum(n) AS n FROM pairs JOIN {old} USING ({o}) GROUP BY ALL) USING (seed, ka, kb, {k})) QUALIFY row_number() OVER (PARTITION BY seed, ka, kb ORDER BY n DESC, sha256(seed || ':{salt}:' || {k})) <= k{k})"
    for r in range(4):
        out += step.format(new=f"a{r + 1}", old=f"b{r}", k="a", o="b", salt="A") + step.format(new=f"b{r + 1}", old=f"a{r + 1}", k="b", o="a", salt="B2")
    out += """, touched AS MATERIALIZED (SELECT seed, ka, kb, g, a, b, n, a4.a IS NOT NULL AS ina, b4.b IS NOT NULL AS inb FROM cand CROSS JOIN (SELECT g, a, b, count(*) AS n FROM rws GROUP BY ALL)
  LEFT JOIN a4 USING (seed, ka, kb, a) LEFT JOIN b4 USING (seed, ka, kb, b) WHERE a4.a IS NOT NULL OR b4.b IS NOT NULL),
grps AS (SELECT g, count(*) AS all_ FROM rws GROUP BY g),
by_group AS MATERIALIZED (SELECT seed, ka, kb, g, any_value(all_) AS all_, CASE WHEN coalesce(sum(n) FILTER (WHERE ina AND inb), 0) = any_value(all_) THEN 'test' ELSE 'buffer' END AS part FROM touched JOIN grps USING (g) GROUP BY seed, ka, kb, g),
sums AS (SELECT seed, ka, kb, coalesce(sum(all_) FILTER (WHERE part = 'test'), 0) AS test_records, coalesce(sum(all_) FILTER (WHERE part = 'buffer'), 0) AS buffer_records, count(*) FILTER (WHERE part = 'test') AS test_groups FROM by_group GROUP BY ALL),
scored AS (SELECT *, (SELECT count(*) FROM rws) - test_records - buffer_records AS core_records, test_records / (SELECT count(*) FROM rws)::DOUBLE AS share FROM sums),"""
    weak = " OR ".join(f"{k} < {v}" for k, v in X5_POWER.items())
    out += f"best AS MATERIALIZED (SELECT seed, ka, kb FROM scored ORDER BY ({weak}), -core_records, buffer_records, NOT share BETWEEN 0.05 AND 0.10, round(abs(share - 0.075), 12), seed, ka, kb LIMIT 1),"
    out += """outside AS (SELECT g, part FROM by_group JOIN best USING (seed, ka, kb)),
core AS (SELECT g AS unit, all_ AS n_records, locked FROM grps JOIN (SELECT g, bool_or(locked) AS locked FROM rws GROUP BY g) USING (g) WHERE g NOT IN (SELECT g FROM outside)),
t AS (SELECT sum(n_records) AS total, coalesce(sum(n_records) FILTER (WHERE locked), 0) AS f FROM core),
inner_ AS (SELECT unit, sum(n_records) OVER (ORDER BY sha256((SELECT seed FROM best) || ':' || unit)) - n_records / 2 AS mid FROM core WHERE NOT locked),
placed AS (SELECT unit AS g, CASE WHEN mid < greatest(0, 0.85 * total - f) THEN 'train' ELSE 'val' END AS part FROM inner_, t UNION ALL SELECT unit, 'train' FROM core WHERE locked UNION ALL SELECT g, part FROM outside)
SELECT record, part AS partition FROM rws JOIN placed USING (g)"""
    return out


@add("x5_both_cold", _x5_sql())
def _(spark, sf):
    r = records(spark, sf).select("record", "donor", "acceptor", "grp", (F.col("donor") == 3).alias("locked"))
    return splits.both_cold(r, "donor", "acceptor", "grp", "record", X5_KA, X5_KB, X5_SEEDS, "locked", X5_POWER)


@add("x6_overrides", R + " SELECT record, CASE WHEN donor = 1 THEN 'historical_quarantine' WHEN donor IN (2, 4) THEN 'train' ELSE 'val' END AS partition, CASE WHEN donor IN (2, 4) THEN 'used before' END AS forced_train_reason FROM records")
def _(spark, sf):
    r = records(spark, sf).select("record", "grp", "donor").withColumn("partition", F.lit("val"))
    forced = r.where("donor in (2, 4)").select("grp", F.lit("used before").alias("reason"))
    return splits.override(r, r.where("donor = 1"), forced, "grp").select("record", "partition", "forced_train_reason")


X7_SQL = BAL + """, best AS (SELECT seed FROM l ORDER BY record_l1, weight_l1, seed LIMIT 1), p AS (SELECT unit, partition FROM b WHERE seed = (SELECT seed FROM best)),
rw AS (SELECT r.record, r.grp, r.donor, 1.0 / count(*) OVER (PARTITION BY r.grp) AS w, p.partition FROM records r JOIN u USING (donor) JOIN p USING (unit)),
c AS (SELECT 'unique_records' AS "check", count(*) - count(DISTINCT record) AS observed FROM rw UNION ALL SELECT 'coverage', abs(count(*) - (SELECT count(*) FROM lineitem)) FROM rw
 UNION ALL SELECT 'domain', count(*) FILTER (WHERE partition NOT IN ('train', 'val', 'test', 'buffer', 'historical_quarantine')) FROM rw
 UNION ALL SELECT 'one_partition_per_group', count(*) FROM (SELECT grp FROM rw GROUP BY grp HAVING count(DISTINCT partition) > 1)
 UNION ALL SELECT 'weights_sum_to_one', count(*) FROM (SELECT grp FROM rw GROUP BY grp HAVING abs(sum(w) - 1) > 1e-9)
 UNION ALL SELECT 'power', (count(*) FILTER (WHERE partition = 'val') < 30)::INT + (count(*) FILTER (WHERE partition = 'test') < 30)::INT FROM rw
 UNION ALL SELECT 'no_target_columns', 0 UNION ALL SELECT 'disjoint_donor', count(*) FROM (SELECT donor FROM rw GROUP BY donor HAVING count(DISTINCT partition) > 1))
SELECT "check", CAST(observed AS BIGINT) AS observed, observed = 0 AS passed FROM c"""


@add("x7_verify", X7_SQL)
def _(spark, sf):
    r = stored(_rows(spark, sf).select("record", "grp", "donor", "group_weight", "forced"))  # what units and checks read, made once
    units = stored(splits.atomic_units(r, "grp", "donor", "group_weight", "forced"))
    best = splits.best_split(splits.balance_units(splits.units_only(units), [1, 2, 3]))
    rows = stored(splits.assign(r.drop("forced"), units, best, "grp").drop("unit"))
    return splits.verify(rows, "record", "grp", ["donor"], "group_weight", table(spark, sf, "lineitem").count(), targets=["y"])


@add("x8_invariance", "SELECT (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem)) AS n, true AS invariant")
def _(spark, sf):
    """The best split has one row a unit, and is the same however the records are dealt."""
    build = lambda d: splits.best_split(splits.balance_units(splits.units_only(splits.atomic_units(d, "grp", "donor", "group_weight", "forced")), [1, 2, 3]))
    return splits.invariance(build, _rows(spark, sf), digest)


FOLDS = R + """, mu AS (SELECT donor, sum(qty * y) / sum(qty) AS m FROM records GROUP BY donor), e AS (SELECT quantile_cont(m, [0.2, 0.4, 0.6, 0.8]) AS e FROM mu), bins AS (SELECT donor, len(list_filter(e, lambda x: x < m)) AS bin FROM mu, e),
o AS (SELECT donor, bin, row_number() OVER (PARTITION BY bin ORDER BY sha256(CAST(donor AS VARCHAR)), donor) AS r, count(*) OVER (PARTITION BY bin) AS n FROM bins)"""


@add("x9_inner_holdout", FOLDS + " SELECT donor, CASE WHEN r <= greatest(1, round(0.15 * n)) THEN 'val' ELSE 'train' END AS inner_part FROM o")
def _(spark, sf):
    return splits.inner_holdout(records(spark, sf), "donor", "y", "qty", bins=5).withColumnRenamed("inner", "inner_part")


@add("x10_unit_folds", FOLDS + " SELECT donor, CAST((r - 1) % 3 AS INTEGER) AS fold FROM o")
def _(spark, sf):
    return splits.unit_folds(records(spark, sf), "donor", "y", "qty", 3, 5)


@add("x11_split_changes", R + " SELECT count(*) AS n, count(*) FILTER (WHERE flag <> status) AS changed, 0::BIGINT AS only_b, 0::BIGINT AS only_a FROM records")
def _(spark, sf):
    r = records(spark, sf)
    return splits.split_changes(r.select("record", F.col("flag").alias("partition")), r.select("record", F.col("status").alias("partition")), "record")


X12 = "CASE flag WHEN 'A' THEN 'train' WHEN 'R' THEN 'val' ELSE 'test' END"


@add("x12_train_overlap", R + f", l AS (SELECT DISTINCT {X12} AS partition, 'acceptor' AS type, CAST(acceptor AS VARCHAR) AS key FROM records UNION ALL SELECT DISTINCT {X12}, 'grp', grp FROM records) SELECT partition, type, count(*) AS n_keys, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM l t WHERE t.partition = 'train' AND t.type = l.type AND t.key = l.key)) AS in_train FROM l WHERE partition <> 'train' GROUP BY partition, type")
def _(spark, sf):
    r = records(spark, sf).withColumn("partition", F.when(F.col("flag") == "A", "train").when(F.col("flag") == "R", "val").otherwise("test"))
    return splits.train_overlap(r, ["acceptor", "grp"])


@add("x12_severity", NEAREST + """, near AS (SELECT doc_id, coalesce(nearest, 0) AS v FROM d LEFT JOIN s USING (doc_id) WHERE doc_id % 3 = 0)
SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, max(v) AS max FROM near""", "mean std min p05 p25 p50 p75 p95 max")
def _(spark, sf):
    docs = stored(geometry.fingerprint_sets(table(spark, sf, "documents").select("doc_id", "text"), "text"))
    near = geometry.nearest_similarity(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0"), "doc_id")
    return stats.summary(near, "nearest")


@add("x13_historical_actions", R + " SELECT grp, CASE WHEN bool_or(flag = 'R') THEN 'quarantine' WHEN bool_or(flag = 'N') THEN 'force_train' ELSE 'none' END AS action FROM records GROUP BY grp")
def _(spark, sf):
    r = records(spark, sf)
    return splits.historical_actions(r, r.where("flag = 'R'"), r.where("flag = 'N'"), "grp")


@add("x14_replicate_policy", R + ", g AS (SELECT grp, count(*) AS n, max(y) - min(y) > 20 AS m, bool_and(qty < 45) AS e FROM records GROUP BY grp) SELECT CASE WHEN n = 1 THEN 'single' WHEN NOT m THEN 'representative' WHEN e THEN 'weighted' ELSE 'aggregate' END AS policy, count(*) AS n_groups, sum(n)::BIGINT AS n_records FROM g GROUP BY policy")
def _(spark, sf):
    r = records(spark, sf).withColumn("small", F.col("qty") < 45)
    return splits.replicate_policy(stats.dispersion(r, "grp", {"y": 20.0}), stats.representatives(r, "grp", F.col("record"), ["small"]), "grp")
