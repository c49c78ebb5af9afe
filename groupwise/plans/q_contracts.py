"""Queries of the scalar functions, contracts, joins, set operations and readers."""

from pyspark.sql import functions as F

from groupwise.functions import scalar as s
from groupwise.operators import candidates as d
from groupwise.operators import contracts as c
from groupwise.sources import readers
from groupwise.operators import stats
from groupwise.storage import stored

from .bindings import PREDICTIONS_SQL, RECORDS_SQL, predictions, records, table
from .registry import registry

QUERIES, ORACLE, add = registry()
R = "WITH " + RECORDS_SQL
P = "WITH " + PREDICTIONS_SQL


@add("s1_projected_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def _(spark, sf):
    return readers.scan_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_extendedprice", "l_shipdate"]).where("l_shipdate >= timestamp'2000-01-01'").select("l_orderkey", "l_extendedprice")


@add("s2_id_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.scan_ids(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"], ids, "o_orderkey")


@add("s12_nested_ledger", "SELECT user_id, 'all' AS split, event_type AS model, count(*) AS n, avg(value) AS mae FROM events GROUP BY user_id, event_type", "mae")
def _(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mae"))
    nested = per.groupBy("user_id").agg(F.to_json(F.create_map(F.lit("all"), F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "mae")))))).alias("metrics"))
    return readers.ledger_from_nested(nested, "metrics", ["user_id"])


@add("p1_normalize_id", "SELECT DISTINCT 'D' || l_suppkey || '_A' || l_partkey AS id, l_suppkey % 3 <> 0 AS accepted FROM lineitem")
def _(spark, sf):
    raw = table(spark, sf, "lineitem").select(F.concat(F.lit("D"), F.when(F.col("l_suppkey") % 2 == 0, "-").otherwise(""), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.when(F.col("l_suppkey") % 3 == 0, "x").otherwise(""), F.lit("_A-"), F.col("l_partkey")).alias("raw"), "l_suppkey", "l_partkey").distinct()
    good = s.normalize_id(F.regexp_replace("raw", "x", ""))
    return raw.select(good.alias("id"), s.is_pair_id(F.col("raw")).alias("accepted"))


@add("p2_group_ids", R + " SELECT record, sha256(grp) AS group_id, sha256(donor || '>>' || acceptor) AS pair_id, sha256(grp || '||D:' || donor || '||A:' || acceptor) AS role_id FROM records")
def _(spark, sf):
    g, a, b = F.col("grp"), F.col("donor").cast("string"), F.col("acceptor").cast("string")
    return records(spark, sf).select("record", s.group_id(g).alias("group_id"), s.pair_id(a, b).alias("pair_id"), s.role_aware_id(g, a, b).alias("role_id"))


@add("p3_canonical_text", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(s.canonical_text(F.col("text")), 256).alias("h"))


@add("p4_numeric_order", "SELECT donor, acceptor, row_number() OVER (ORDER BY donor, acceptor) AS place FROM (SELECT DISTINCT l_suppkey AS donor, l_partkey AS acceptor FROM lineitem)")
def _(spark, sf):
    """Places in the order of the numbers inside the ids, counted in ranges."""
    ids = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("donor"), F.col("l_partkey").alias("acceptor")).distinct()
    key = s.id_sort_key(F.concat(F.lit("D"), "donor", F.lit("_A"), "acceptor"))
    return stats.running_sum(ids.withColumn("k", key).withColumn("one", F.lit(1).cast("long")), [], ["k"], "one", "place").drop("k", "one")


@add("p5_allowed_columns", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def _(spark, sf):
    return c.allowed_columns(table(spark, sf, "lineitem"), ["*price*", "*ship*"], ["l_orderkey", "l_quantity", "l_discount"], {"l_orderkey": 0, "l_quantity": 0, "l_discount": 1}, 1)


@add("p6_partition_view", R + " SELECT record, flag FROM records WHERE flag = 'R'")
def _(spark, sf):
    return c.partition_view(records(spark, sf).select("record", "flag"), "R", "flag", ("A", "R"))


@add("p7_strata", R + " SELECT st, count(*) AS n FROM (SELECT unnest(list_filter(['all', CASE WHEN qty > 25 THEN 'large' END, CASE WHEN discount = 0 THEN 'full' END], lambda x: x IS NOT NULL)) AS st FROM records) GROUP BY st")
def _(spark, sf):
    return records(spark, sf).select(F.explode(s.strata({"all": F.lit(True), "large": F.col("qty") > 25, "full": F.col("discount") == 0})).alias("st")).groupBy("st").agg(F.count("*").alias("n"))


@add("p7_role_class", "SELECT o_orderkey, CASE WHEN f = 0 OR o = 0 THEN 'empty' WHEN p > 0 THEN 'has_unknown' ELSE 'pure' END AS role_class FROM (SELECT o_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_quantity > 45) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)")
def _(spark, sf):
    per = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_quantity") > 45).alias("p"))
    return per.select("o_orderkey", s.role_class(F.col("f"), F.col("o"), F.col("p")).alias("role_class"))


@add("p8_frequency_bin", R + " SELECT bin, count(*) AS n FROM (SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS bin FROM (SELECT count(*) AS n FROM records GROUP BY acceptor)) GROUP BY bin")
def _(spark, sf):
    return records(spark, sf).groupBy("acceptor").agg(F.count("*").alias("n")).groupBy(s.frequency_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("n"))


@add("p11_codes", R + " SELECT code, count(*) AS n FROM (SELECT CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS code FROM records) GROUP BY code")
def _(spark, sf):
    return records(spark, sf).groupBy(s.code_of(F.col("flag"), {"A": 1, "N": 2}).alias("code")).agg(F.count("*").alias("n"))


@add("p13_standardize", R + ", m AS (SELECT avg(aux) AS mu, stddev_pop(aux) AS sd FROM records) SELECT record, (coalesce(aux, 0.05) - mu) / sd AS z, coalesce(aux, 0.05) AS back FROM records, m", "z back")
def _(spark, sf):
    r = records(spark, sf)
    m = r.agg(F.avg("aux").alias("mu"), F.stddev_pop("aux").alias("sd"))
    z = r.crossJoin(F.broadcast(m)).withColumn("z", s.standardized(F.col("aux"), F.col("mu"), F.col("sd"), F.lit(0.05)))
    return z.select("record", "z", s.unstandardized(F.col("z"), F.col("mu"), F.col("sd")).alias("back"))


@add("p14_paired_deltas", R + " SELECT record, m1 - m2 AS signed, abs(m1 - m2) AS absolute FROM records", "signed absolute")
def _(spark, sf):
    return records(spark, sf).select("record", (F.col("m1") - F.col("m2")).alias("signed"), F.abs(F.col("m1") - F.col("m2")).alias("absolute"))


@add("p15_identity_audit", R + ", gaps AS (SELECT 'm2' AS identity, abs(m2 - (y - y * discount)) AS gap FROM records UNION ALL SELECT 'm1', abs(m1 - y) FROM records) SELECT identity, count(*) AS n, max(gap) AS max_abs, quantile_cont(gap, 0.99) AS p99_abs, max(gap) <= 1e-6 AS holds FROM gaps GROUP BY identity", "max_abs p99_abs")
def _(spark, sf):
    """One identity that holds and one that does not."""
    r = records(spark, sf)
    return c.identity_residual(r, "m2", F.col("m2"), F.col("y") - F.col("y") * F.col("discount"), 1e-6).union(c.identity_residual(r, "m1", F.col("m1"), F.col("y"), 1e-6))


@add("p16_hash_sample", R + " SELECT record FROM records ORDER BY sha256(record) LIMIT 50")
def _(spark, sf):
    return c.hash_sample(records(spark, sf).select("record"), "record", 50)


@add("p18_anonymous", R + " SELECT DISTINCT donor, substr(sha256(CAST(donor AS VARCHAR)), 1, 12) AS k FROM records")
def _(spark, sf):
    return records(spark, sf).select("donor", s.anonymous(F.col("donor").cast("string")).alias("k")).distinct()


@add("p19_arm", R + " SELECT record, qty, discount FROM records")
def _(spark, sf):
    return c.arm(records(spark, sf), ["record"], {"cheap": ["qty", "discount"]}, "cheap", 2, ["y", "m*"])


@add("p22_classify", R + " SELECT label, fam, count(*) AS n FROM (SELECT CASE WHEN qty > 40 AND discount > 0.05 THEN 'risk' WHEN aux IS NULL THEN 'unresolved' ELSE 'control' END AS label, unnest(CASE flag WHEN 'A' THEN ['x', 'y'] WHEN 'R' THEN ['y'] END) AS fam FROM records) GROUP BY label, fam")
def _(spark, sf):
    label = s.classify([((F.col("qty") > 40) & (F.col("discount") > 0.05), "risk"), (F.col("aux").isNull(), "unresolved")], "control")
    return records(spark, sf).select(label.alias("label"), F.explode(s.families(F.col("flag"), {"A": ["x", "y"], "R": ["y"]})).alias("fam")).groupBy("label", "fam").agg(F.count("*").alias("n"))


@add("p23_long_targets", R + " SELECT record, 'aux' AS task, aux AS value, aux IS NOT NULL AS mask FROM records UNION ALL SELECT record, 'y', y, true FROM records")
def _(spark, sf):
    return c.long_targets(records(spark, sf), ["record"], ["aux", "y"])


@add("p25_first_truth", R + " SELECT record, coalesce(aux, tax) AS v, CASE WHEN aux IS NOT NULL THEN 'aux' ELSE 'tax' END AS source FROM records")
def _(spark, sf):
    r = records(spark, sf)
    return c.first_truth(r.select("record"), {"aux": r.select("record", F.col("aux").alias("v")), "tax": r.select("record", F.col("tax").alias("v"))}, "record", "v")


@add("p27_fingerprint_size", "SELECT doc_id, CASE WHEN length(text) >= 3 THEN (SELECT count(DISTINCT text[i:i+2]) FROM (SELECT unnest(range(1, length(text) - 1)) AS i)) WHEN length(text) > 0 THEN 1 ELSE 0 END AS n_grams FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(s.fingerprint(F.col("text"), 3, 1 << 40)).cast("long").alias("n_grams"))


@add("p29_lists", R + " SELECT donor, list_aggregate(list_sort(list(DISTINCT flag)), 'string_agg', ';') AS flags, len(list(DISTINCT flag)) AS n FROM records GROUP BY donor")
def _(spark, sf):
    per = records(spark, sf).groupBy("donor").agg(s.encode_list(F.collect_set("flag")).alias("flags"))
    return per.withColumn("n", F.size(s.decode_list(F.col("flags"))).cast("long"))


@add("p30_vector_checks", "SELECT label, count(*) AS n, count(*) FILTER (WHERE list_sum(list_transform(embedding, lambda x: x * x)) = 0) AS zero FROM embeddings GROUP BY label")
def _(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("fault", s.vector_fault(F.col("embedding")))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.count("fault").alias("zero"))


@add("j1_join_1to1", "SELECT o_orderkey, o_totalprice, lines FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) USING (o_orderkey)")
def _(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(per.select("o_orderkey"), "o_orderkey", "left_semi")
    return c.join_1to1(orders, per, ["o_orderkey"], required=["lines"])


@add("j2_join_many_to_one", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def _(spark, sf):
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return c.join_many_to_one(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), sup, ["l_suppkey"]).drop("l_suppkey")


@add("j3_coverage", "SELECT count(*) FILTER (WHERE a.k IS NOT NULL) AS eligible, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS covered, count(*) FILTER (WHERE b.k IS NULL) AS missing, count(*) FILTER (WHERE a.k IS NULL) AS extra FROM (SELECT DISTINCT doc_id AS k FROM documents WHERE lang = 'en') a FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) b ON a.k = b.k")
def _(spark, sf):
    return c.coverage(table(spark, sf, "documents").where("lang = 'en'"), table(spark, sf, "labels"), "doc_id")


@add("j4_semi_anti", "SELECT lang, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS labelled, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY lang")
def _(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")
    both = c.stack({"in": c.keep_ids(docs, labels, "doc_id"), "out": c.drop_ids(docs, labels, "doc_id")}, "side")
    return both.groupBy("lang").agg(F.count_if(F.col("side") == "in").alias("labelled"), F.count_if(F.col("side") == "out").alias("unlabelled"))


@add("j5_overlap_counts", "WITH m AS (SELECT DISTINCT o_orderpriority AS s, o_custkey AS k FROM orders) SELECT a.s AS set_a, b.s AS set_b, count(*) AS overlap FROM m a JOIN m b ON a.k = b.k AND a.s < b.s GROUP BY a.s, b.s")
def _(spark, sf):
    return c.overlap_counts(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("set"), F.col("o_custkey").alias("key")))


@add("j6_membership", """SELECT c_custkey, c_nationkey, f OR fn AS in_failed, p OR pn AS in_pending, concat_ws(';', CASE WHEN f THEN 'failed:c_custkey' END, CASE WHEN fn THEN 'failed:c_nationkey' END) AS reasons FROM (
SELECT c_custkey, c_nationkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS f, c_nationkey IN (SELECT 3) AS fn, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS p, c_nationkey IN (SELECT 3) AS pn FROM customer)""")
def _(spark, sf):
    of = lambda x: table(spark, sf, "orders").where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("c_custkey"), F.lit(3).alias("c_nationkey"))
    return c.membership(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), {"failed": of("F"), "pending": of("P")}, ["c_custkey", "c_nationkey"], ["pending"])


@add("j12_registry_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return c.registry_lookup(table(spark, sf, "nation"), region, ["n_regionkey"]).select("n_name", "r_name")


@add("j13_reconcile", R + " SELECT count(*) AS n_both, 0::BIGINT AS only_a, 0::BIGINT AS only_b, max(abs(m1 - m2)) AS max_abs_delta, bool_and(m1 = m2) AS equal, false AS within FROM records", "max_abs_delta")
def _(spark, sf):
    r = records(spark, sf)
    return c.reconcile(r.select("record", F.col("m1").alias("v")), r.select("record", F.col("m2").alias("v")), "record", "v", 1e-3)


@add("j14_assemble", R + " SELECT record, coalesce(aux, tax) AS v, CASE WHEN aux IS NULL THEN 1 ELSE 0 END AS source_rank, CAST(CASE WHEN aux IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n_sources, aux IS NOT NULL AND abs(aux - tax) > 1e-12 AS conflict FROM records")
def _(spark, sf):
    r = records(spark, sf)
    return c.assemble([r.select("record", F.col("aux").alias("v")), r.select("record", F.col("tax").alias("v"))], "record", "v")


@add("j15_group_statistic", R + ", n AS (SELECT acceptor, count(*) AS n FROM records WHERE flag = 'A' GROUP BY acceptor) SELECT record, coalesce(n, 0) AS n FROM records LEFT JOIN n USING (acceptor)")
def _(spark, sf):
    r = records(spark, sf)
    return c.with_group_statistic(r.select("record", "acceptor"), r.where("flag = 'A'").groupBy("acceptor").agg(F.count("*").alias("n")), "acceptor", "n").select("record", "n")


@add("j16_wide", R + " SELECT record, m1, m2 FROM records", "m1 m2")
def _(spark, sf):
    return c.wide(predictions(spark, sf), "record", "model", "pred", ["m1", "m2"])


def _digest_sql(bucket_rows: int = 10_000) -> str:
    """A tree of 256 over a power of 256 buckets, as many as keep each at about `bucket_rows` rows; a step above the tree's height changes nothing."""
    out = R + f""", l AS (SELECT CASE {" ".join(f"WHEN count(*) <= {256**k * bucket_rows} THEN {k}" for k in (1, 2, 3))} ELSE 4 END AS levels FROM records),
p0 AS (SELECT CAST('0x' || substr(sha256(record), 1, 8) AS BIGINT) % CAST(256 ** levels AS BIGINT) AS b, sha256(string_agg(record || '|' || flag, chr(10) ORDER BY record || '|' || flag)) AS h FROM records, l GROUP BY ALL)"""
    for k in (1, 2, 3):
        up = f"levels > {k}"
        out += f", p{k} AS (SELECT CASE WHEN {up} THEN b // 256 ELSE b END AS b, CASE WHEN bool_or({up}) THEN sha256(string_agg(h, chr(10) ORDER BY p.b)) ELSE max(h) END AS h FROM p{k - 1} p, l GROUP BY ALL)"
    return out + " SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM p3"


@add("a35_exact_digest", _digest_sql())
def _(spark, sf):
    return c.bucketed_digest(records(spark, sf).select("record", "flag"), "record", ["record", "flag"])


@add("a35_digest")
def _(spark, sf):
    return c.digest(records(spark, sf).select("record", "flag", "qty"))


for _kind, _op in (("union", "UNION"), ("intersection", "INTERSECT"), ("difference", "EXCEPT")):
    @add(f"t1_{_kind}", f"SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' {_op} SELECT l_partkey FROM lineitem WHERE l_suppkey % 7 = 0")
    def _(spark, sf, kind=_kind):  # the kind of this turn of the loop
        li = table(spark, sf, "lineitem")
        return c.set_operation(li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")), li.where("l_suppkey % 7 = 0").select(F.col("l_partkey").alias("k")), kind)


@add("t1_symmetric", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _(spark, sf):
    of = lambda x: table(spark, sf, "orders").where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k"))
    return c.set_operation(of("F"), of("P"), "symmetric")


@add("t1_partition_overlap", R + " SELECT acceptor, count(DISTINCT flag) AS n_partitions FROM records GROUP BY acceptor HAVING count(DISTINCT flag) > 1")
def _(spark, sf):
    return c.partition_overlap(records(spark, sf), "acceptor", "flag")


@add("t2_stack", R + " SELECT 'a' AS part, record FROM records WHERE flag = 'A' UNION ALL SELECT 'r', record FROM records WHERE flag = 'R'")
def _(spark, sf):
    r = records(spark, sf).select("record", "flag")
    return c.stack({"a": r.where("flag = 'A'").drop("flag"), "r": r.where("flag = 'R'").drop("flag")}, "part").select("part", "record")


@add("t3_expectations", R + """ SELECT 'null_aux' AS "check", count(*) FILTER (WHERE aux IS NULL) = 0 AS passed, count(*) FILTER (WHERE aux IS NULL) AS observed FROM records
UNION ALL SELECT 'unique', count(*) = count(DISTINCT record), count(*) - count(DISTINCT record) FROM records UNION ALL SELECT 'one_line_an_order', count(*) = count(DISTINCT orderkey), count(*) - count(DISTINCT orderkey) FROM records""")
def _(spark, sf):
    unique = lambda k: F.count("*") - F.count_distinct(k)
    return c.expect(records(spark, sf), {"null_aux": F.count_if(F.col("aux").isNull()), "unique": unique("record"), "one_line_an_order": unique("orderkey")})


@add("t3_once_each", "SELECT count(*) AS expected, count(*) FILTER (WHERE n = 1) AS once, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE n IS NULL) AS missing, 0::BIGINT AS \"foreign\" FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(spark, sf):
    return c.once_each(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf, "customer"), "c_custkey")


@add("t4_protocol_labels", R + " SELECT record, 'iid' AS split_name, CASE flag WHEN 'A' THEN 'train' ELSE 'val' END AS partition, y FROM records WHERE flag <> 'N'")
def _(spark, sf):
    r = records(spark, sf)
    m = r.select("record", F.lit("iid").alias("split_name"), F.when(F.col("flag") == "A", "train").when(F.col("flag") == "R", "val").otherwise("buffer").alias("partition"))
    return c.protocol_labels(r.select("record", "y"), m, "record")


@add("t5_distinct", R + " SELECT DISTINCT donor, brand FROM records")
def _(spark, sf):
    return c.distinct_values(records(spark, sf), ["donor", "brand"])


@add("j9_universe", """WITH seen AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), sa AS (SELECT a, sum(n) AS n FROM seen GROUP BY a), sb AS (SELECT b, sum(n) AS n FROM seen GROUP BY b),
known AS (SELECT DISTINCT a * b AS product FROM seen), u AS (SELECT s_suppkey AS a, p_partkey AS b, s_suppkey * p_partkey AS product, count(*) OVER (PARTITION BY s_suppkey * p_partkey) AS n_products FROM supplier, part)
SELECT *, status = 'new' AS in_domain FROM (SELECT u.a, u.b, coalesce(sa.n, 0)::BIGINT AS support_a, coalesce(sb.n, 0)::BIGINT AS support_b, n_products,
CASE WHEN seen.a IS NOT NULL THEN 'observed' WHEN known.product IS NOT NULL THEN 'known_product' WHEN n_products > 1 THEN 'collision' WHEN least(coalesce(sa.n, 0), coalesce(sb.n, 0)) < 30 THEN 'low_support' ELSE 'new' END AS status
FROM u LEFT JOIN seen ON u.a = seen.a AND u.b = seen.b LEFT JOIN known ON u.product = known.product LEFT JOIN sa ON u.a = sa.a LEFT JOIN sb ON u.b = sb.b)""")
def _(spark, sf):
    """All pairs of suppliers and parts; the product of a pair is the product of its keys, so pairs collide."""
    seen = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    u = d.universe(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a")), table(spark, sf, "part").select(F.col("p_partkey").alias("b")), seen, "a", "b", (F.col("a") * F.col("b")).cast("string"), 30)
    return u.drop("product_hash")


@add("d1_decision", R + " SELECT CASE WHEN avg(abs(m2 - y)) - avg(abs(m1 - y)) <= 0 THEN 'ADMIT' ELSE 'REJECT' END AS label FROM records")
def _(spark, sf):
    one = records(spark, sf).agg((F.avg(F.abs(F.col("m2") - F.col("y"))) - F.avg(F.abs(F.col("m1") - F.col("y")))).alias("point"))
    return d.decide(one, [(F.col("point") <= 0, "ADMIT")], "REJECT").select("label")


@add("d2_target_ledger", R + """, l AS (SELECT 'y' AS "column", y AS v FROM records UNION ALL SELECT 'aux', aux FROM records UNION ALL SELECT 'm1', m1 FROM records UNION ALL SELECT 'm2', m2 FROM records UNION ALL SELECT 'late', CASE WHEN qty > 30 THEN tax END FROM records),
f AS (SELECT "column", count(v) / count(*) AS fraction FROM l GROUP BY "column"),
o AS (SELECT *, CASE WHEN "column" = 'm2' THEN 'report_only' WHEN "column" = 'm1' THEN 'redundant' WHEN fraction < 0.5 THEN 'masked' ELSE 'secondary' END AS role FROM f)
SELECT "column", fraction, role, CASE role WHEN 'secondary' THEN 1.0::DOUBLE WHEN 'masked' THEN 0.25 ELSE 0 END / count(*) OVER (PARTITION BY role) AS weight FROM o""", "fraction weight")
def _(spark, sf):
    r = records(spark, sf).withColumn("late", F.when(F.col("qty") > 30, F.col("tax")))
    full = stats.completeness(r, ["y", "aux", "m1", "m2", "late"])
    return d.target_ledger(full, full.where("column = 'm1'").select("column"), ["m2"])


@add("d3_field_ledger", R + """, l AS (SELECT 'qty' AS "column", qty::DOUBLE AS v FROM records UNION ALL SELECT 'aux', aux FROM records UNION ALL SELECT 'price', price FROM records),
q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY "column"),
f AS (SELECT "column", count(v) / count(*) AS fraction, avg(CASE WHEN v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1) THEN 1.0::DOUBLE WHEN v IS NOT NULL THEN 0 END) AS beyond_3 FROM l JOIN q USING ("column") GROUP BY "column")
SELECT *, CASE WHEN fraction < 0.95 THEN 'incomplete' WHEN beyond_3 > 0.05 THEN 'outliers' ELSE 'admitted' END AS status FROM f""", "fraction beyond_3")
def _(spark, sf):
    r = records(spark, sf)
    return d.field_ledger(stats.completeness(r, ["qty", "aux", "price"]), stats.outliers(r, ["qty", "aux", "price"]))


@add("d4_reproduction", R + " SELECT line AS seed, max(abs(m1 - y)) AS max_abs_delta, CASE WHEN bool_and(m1 = y) THEN 'strict' WHEN max(abs(m1 - y)) <= 0.001 THEN 'numeric' ELSE 'failed' END AS verdict FROM records GROUP BY line UNION ALL SELECT -1, max(abs(m1 - y)), CASE WHEN bool_and(m1 = y) THEN 'strict' WHEN max(abs(m1 - y)) <= 0.001 THEN 'numeric' ELSE 'failed' END FROM records", "max_abs_delta")
def _(spark, sf):
    per = records(spark, sf).groupBy(F.col("line").alias("seed")).agg(F.max(F.abs(F.col("m1") - F.col("y"))).alias("max_abs_delta"), F.bool_and(F.col("m1") == F.col("y")).alias("equal"))
    return d.reproduction(per)


D5_SQL = R.replace("WITH ", "WITH RECURSIVE ", 1) + """, ordered AS MATERIALIZED (SELECT record, grp, donor, acceptor, row_number() OVER (ORDER BY m1, record) AS r FROM records),
walk(r, record, ds, accs, n) AS (
  SELECT r, record, [donor], [acceptor], 1 FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.r, o.record, list_append(ds, donor), list_append(accs, acceptor), n + 1 FROM walk p, LATERAL (
    SELECT * FROM ordered o WHERE o.r > p.r AND len(list_filter(p.ds, lambda x: x = o.donor)) < 2 AND len(list_filter(p.accs, lambda x: x = o.acceptor)) < 2 ORDER BY o.r LIMIT 1) o WHERE n < 6
), picks AS MATERIALIZED (SELECT o.* FROM walk JOIN ordered o USING (record)),
c AS (SELECT 'categories' AS "check", (count(*) <> 6)::BIGINT AS observed FROM picks UNION ALL SELECT 'unique_structures', count(*) - count(DISTINCT grp) FROM picks
 UNION ALL SELECT 'cap_donor', count(*) FROM (SELECT donor FROM picks GROUP BY donor HAVING count(*) > 2) UNION ALL SELECT 'cap_acceptor', count(*) FROM (SELECT acceptor FROM picks GROUP BY acceptor HAVING count(*) > 2)
 UNION ALL SELECT 'same_ids', 0)
SELECT "check", observed, observed = 0 AS passed FROM c"""


@add("d5_shortlist_checks", D5_SQL)
def _(spark, sf):
    from groupwise.operators import ranking

    r = records(spark, sf).select("record", "grp", "donor", "acceptor", "m1")
    picks = ranking.capped_picks(r, "record", "donor", "acceptor", [F.asc("m1"), F.asc("record")], 6, keep=["grp", "donor", "acceptor"])
    picks = stored(picks.withColumn("category", F.lit("low")))  # at most six rows; written, for each check reads them
    return d.shortlist_checks(picks, picks, "record", "category", "grp", "donor", "acceptor", {"low": 6})
