"""Queries of similarity search and points."""

from pyspark.sql import functions as F

from groupwise.functions import scalar as s
from groupwise.operators import contracts, geometry, ranking, stats
from groupwise.storage import stored

from .bindings import POINTS_SQL, points, table
from .registry import registry

QUERIES, ORACLE, add = registry()
X = "WITH " + POINTS_SQL
NEAR = X + ", pairs AS (SELECT a.record, a.idx AS dst, b.idx AS src, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist FROM points a JOIN points b ON a.record = b.record AND a.idx <> b.idx)"


@add("j7_radius_graph", NEAR + " SELECT record, dst, src, dist FROM (SELECT *, row_number() OVER (PARTITION BY record, dst ORDER BY dist, src) AS r FROM pairs WHERE dist <= 0.5) WHERE r <= 6", "dist")
def _(spark, sf):
    return geometry.radius_graph(points(spark, sf), "record", "idx", 0.5, 6)


@add("j7_empty_graphs", NEAR + " SELECT DISTINCT record FROM points WHERE record NOT IN (SELECT record FROM pairs WHERE dist <= 0.02)")
def _(spark, sf):
    p = points(spark, sf)
    return geometry.empty_graphs(p, geometry.radius_graph(p, "record", "idx", 0.02, 6), "record")


@add("j8_interface_features", X + """, c AS (SELECT d.record, d.idx AS di, e.idx AS ei, sqrt((d.x - e.x) ** 2 + (d.y - e.y) ** 2 + (d.z - e.z) ** 2) AS dist FROM points d JOIN points e ON d.record = e.record AND d.role = 'donor' AND e.role = 'acceptor'),
a AS (SELECT record, min(dist) AS min_dist, quantile_cont(dist, 0.25) AS q25, quantile_cont(dist, 0.5) AS q50, quantile_cont(dist, 0.75) AS q75, count(*) FILTER (WHERE dist <= 3.5) AS contacts_35, count(*) FILTER (WHERE dist <= 4) AS contacts_40, count(*) FILTER (WHERE dist <= 5) AS contacts_50, count(DISTINCT CASE WHEN dist <= 4 THEN di END) AS interface_first, count(DISTINCT CASE WHEN dist <= 4 THEN ei END) AS interface_second FROM c GROUP BY record),
m AS (SELECT record, sqrt((avg(x) FILTER (WHERE role = 'donor') - avg(x) FILTER (WHERE role = 'acceptor')) ** 2 + (avg(y) FILTER (WHERE role = 'donor') - avg(y) FILTER (WHERE role = 'acceptor')) ** 2 + (avg(z) FILTER (WHERE role = 'donor') - avg(z) FILTER (WHERE role = 'acceptor')) ** 2) AS centroid_dist FROM points GROUP BY record),
u AS (SELECT d.record, min(sqrt((d.x - e.x) ** 2 + (d.y - e.y) ** 2 + (d.z - e.z) ** 2)) AS unknown_min FROM points d JOIN points e ON d.record = e.record AND d.role = 'unknown' AND e.role <> 'unknown' GROUP BY d.record)
SELECT * FROM a LEFT JOIN m USING (record) LEFT JOIN u USING (record)""", "min_dist q25 q50 q75 centroid_dist unknown_min")
def _(spark, sf):
    return geometry.interface_features(points(spark, sf), "record", "idx", "role")


def _bits(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return docs.withColumn("bits", s.fingerprint(F.col("text"), 3, 1 << 40))


def _grams(spark, sf):
    """The sets of _bits, without the other columns."""
    return stored(geometry.fingerprint_sets(table(spark, sf, "documents").select("doc_id", "text"), "text"))


GRAMS = "WITH d AS (SELECT doc_id, lang, text FROM documents), g AS (SELECT DISTINCT doc_id, lang, text[i:i+2] AS gram FROM (SELECT *, unnest(range(1, greatest(length(text) - 1, 2))) AS i FROM d WHERE length(text) > 0)), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)"


#: d: the documents; s: the largest similarity of each third document to one of the others, where they share a gram.
NEAREST = GRAMS + ", p AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS i FROM g a JOIN g b USING (gram) WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0 GROUP BY a.doc_id, b.doc_id), s AS (SELECT p.doc_id, max(i / (na.n + nb.n - i)) AS nearest FROM p JOIN n na ON p.doc_id = na.doc_id JOIN n nb ON other = nb.doc_id GROUP BY p.doc_id)"


@add("j10_nearest_similarity", NEAREST + " SELECT doc_id, coalesce(nearest, 0) AS nearest FROM d LEFT JOIN s USING (doc_id) WHERE doc_id % 3 = 0", "nearest")
def _(spark, sf):
    b = _grams(spark, sf)
    return geometry.nearest_similarity(b.where("doc_id % 3 = 0"), b.where("doc_id % 3 <> 0"), "doc_id")


@add("j10_minhash_recall")
def _(spark, sf):
    """Recall of the approximate search against the exact one, over all queries."""
    b = _grams(spark, sf)
    q, t = b.where("doc_id % 3 = 0"), b.where("doc_id % 3 <> 0")
    return geometry.search_recall(geometry.minhash_nearest(q, t, "doc_id"), geometry.nearest_similarity(q, t, "doc_id"), "doc_id", "nearest")


@add("j10_minhash_nearest")
def _(spark, sf):
    b = _grams(spark, sf)
    return geometry.minhash_nearest(b.where("doc_id % 3 = 0"), b.where("doc_id % 3 <> 0"), "doc_id")


COS = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@add("j11_nearest_cosine", COS + " SELECT a.vec_id, 1 - max(list_cosine_similarity(a.e, b.e)) AS distance FROM v a JOIN v b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY a.vec_id", "distance")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return geometry.nearest_cosine(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), "vec_id", "embedding")


@add("j11_nearest_cosine_cells", COS + " SELECT a.vec_id, 1 - max(list_cosine_similarity(a.e, b.e)) AS distance FROM v a JOIN v b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY a.vec_id", "distance")
def _(spark, sf):
    return geometry.nearest_cosine_cells(*_two_sets(spark, sf), "vec_id", "embedding").select("vec_id", "distance")


def _two_sets(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0")


@add("j11_nearest_cosine_lsh")
def _(spark, sf):
    return geometry.nearest_cosine_lsh(*_two_sets(spark, sf), "vec_id", "embedding")


@add("j11_lsh_recall")
def _(spark, sf):
    """Recall of the approximate search against the exact one, over all queries."""
    q, t = _two_sets(spark, sf)
    exact = geometry.nearest_cosine(q, t, "vec_id", "embedding")
    return geometry.search_recall(geometry.nearest_cosine_lsh(q, t, "vec_id", "embedding"), exact, "vec_id", "distance")


@add("p26_similarity", COS + " SELECT a.vec_id, list_cosine_similarity(a.e, b.e) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1", "cosine")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", s.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@add("p20_random_projection")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return geometry.projection_distortion(e, geometry.random_projection(e, "vec_id", "v", 16), "vec_id", "v")


@add("p20_projected", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
h AS (SELECT i, j, (CAST('0x' || substr(sha256('0:' || i || ':' || j || ':u'), 1, 8) AS BIGINT) + 0.5) / 4294967296 AS u, (CAST('0x' || substr(sha256('0:' || i || ':' || j || ':v'), 1, 8) AS BIGINT) + 0.5) / 4294967296 AS w FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(16)) AS j))
SELECT vec_id, CAST(j AS INTEGER) AS j, sum(x * sqrt(-2 * ln(u)) * cos(2 * pi() * w) / 4) AS value FROM v JOIN h USING (i) GROUP BY vec_id, j""", "value")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return geometry.random_projection(e, "vec_id", "v", 16).select("vec_id", F.posexplode("projected").alias("j", "value"))


@add("p21_rotate", X + " SELECT record, idx, cos(0.3) * x - sin(0.3) * y + 1 AS x, sin(0.3) * x + cos(0.3) * y + 2 AS y, z + 3 AS z, role FROM points", "x y z")
def _(spark, sf):
    return geometry.perturb(points(spark, sf), "record", "idx", "role", "rotate", 0.3)


@add("p21_noise")
def _(spark, sf):
    return geometry.perturb(points(spark, sf), "record", "idx", "role", "noise", 0.1)


@add("p21_separate", X + """, m AS (SELECT record, avg(x) FILTER (WHERE role = 'donor') AS dx, avg(y) FILTER (WHERE role = 'donor') AS dy, avg(z) FILTER (WHERE role = 'donor') AS dz, avg(x) FILTER (WHERE role = 'acceptor') AS ex, avg(y) FILTER (WHERE role = 'acceptor') AS ey, avg(z) FILTER (WHERE role = 'acceptor') AS ez FROM points GROUP BY record),
f AS (SELECT *, sqrt((dx - ex) ** 2 + (dy - ey) ** 2 + (dz - ez) ** 2) AS far FROM m) SELECT record, idx, role, CASE WHEN role = 'acceptor' THEN x + 2 * (ex - dx) / far ELSE x END AS x, CASE WHEN role = 'acceptor' THEN y + 2 * (ey - dy) / far ELSE y END AS y, CASE WHEN role = 'acceptor' THEN z + 2 * (ez - dz) / far ELSE z END AS z, false AS skipped FROM points JOIN f USING (record)""", "x y z")
def _(spark, sf):
    return geometry.perturb(points(spark, sf), "record", "idx", "role", "separate", 2.0)


@add("a42_similarity_quantiles", GRAMS + """, sampled AS (SELECT doc_id FROM d ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100), sg AS (SELECT * FROM g WHERE doc_id IN (SELECT doc_id FROM sampled)),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sg a JOIN sg b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT coalesce(i, 0) / greatest(coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(i, 0), 1) AS s FROM sampled a JOIN sampled b ON a.doc_id < b.doc_id LEFT JOIN i ON x = a.doc_id AND y = b.doc_id LEFT JOIN n na ON na.doc_id = a.doc_id LEFT JOIN n nb ON nb.doc_id = b.doc_id)
SELECT count(*) AS pairs, quantile_cont(s, 0.05) AS p05, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.95) AS p95, max(s) AS top FROM p""", "p05 p50 p95 top")
def _(spark, sf):
    return geometry.similarity_quantiles(_bits(spark, sf), "doc_id", "bits", 100)


@add("a43_distance_rmsd", X + " SELECT record, 0.0::DOUBLE AS rmsd, 'OK' AS status FROM points GROUP BY record", "rmsd")
def _(spark, sf):
    p = points(spark, sf)
    return geometry.distance_rmsd(p, geometry.perturb(p, "record", "idx", "role", "rotate", 1.1), "record", "idx")


@add("a43_flattened_rmsd", NEAR.replace("AS dist FROM", "AS dist, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + ((a.z - b.z) / 2) ** 2) AS flat FROM") + " SELECT record, sqrt(avg((dist - flat) ** 2)) AS rmsd FROM pairs GROUP BY record", "rmsd")
def _(spark, sf):
    """Against a copy whose z is halved."""
    p = points(spark, sf)
    return geometry.distance_rmsd(p, p.withColumn("z", F.col("z") / 2), "record", "idx").select("record", "rmsd")


@add("a44_role_counts", X + " SELECT record, count(*) AS n, count(*) FILTER (WHERE role = 'donor') AS n_donor, count(*) FILTER (WHERE role = 'unknown') AS n_unknown, count(*) FILTER (WHERE role = 'donor') / count(*) AS f_donor, count(*) FILTER (WHERE role = 'unknown') / count(*) AS f_unknown, count(*) FILTER (WHERE role = 'donor') > 0 AS has_donor, count(*) FILTER (WHERE role = 'unknown') > 0 AS has_unknown FROM points GROUP BY record", "f_donor f_unknown")
def _(spark, sf):
    return stats.role_counts(points(spark, sf), "record", "role", ["donor", "unknown"])


@add("p24_relabel", X + " SELECT record, idx, CASE WHEN role = 'unknown' AND idx % 2 = 0 THEN 'donor' ELSE role END AS role, role = 'unknown' AND idx % 2 = 0 AS changed, false AS violation FROM points")
def _(spark, sf):
    p = points(spark, sf).select("record", F.col("idx").cast("int").alias("idx"), "role")
    listed = p.where("role = 'unknown' and idx % 2 = 0").groupBy("record").agg(s.encode_list(F.collect_list("idx")).alias("indices")).withColumn("new_role", F.lit("donor"))
    return contracts.relabel(p, listed, "record").withColumn("idx", F.col("idx").cast("long"))


@add("a44_role_equality", X + " SELECT record, NOT bool_or(role = 'unknown' AND idx % 2 = 0) AS equal FROM points GROUP BY record")
def _(spark, sf):
    p = points(spark, sf)
    other = p.withColumn("role", F.when((F.col("role") == "unknown") & (F.col("idx") % 2 == 0), "donor").otherwise(F.col("role")))
    return stats.role_equality(p, other, "record", "idx", "role")


@add("s13_pack_points", X + ", g AS (SELECT record, max(greatest(abs(x - round(x, 3)), abs(y - round(y, 3)), abs(z - round(z, 3)))) AS max_delta FROM points GROUP BY record) SELECT record, idx, x, y, z, max_delta, max_delta <= 0.0004 AS agrees FROM points JOIN g USING (record)", "x y z max_delta")
def _(spark, sf):
    """Points against a copy written with three decimals, packed and unpacked again."""
    p = points(spark, sf)
    packed = stored(geometry.pack_points(p.drop("role"), p.withColumns({a: F.round(a, 3) for a in ("x", "y", "z")}), "record", "idx", 0.0004))
    return geometry.unpack_points(packed, "record").join(packed.select("record", "max_delta", "agrees"), "record")


@add("w9_diverse_picks")
def _(spark, sf):
    return ranking.diverse_picks(_bits(spark, sf).withColumn("near", F.lit(0.0)), "doc_id", "bits", "near", 5)


@add("w10_matched_controls")
def _(spark, sf):
    b = _bits(spark, sf).withColumn("near", F.lit(0.0))
    picks = ranking.diverse_picks(b.where("doc_id % 3 = 0"), "doc_id", "bits", "near", 3).join(b, "doc_id")
    return ranking.matched_controls(picks, b.where("doc_id % 3 <> 0"), "doc_id", "bits", "lang", "text")
