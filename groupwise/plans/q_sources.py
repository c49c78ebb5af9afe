"""Queries of the readers: a given table is written in the format to the shared folder and read back by the operator."""

import uuid

from pyspark.sql import functions as F

from groupwise.sources import readers
from groupwise.storage import shared_folder, stored

from .bindings import table
from .registry import registry

QUERIES, ORACLE, add = registry()


def _fresh(spark, name):
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}/{name}"


@add("s3_manifest", "SELECT CAST(c_custkey AS VARCHAR) AS molecule_id, c_mktsegment AS partition, CAST(c_nationkey AS VARCHAR) AS unit FROM customer")
def _(spark, sf):
    """Ids and partitions stay strings."""
    path = _fresh(spark, "manifest")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("molecule_id"), F.col("c_mktsegment").alias("partition"), F.col("c_nationkey").alias("unit"))
    rows.write.option("header", True).csv(path)
    return readers.scan_manifest(spark, path, "molecule_id string, partition string, unit string", ["molecule_id", "partition", "unit"])


@add("s4_jsonl", "SELECT CASE WHEN doc_id % 50 <> 7 THEN doc_id END AS doc_id, CASE WHEN doc_id % 50 <> 7 THEN n_chars END AS n_chars, doc_id % 50 = 7 AS malformed FROM documents")
def _(spark, sf):
    """Each fiftieth line is cut short and must come back as malformed."""
    path = _fresh(spark, "registry")
    line = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    table(spark, sf, "documents").select(F.when(F.col("doc_id") % 50 == 7, F.substring(line, 1, 5)).otherwise(line).alias("value")).write.text(path)
    return readers.scan_jsonl(spark, path, "doc_id long, lang string, n_chars long", ["doc_id", "n_chars"])


@add("s5_curves", "SELECT CAST(user_id AS INTEGER) AS epoch, value AS train_loss, value / 2 AS val_mae, count(*) AS n FROM events GROUP BY ALL", "train_loss val_mae")
def _(spark, sf):
    path = _fresh(spark, "curves")
    value = F.col("value").cast("double")
    table(spark, sf, "events").select(F.col("user_id").cast("int").alias("epoch"), value.alias("train_loss"), F.struct((value / 2).alias("group_macro_mae")).alias("validation")).write.json(path)
    return readers.scan_curves(spark, path).groupBy("epoch", "train_loss", F.col("validation.group_macro_mae").alias("val_mae")).agg(F.count("*").alias("n"))


def _of_orders(spark, sf):
    """A record for each order, with its lines as parts in a fixed order."""
    part = F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("record")).agg(F.array_sort(F.collect_list(part)).alias("parts"))


PART = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1"


@add("s6_structures", f"SELECT CAST(l_orderkey AS VARCHAR) AS record, CAST({PART} AS INTEGER) AS idx, l_linestatus AS element, l_returnflag AS role, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y, CAST(l_tax AS DOUBLE) AS z FROM lineitem", "x y z")
def _(spark, sf):
    """Orders as records of a packed file; the parts are written in reverse and must come back in order of index."""
    path = _fresh(spark, "structures")
    atom = lambda p, i: F.struct(i.alias("index"), p["l_linestatus"].alias("element"), F.lit(6).alias("atomic_num"), F.array(p["l_quantity"].cast("double"), p["l_discount"].cast("double"), p["l_tax"].cast("double")).alias("coords"), p["l_returnflag"].alias("type"))
    _of_orders(spark, sf).select("record", F.reverse(F.transform("parts", atom)).alias("atoms")).write.json(path)
    return readers.atom_table(readers.scan_structures(spark, path, packed=True))


@add("s6_bonds", f"SELECT CAST(l_orderkey AS VARCHAR) AS record, CAST(p - 1 AS INTEGER) AS a, CAST(p AS INTEGER) AS b, l_returnflag AS type FROM (SELECT *, {PART} AS p FROM lineitem) WHERE p > 0")
def _(spark, sf):
    """Successive lines of an order are bonded."""
    path = _fresh(spark, "structures")
    bond = lambda p, i: F.when(i > 0, F.struct((i - 1).alias("atom1_index"), i.alias("atom2_index"), p["l_returnflag"].alias("type")))
    _of_orders(spark, sf).select("record", F.filter(F.transform("parts", bond), lambda b: b.isNotNull()).alias("bonds")).write.json(path)
    return readers.bond_table(readers.scan_structures(spark, path, packed=True))


@add("s7_sidecars", f"SELECT CAST(l_orderkey AS VARCHAR) AS record, CAST({PART} AS INTEGER) AS idx, l_returnflag AS origin, 'd' || l_orderkey AS donor_smiles, CAST(NULL AS VARCHAR) AS acceptor_smiles FROM lineitem")
def _(spark, sf):
    path = _fresh(spark, "sidecars")
    _of_orders(spark, sf).select("record", F.transform("parts", lambda p: p["l_returnflag"]).alias("atom_origins"), F.concat(F.lit("d"), "record").alias("donor_smiles")).write.json(path)
    return readers.scan_sidecars(spark, path, packed=True)


@add("s8_fixed_width", f"SELECT CAST(l_orderkey AS VARCHAR) AS record, CAST({PART} AS INTEGER) AS idx, l_linestatus AS element, CAST(l_quantity AS DOUBLE) AS x, -CAST(l_discount AS DOUBLE) AS y, CAST(l_tax AS DOUBLE) AS z FROM lineitem", "x y z")
def _(spark, sf):
    """Many records a file, each from HEADER to END."""
    path = _fresh(spark, "fixed")
    line = lambda p: F.format_string("ATOM  %5d  C   MOL     1    %8.3f%8.3f%8.3f%22s%2s", p["l_linenumber"].cast("int"), p["l_quantity"].cast("double"), -p["l_discount"].cast("double"), p["l_tax"].cast("double"), F.lit(""), p["l_linestatus"])
    text = F.concat(F.lit("HEADER    "), "record", F.lit("\nREMARK\n"), F.array_join(F.transform("parts", line), "\n"), F.lit("\nEND"))
    _of_orders(spark, sf).select(text.alias("value")).write.text(path)
    return readers.scan_fixed_width(spark, path, "\nEND\n")


@add("s9_inventory")
def _(spark, sf):
    """The table's own files against a manifest of them: no file may be missing, unknown or of another size."""
    path = _fresh(spark, "inventory")
    table(spark, sf, "orders").repartition(8, "o_orderkey").write.parquet(path)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), F.col("length").alias("size"))
    found = stored(readers.file_inventory(spark, path, files))
    states = found.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"), "state").agg(F.count("*").alias("n"))
    return states.join(readers.directory_sets(found), "directory")


@add("s10_verify_hashes", "SELECT 0::BIGINT AS unmatched, count(*) > 0 AS found_any FROM orders")
def _(spark, sf):
    """Hashes of the table's files, taken twice: every entry of the first registry is matched by the second."""
    path = _fresh(spark, "hashed")
    table(spark, sf, "orders").write.parquet(path)
    registry_ = stored(readers.content_hashes(spark, path))
    unmatched = readers.verify_hashes(readers.content_hashes(spark, path), registry_).agg(F.count("*").alias("unmatched"))
    return unmatched.crossJoin(F.broadcast(registry_.agg((F.count("*") > 0).alias("found_any"))))  # one row


@add("s11_run_logs", "SELECT CAST(user_id AS INTEGER) AS epoch, CAST(event_id % 997 AS DOUBLE) AS mae, CAST(event_id % 13 AS DOUBLE) AS seconds, count(*) AS n FROM events WHERE event_id % 10 <> 3 GROUP BY ALL")
def _(spark, sf):
    """A log line an event, and noise in each tenth."""
    path = _fresh(spark, "logs")
    line = F.format_string("epoch %d train mae %d time %d", F.col("user_id").cast("long"), (F.col("event_id") % 997).cast("long"), (F.col("event_id") % 13).cast("long"))
    table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 3, "saved a checkpoint").otherwise(line).alias("value")).write.text(path)
    return readers.scan_run_logs(spark, path).groupBy("epoch", "mae", "seconds").agg(F.count("*").alias("n"))


@add("s12_union_ledgers", "SELECT o_orderkey AS key, o_totalprice AS mae, CAST(NULL AS BIGINT) AS n FROM orders UNION ALL SELECT l_orderkey, NULL, count(*) FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("mae"))
    return readers.union_ledgers(a, table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n")))


@add("s14_edge_store", "SELECT l_orderkey AS record, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey", "total", 3)
def _(spark, sf):
    """An order's lines as edges from part to supplier; the store is read back."""
    path = _fresh(spark, "edges")
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("dst"), F.col("l_suppkey").alias("src"), F.col("l_quantity").cast("double").alias("dist"))
    readers.write_edge_store(edges, path, "record", 8)
    return spark.read.parquet(path).groupBy("record").agg(F.count("*").alias("n"), F.sum("dist").alias("total"))


@add("s15_write_once", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    path = _fresh(spark, "report")
    readers.write_once(table(spark, sf, "orders"), path, ["o_orderkey", "o_orderstatus"], {"o_orderkey": "%012d"}, "csv")
    return spark.read.schema("o_orderkey string, o_orderstatus string").option("header", True).csv(path)


@add("s16_exports", "WITH m AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT a.s AS set_a, b.s AS set_b, count(*) AS overlap FROM m a JOIN m b ON a.k = b.k AND a.s < b.s GROUP BY a.s, b.s")
def _(spark, sf):
    """Two exports named by their folder."""
    base = _fresh(spark, "exports")
    for status in ("F", "O"):
        table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select("o_custkey").write.parquet(f"{base}/{status}")
    return readers.exported_databases(spark, [f"{base}/F", f"{base}/O"], "o_custkey")
