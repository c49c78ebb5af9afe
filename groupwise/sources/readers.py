"""Readers and writers with declared schemas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType

from groupwise.operators.contracts import ContractError

MANIFEST = "molecule_id string, partition string, structure_group_id_v1 string, donor_structure_group_id_v1 string, acceptor_structure_group_id_v1 string, pair_group_id_v1 string, full_scaffold_group_id_v1 string, role_aware_group_id_v1 string, structure_group_size int, group_weight double, assignment_unit_id string, historical_status string, forced_train_reason string, split_name string, split_version string"
STRUCTURE = "atoms array<struct<index:int,element:string,atomic_num:int,coords:array<double>,type:string>>, bonds array<struct<atom1_index:int,atom2_index:int,type:string>>"
SIDECAR = "atom_origins array<string>, donor_smiles string, acceptor_smiles string"
CURVE = "epoch int, train_loss double, validation struct<group_macro_mae:double>, improved boolean, best_epoch int, epoch_wall_seconds double"


def scan_table(spark: SparkSession, path: str, columns: Sequence[str], schema: str | StructType | None = None) -> DataFrame:
    """The asked columns of a Parquet table; only they are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).select(*columns)


def scan_ids(spark: SparkSession, path: str, columns: Sequence[str], ids: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """Two or so columns of the rows whose key is in ids. Spark picks the join by the ids' real size; the count can be checked."""
    out = spark.read.parquet(path).select(*columns).join(ids.select(key).distinct(), key, "left_semi")
    if expected is not None and (n := out.count()) != expected:
        raise ContractError(f"{n} rows read, {expected} expected")
    return out


def scan_manifest(spark: SparkSession, path: str, schema: str = MANIFEST, columns: Sequence[str] | None = None) -> DataFrame:
    """S3: CSV with a header; names are taken by the declared types, a malformed row fails."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def scan_jsonl(spark: SparkSession, path: str, schema: str, wanted: Sequence[str]) -> DataFrame:
    """Wanted fields and `malformed`, true for a line that is no JSON of the schema."""
    full = StructType([*StructType.fromDDL(schema).fields, StructField("_corrupt", StringType())])
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.select(*wanted, F.col("_corrupt").isNotNull().alias("malformed"))


def scan_curves(spark: SparkSession, path: str, schema: str = CURVE) -> DataFrame:
    """Epoch logs, one object per line; run is the file's name without its ending."""
    return spark.read.schema(schema).json(path).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)?$", 1))


def _json_records(spark: SparkSession, path: str, schema: str, packed: bool) -> DataFrame:
    """A JSON document per file, named by the file; or packed, a document per line with its name in `record`, so that one file is read by many tasks."""
    if packed:
        return spark.read.schema(f"record string, {schema}").option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("record", record_name())


def scan_structures(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(record, atoms, bonds), atoms in order of index."""
    return _json_records(spark, path, STRUCTURE, packed).select("record", F.array_sort("atoms").alias("atoms"), "bonds")


def atom_table(structures: DataFrame) -> DataFrame:
    """(record, idx, element, role, x, y, z)."""
    a = structures.select("record", F.explode("atoms").alias("a"))
    return a.select("record", F.col("a.index").alias("idx"), "a.element", F.col("a.type").alias("role"), *[F.get("a.coords", k).alias(x) for k, x in enumerate("xyz")])


def bond_table(structures: DataFrame) -> DataFrame:
    """(record, a, b, type)."""
    b = structures.select("record", F.explode("bonds").alias("b"))
    return b.select("record", F.col("b.atom1_index").alias("a"), F.col("b.atom2_index").alias("b"), F.col("b.type").alias("type"))


def scan_sidecars(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(record, idx, origin, donor_smiles, acceptor_smiles), one row per atom."""
    return _json_records(spark, path, SIDECAR, packed).select("record", F.posexplode("atom_origins").alias("idx", "origin"), "donor_smiles", "acceptor_smiles")


def scan_fixed_width(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """(record, idx, element, x, y, z) of ATOM and HETATM lines: coordinates in columns 31-54, element in 77-78, in the record's order.

    One record a file, named by the file; or, with `end` (such as a line END with its line breaks), many records a file, each closed by it and
    named by its HEADER line. Then a file is split at record ends between tasks, and no task holds a file."""
    if end is None:
        whole = spark.read.option("wholetext", True).text(path).withColumn("record", record_name())
    else:
        whole = spark.read.option("lineSep", end).text(path).withColumn("record", F.regexp_extract("value", r"(?m)^HEADER +(\S+)", 1))
    atoms = F.filter(F.split("value", r"\r?\n"), lambda v: v.startswith("ATOM") | v.startswith("HETATM"))
    at = lambda s, n: F.trim(F.substring("line", s, n))
    lines = whole.select("record", F.posexplode(atoms).alias("idx", "line"))
    return lines.select("record", "idx", at(77, 2).alias("element"), *[F.expr(f"try_cast(trim(substring(line, {31 + 8 * k}, 8)) as double)").alias(x) for k, x in enumerate("xyz")])


def record_name():
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)?$", 1)


def file_inventory(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Per relative path its state: ok, missing, empty, size_mismatch, duplicate (in the manifest) or unknown (not in it). manifest: (path, size).

    Contents are not read; names are compared by their last two parts."""
    tail = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+)$", 1)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(tail(F.col("path")).alias("path"), F.col("length").alias("found"))
    listed = manifest.groupBy("path").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "duplicate").when(F.col("found") == 0, "empty").when(F.col("found") != F.col("size"), "size_mismatch").otherwise("ok")
    return there.join(listed, "path", "full_outer").select("path", "size", "found", state.alias("state"))


def directory_sets(inventory: DataFrame) -> DataFrame:
    """Per directory of an inventory the files only found, only listed and in both, and whether the two sets are equal."""
    found, listed = F.col("found").isNotNull(), F.col("size").isNotNull()
    per = inventory.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"))
    counts = per.agg(F.count_if(found & ~listed).alias("only_found"), F.count_if(listed & ~found).alias("only_listed"), F.count_if(found & listed).alias("in_both"))
    return counts.withColumn("equal", (F.col("only_found") == 0) & (F.col("only_listed") == 0))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files; for tables use the digests of contracts instead."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))


def verify_hashes(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry entries that no file matches."""
    return registry.join(found, ["path", "sha256"], "left_anti")


def scan_run_logs(spark: SparkSession, path: str, pattern: str = r"epoch[= ](\d+).*?mae[= ]([0-9.]+).*?(?:time|sec)[= ]([0-9.]+)") -> DataFrame:
    """(run, epoch, mae, seconds) of the lines that match."""
    line = F.lower("value")
    get = lambda k: F.regexp_extract(line, pattern, k)
    return spark.read.text(path).where(line.rlike(pattern)).select(record_name().alias("run"), get(1).cast("int").alias("epoch"), get(2).cast("double").alias("mae"), get(3).cast("double").alias("seconds"))


def log_summary(rows: DataFrame) -> DataFrame:
    """Best (earliest on ties) and last epoch of each run, and its seconds."""
    return rows.groupBy("run").agg(F.min_by("epoch", F.struct("mae", "epoch")).alias("best_epoch"), F.min("mae").alias("best_mae"), F.max_by("mae", "epoch").alias("last_mae"), F.sum("seconds").alias("seconds"))


def ledger_from_nested(df: DataFrame, column: str, keys: Sequence[str] = (), value: str = "struct<n:bigint,mae:double>") -> DataFrame:
    """JSON of {split: {model: metrics}} to long rows (keys, split, model, metrics...)."""
    parsed = df.select(*keys, F.from_json(column, f"map<string,map<string,{value}>>").alias("m"))
    return parsed.select(*keys, F.explode("m").alias("split", "m2")).select(*keys, "split", F.explode("m2").alias("model", "v")).select(*keys, "split", "model", "v.*")


def union_ledgers(*ledgers: DataFrame) -> DataFrame:
    """Rows of all, missing columns null."""
    out = ledgers[0]
    for one in ledgers[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def write_edge_store(edges: DataFrame, path: str, record: str, shards: int, file_rows: int = 1 << 19) -> DataFrame:
    """Edges dealt by record and sorted inside, written once; (shard, n, digest) of what is there. A shard has as many files as it has times
    `file_rows` edges, so that a task sorts about that many whatever the size of the store; a record is in one file."""
    shard = F.pmod(F.xxhash64(record), F.lit(shards)).cast("int")
    files = max(1, math.ceil(edges.count() / shards / file_rows))
    piece = F.pmod(F.xxhash64(F.lit(1), record), F.lit(files)).cast("int")
    dealt = edges.withColumn("shard", shard).repartitionById(shards * files, F.col("shard") * files + piece)
    dealt.sortWithinPartitions("shard", record, "dst", "src").write.partitionBy("shard").mode("errorifexists").parquet(path)
    return edges.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(record, "dst", "src", "dist")).alias("digest"))


def write_once(df: DataFrame, path: str, columns: Sequence[str], formats: dict[str, str] | None = None, kind: str = "parquet") -> None:
    """Fixed column order and number formats; refuses to overwrite. Spark's committer makes the files visible at the end of the job only."""
    out = df.select(*[F.format_string(formats[c], c).alias(c) if formats and c in formats else F.col(c) for c in columns])
    writer = out.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def exported_databases(spark: SparkSession, paths: Sequence[str], key: str) -> DataFrame:
    """S16, re-aimed at Parquet exports: (first, second, overlap) of the ids of each pair of exports."""
    from groupwise.operators.contracts import overlap_counts

    out = None
    for name in paths:
        one = spark.read.parquet(name).select(F.lit(name.rstrip("/").rpartition("/")[2]).alias("set"), F.col(key).cast("string").alias("key"))
        out = one if out is None else out.union(one)
    return overlap_counts(out)
