"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go; of each group of near copies (Jaccard 0.8 or more of five-word shingles, over chains) the one with the smallest
doc_id stays; documents that hold a benchmark's words go; personal data is replaced by its kind; what is left is packed into
batches. All but the last stage return the columns of documents. Rows are judged each by itself, so null and repeated ids are kept.
What is beside doc_id and text travels through a stage as one struct, so no column of a document can clash with those that a stage makes.
No stage fits SQL as a whole (learned scores, connected components), so ORACLE_SQL is None; tests/llm compares with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.llm.common import keep
from groupwise.llm.decontaminate import decontaminate
from groupwise.llm.near_copies import one_of_each
from groupwise.llm.packing import pack
from groupwise.llm.pii import find_pii, redact
from groupwise.llm.toxicity import toxicity
from groupwise.storage import drop_tables, mark


def bare(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *others).alias("rest"))


def whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is predicted toxic and holds a significant passage goes; nothing holds one if no labels of both classes were there to learn from."""
    scored = toxicity(spark, bare(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return whole(scored.where("predicted = 0 or n_passages = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return whole(one_of_each(bare(docs)), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row goes or stays by its own text: decisions come back by a 128-bit hash of it (a null text has one too), not by doc_id."""
    text = F.col("text").cast("string")
    key = F.struct(F.xxhash64(text.isNull(), text).alias("h1"), F.xxhash64(F.lit(1), text.isNull(), text).alias("h2"))
    keyed = bare(docs).withColumn("text_key", key)
    clean = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="text_key").where("n_hit = 0").select(F.col("id").alias("text_key")).distinct()
    return whole(keyed.join(clean.hint("shuffle_hash"), "text_key", "left_semi"), docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = whole(redact(find_pii(bare(docs))), docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("packing", pack_batches),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last one. What a stage wrote for itself is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = mark()
        docs = keep(stage(spark, docs, sf_dir))
        drop_tables(spark, before, spare=1)
    return docs
