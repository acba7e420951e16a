"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage
returns to the shared folder and gives it to the next. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm import mixing, near, packing, pii, quality
from vireo.llm.common import cut, few, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _larger_files(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a shuffle dealt out, in a third as many files."""
    return rows.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that fail, or lose too much text, go."""
    kept = quality.line_first(docs).where("q_kept")
    return kept.select("doc_id", F.col("q_clean_text").alias("text"), "lang", "source", F.length("q_clean_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with
    the smallest id stays; of rows with that id, if it has several in its group, the one with the least text hash."""
    id_ = F.coalesce("doc_id", F.lit(2**63 - 1))
    rows = docs.withColumn("key", F.struct(id_.alias("id"), F.xxhash64("doc_id", "text", "lang", "source").alias("at")))
    found = near.near_copies(rows.select("key", "text"), id_col="key")
    groups = cut(found.groupBy("key").agg(F.min("component_id").alias("first"), F.count("*").alias("n")))
    gone = groups.where("key <> first").select("key")
    many = groups.where("key = first and n > 1").select("key")  # rows that are equal in all columns
    if many.isEmpty():
        return rows.join(few(gone), "key", "left_anti").select(*COLUMNS)
    kept = rows.join(few(gone.unionByName(many)), "key", "left_anti")
    return kept.unionByName(rows.join(few(many), "key", "left_semi").dropDuplicates(["key"])).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    found = pii.find_personal_data(docs)
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(pii.redacted(F.col("text"), F.col("p_spans")))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return _larger_files(spark, mixing.mixed(docs).select(*COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048, with a checksum of each piece."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: XXH64 and byte-pair encoding have no form in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
