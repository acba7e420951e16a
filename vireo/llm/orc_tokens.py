"""Token ids in ORC files: stripes with run-length integers, row indexes and Bloom filters."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vireo.llm.common import blocks, ordered, raw, small_batches
from vireo.llm.tokens import default_vocabulary, encoder


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = 0) -> DataFrame:
    """(id, first, n_tokens, tokens) of every row, in the order of its partition's rows:
    the ids of the whole text, then end_id; first counts the ids of the partition's rows
    before it. Null text counts as empty."""
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([] if end_id is None else [end_id], dtype="<u4")

    def run(batches):
        encode, before = encoder(path), 0
        for block in blocks(batches, "text", 16 << 20):
            names, row = block.column(0), 0
            for group in encode.groups(raw(block, "text")):
                ids = [np.r_[x, end] for x in group]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                ends = np.cumsum(sizes)
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([names.slice(row, len(ids)), pa.array(before + ends - sizes), pa.array(sizes), tokens], names=["id", "first", "n_tokens", "tokens"])
                before += int(ends[-1])
                row += len(ids)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, first long, n_tokens long, tokens array<int>")


def write_token_orc(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = 0, stripe_bytes: int = 16 << 20, row_stride: int = 1000) -> None:
    """Writes every document's ids to ORC files under path, in ascending id order: the files
    hold disjoint ranges of ids, and rows ascend in each (a null id counts as the largest;
    rows of one id are ordered by text). Integers are run-length encoded; a row index every
    row_stride rows and a Bloom filter on the id let readers skip stripes and row groups.

    An empty table writes files without rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, ordered(F.col(id_col))).sortWithinPartitions(ordered(F.col(id_col)), "text_")
    encoded = encode_documents(rows, id_col, "text_", vocabulary, end_id)
    (
        encoded.write.option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "id")
        .option("orc.bloom.filter.fpp", "0.01")
        .mode("errorifexists")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens) of every document in the files: start counts the ids of
    all documents before it, over all files. Filters on id reach the stripes."""
    read = spark.read.orc(path)
    rows = read.withColumn("file", F.col("_metadata.file_path"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"), F.min(ordered(F.col("id"))).alias("least"))
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    if len(read.inputFiles()) <= 50_000:  # a path and a number for each: a few MB
        base = F.broadcast(base)
    return rows.join(base, "file").select("id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "tokens")


def digest(tokens: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): CRC-32 of the ids as little-endian unsigned 32-bit."""
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("id", "start", "n_tokens", "tokens").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
