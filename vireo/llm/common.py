"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words everywhere in this subpackage (ASCII white space).
SPACE = r"[\x20\x09-\x0D]"
#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where none is set, a local master (tests, a laptop) takes a temporary folder of this
    machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vireo-"))
        where = sc.getCheckpointDir()
    return where


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and kept in the shared folder: later steps do not
    compute them again, and the loss of an executor loses none of them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def rounds(spark: SparkSession, name: str):
    """For loops: a function that writes rows to the shared folder and gives the table to read.
    All tables go when the loop is over, so what it returns must be cut before.

    Unlike a checkpoint, which hands the planner's estimate of its rows on, a table has its
    true size: the estimate of a join is a product, whose digits would double each round."""
    top, n = scratch(spark, name), count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{top}/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Short rows that are broadcast at most.
MOST_SENT = 500_000


def few(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df, to be broadcast if it has `most` short rows or fewer; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def words_array(text: Column) -> Column:
    """array<string>: the words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def spare(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def once(value: Column) -> Column:
    """A value that the optimizer neither copies nor moves: a filter on what is derived from it
    stays above it, instead of having the whole derivation repeated below."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 21, size=None):
    """Runs of a batch's rows with about max_bytes in one binary column, one row at least.
    size: gives what a value counts for, if not its length."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.array(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False) if size is None else [size(x) for x in col.to_pylist()], dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def blocks(batches, column: str, max_bytes: int):
    """The rows of all batches in runs of about max_bytes in one binary column."""
    held, total = [], 0
    for batch in batches:
        for part in slices(batch, column, max_bytes):
            n = int(pc.sum(pc.binary_length(part.column(part.schema.get_field_index(column)))).as_py() or 0)
            if held and total + n > max_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
            held.append(part)
            total += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def small_batches(spark: SparkSession) -> None:
    """From here on Spark sends Python a few MB at a time, not 64: long texts would else fill the
    memory of both sides. Operators gather as much as they need."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column's UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ordered(doc_id: Column) -> Column:
    """A document's place among ids: null counts as the largest."""
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))
