"""Scoring requests: strict parsing of JSON bodies, and payload files."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.sources.schema import REQUEST, REQUIRED, REQUIRED_LAST

#: Fixed value: RFC 3339 date and time with an offset, to microseconds.
RFC3339 = r"\A(?!0000)\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,6})?([Zz]|[+-]\d{2}:\d{2})\z"


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def _fits(value, kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and all(
            (f.name in value and _fits(value[f.name], f.dataType)) or (f.name == "last_transaction" and value.get(f.name) is None) for f in kind.fields
        )
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(_fits(x, kind.elementType) for x in value)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.TimestampType):
        try:
            return isinstance(value, str) and datetime.fromisoformat(value.upper()).tzinfo is not None
        except ValueError:
            return False
    if isinstance(kind, T.FloatType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    top = 255 if isinstance(kind, T.ShortType) else 65_535
    return isinstance(value, int) and not isinstance(value, bool) and 0 <= value <= top


def _refuse(_):
    raise ValueError("not a JSON number")


def _texts(kind: T.DataType) -> T.DataType:
    """The type with texts for times."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _texts(f.dataType)) for f in kind.fields])
    return T.StringType() if isinstance(kind, T.TimestampType) else kind


def _time(text: Column) -> Column:
    """Null for what is no time with an offset."""
    return F.when(text.rlike(RFC3339), F.upper(text).try_cast("timestamp"))


@F.pandas_udf(T.BooleanType())
def _strict(body: pd.Series) -> pd.Series:
    def ok(text) -> bool:
        try:
            return _fits(json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse), REQUEST)
        except (ValueError, TypeError, RecursionError):
            return False

    return body.map(ok).astype(bool)


def request_text(columns: list) -> Column:
    """A request as JSON text, of its columns; nulls are left out."""
    return F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def parse_requests(bodies: DataFrame, body_col: str = "body", strict: bool = True) -> DataFrame:
    """bodies with request (struct) and valid. Built-in parsing checks types, required leaves,
    ranges and RFC 3339 times. strict also refuses what it lets pass: numbers for strings,
    repeated keys, text after the object. A body that is letter for letter what request_text makes
    of it has none of these; Python judges the others. An invalid body has a null request."""
    parsed = F.from_json(F.col(body_col), T.StructType([*_texts(REQUEST).fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "false"})
    p = lambda path: F.col(f"p_.{path}")
    times = {"at_": _time(p("transaction.requested_at")), "last_": _time(p("last_transaction.timestamp"))}
    out = bodies.withColumn("p_", parsed).withColumns(times)
    ok: Column = F.col("p_").isNotNull() & p("_corrupt").isNull() & p("id").isNotNull() & F.col("at_").isNotNull()
    for leaf in REQUIRED:
        ok &= p(leaf).isNotNull()
    ok &= p("transaction.installments").between(0, 255) & p("customer.tx_count_24h").between(0, 65_535)
    ok &= ~F.exists(p("customer.known_merchants"), lambda m: m.isNull())
    both = p("last_transaction").isNull() | (p(REQUIRED_LAST[1]).isNotNull() & F.col("last_").isNotNull())
    out = out.withColumn("valid", F.coalesce(ok & both, F.lit(False)))
    if strict:
        body = F.col(body_col)
        same = F.coalesce(body == request_text([p(f.name).alias(f.name) for f in REQUEST.fields]), F.lit(False))
        out = out.withColumn("same_", F.col("valid") & same)
        judged = _strict(F.when(F.col("valid") & ~F.col("same_"), body))
        out = out.withColumn("valid", F.col("same_") | judged).drop("same_")
    at = lambda top, name, time: F.when(p(top).isNotNull(), p(top).withField(name, F.col(time)))
    made = {"transaction": at("transaction", "requested_at", "at_"), "last_transaction": at("last_transaction", "timestamp", "last_")}
    request = F.struct(*[made.get(f.name, p(f.name)).alias(f.name) for f in REQUEST.fields])
    return out.withColumn("request", F.when(F.col("valid"), request)).drop("p_", "at_", "last_")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """A file with a JSON array of requests, each with its position; a bad element ends the query."""
    rows = spark.read.schema(REQUEST).option("mode", "FAILFAST").json(path, multiLine=True)
    return rows.withColumn("position", F.monotonically_increasing_id())


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, vector, label) of a JSON array of references, plain or .gz; ref_id is the place
    in the file. Such a file is one task: write the result as Parquet once."""
    from vireo.sources.schema import REFERENCE

    rows = spark.read.schema(REFERENCE).option("mode", "FAILFAST").json(path, multiLine=True)
    checked = rows.withColumn("vector", F.when(F.size("vector") == 14, F.col("vector")).otherwise(F.raise_error(F.lit("a reference has 14 numbers")).cast("array<float>")))
    return checked.select(F.monotonically_increasing_id().alias("ref_id"), "vector", "label")
