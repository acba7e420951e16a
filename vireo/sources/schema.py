"""Schemas of references and scoring requests."""

from pyspark.sql import types as T

REFERENCE = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("label", T.StringType())])


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


REQUEST = _struct(
    id=T.StringType(),
    transaction=_struct(amount=T.FloatType(), installments=T.ShortType(), requested_at=T.TimestampType()),
    customer=_struct(avg_amount=T.FloatType(), tx_count_24h=T.IntegerType(), known_merchants=T.ArrayType(T.StringType())),
    merchant=_struct(id=T.StringType(), mcc=T.StringType(), avg_amount=T.FloatType()),
    terminal=_struct(is_online=T.BooleanType(), card_present=T.BooleanType(), km_from_home=T.FloatType()),
    last_transaction=_struct(timestamp=T.TimestampType(), km_from_current=T.FloatType()),
)
#: Leaves that a request must have; last_transaction may be absent, but is whole if present.
REQUIRED = [f"{f.name}.{g.name}" for f in REQUEST.fields[1:-1] for g in f.dataType.fields]
REQUIRED_LAST = ["last_transaction.timestamp", "last_transaction.km_from_current"]
