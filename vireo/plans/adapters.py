"""Transactions and vectors made of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vireo.functions.features import FEATURES, MCC_RISK, compiled

#: The categories that merchants have, by their number modulo eleven.
CODES = [*sorted(MCC_RISK), "0000"]
#: Merchants whose averages go to all executors; more are joined by a shuffle.
_MOST_SHOPS = 100_000
_DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(value: Column) -> Column:
    return F.floor(value * 100 + 0.5).cast("long")


def _merchant(props: Column) -> Column:
    """$.k of JSON text. Text of k alone, as the tables have it, is cut: a JSON parser takes
    several times as long as all other work on an event."""
    cut = F.substring(props, F.lit(7), F.length(props) - 7)
    return F.when(props.rlike(r'\A\{"k": (0|[1-9][0-9]{0,8})\}\z'), cut.cast("int")).otherwise(F.get_json_object(props, "$.k").cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with what their user and merchant add: averages (whole cents summed, divided once),
    the merchants a user buys from, the event before, the events of 24 hours. A user's rows meet
    once; few merchants are sent to them, else every row would go to its merchant."""
    e = table(spark, sf_dir, "events").withColumn("k", _merchant(F.col("props"))).withColumn("at", F.col("ts").cast("timestamp"))
    shops = e.groupBy("k").agg((F.sum(_cents(F.col("value"))).cast("double") / F.count("*") / 100).cast("float").alias("shop_avg"))
    few = shops.limit(_MOST_SHOPS + 1).toArrow()
    shops = F.broadcast(spark.createDataFrame(few, shops.schema)) if few.num_rows <= _MOST_SHOPS else shops
    own = Window.partitionBy("user_id")
    last = own.orderBy("us", "event_id")
    upto = lambda end: F.count("*").over(own.orderBy("us").rangeBetween(Window.unboundedPreceding, end))
    rows = e.where(F.col("user_id").isNotNull()).withColumn("us", F.unix_micros("at"))
    rows = rows.withColumns({"last_at": F.lag("at").over(last), "last_value": F.lag("value").over(last)})
    # a difference of two counts that only grow: a frame of 24 hours is counted anew for every row
    rows = rows.withColumn("day", (upto(0) - F.when(F.col("us").isNull(), 0).otherwise(upto(-_DAY - 1))).cast("int"))
    bought = F.when(F.col("event_type") == "purchase", F.col("k"))
    rows = rows.withColumns({
        "avg_amount": (F.sum(_cents(F.col("value"))).over(own).cast("double") / F.count("*").over(own) / 100).cast("float"),
        "known": F.collect_set(bought).over(own),
    })
    return rows.join(shops, "k")


def _leaves() -> dict[str, Column]:
    """The leaves of a transaction, by path, of the rows of _events; last_transaction is null
    where there is none."""
    name = lambda k: F.concat(F.lit("M"), k)
    is_ = lambda *kinds: F.col("event_type").isin(*kinds)
    f = lambda c: c.cast("float")
    return {
        "qid": F.col("event_id"),
        "id": F.concat(F.lit("tx-"), "event_id"),
        "transaction.amount": f(F.col("value")),
        "transaction.installments": (F.col("k") % 13).cast("short"),
        "transaction.requested_at": F.col("at"),
        "customer.avg_amount": F.col("avg_amount"),
        "customer.tx_count_24h": F.col("day"),
        "customer.known_merchants": F.sort_array(F.transform("known", name)),
        "customer.known_numbers": F.col("known"),
        "merchant.id": name("k"),
        "merchant.number": F.col("k"),
        "merchant.mcc": F.get(F.array(*[F.lit(c) for c in CODES]), F.col("k") % len(CODES)),
        "merchant.avg_amount": F.col("shop_avg"),
        "terminal.is_online": is_("click", "view"),
        "terminal.card_present": is_("purchase", "signup"),
        "terminal.km_from_home": f(F.col("k") * 10),
        "last_transaction": F.col("last_at"),
        "last_transaction.timestamp": F.col("last_at"),
        "last_transaction.km_from_current": f(F.abs(F.col("value") - F.col("last_value"))),
        "label": F.when(is_("error"), "fraud").otherwise("legit"),
    }


def nested(leaf: Callable[[str], Column]) -> list[Column]:
    """The columns of a request, of the leaves of a transaction."""
    held = lambda top, *names: F.struct(*[leaf(f"{top}.{n}").alias(n) for n in names])
    return [
        leaf("id").alias("id"),
        held("transaction", "amount", "installments", "requested_at").alias("transaction"),
        held("customer", "avg_amount", "tx_count_24h", "known_merchants").alias("customer"),
        held("merchant", "id", "mcc", "avg_amount").alias("merchant"),
        held("terminal", "is_online", "card_present", "km_from_home").alias("terminal"),
        F.when(leaf("last_transaction").isNotNull(), held("last_transaction", "timestamp", "km_from_current")).alias("last_transaction"),
    ]


def numbered(leaf: Callable[[str], Column]) -> Callable[[str], Column]:
    """The leaves with merchants as numbers, which are equal if their names are."""
    other = {"merchant.id": "merchant.number", "customer.known_merchants": "customer.known_numbers"}
    return lambda name: leaf(other.get(name, name))


def _request(leaf: Callable[[str], Column]) -> list[Column]:
    return [leaf("qid").alias("qid"), *nested(leaf), leaf("label").alias("label")]


def transactions(spark: SparkSession, sf_dir: str, columns: Callable[[Callable[[str], Column]], list[Column]] = _request) -> DataFrame:
    """events as nested transactions, with qid and a label: a user is a customer, props.k a
    merchant, an error a fraud. `columns` makes other columns of the leaves, without structs."""
    compiled(spark)
    return _events(spark, sf_dir).select(*columns(_leaves().__getitem__))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, vector, label): the first 14 numbers of each embedding, moved into [0, 1]."""
    rows = table(spark, sf_dir, "embeddings")
    scaled = F.transform(F.slice("embedding", 1, len(FEATURES)), lambda x: (((x + F.lit(1.0).cast("float")).cast("float")) / F.lit(2.0)).cast("float"))
    return rows.select(F.col("vec_id").alias("ref_id"), scaled.alias("vector"), F.when(F.col("label") >= 5, "fraud").otherwise("legit").alias("label"))
