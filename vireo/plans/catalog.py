"""The registered queries of the scoring engine, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions import features as X
from vireo.functions.features import FEATURES, QUANTS
from vireo.operators import clusters, ivf, report
from vireo.operators.nearest import ROWS, nearest_exact, votes
from vireo.plans import oracle as O
from vireo.plans.adapters import nested, numbered, table, transactions, vectors
from vireo.plans.engine import BuildConfig, Engine, answer, prepare_references
from vireo.sources.requests import parse_requests, request_text

#: Clusters of the registered index queries; the first references are their seeds.
CLUSTERS = 32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _points(spark, sf_dir, encoding: str = "i16", **more: Callable) -> DataFrame:
    """Every transaction as a point, with its label code and more columns by name, of its leaves."""
    made = lambda leaf: [leaf("qid").alias("qid"), X.label_code(leaf("label")).alias("label"), *X.vector(numbered(leaf)), *[c(leaf).alias(name) for name, c in more.items()]]
    return X.with_quants(transactions(spark, sf_dir, made), encoding)


def _asked(points: DataFrame) -> DataFrame:
    """The stated query set: every point whose id is divisible by 20."""
    return points.where(F.col("qid") % 20 == 0)


def _as_refs(points: DataFrame) -> DataFrame:
    return points.withColumnRenamed("qid", "ref_id").drop(*FEATURES)


def _index(points: DataFrame, together: bool = False) -> ivf.Index:
    """One assignment and one update from the first references, then the final assignment. Members
    of a cluster meet in one task if `together`: a query is searched there only, not in every task."""
    refs = _as_refs(points)
    spark = points.sparkSession
    first = refs.orderBy("ref_id").limit(CLUSTERS).toPandas()
    seeds = clusters.dequantized(first[QUANTS].to_numpy(np.int64))
    frame = clusters.centroid_frame(spark, seeds)
    centroids = clusters.centroid_array(clusters.update(clusters.assign(refs, seeds), frame))
    members = clusters.assign(refs, centroids)
    members = (members.repartition(CLUSTERS, "cid") if together else members).persist()  # every tier of a search reads them
    return ivf.Index(centroids, clusters.layout(members, clusters.centroid_frame(spark, centroids)), members)


def _seeds(spark, refs: DataFrame) -> np.ndarray:
    return clusters.dequantized(refs.orderBy("ref_id").limit(CLUSTERS).toPandas()[QUANTS].to_numpy(np.int64))


def _vector_points(spark, sf_dir, encoding: str = "i16") -> DataFrame:
    return prepare_references(vectors(spark, sf_dir), encoding)


def _double(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


@query(O.CLAMP)
def clamp01_nan_inf(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    case = F.col("event_id") % 6
    x = F.when(case == 0, F.lit(float("nan"))).when(case == 1, F.lit(float("inf"))).when(case == 2, F.lit(float("-inf"))).when(case == 3, -F.col("value")).otherwise(F.col("value") / 100)
    e = e.withColumn("x", x.cast("float"))
    return e.select("event_id", X.clamp01(F.col("x")).cast("double").alias("clamped"), X.floored(F.col("x")).cast("double").alias("floored"))


@query(O.MCC)
def mcc_risk_lookup(spark, sf_dir):
    t = transactions(spark, sf_dir)
    return t.select("qid", F.col("merchant.mcc").alias("mcc"), X.mcc_risk(F.col("merchant.mcc")).cast("double").alias("risk"))


@query(O.TEMPORAL)
def temporal_features(spark, sf_dir):
    t = transactions(spark, sf_dir)
    at, last = F.col("transaction.requested_at"), F.col("last_transaction.timestamp")
    return t.select("qid", F.hour(at).alias("hour"), F.weekday(at).alias("weekday"), X.whole_seconds(last, at).cast("long").alias("seconds"))


@query(O.UNKNOWN)
def unknown_merchant(spark, sf_dir):
    t = transactions(spark, sf_dir)
    return t.select("qid", X.unknown_merchant(F.col("merchant.id"), F.col("customer.known_merchants")).alias("unknown"))


@query(O.SENTINEL)
def last_tx_sentinel(spark, sf_dir):
    return transactions(spark, sf_dir).select("qid", *X.vector()).select("qid", *_double("f5", "f6"))


@query(O.VECTORIZE)
def vectorize(spark, sf_dir):
    return transactions(spark, sf_dir).select("qid", *X.vector()).select("qid", *_double(*FEATURES))


@query(O.quants("i16"))
def quantize_i16(spark, sf_dir):
    return _points(spark, sf_dir).select("qid", *QUANTS)


@query(O.quants("u8"))
def quantize_u8(spark, sf_dir):
    return _points(spark, sf_dir, "u8").select("qid", *QUANTS)


@query(O.DEQUANTIZE)
def dequantize(spark, sf_dir):
    return _points(spark, sf_dir).select("qid", *[X.dequantize_i16(F.col(q)).cast("double").alias(f) for q, f in zip(QUANTS, FEATURES)])


@query(O.vector_quants("i16"))
def quantize_vectors_i16(spark, sf_dir):
    return _vector_points(spark, sf_dir).select("ref_id", *QUANTS)


@query(O.vector_quants("u8"))
def quantize_vectors_u8(spark, sf_dir):
    return _vector_points(spark, sf_dir, "u8").select("ref_id", *QUANTS)


@query(O.LABELS)
def label_encode(spark, sf_dir):
    return transactions(spark, sf_dir).select("qid", X.label_code(F.col("label")).alias("label"))


def _against_first(points: DataFrame) -> DataFrame:
    one = points.orderBy("ref_id").limit(1).select(*[F.col(c).alias(f"o_{c}") for c in (*QUANTS, *FEATURES)])
    return points.crossJoin(F.broadcast(one))  # one row


@query(O.distance("i16"))
def distance_i16(spark, sf_dir):
    p = _against_first(_vector_points(spark, sf_dir))
    return p.select("ref_id", X.squared_distance([F.col(q) for q in QUANTS], [F.col(f"o_{q}") for q in QUANTS]).alias("dist"))


@query(O.distance("u8"))
def distance_u8(spark, sf_dir):
    p = _against_first(_vector_points(spark, sf_dir, "u8"))
    return p.select("ref_id", X.squared_distance([F.col(q) for q in QUANTS], [F.col(f"o_{q}") for q in QUANTS]).alias("dist"))


@query(O.distance("f32"))
def distance_centroid(spark, sf_dir):
    p = _against_first(_vector_points(spark, sf_dir))
    return p.select("ref_id", X.squared_distance_f32([F.col(f) for f in FEATURES], [F.col(f"o_{f}") for f in FEATURES]).cast("double").alias("dist"))


def _whole(points: DataFrame) -> DataFrame:
    """Kept on the executors, without features, which an exact search does not read, and with all
    numbers of a point in four columns, which are quicker to keep uncompressed and take about as much room."""
    spark, name = points.sparkSession, "spark.sql.inMemoryColumnarStorage.compressed"
    others = [c for c in points.columns if c not in (*FEATURES, *QUANTS)]
    points = points.select(*others, *[F.expr(f"cast({q} as smallint) as {q}") for q in QUANTS])
    words, bits = X.packed(points)
    held, before = points.select(*others, *words), spark.conf.get(name)
    spark.conf.set(name, "false")  # read when persist() is called
    try:
        return held.persist().select(*others, *X.unpacked(bits))
    finally:
        spark.conf.set(name, before)


def _exact(points: DataFrame) -> DataFrame:
    return nearest_exact(_asked(points), _as_refs(points))


@query(O.knn("i16"))
def knn_exact_i16(spark, sf_dir):
    return _exact(_whole(_points(spark, sf_dir))).select("qid", "place", "ref_id", "dist", "label")


@query(O.knn("u8"))
def knn_exact_u8(spark, sf_dir):
    return _exact(_whole(_points(spark, sf_dir, "u8"))).select("qid", "place", "ref_id", "dist", "label")


@query(O.knn_vectors())
def knn_exact_vectors(spark, sf_dir):
    p = _vector_points(spark, sf_dir).withColumnRenamed("ref_id", "qid").persist()
    return _exact(p).select("qid", "place", "ref_id", "dist", "label")


def _responses(voted: DataFrame) -> DataFrame:
    return answer(voted).select("qid", "votes", "approved", "response")


@query(O.SCORES)
def score_response(spark, sf_dir):
    p = _whole(_points(spark, sf_dir))
    return _responses(votes(_asked(p), _exact(p)).withColumn("status", F.lit("ok")))


@query(O.ASSIGN)
def kmeans_assign(spark, sf_dir):
    refs = _as_refs(_points(spark, sf_dir)).persist()
    return clusters.assign(refs, _seeds(spark, refs)).select("ref_id", "cid")


@query(O.UPDATE)
def kmeans_update(spark, sf_dir):
    refs = _as_refs(_points(spark, sf_dir)).persist()
    seeds = _seeds(spark, refs)
    new = clusters.update(clusters.assign(refs, seeds), clusters.centroid_frame(spark, seeds))
    return new.select("cid", *_double(*clusters.CENTROIDS))


@query(O.CHANGED)
def kmeans_changed(spark, sf_dir):
    refs = _as_refs(_points(spark, sf_dir)).persist()
    seeds = _seeds(spark, refs)
    first = clusters.assign(refs, seeds).persist()
    new = clusters.centroid_array(clusters.update(first, clusters.centroid_frame(spark, seeds)))
    return clusters.changed(first, clusters.assign(refs, new))


@query(O.COUNTS)
def cluster_counts(spark, sf_dir):
    return _index(_points(spark, sf_dir).persist()).clusters.select("cid", "n")


@query(O.OFFSETS)
def cluster_offsets(spark, sf_dir):
    return _index(_points(spark, sf_dir).persist()).clusters.select("cid", "offset")


@query(O.BOXES)
def cluster_bbox(spark, sf_dir):
    return _index(_points(spark, sf_dir).persist()).clusters.select("cid", *clusters.LOW, *clusters.HIGH)


@query(O.LAYOUT)
def cluster_layout(spark, sf_dir):
    return clusters.positions(_index(_points(spark, sf_dir).persist()).members)


@query(O.PROBES)
def probe_ranking(spark, sf_dir):
    p = _points(spark, sf_dir).persist()
    return clusters.rank_probes(_asked(p), _index(p).centroids, 8)


def _searched(spark, sf_dir, **config) -> DataFrame:
    p = _points(spark, sf_dir).persist()
    return ivf.search(_asked(p), _index(p), ivf.SearchConfig(**config))


@query(O.ivf(2, 2))
def ivf_fast(spark, sf_dir):
    return _searched(spark, sf_dir, probes=2).select("qid", "votes")


@query(O.ivf(2, 8))
def ivf_two_tier(spark, sf_dir):
    return _searched(spark, sf_dir, probes=2, full_probes=8).select("qid", "votes")


@query(O.ivf(2, 8, repair=True))
def ivf_repair(spark, sf_dir):
    return _searched(spark, sf_dir, probes=2, full_probes=8, repair=True).select("qid", "votes")


@query(O.ivf(2, 8, budget=1500))
def ivf_budgeted(spark, sf_dir):
    return _searched(spark, sf_dir, probes=2, full_probes=8, budget=1500)


def _distinct(points: DataFrame) -> DataFrame:
    """Points of the same features, which every search answers alike, as one: the smallest id, and
    how many there are."""
    rows = points.groupBy(*FEATURES).agg(F.min("qid").alias("qid"), F.count("*").alias("copies"))
    return X.with_quants(rows)


@query(O.compare(2))
def compare_scores(spark, sf_dir):
    """Every point is asked, of both indexes."""
    p = _points(spark, sf_dir).persist()
    q = _distinct(p).persist()
    block = min(ROWS, max(1024, p.count() // (2 * spark.sparkContext.defaultParallelism)))  # all cores search, few as the rows may be
    exact = votes(q, nearest_exact(q, _as_refs(p), block=block))
    return report.compare_scores(exact, ivf.search(q, _index(p, together=True), ivf.SearchConfig(probes=2)), q)


@query(O.LATENCY)
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return report.latency_report(e.select(F.floor(F.col("value") * 1_000_000).cast("long").alias("ns")))


_REQUEST = ["id", "transaction", "customer", "merchant", "terminal", "last_transaction"]


def _broken(text: Column, every: int = 1) -> Column:
    """Bodies of which some are broken, by id over `every`."""
    case = F.floor(F.col("qid") / every) % 10
    return (
        F.when(case == 1, F.concat(text, F.lit(" x")))
        .when(case == 2, F.replace(text, F.lit('"installments"'), F.lit('"instalments"')))
        .when(case == 3, F.replace(text, F.lit('{"id":"'), F.lit('{"id":7,"ids":"')))
        .when(case == 4, F.replace(text, F.lit('{"id":"'), F.lit('{"id":"a","id":"')))
        .when(case == 5, F.lit("not json"))
        .when(case == 6, F.replace(text, F.lit('"merchant":{'), F.lit('"extra":[1],"merchant":{')))
        .otherwise(text)
    )


def bodies(spark, sf_dir, every: int = 1) -> DataFrame:
    """Transactions whose id `every` divides, as JSON text."""
    return transactions(spark, sf_dir).where(F.col("qid") % every == 0).select("qid", _broken(request_text(_REQUEST), every).alias("body"))


@query(O.PAYLOADS)
def payload_parse(spark, sf_dir):
    return parse_requests(bodies(spark, sf_dir)).select("qid", "valid", F.col("request.merchant.mcc").alias("mcc"))


@query()
def kmeanspp_init(spark, sf_dir):
    refs = _vector_points(spark, sf_dir).drop(*FEATURES)
    return clusters.centroid_frame(spark, clusters.train(refs, 16, iterations=1))


@query(O.BODIES)
def score_bodies(spark, sf_dir):
    """Valid and broken bodies through the engine: a broken one is approved with score 0."""
    engine = Engine(spark, BuildConfig("exact", encoding="i16"))
    # references and bodies from one pass over the events
    p = _points(spark, sf_dir, body=lambda leaf: F.when(leaf("qid") % 20 == 0, request_text(nested(leaf))))
    p = _whole(p.withColumn("body", _broken(F.col("body"), 20)))
    engine.references = _as_refs(p).select("ref_id", "label", *QUANTS)
    return engine.score_bodies(_asked(p).select("qid", "body")).select("qid", "votes", "status", "approved", "response")


@query(O.BENCH)
def bench_summary(spark, sf_dir):
    p = _whole(_points(spark, sf_dir))
    voted = votes(_asked(p), _exact(p))
    return report.bench_summary(voted.select(F.expr("qid div 20").alias("position"), "votes"), 1234)


@query(O.MEMBERS)
def ivf_roundtrip(spark, sf_dir):
    """Members of an inverted file, written and read again: ref_id is the place in the file."""
    from vireo.sources.binary import open_index, write_ivf
    from vireo.sources.shared import scratch

    path = write_ivf(_index(_points(spark, sf_dir).persist()), scratch(spark, "ivf-index"))
    return open_index(spark, path).members.select("ref_id", "cid", "label", *QUANTS)


@query(O.ROUNDTRIP)
def index_roundtrip(spark, sf_dir):
    from vireo.sources.binary import open_index, write_exact
    from vireo.sources.shared import scratch

    refs = _vector_points(spark, sf_dir, "u8").select("ref_id", "label", *QUANTS)
    return open_index(spark, write_exact(refs, scratch(spark, "exact-index")))


@query(O.SCORES)
def stream_score(spark, sf_dir):
    """The registered scores, from a stream of request bodies."""
    from vireo.sources.shared import scratch
    from vireo.streaming.score import score_stream

    p = _points(spark, sf_dir).persist()
    engine = Engine(spark, BuildConfig("exact", encoding="i16"))
    engine.references = _as_refs(p).select("ref_id", "label", *QUANTS)
    t = transactions(spark, sf_dir).where(F.col("qid") % 20 == 0)
    inbox, out, log = (scratch(spark, f"stream-{x}") for x in ("in", "out", "log"))
    t.select("qid", request_text(_REQUEST).alias("body")).write.parquet(inbox)

    source = spark.readStream.schema("qid long, body string").option("maxFilesPerTrigger", 100).parquet(inbox)
    score_stream(engine, source, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), log).awaitTermination()
    return spark.read.parquet(out).select("qid", "votes", "approved", "response")
