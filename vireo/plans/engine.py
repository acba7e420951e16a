"""The engine: references in, index out, transactions scored."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.functions.features import FEATURES, QUANTS, approved, compiled, label_code, response, score, vector, with_quants
from vireo.operators import clusters, ivf
from vireo.operators.nearest import nearest_exact, votes
from vireo.sources.requests import parse_requests


@dataclass(frozen=True)
class BuildConfig:
    """encoding: of an exact index; the inverted file has i16."""

    kind: str = "ivf"
    clusters: int = 4096
    sample: int = 50_000
    iterations: int = 25
    encoding: str = "u8"


def _number(env, name: str, default: int) -> int:
    try:
        return int(env[name])
    except (KeyError, ValueError):
        return default


def _flag(env, name: str, default: bool = False) -> bool:
    """1, true, TRUE, yes, YES and their opposites; else the default."""
    word = env.get(name, "")
    return True if word in ("1", "true", "TRUE", "yes", "YES") else False if word in ("0", "false", "FALSE", "no", "NO") else default


def build_config(env=os.environ) -> BuildConfig:
    kind = "exact" if env.get("INDEX_KIND") == "exact" else "ivf"
    return BuildConfig(kind, _number(env, "IVF_CLUSTERS", 4096), _number(env, "IVF_SAMPLE", 50_000), _number(env, "IVF_KMEANS_ITERS", 25))


def timeout_micros(env=os.environ) -> int:
    """Fixed value: 1000 microseconds, unless the setting is a greater whole number than 0."""
    given = _number(env, "KNN_TIMEOUT_US", 0)
    return given if given > 0 else 1000


def search_config(env=os.environ, records_per_micro: float | None = None) -> ivf.SearchConfig:
    """records_per_micro: what a query scans in a microsecond, to make a budget of the timeout;
    without it there is no budget."""
    probes = _number(env, "IVF_NPROBE", 1)
    budget = None if records_per_micro is None else int(timeout_micros(env) * records_per_micro)
    return ivf.SearchConfig(probes, _number(env, "IVF_FULL_NPROBE", probes), _flag(env, "IVF_REPAIR"), budget)


def prepare_references(references: DataFrame, encoding: str = "i16") -> DataFrame:
    """(ref_id, label, f0.., q0..) of references(ref_id, vector, label)."""
    flat = references.select("ref_id", label_code(F.col("label")).alias("label"), *[F.get("vector", i).cast("float").alias(f) for i, f in enumerate(FEATURES)])
    return with_quants(flat, encoding)


def prepare_transactions(transactions: DataFrame, id_col: str = "qid", encoding: str = "i16", prefix: str = "") -> DataFrame:
    """(qid, f0.., q0..) of nested transactions."""
    return with_quants(transactions.select(F.col(id_col).alias("qid"), *vector(prefix)), encoding)


class Engine:
    """An index over references, exact or inverted-file, and its scorer."""

    def __init__(self, spark: SparkSession, build: BuildConfig = BuildConfig(), search: ivf.SearchConfig = ivf.SearchConfig()):
        compiled(spark)
        self.spark, self.build_config, self.search_config = spark, build, search
        self.references: DataFrame | None = None
        self.index: ivf.Index | None = None

    @property
    def encoding(self) -> str:
        return self.build_config.encoding if self.build_config.kind == "exact" else "i16"

    def __len__(self) -> int:
        return 0 if self.references is None else self.references.count()

    def ready(self) -> bool:
        return self.references is not None and (self.build_config.kind == "exact" or self.index is not None)

    def build(self, references: DataFrame) -> "Engine":
        """references(ref_id, vector, label); ref_id is dense from 0."""
        c = self.build_config
        self.references = prepare_references(references, self.encoding).drop(*FEATURES)
        if c.kind != "exact":
            centroids = clusters.train(self.references, c.clusters, c.sample, c.iterations)
            members = clusters.assign(self.references, centroids).persist()  # every tier of a search reads them
            frame = clusters.centroid_frame(self.spark, centroids)
            self.index = ivf.Index(centroids, clusters.layout(members, frame), members)
        return self

    def save(self, path: str) -> None:
        """Members ordered by cluster, so that a probe reads few row groups; one row a cluster."""
        if self.index is None:
            self.references.write.parquet(f"{path}/references")
            return
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.index.members.repartitionByRange(n, "cid", "ref_id").sortWithinPartitions("cid", "ref_id").write.parquet(f"{path}/members")
        clusters.centroid_frame(self.spark, self.index.centroids).write.parquet(f"{path}/centroids")
        self.index.clusters.write.parquet(f"{path}/clusters")

    def load(self, path: str) -> "Engine":
        read = self.spark.read.parquet
        if self.build_config.kind == "exact":
            self.references = read(f"{path}/references")
        else:
            self.references = read(f"{path}/members")
            self.index = ivf.Index(clusters.centroid_array(read(f"{path}/centroids")), read(f"{path}/clusters"), self.references)
        return self

    def warm(self) -> int:
        """Keeps what a search reads on the executors; how many references that is."""
        self.references = self.references.persist()
        if self.index is None:
            return self.references.count()
        self.index.members = self.index.members.persist()
        return self.index.members.count()

    def vote(self, prepared: DataFrame) -> DataFrame:
        """(qid, votes, status) of transactions from prepare_transactions."""
        if self.index is None:
            return votes(prepared, nearest_exact(prepared, self.references)).withColumn("status", F.lit("ok"))
        return ivf.search(prepared, self.index, self.search_config)

    def score(self, transactions: DataFrame, id_col: str = "qid", prefix: str = "") -> DataFrame:
        """(qid, votes, status, fraud_score, approved, response) of nested transactions."""
        return answer(self.vote(prepare_transactions(transactions, id_col, self.encoding, prefix)))

    def score_bodies(self, bodies: DataFrame, id_col: str = "qid", body_col: str = "body") -> DataFrame:
        """As score, for JSON bodies; an invalid one is approved with score 0."""
        parsed = parse_requests(bodies.select(id_col, F.col(body_col).alias("body"))).persist()
        good = self.score(parsed.where("valid").select(id_col, "request.*"), id_col)
        bad = answer(parsed.where("not valid").select(F.col(id_col).alias("qid"), F.lit(0).alias("votes"), F.lit("invalid").alias("status")))
        return good.unionByName(bad)


def answer(voted: DataFrame) -> DataFrame:
    v = F.col("votes")
    return voted.select("qid", "votes", "status", score(v).alias("fraud_score"), approved(v).alias("approved"), response(v).alias("response"))
