"""Training and layout of the inverted-file index: k-means over quantised references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vireo.functions.features import DIMS, FEATURES, I16_SCALE, QUANTS

CENTROIDS = [f"c{i}" for i in range(DIMS)]
LOW, HIGH = [f"lo{i}" for i in range(DIMS)], [f"hi{i}" for i in range(DIMS)]
#: Most clusters of an index: what is broadcast stays below a MB.
MOST_CLUSTERS = 4096
_MASK = (1 << 64) - 1


class Lcg:
    """A 64-bit linear congruential generator."""

    #: Multiplier and increment.
    A, C = 6364136223846793005, 1442695040888963407

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = (self.state * self.A + self.C) & _MASK
        return self.state

    def below(self, n: int) -> int:
        return (self.next() >> 33) % n

    def unit(self) -> float:
        return (self.next() >> 11) / float(1 << 53)


def dequantized(q: np.ndarray) -> np.ndarray:
    return np.where(q < 0, np.float32(-1), q.astype(np.float32) / np.float32(I16_SCALE)).astype(np.float32)


def sequential_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances in single precision, summed from the first dimension on, so that equal
    inputs give equal clusters wherever they are computed."""
    out = np.zeros((len(x), len(c)), dtype=np.float32)
    for i in range(x.shape[1]):
        d = x[:, i, None] - c[None, :, i]
        out += d * d
    return out


def draw_sample(n: int, size: int, rng: Lcg) -> list[int]:
    """Places of a sample: all if it has room for all, else drawn with replacement."""
    return list(range(n)) if size >= n else [rng.below(n) for _ in range(size)]


def seed_centroids(points: np.ndarray, k: int, rng: Lcg) -> np.ndarray:
    """k-means++ over a bounded sample in the driver's memory: each further centroid is drawn
    by squared distance to the nearest so far, or uniformly if all distances are 0."""
    chosen = [points[rng.below(len(points))]]
    near = sequential_distances(points, chosen[0][None])[:, 0].astype(np.float64)
    while len(chosen) < k:
        total = float(near.sum())
        at = rng.below(len(points)) if total <= 0 else min(int(np.searchsorted(np.cumsum(near), rng.unit() * total, side="left")), len(points) - 1)
        chosen.append(points[at])
        near = np.minimum(near, sequential_distances(points, points[at][None])[:, 0])
    return np.stack(chosen)


def centroid_frame(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(centroids.astype(np.float64), columns=CENTROIDS).assign(cid=range(len(centroids))), ", ".join(f"{c} double" for c in CENTROIDS) + ", cid int").select("cid", *[F.col(c).cast("float").alias(c) for c in CENTROIDS])


def centroid_array(centroids: DataFrame) -> np.ndarray:
    rows = centroids.select("cid", *CENTROIDS).orderBy("cid").limit(MOST_CLUSTERS + 1).toPandas()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"an index has at most {MOST_CLUSTERS} clusters")
    return rows[CENTROIDS].to_numpy(np.float32)


def assign(references: DataFrame, centroids: np.ndarray) -> DataFrame:
    """references with cid, their nearest centroid; ties go to the smaller cid."""
    spark = references.sparkSession
    shared = spark.sparkContext.broadcast(centroids.astype(np.float32))
    old = [f for f in references.schema.fields if f.name != "cid"]

    def run(batches):
        for pdf in batches:
            x = dequantized(pdf[QUANTS].to_numpy(np.int64))
            cid = np.concatenate([np.argmin(sequential_distances(x[i : i + 2048], shared.value), axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.empty(0, np.int64)
            yield pdf.assign(cid=cid.astype(np.int32))

    from pyspark.sql import types as T

    return references.select(*[f.name for f in old]).mapInPandas(run, T.StructType([*old, T.StructField("cid", T.IntegerType())]))


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """New centroids: the mean of each cluster's members; an empty one keeps its place. Integers
    are summed and divided once, so the result does not depend on partitions."""
    sums = assigned.groupBy("cid").agg(F.count("*").alias("n"), *[F.sum(F.col(q).cast("long")).alias(q) for q in QUANTS])
    mean = lambda q: (F.col(q).cast("double") / F.col("n") / F.lit(float(I16_SCALE))).cast("float")
    return centroids.join(F.broadcast(sums), "cid", "left").select("cid", *[F.coalesce(mean(q), F.col(c)).alias(c) for q, c in zip(QUANTS, CENTROIDS)])


def train(references: DataFrame, k: int, sample: int = 50_000, iterations: int = 25, seed: int = 0xDEADBEEFCAFEBABE, first: np.ndarray | None = None) -> np.ndarray:
    """Centroids of the references: seeded on a bounded sample, then refined over all of them
    until fewer than one in a thousand moves, or so many iterations. References need q0 to
    q13 and a dense ref_id from 0; none give one centroid at the origin."""
    spark = references.sparkSession
    references = references.select("ref_id", *QUANTS)
    n = references.count()
    if n == 0:
        return np.zeros((1, DIMS), np.float32)
    k = max(1, min(k, n, MOST_CLUSTERS))
    if first is None:
        rng = Lcg(seed)
        places = draw_sample(n, max(1, min(sample, n)), rng)
        drawn = spark.createDataFrame(pd.DataFrame({"ref_id": sorted(set(places))}), "ref_id long")
        rows = references.join(F.broadcast(drawn), "ref_id").toPandas().set_index("ref_id")
        if len(rows) < len(set(places)):
            raise ValueError("ref_id is not dense from 0")
        points = dequantized(rows.loc[places, QUANTS].to_numpy(np.int64))
        first = seed_centroids(points, k, rng)
    centroids, before = first.astype(np.float32), None
    references = references.persist()
    try:
        for _ in range(max(1, iterations)):
            rows = references if before is None else before.select("ref_id", F.col("cid").alias("old"), *QUANTS)
            now = assign(rows, centroids).persist()  # the cluster of the round before stays in the row
            moved = n if before is None else now.where("cid <> old").count()
            centroids = centroid_array(update(now, centroid_frame(spark, centroids)))
            if before is not None:
                before.unpersist()
            before = now
            if moved * 1000 < n:
                break
        before.unpersist()
    finally:
        references.unpersist()
    return centroids


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many references have another cluster."""
    both = before.select("ref_id", F.col("cid").alias("old")).join(after.select("ref_id", "cid"), "ref_id")
    return both.agg(F.sum((F.col("cid") != F.col("old")).cast("long")).alias("changed"))


def layout(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cid, n, offset, lo0.., hi0..) of every cluster: members, those before it, and the box
    around its members, zeros if it has none. One row a cluster is left after a partially
    aggregated group; the running sum is over those."""
    per = assigned.groupBy("cid").agg(
        F.count("*").alias("n"), *[F.min(q).alias(lo) for q, lo in zip(QUANTS, LOW)], *[F.max(q).alias(hi) for q, hi in zip(QUANTS, HIGH)]
    )
    rows = centroids.select("cid").join(F.broadcast(per), "cid", "left").na.fill(0)
    before = Window.orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("cid", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), *LOW, *HIGH)


def positions(assigned: DataFrame) -> DataFrame:
    """(ref_id, cid, pos): the place of a reference in its cluster, in the order of ref_id."""
    w = Window.partitionBy("cid").orderBy("ref_id")
    return assigned.select("ref_id", "cid", (F.row_number().over(w) - 1).alias("pos"))


def rank_probes(queries: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """(qid, cid, rank) of the `most` nearest centroids of each query by its unquantised
    features; ranks from 0, ties to the smaller cid. Centroids are broadcast: 4096 at most."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids.astype(np.float32))
    most = max(1, min(most, len(centroids)))

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 2048):
                part = pdf.iloc[i : i + 2048]
                d = sequential_distances(part[FEATURES].to_numpy(np.float32), shared.value)
                cid = np.argsort(d, axis=1, kind="stable")[:, :most]
                yield pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy(np.int64), most), "cid": cid.ravel().astype(np.int32), "rank": np.tile(np.arange(most, dtype=np.int64), len(part))})

    return queries.select("qid", *FEATURES).mapInPandas(run, "qid long, cid int, rank long")
