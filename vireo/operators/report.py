"""Reports: two indexes compared, and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.functions.features import approved, score


def compare_scores(a: DataFrame, b: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """One row for the scores (qid, votes) of the same requests by two indexes: requests, those
    with another score, those with another decision, fraud scores of each, greatest difference.
    With `copies` (qid, copies) a request counts as often as that says."""
    both = a.select("qid", F.col("votes").alias("a")).join(b.select("qid", F.col("votes").alias("b")), "qid")
    both = both.withColumn("copies", F.lit(1)) if copies is None else both.join(copies.select("qid", "copies"), "qid")
    gap = F.abs(score(F.col("a")) - score(F.col("b")))
    total = lambda x: F.coalesce(F.sum(x * F.col("copies")), F.lit(0)).cast("long")
    return both.agg(
        total(F.lit(1)).alias("payloads"),
        total((gap > F.lit(1.1920929e-07).cast("float")).cast("int")).alias("score_mismatches"),
        total((approved(F.col("a")) != approved(F.col("b"))).cast("int")).alias("decision_mismatches"),
        F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0)).cast("int").alias("max_vote_delta"),
        total(F.col("a")).alias("votes_a"),
        total(F.col("b")).alias("votes_b"),
    )


def bench_summary(scored: DataFrame, iterations: int = 1000) -> DataFrame:
    """One row for a bench that asks requests (position dense from 0, votes) in turn, over and
    over, `iterations` times: iterations, payloads, and the sum of the scores given. Each request
    counts as often as its turn comes; none is scored twice. No requests give a sum of 0."""
    n = scored.agg(F.count("*").alias("payloads"))
    turn = scored.select(F.col("position").cast("long"), F.col("votes").cast("long")).crossJoin(F.broadcast(n))  # one row
    times = F.expr(f"{int(iterations)}L div payloads") + (F.col("position") < F.expr(f"{int(iterations)}L % payloads")).cast("long")
    out = turn.agg(F.count("*").alias("payloads"), F.coalesce(F.sum(times * F.col("votes")), F.lit(0)).alias("given"))
    return out.select(F.lit(int(iterations)).cast("long").alias("iterations"), "payloads", (F.col("given") / 5).alias("checksum"))


def latency_report(latencies: DataFrame, nanos: str = "ns", bins: int = 4096) -> DataFrame:
    """One row: count, average in whole microseconds, and percentiles p50, p95, p99 and the
    greatest, where percentile p of n is the element at place (n - 1) * p div 100 from 0.

    Latencies are counted by value first, so equal ones are one row, and only the running
    count is over all; no list of all latencies is made."""
    counted = latencies.where(F.col(nanos).isNotNull()).groupBy(F.col(nanos).cast("long").alias("v")).agg(F.count("*").alias("k"))
    total = counted.agg(F.sum("k").alias("n"), F.sum(F.col("v") * F.col("k")).alias("sum"), F.max("v").alias("top"), F.min("v").alias("low"))
    width = F.greatest(F.expr(f"(top - low) div {bins} + 1"), F.lit(1))
    ranged = counted.crossJoin(F.broadcast(total)).withColumn("bin", F.expr("v - low") / width)  # one row
    ranged = ranged.withColumn("bin", F.floor("bin"))
    from pyspark.sql import Window

    by_bin = ranged.groupBy("bin").agg(F.sum("k").alias("k"))  # bins rows at most
    before = by_bin.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    placed = ranged.join(F.broadcast(before), "bin")
    upto = F.col("before") + F.sum("k").over(Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("upto", upto)
    at = lambda p: F.min(F.when(F.col("upto") > F.expr(f"(n - 1) * {p} div 100"), F.col("v")))
    micros = lambda c: F.expr(f"{c} div 1000")
    out = placed.agg(F.first("n").alias("n"), F.first("sum").alias("sum"), at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"), F.first("top").alias("top"))
    return out.where("n is not null").select("n", F.expr("sum div n div 1000").alias("avg_us"), micros("p50").alias("p50_us"), micros("p95").alias("p95_us"), micros("p99").alias("p99_us"), micros("top").alias("max_us"))
