"""Connected components of an edge list, by contraction in a shrinking graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import cut, rounds


def connected_components(edges: DataFrame, max_rounds: int = 200, part_rows: int = 500_000) -> DataFrame:
    """(node, label) for every node of edges(a, b): nodes joined by a path, and only they,
    have equal labels.

    Each round every node moves to its neighbour (or itself) with the smallest hash, where
    the hash changes by round; edges follow and loops fall away. A constant share of the
    nodes goes each round, so rounds are logarithmic, also on chains. The smallest
    neighbour is found by a partially aggregated minimum: the many edges of a hub are
    reduced before the shuffle. What is kept between rounds has a partition for every
    `part_rows` edges at most. Null nodes are ignored; an empty list gives no rows.
    """
    with rounds(edges.sparkSession, "components") as keep:
        return cut(_labels(edges, keep, max_rounds, part_rows))


def _labels(edges: DataFrame, keep, max_rounds: int, part_rows: int) -> DataFrame:
    edges = keep(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    parts = max(1, -(-edges.count() // part_rows))
    moves: list[DataFrame] = []
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("n"))  # noqa: E731, B023
        both = edges.select(F.col("a").alias("node"), rank(F.col("b")).alias("to")).unionByName(edges.select(F.col("b").alias("node"), rank(F.col("a")).alias("to")))
        move = both.groupBy("node").agg(F.min("to").alias("to"))
        move = keep(move.select("node", F.least("to", rank(F.col("node")))["n"].alias("to")).coalesce(parts))
        moves.append(move)
        step = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
        step = step.join(move.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        edges = keep(step.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct().coalesce(parts))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    final = moves[-1].select("node", F.col("to").alias("label"))
    for move in reversed(moves[:-1]):
        # a node that no later round moves is its own label
        later = final.select(F.col("node").alias("to"), "label")
        final = keep(move.join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label")).coalesce(parts))
    return final
