"""Scoring of a stream of request bodies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vireo.plans.engine import Engine


def score_stream(engine: Engine, bodies: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, id_col: str = "qid", body_col: str = "body", available_now: bool = True) -> StreamingQuery:
    """Starts scoring: each micro-batch of bodies is scored like a batch and given to sink with
    its number. Requests are independent, so there is no state; the checkpoint makes each be
    scored once, and a sink that writes by batch number makes the whole exactly once."""
    writer = bodies.writeStream.foreachBatch(lambda df, n: sink(engine.score_bodies(df, id_col, body_col), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
