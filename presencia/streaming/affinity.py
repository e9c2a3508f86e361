"""Scoring of new genomes as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from presencia.operators.factor import affinities


def score_arrivals(stream: DataFrame, l_norm: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Affinities of each micro-batch of (gene, genome) rows, written to ``path`` in a folder per batch.

    Genomes must arrive whole within a batch, as a file each does.  A batch that runs again overwrites its own folder, so
    the result holds each batch once.
    """

    def write(batch: DataFrame, number: int) -> None:
        affinities(l_norm, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
