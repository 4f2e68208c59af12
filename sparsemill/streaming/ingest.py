"""Streaming ingestion: each micro-batch is one commit, repeated batches are recognised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from sparsemill.sources.index import SparseIndex


def commit_batch(index: SparseIndex, batch: DataFrame, batch_id: int) -> bool:
    """Append and commit one batch; False when the manifest shows that this batch is in already (a restart repeats the last one).

    The writer's lock has the stream's name, so a stream that is restarted after a crash takes over its own lock.
    """
    if index.snapshot().stream_batch >= batch_id:
        return False
    with index.writer(owner="stream") as writer:
        writer.append(batch)
        writer._batch = batch_id
        writer.commit()
    return True


def ingest_stream(stream: DataFrame, index_path: str, checkpoint: str) -> DataStreamWriter:
    """``stream(row_id, indices, vals[, opstamp])`` into the index. The caller sets the trigger and starts it."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        commit_batch(SparseIndex.open(batch.sparkSession, index_path), batch, batch_id)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
