"""Batch maps over unbounded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from batchloom.operators.batch_frame import BatchFrame


def streamed(frame: BatchFrame, stream: DataFrame) -> DataFrame:
    """The stages of ``frame`` over a streaming DataFrame with the same columns; regions are the same."""
    if not stream.isStreaming:
        raise ValueError("the frame is not a stream")
    if stream.schema.names != frame.base.schema.names:
        raise ValueError(f"the stream has the columns {stream.schema.names}, the stages take {frame.base.schema.names}")
    return BatchFrame(stream, frame.stages, frame.settings).df
