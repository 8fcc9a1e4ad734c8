"""Audit events of a stream, each written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from riskweave.sources.datasets import append_audit_once


def audit_writer(events: DataFrame, path: str, checkpoint: str, name: str = "stream") -> DataStreamWriter:
    """A writer of streamed events into the audit table at ``path``; the caller sets a trigger and starts it.

    Spark repeats a micro-batch whose end it has not recorded in ``checkpoint``.  The batch is committed in the
    table under ``name`` and its number, so its repetition adds nothing.  Streams into one table need names of their own.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_audit_once(batch, path, f"{name}-{number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
