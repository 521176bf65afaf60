"""Streams into tiered tables.

Late rows are never dropped, so no watermark is used: rows land in the hot tier,
a late bucket gets a follow-up file and an additive rollup delta.  A micro-batch is one
publish under its batch id, so a batch that is tried again is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strata.operators.table import TieredTable


def ingest(stream: DataFrame, table: TieredTable, checkpoint: str, maintain: bool = False, name: str = "ingest", available_now: bool = True) -> StreamingQuery:
    """Start appending a stream's rows; ``maintain`` runs after each batch if asked."""

    def write(rows: DataFrame, batch: int) -> None:
        table.refresh()
        table.insert(rows, batch=f"{name}:{batch}")
        if maintain:
            table.maintain()

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (out.trigger(availableNow=True) if available_now else out).start()
