"""Upkeep on a clock, as a stream without data: its trigger is the schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strata.engine import Engine
from strata.errors import StrataError


def keep_up(engine: Engine, checkpoint: str, every: str = "10 minutes", now=None) -> StreamingQuery:
    """Maintain every table of ``engine`` at each tick, until the query is stopped.

    A table that another writer changed in the meantime is taken up anew at the next
    tick; other errors end the query, which shows them.  ``now`` is a function that gives
    the time, in place of the clock.
    """

    def tick(rows: DataFrame, batch: int) -> None:
        for name, table in list(engine.tables.items()):
            table.refresh()
            try:
                engine.maintain(name, now() if now else None)
            except StrataError as e:
                if "another writer" not in str(e):
                    raise
                table.refresh()

    beat = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return beat.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
