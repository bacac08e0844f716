"""Snapshots as a stream: each micro-batch's update texts become operations, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.updates import to_ops


def ingest(snapshots: DataFrame, ops_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that appends the operations of new snapshots under ops_path. A batch that is run again replaces its own folder, so no operation comes twice."""

    def batch(df: DataFrame, number: int) -> None:
        to_ops(df).write.mode("overwrite").parquet(f"{ops_path}/batch={number}")

    writer = snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
